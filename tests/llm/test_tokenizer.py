import pytest

from plumbline.llm.tokenizer import MergeReplay, default_vocabulary, encode_corpus, token_sizes

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [None, "", " ", "\n\n \t\r\n", "Hello world", "def f(x):\n    return x+1  # ok", "naïve café 😀😀 日本語 e\u0301", "aaaaaaaaaaaaaaaaaaa", "x" * 5000, "a b\u3000c\u2028d", "don't WE'LL 'S", "<|endoftext|>", "½ ² Ⅷ ७ 12345"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_same_ids(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(4, TEXTS[4])], "doc_id long, text string").repartition(2)
    got = encode_corpus(df, ["doc_id"]).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(list(r["ids"]) == reference(TEXTS[r["doc_id"]]) for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in token_sizes(df, ["doc_id"]).collect()} == {i: len(reference(t)) for i, t in enumerate(TEXTS)}


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", "ab")], "_words long, ids string, text string")
    assert [r["n_tokens"] for r in token_sizes(df.withColumnRenamed("_words", "doc_id"), ["doc_id"]).collect()] == [1]
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_the_store_is_bounded(monkeypatch, reference):
    import plumbline.llm.tokenizer as m

    monkeypatch.setattr(m, "CACHED_WORDS", 3)
    bpe = MergeReplay(default_vocabulary())
    for words in (["hello", " world"], ["abc", "def", "ghi"], ["hello", "xyz"]):
        at = bpe.locate(words)
        assert [list(bpe.pool[bpe.starts[i] : bpe.starts[i] + bpe.sizes[i]]) for i in at] == [reference(w) for w in words]
