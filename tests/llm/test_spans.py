import random

import pytest

from plumbline.llm.spans import shared_portion, shared_spans


def slow(texts, length):
    seen = {}
    for d, t in texts:
        for i in range(len(t or "") - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d in {d for d, _ in texts}:
        marks = set()
        for e, t in texts:
            if e == d and t:
                for i in range(len(t) - length + 1):
                    if len(seen[t[i : i + length]]) > 1:
                        marks.update(range(i, i + length))
        for p in sorted(marks):
            if p - 1 not in marks:
                q = p
                while q in marks:
                    q += 1
                out.add((d, p, q))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab 😀é\n") for _ in range(rng.randint(5, 60))) for _ in range(8)] + ["a" * 70, "ab" * 30]
    texts = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for k in range(25)] + [(100, None), (101, ""), (None, "a" * 99)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in shared_spans(df, length=20, gram=7).collect()]
    assert len(got) == len(set(got)) and set(got) == slow([t for t in texts if t[0] is not None], 20)


def test_repeats_inside_one_text_and_equal_rows(spark):
    t = "the same words again and again. "
    df = spark.createDataFrame([(1, t * 3), (1, t * 3), (2, "other"), (3, "x" * 40)], "doc_id long, text string")
    assert shared_spans(df, length=20, gram=8).count() == 0


def test_empty_and_portion(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(df).count() == 0
    df = spark.createDataFrame([(1, "q" * 10 + "w" * 30, 5), (2, "w" * 30, 6), (3, None, 7)], "doc_id long, text string, lo long")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shared_portion(df, shared_spans(df, length=20, gram=5)).collect()}
    assert got == {1: (40, 30), 2: (30, 30), 3: (0, 0)}
    with pytest.raises(ValueError):
        shared_spans(df, length=5, gram=6)
