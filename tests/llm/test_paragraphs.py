import random

import numpy as np
import pytest

from plumbline.llm import paragraphs
from plumbline.llm.paragraphs import band_keys, least_overlap, near_paragraphs, paragraphs_of, shingles_of

WORDS = [f"w{k}" for k in range(400)]


def jaccard(a, b, size=5):
    x, y = ({tuple(t.split()[k : k + size]) for k in range(max(1, len(t.split()) - size + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_paragraphs():
    text = "a b\nc\n\n  \n  d\r\n\r\n\n\ne  "
    assert [text[a:b] for a, b in paragraphs_of(text)] == ["a b\nc", "d", "e"]
    assert paragraphs_of("") == paragraphs_of(" \n\n ") == []


def test_shingles():
    a, b, c = shingles_of("a b c d e f", 5), shingles_of("x a b c d e", 5), shingles_of("a b", 5)
    assert len(a) == len(b) == 2 and a[0] == b[1] and len(c) == 1 and c[0] != a[0] and shingles_of("a b", 5)[0] == c[0]
    assert (band_keys(["a b c d e f", "x", "a b"], 5, 3, 2)[0] == band_keys(["a b c d e f"], 5, 3, 2)[0]).all()


def test_collisions_follow_the_similarity():
    dice = random.Random(1)
    hits = {0.8: 0, 0.2: 0}
    for _ in range(60):
        base = [dice.choice(WORDS) for _ in range(120)]
        for level, changes in ((0.8, 2), (0.2, 22)):
            other = list(base)
            for k in dice.sample(range(len(other)), changes):
                other[k] = dice.choice(WORDS)
            a, b = band_keys([" ".join(base), " ".join(other)], 5, 16, 4)
            hits[level] += bool(np.intersect1d(a, b).size)
    assert hits[0.8] >= 59 and hits[0.2] <= 20


def corpus(seed=3):
    dice = random.Random(seed)
    docs = []
    bases = [" ".join(dice.choice(WORDS) for _ in range(60)) for _ in range(12)]
    for d in range(60):
        parts = []
        for _ in range(dice.randint(1, 4)):
            words = dice.choice(bases).split()
            for k in dice.sample(range(len(words)), dice.choice([0, 0, 1, 2, 8])):
                words[k] = dice.choice(WORDS)
            parts.append(" ".join(words))
        docs.append((d, "\n\n".join(parts)))
    return docs


def test_components_against_all_pairs(spark):
    docs = corpus() + [(None, "x y z"), (100, None), (101, ""), (102, "one two"), (103, "one two"), (7, dict(corpus())[7])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS c", "1 AS keys")
    got = {(r["doc_id"], r["span_start"]): r for r in near_paragraphs(d).collect()}
    parts = {(i, a): t[a:b] for i, t in docs if i is not None and t for a, b in paragraphs_of(t)}
    assert set(got) == set(parts)
    parent = {p: p for p in parts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parts)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if parts[a] == parts[b] or jaccard(parts[a], parts[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {p: root(p) for p in parts}
    assert {p: (r["class_id"], r["class_start"]) for p, r in got.items()} == want
    assert all(r["copies"] == sum(want[q] == want[p] for q in want) for p, r in got.items())


@pytest.mark.parametrize("texts", [[], ["a b c d e f g"]])
def test_few_texts(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r) for r in near_paragraphs(d).collect()] == [(k, 0, len(t), k, 0, 1) for k, t in enumerate(texts)]


def components_of(texts, similarity=0.8):
    """The least text of each one's component, by all pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= similarity and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def classes_of(spark, texts, **settings):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["class_id"] for r in near_paragraphs(d, **settings).orderBy("doc_id").collect()]


def test_pairs_that_no_band_finds(spark):
    dice = random.Random(5)
    texts = []
    while len(texts) < 6:
        words = [str(dice.random()) for _ in range(54)]
        two = [" ".join(words[:44] + words[44:49]), " ".join(words[:44] + words[49:])]
        if not np.intersect1d(*band_keys(two, 5, 10, 4)).size:
            texts += two
    assert [jaccard(*texts[k : k + 2]) for k in (0, 2, 4)] == [0.8] * 3
    assert classes_of(spark, texts) == [0, 0, 2, 2, 4, 4]


@pytest.mark.parametrize("similarity", [0.55, 0.7, 0.8, 0.9, 1.0])
def test_least_overlap(similarity):
    n = np.arange(1, 400)
    assert least_overlap(n, similarity).tolist() == [next(o for o in range(1, k + 1) if o / k >= similarity) for k in n.tolist()]


def test_similarity_equal_to_the_threshold(spark):
    words = [str(k) for k in range(200)]
    texts = [" ".join(words[:81]), " ".join(words[:59] + words[100:123])]
    assert jaccard(*texts) == 55 / 100
    assert classes_of(spark, texts, similarity=0.55) == [0, 0] and classes_of(spark, texts, similarity=0.56) == [0, 1]


def chains(seed, links):
    """Windows over a few long texts that begin alike, so many classes have keys in common and few of their pairs are near."""
    dice = random.Random(seed)
    same = [f"s{k}" for k in range(60)]
    texts = []
    for _ in range(4):
        words = same + [dice.choice(WORDS) for _ in range(20)] + same
        at = 0
        for _ in range(links):
            texts.append(" ".join(words[at : at + dice.choice([48, 50, 52])]))
            at += dice.choice([1, 2, 6, 7])
            if at > len(words) - 48:
                break
    dice.shuffle(texts)
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_of_many_classes(spark, monkeypatch, seed):
    monkeypatch.setattr(paragraphs, "PIVOTS", 1)
    monkeypatch.setattr(paragraphs, "GROWTH", 2)
    texts = chains(seed, 30)
    want = components_of(texts)
    assert 3 < len(set(want)) < len(texts) - 10
    assert classes_of(spark, texts) == want


def test_one_id_with_two_texts(spark):
    dice = random.Random(9)
    a, b = (" ".join(dice.choice(WORDS) for _ in range(60)) for _ in range(2))
    d = spark.createDataFrame([(1, a), (1, "first\n\n" + b), (2, a + " x"), (3, b + " x")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_paragraphs(d).where("doc_id > 1").collect()} == {2: 1, 3: 1}
