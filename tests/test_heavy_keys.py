import math
import random

import pytest

from plumbline.operators.heavy_keys import compress, heavy_keys, key_profile, percentiles

ROWS = [(1, "a", "x", 5), (1, "a", "x", 5), (2, "a", "y", 7), (3, "a", "y", 1), (4, None, None, None), (5, "b", None, 3), (None, "a", "x", 9), (6, "b", "z", -2), (7, "", "z", 10**12)]
SCHEMA = "id long, k string, c string, v long"


def test_heavy(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r[:2] for r in rows(heavy_keys(df, "k", "id", "c", 0.4))] == [("a", 3)]
    assert {r[0] for r in rows(heavy_keys(df, "k", "id", "c", 0.01))} == {"a", "b", None, ""}


def test_profile(spark, rows):
    got = {r[0]: r[1:] for r in rows(key_profile(spark.createDataFrame(ROWS, SCHEMA), "k", "c", "v", "id", blocks=4))}
    assert got == {"a": (3, 2, "y", 5), None: (1, 0, None, None), "b": (2, 1, "z", -2), "": (1, 1, "z", 10**12)}


def test_compress(spark, rows):
    assert ("a", "x", 1) in rows(compress(spark.createDataFrame(ROWS, SCHEMA), "k", "c", "id")) and ("a", "x", 3) in rows(compress(spark.createDataFrame(ROWS, SCHEMA), "k", "c"))


def test_clashing_names_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "a", "q", 3, "no")], "_id long, key string, value string, n long, weight string")
    assert rows(heavy_keys(df, "key", "_id", "value")) == [("a", 1, 1.0)]
    assert rows(key_profile(df, "key", "value", "n", "_id")) == [("a", 1, 1, "q", 3)]
    empty = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(empty, "k", "id", "c").count() == 0 and key_profile(empty, "k", "c", "v", "id").count() == 0


def test_an_id_with_several_keys_counts_once_in_the_total(spark, rows):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "a", "y"), (2, "a", None)], "id long, k string, c string")
    assert rows(heavy_keys(df, "k", "id", "c")) == [("a", 2, 1.0), ("b", 1, 0.5)]
    assert rows(compress(df, "k", "c", "id")) == [("a", "x", 1), ("a", None, 1), ("b", "x", 1)]


@pytest.mark.parametrize("spread", [3, 5_000, (1 << 63) - 1])
def test_percentiles_of_a_hot_key_with_sparse_numbers(spark, spread):
    dice = random.Random(spread)
    data = [("hot", dice.randint(-spread, spread), dice.randint(1, 5)) for _ in range(3000)] + [(f"k{k % 40}", dice.randint(-spread, spread), 1) for k in range(400)] + [(None, 7, 2), ("none", None, 3)]
    data = [(k, v, w) for (k, v), w in {(k, v): w for k, v, w in data}.items()]
    df = spark.createDataFrame(data, "key string, v long, weight long")
    for percent in (0.5, 1.0):
        want = {}
        for key in {k for k, v, _ in data if v is not None}:
            values = sorted((v, w) for k, v, w in data if k == key and v is not None)
            rank, seen = max(1, math.ceil(sum(w for _, w in values) * percent)), 0
            for v, w in values:
                seen += w
                if seen >= rank:
                    want[key] = v
                    break
        assert {r["key"]: r["p"] for r in percentiles(df, percent, blocks=64).collect()} == want
