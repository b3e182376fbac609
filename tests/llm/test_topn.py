import math
import random

import pytest

from plumbline.llm.topn import top_n_per_group

SCHEMA = "g long, i long, v double"


def slow(rows, n):
    best = {}
    for g, i, v in rows:
        if i is not None:
            x = -math.inf if v is None or math.isnan(v) else v
            plain = v is not None and not math.isnan(v)
            best[g, i] = max(best.get((g, i), (False, -math.inf)), (plain, x))
    out = set()
    for g in {k[0] for k in best}:
        order = sorted((k[1] for k in best if k[0] == g), key=lambda i: (not best[g, i][0], -best[g, i][1], i))
        out |= {(g, i) for i in order[:n]}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-300, 5e-324, 1e300, -1.5, 2.5, 0.000002]
    rows = [(rng.choice([1, 2, None, 2**40]), rng.choice([None, rng.randint(-50, 50), 2**63 - 1 - rng.randint(0, 3), -(2**63)]), rng.choice([*values, rng.random()])) for _ in range(250)]
    rows += [(7, k, 0.5) for k in range(400)] + rows[:40]
    for n in (1, 3):
        got = [tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "v", n).collect()]
        assert len(got) == len(set(got)) and set(got) == slow(rows, n)


def test_edges(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "g", "i", "v", 3).count() == 0
    df = spark.createDataFrame([(1, 2, 3.0, "x")], "want long, s long, k double, part string")
    assert [tuple(r) for r in top_n_per_group(df, "want", "s", "k", 2).collect()] == [(1, 2)]
    assert top_n_per_group(df, "want", "s", "k", 0).count() == 0
