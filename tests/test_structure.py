import random

import pytest

from plumbline.operators.structure import cycles, layers, strongly_connected


def reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    full = {}
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        full[a] = seen
    return full


def components(pairs):
    r = reach([(a, b) for a, b in pairs if a != b])
    out = {}
    for a in r:
        same = {b for b in r[a] if b != a and a in r.get(b, ())}
        if same:
            out[a] = (min(same | {a}), len(same | {a}))
    return out


def kahn(pairs):
    pairs = set(pairs)
    nodes = {x for p in pairs for x in p}
    degree = {n: sum(b == n for _, b in pairs) for n in nodes}
    layer = dict.fromkeys(nodes, 0)
    todo = [n for n in nodes if not degree[n]]
    while todo:
        n = todo.pop()
        for a, b in pairs:
            if a == n:
                layer[b] = max(layer[b], layer[a] + 1)
                degree[b] -= 1
                if not degree[b]:
                    todo.append(b)
    return layer


@pytest.mark.parametrize("seed,one_task", [(0, 0), (1, 0), *[(k, 1000) for k in range(6)]])
def test_random_graphs(spark, seed, one_task):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(rng.randint(3, 12))]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(2, 22))]
    df = spark.createDataFrame(pairs, "src string, dst string")
    assert {r["node"]: (r["component"], r["size"]) for r in strongly_connected(df, one_task).collect()} == components(pairs)
    assert {r["node"]: r["layer"] for r in layers(df, one_task).collect()} == kahn(pairs)


@pytest.mark.parametrize("one_task", [0, 100])
def test_cycles_are_sorted_and_loops_ignored(spark, one_task):
    pairs = [("b", "a"), ("a", "b"), ("x", "x"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "a"), (None, "a"), ("a", None)]
    found = cycles(spark.createDataFrame(pairs, "src string, dst string"), one_task).collect()
    assert [r["members"] for r in found] == [["c", "d", "e"], ["a", "b"]]


def test_empty_graph(spark):
    df = spark.createDataFrame([], "src string, dst string")
    assert strongly_connected(df).count() == 0 and layers(df).count() == 0
