import pytest

from plumbline.operators.rank import pagerank, personalized_pagerank


def slow_pagerank(edges, nodes, d=0.85, rounds=30):
    w = {}
    for a, b, x in edges:
        if a != b and a in nodes and b in nodes:
            w[a, b] = w.get((a, b), 0) + max(x, 1e-6)
    out = {a: sum(x for (s, _), x in w.items() if s == a) for a in nodes}
    n = len(nodes)
    r = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        lost = sum(r[a] for a in nodes if not out[a])
        r = {a: (1 - d) / n + d * (sum(r[s] * x / out[s] for (s, t), x in w.items() if t == a) + lost / n) for a in nodes}
    return r


EDGES = [(1, 2, 0.9), (1, 2, 0.5), (2, 3, 0.4), (3, 1, 1.0), (3, 3, 9.0), (4, 3, 0.0), (3, 5, 0.7), (9, 1, 1.0)]


@pytest.mark.parametrize("one_task", [0, 100])
def test_pagerank(spark, one_task):
    nodes = [1, 2, 3, 4, 5, 6]
    got = pagerank(spark.createDataFrame(EDGES, "src long, dst long, weight double"), spark.createDataFrame([(x,) for x in nodes], "id long"), tolerance=0.0, iterations=12, one_task=one_task)
    want = slow_pagerank(EDGES, nodes, rounds=12)
    scores = {r["id"]: r["score"] for r in got.collect()}
    assert scores == pytest.approx(want) and sum(scores.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("one_task", [0, 100])
def test_tolerance_stops_near_the_limit(spark, one_task):
    nodes = [1, 2, 3]
    got = pagerank(spark.createDataFrame(EDGES[:4], "src long, dst long, weight double"), spark.createDataFrame([(x,) for x in nodes], "id long"), tolerance=1e-2, iterations=30, one_task=one_task)
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(slow_pagerank(EDGES[:4], nodes, rounds=60), abs=2e-2)


def test_no_nodes(spark):
    assert pagerank(spark.createDataFrame([], "src long, dst long, weight double"), spark.createDataFrame([], "id long")).count() == 0


def test_personalized(spark):
    got = personalized_pagerank(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double"), spark.createDataFrame([(1,)], "id long"))
    scores = {r["id"]: r["score"] for r in got.collect()}
    assert set(scores) == {2, 3} and scores[2] > scores[3] > 0


def test_personalized_without_seeds(spark):
    assert personalized_pagerank(spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double"), spark.createDataFrame([], "id long")).count() == 0
