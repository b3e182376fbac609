import pytest

from plumbline.llm.mixing import mix_sources, pfair, plan_quotas

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 3)]


def test_pfair_deviates_by_less_than_a_block():
    blocks = {"a": 50, "b": 31, "c": 3, "d": 1, "e": 0}
    order = pfair(blocks)
    total = sum(blocks.values())
    done = dict.fromkeys(blocks, 0)
    for t, (s, i) in enumerate(order, 1):
        assert i == done[s]
        done[s] += 1
        assert all(abs(done[x] - t * blocks[x] / total) < 1 for x in blocks)
    assert done == blocks and pfair({}) == []


def test_quotas():
    plan = {p[0]: p[5] for p in plan_quotas({"a": (9, 1000), "b": (2, 100), "x": (1, 5)}, {"a": (0.5, 1), "b": (0.25, 2), "n": (0.25, 9)})}
    assert plan == {"a": 400, "b": 200, "n": 0}
    assert plan_quotas({}, {}) == []


def test_mix(spark):
    rows = [(k, "a", 10 + k % 7) for k in range(600)] + [(1000 + k, "b", 20) for k in range(50)] + [(2000 + k, "c", 5) for k in range(60)]
    rows += [(5000, None, 9), (5001, "unlisted", 9), (5002, "a", 0), (5003, "a", None), (5004, "zero", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    mix, report = mix_sources(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"), buckets=8, max_slots=60)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"a", "b", "c", "none", "zero"} and r["none"]["mixed_tokens"] == 0
    assert abs(r["a"]["actual_share"] - 0.5) < 0.01 and abs(r["b"]["actual_share"] - 0.3) < 0.01 and abs(r["c"]["actual_share"] - 0.2) < 0.01
    got = mix.collect()
    assert all(x["repetition"] < {"a": 1, "b": 3, "c": 4}[x["source"]] for x in got)
    assert len({(x["doc_id"], x["repetition"]) for x in got}) == len(got) and sum(x["n_tokens"] for x in got) == sum(x["mixed_tokens"] for x in r.values())
    by_slot = {}
    for x in got:
        by_slot.setdefault(x["slot"], set()).add(x["source"])
    assert all(len(v) == 1 for v in by_slot.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    mix, report = mix_sources(df, spark.createDataFrame(TARGETS[:2], "source string, target_share double, max_repeats int"))
    assert mix.count() == 0 and [x["actual_share"] for x in report.collect()] == [0.0, 0.0]


def test_a_small_source_falls_short_of_a_given_total(spark):
    sized = spark.createDataFrame([(k, "a", 10) for k in range(100)] + [(1000 + k, "b", 10) for k in range(5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(sized, targets, total_tokens=1000)
    rows = {r["source"]: r for r in report.collect()}
    assert (rows["a"]["mixed_tokens"], rows["b"]["mixed_tokens"]) == (500, 100) and rows["b"]["actual_share"] == pytest.approx(1 / 6)
    assert mix.where("source = 'b'").groupBy("doc_id").count().selectExpr("max(count)").first()[0] == 2
    assert {r["mixed_tokens"] for r in mix_sources(sized, targets)[1].collect()} == {100}
