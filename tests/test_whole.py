"""Queries over all symbols against brute force on a small fixture."""

import pytest

from plumbline.queries import QUERIES

SYMBOLS = "id long, file_id long, parent_id long, name string, qualname string, kind string, lang string, start_line int, end_line int, signature string, docstring string, exported boolean, rank double"
KINDS = ["class", "method", "function", "const", "interface", "struct", "enum", "type"]


@pytest.fixture
def folder(spark, tmp_path):
    """Twenty-four symbols of every kind in three files; the third has no text."""
    rows = [(i, 1 + i % 3, None, f"n{i}", f"m:n{i}", KINDS[i % 8], "go", 1 + i % 5, 1 + i % 5 + i % 4, None, None, i % 2 == 0, None) for i in range(24)]
    spark.createDataFrame([*rows, rows[0]], SYMBOLS).write.parquet(f"{tmp_path}/symbols.parquet")
    texts = [(1, "\n".join(f"a{k}" for k in range(12))), (1, "A"), (2, "b0\r\nb1\nb2"), (3, None), (None, "x")]
    spark.createDataFrame(texts, "file_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows, {1: texts[0][1], 2: texts[2][1]}


def test_source_of_every_symbol(spark, folder):
    path, symbols, texts = folder
    want = {s[0]: "\n".join(texts[s[1]].split("\n")[s[7] - 1 : s[8]]) if s[1] in texts else None for s in symbols}
    got = QUERIES["src11_symbol_source"](spark, path).collect()
    assert {r["id"]: r["source"] for r in got} == want and len(got) == 24


def test_callers_of_every_symbol(spark, folder):
    path, symbols, _ = folder
    edges = [(k, k * 7 % 24, (k * 5 + k // 3) % 26, "n", ["calls", "instantiates", "inherits"][k % 3], k % 9, [0.9, 0.5, 0.2, 0.3][k % 4], f"r{k % 2}") for k in range(60)] + [(60, 1, None, "n", "calls", 1, 0.9, "r")]
    spark.createDataFrame(edges, "id long, src_id long, dst_id long, dst_name string, kind string, line int, confidence double, reason string").write.parquet(f"{path}/edges.parquet")
    calls = [e for e in edges if e[4] != "inherits" and e[6] >= 0.3 and e[2] is not None]
    walks = [(a[2], a[1], 1, a[6], a[5], a[7]) for a in calls] + [(a[2], b[1], 2, min(a[6], b[6]), b[5], b[7]) for a in calls for b in calls if b[2] == a[1]]
    want = {}
    for root, node, depth, sure, line, reason in walks:
        if node != root and root < 24:
            x = want.get((root, node), (depth, sure, line, reason))
            want[root, node] = (min(x[0], depth), max(x[1], sure), min(x[2], line), min(x[3], reason))
    got = QUERIES["q05_all_callers"](spark, path).collect()
    assert {(r["root"], r["id"]): (r["depth"], r["confidence"], r["via_line"], r["reason"]) for r in got} == want
    assert {symbols[r][5] for r, _ in want} == set(KINDS)


def test_pagerank_until_it_converges(spark, folder):
    path, symbols, _ = folder
    links = [(k, (k + 1) % 12) for k in range(12)] + [(0, 5), (3, 14), (14, 15), (15, 14)]
    spark.createDataFrame([(k, a, b, "n", "calls", 1, 1.0, "r") for k, (a, b) in enumerate(links)], "id long, src_id long, dst_id long, dst_name string, kind string, line int, confidence double, reason string").write.parquet(f"{path}/edges.parquet")
    n, rounds = 24, [dict.fromkeys(range(24), 1 / 24)]
    out = {a: sum(s == a for s, _ in links) for a in range(n)}
    while len(rounds) <= 30 and (len(rounds) < 2 or sum(abs(rounds[-1][a] - rounds[-2][a]) for a in range(n)) >= 1e-7):
        r = rounds[-1]
        lost = sum(r[a] for a in r if not out[a])
        rounds.append({a: 0.15 / n + 0.85 * (sum(r[s] / out[s] for s, t in links if t == a) + lost / n) for a in range(n)})
    got = {r["id"]: r["score"] for r in QUERIES["ga1_pagerank"](spark, path).collect()}
    assert got == pytest.approx(rounds[-1], abs=1e-9) and got != pytest.approx(rounds[10], abs=1e-6)
