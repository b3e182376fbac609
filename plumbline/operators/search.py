"""Full-text search over symbols: postings with positions, phrases, and BM25 with column weights."""

from __future__ import annotations

import functools
import math
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.session import stage

#: Searched columns and their weights.
WEIGHTS = {"name": 8.0, "qualname": 4.0, "signature": 2.0, "docstring": 1.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1.0e-6
RANK_WEIGHT = 3.0


def fold(text: str) -> str:
    """Without diacritics, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else (x.lower() if x.isascii() else fold(x)))


def postings(symbols: DataFrame) -> DataFrame:
    """(id, col, pos, term): every word of the searched columns; words are runs of letters and digits."""
    words = lambda c: F.regexp_extract_all(_fold(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    cells = symbols.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("col"), words(c).alias("w")) for k, c in enumerate(WEIGHTS)])).alias("x"))
    return cells.select("id", "x.col", F.posexplode("x.w").alias("pos", "term"))


def lengths(posts: DataFrame) -> DataFrame:
    """(id, len): words of each symbol over all columns."""
    return posts.groupBy("id").agg(F.count("*").alias("len"))


def phrases(query: str) -> list[tuple[list[str], bool]]:
    """(words, last word is a prefix) of each blank-separated part of a query; colons separate too."""
    out = []
    for part in query.replace(":", " ").split():
        words = ["".join(w) for w in _runs(fold(part))]
        if words:
            out.append((words, part.isidentifier()))
    return out


def _runs(text: str) -> list[list[str]]:
    runs: list[list[str]] = [[]]
    for c in text:
        if unicodedata.category(c)[0] in "LN":
            runs[-1].append(c)
        elif runs[-1]:
            runs.append([])
    return [r for r in runs if r]


def _idf(n_docs: int, n: int) -> float:
    idf = math.log((n_docs - n + 0.5) / (n + 0.5)) if n_docs - n + 0.5 > 0 else 0.0
    return idf if idf > 0 else LEAST_IDF


def _ranked(view: DataFrame, hits: DataFrame, found: list[int], n_docs: int, average: float, limit: int) -> DataFrame:
    """Symbols by score; ``hits`` has id, len and the weighted frequency of each part of the query (0 without a hit)."""
    score = F.lit(0.0)
    for k, n in enumerate(found):
        tf = F.col(f"tf{k}")
        score = score + F.lit(-_idf(n_docs, n) * (K1 + 1)) * tf / (tf + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
    best = hits.select("id", score.alias("bm25"))
    return view.join(best, "id").withColumn("score", F.round(F.col("bm25") - RANK_WEIGHT * F.col("rank"), 9)).drop("bm25").orderBy("score", "id").limit(limit)


def search(view: DataFrame, posts: DataFrame, n_docs: int, average: float, query: str, limit: int = 20) -> DataFrame:
    """Symbols by BM25 less three times their rank; ``score`` is lower for better hits.  Ties by id.

    ``posts`` from :func:`postings` (stage or store them: they are the index), ``n_docs`` all symbols and ``average``
    their mean length.  A query without words has no hits.  All parts of the query are looked up in one plan.
    """
    parts = phrases(query)
    if not parts:
        return view.withColumn("score", F.lit(0.0)).where(F.lit(False))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS.values()]), F.col("col") + 1)
    rows = None
    for q, (words, prefix) in enumerate(parts):
        hits = None
        for k, w in enumerate(words):
            match = F.startswith(F.col("term"), F.lit(w)) if prefix and k == len(words) - 1 else F.col("term") == w
            one = posts.where(match).select("id", "col", (F.col("pos") - k).alias("pos"))
            hits = one if hits is None else hits.join(one, ["id", "col", "pos"], "left_semi")
        hits = hits.select("id", F.lit(q).alias("q"), weight.alias("w"))
        rows = hits if rows is None else rows.unionByName(hits)
    tf = [F.coalesce(F.sum(F.when(F.col("q") == q, F.col("w"))), F.lit(0.0)).alias(f"tf{q}") for q in range(len(parts))]
    hits = rows.groupBy("id").agg(*tf).join(lengths(posts), "id")
    seen = Observation()
    hits = stage(hits.observe(seen, *[F.count_if(F.col(f"tf{q}") > 0).alias(f"n{q}") for q in range(len(parts))]), "hits")
    return _ranked(view, hits, [seen.get[f"n{q}"] for q in range(len(parts))], n_docs, average, limit)


def search_symbols(view: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """:func:`search` over a view without an index: one pass over the symbols counts the hits in each, and the corpus' figures with them."""
    parts = phrases(query)
    if not parts:
        return view.withColumn("score", F.lit(0.0)).where(F.lit(False))
    words = view.select("id", *[F.regexp_extract_all(_fold(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias(f"w{k}") for k, c in enumerate(WEIGHTS)])

    def count(k: int, terms: list[str], prefix: bool):
        w, m = F.col(f"w{k}"), len(terms)
        fits = lambda x, j: F.startswith(x, F.lit(terms[j])) if prefix and j == m - 1 else x == terms[j]
        if m == 1:
            return F.size(F.filter(w, lambda x: fits(x, 0)))
        whole = lambda x, i: functools.reduce(lambda a, b: a & b, [F.coalesce(fits(F.get(w, i + j), j), F.lit(False)) for j in range(m)])
        return F.size(F.filter(w, whole))

    tf = [sum((F.lit(x) * count(k, terms, prefix) for k, x in enumerate(WEIGHTS.values())), F.lit(0.0)).alias(f"tf{q}") for q, (terms, prefix) in enumerate(parts)]
    size = sum((F.size(f"w{k}") for k in range(len(WEIGHTS))), F.lit(0))
    seen = Observation()
    every = words.select("id", size.alias("len"), *tf).observe(
        seen, F.count("*").alias("n"), F.sum("len").alias("words"), *[F.count_if(F.col(f"tf{q}") > 0).alias(f"n{q}") for q in range(len(parts))]
    )
    hits = stage(every.where(" OR ".join(f"tf{q} > 0" for q in range(len(parts)))), "hits")
    n = seen.get["n"]
    return _ranked(view, hits, [seen.get[f"n{q}"] for q in range(len(parts))], n, (seen.get["words"] or 0) / n if n else 0.0, limit)


__all__ = ["fold", "lengths", "phrases", "postings", "search", "search_symbols"]
