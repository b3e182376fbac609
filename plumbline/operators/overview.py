"""Counts, module graph, hotspots, entry points and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(files: DataFrame, symbols: DataFrame, edges: DataFrame, imports: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: rows of each table, resolved and external edges, lines."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_k", F.lit(1))
    parts = [
        one(files, F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")),
        one(symbols, F.count("*").alias("symbols")),
        one(edges, F.count("*").alias("edges"), F.count("dst_id").alias("resolved_edges"), F.count_if(F.col("reason") == "external").alias("external_edges")),
        one(imports, F.count("*").alias("imports")),
        one(refs, F.count("*").alias("refs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "_k")  # one row each
    return out.drop("_k").select("files", "symbols", "edges", "imports", "refs", "resolved_edges", "external_edges", "lines")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """(key, n), the most frequent first; null is printed as None."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def resolution(edges: DataFrame) -> DataFrame:
    """One row: edges, resolved, external, and the rates of resolution over all and over internal edges (0 if none)."""
    row = edges.agg(F.count("*").alias("edges"), F.count("dst_id").alias("resolved"), F.count_if(F.col("reason") == "external").alias("external"))
    rate = lambda d: F.coalesce(F.try_divide(F.col("resolved").cast("double"), d), F.lit(0.0))
    return row.select("*", rate(F.col("edges")).alias("resolution_rate"), rate(F.col("edges") - F.col("external")).alias("internal_resolution_rate"))


def modules(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, files, symbols), modules with many symbols first.  Symbols are counted per file before they meet the files."""
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    return (
        files.select(F.col("id").alias("file_id"), "module").join(per_file, "file_id", "left")
        .groupBy("module").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))
        .orderBy(F.desc("symbols"), "module")
    )


def module_edges(files: DataFrame, imports: DataFrame, min_weight: int = 1) -> DataFrame:
    """(src_module, dst_module, weight): imports between different modules."""
    # the hot side is counted before the modules' names are joined
    pairs = imports.where("dst_file_id IS NOT NULL").groupBy("file_id", "dst_file_id").agg(F.count("*").alias("n"))
    src = files.select(F.col("id").alias("file_id"), F.col("module").alias("src_module"))
    dst = files.select(F.col("id").alias("dst_file_id"), F.col("module").alias("dst_module"))
    return (
        pairs.join(src, "file_id").join(dst, "dst_file_id").where("src_module <> dst_module")
        .groupBy("src_module", "dst_module").agg(F.sum("n").alias("weight"))
        .where(F.col("weight") >= min_weight)
        .orderBy(F.desc("weight"), "src_module", "dst_module")
    )


def hotspots(view: DataFrame, edges: DataFrame, limit: int = 20, kind: str | None = None) -> DataFrame:
    """(id, qualname, kind, path, rank, fan_in): by rank, then by the number of edges of any kind that arrive."""
    rows = view if kind is None else view.where(F.col("kind") == kind)
    fan_in = edges.where("dst_id IS NOT NULL").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("fan_in"))
    return (
        rows.select("id", "qualname", "kind", "path", "rank").join(fan_in, "id", "left").fillna(0, ["fan_in"])
        .orderBy(F.desc("rank"), F.desc("fan_in"), "id").limit(limit)
    )


def entry_points(view: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(id, qualname, kind, path, rank) of exported functions and classes that call something and that nothing calls."""
    exported = symbols.where(F.col("exported") & F.col("kind").isin("function", "class")).select("id")
    starts = exported.join(edges.select(F.col("dst_id").alias("id")), "id", "left_anti").join(edges.select(F.col("src_id").alias("id")), "id", "left_semi")
    return view.join(starts, "id", "left_semi").select("id", "qualname", "kind", "path", "rank").orderBy(F.desc("rank"), "qualname", "id").limit(limit)


def import_list(files: DataFrame, imports: DataFrame, path: str) -> DataFrame:
    """(module, target, external, line) of a file's imports by line; target is the resolved path or null."""
    own = files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    target = files.select(F.col("id").alias("dst_file_id"), F.col("path").alias("target"))
    return imports.join(own, "file_id", "left_semi").join(target, "dst_file_id", "left").select("id", "module", "target", "external", "line").orderBy("line", "id")

