"""Bounded traversal of the call graph and of the import graph.

A walk is a loop over levels in which each node of a level is one row: the best confidence of the walks that
reach it there, and the least line and reason of their last edges.  Keeping one row loses nothing, as a path's
confidence is the least of its edges' and the roll-up takes maxima and minima; and a level never has more rows than
there are (root, node) pairs, however many walks lead there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import CALL_KINDS
from plumbline.session import counted

MAX_DEPTH = 8


def walk(edges: DataFrame, roots: DataFrame, direction: str = "callers", depth: int = 2, min_confidence: float = 0.5, tiny: bool = False) -> DataFrame:
    """(root, id, depth, confidence, via_line, reason) of the nodes within ``depth`` calls of each root.

    ``edges``: src_id, dst_id, kind, line, confidence, reason; rows that arrive twice change nothing.  ``roots``: a column
    ``root``.  Every edge has to reach ``min_confidence``; unresolved ends and kinds other than calls don't count; the root
    itself is left out.  A node that is passed again at a later level still counts there, since a longer walk may be surer.

    A level is counted: while it is small the edges are scanned past it, filters pushed down, and only its own rows are
    shuffled; beyond that edges and level meet by a shuffle on the node, the edges' being the same at each level.  ``tiny``
    levels, of one root, are tried without files.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    near, far = ("dst_id", "src_id") if direction == "callers" else ("src_id", "dst_id")
    usable = edges.where(F.col("kind").isin(*CALL_KINDS) & (F.col("confidence") >= min_confidence) & F.col("dst_id").isNotNull()).select(
        F.col(near).alias("near"), F.col(far).alias("far"), F.col("confidence").alias("c"), "line", "reason"
    )
    level = roots.select("root", F.col("root").alias("id"), F.lit(1.0).alias("confidence")).distinct()
    out = None
    for k in range(1, depth + 1):
        step = (
            level.select("root", "id", "confidence").join(usable, F.col("id") == F.col("near"))
            .groupBy("root", "far")
            .agg(F.max(F.least("confidence", "c")).alias("confidence"), F.min("line").alias("via_line"), F.min("reason").alias("reason"))
            .select("root", F.col("far").alias("id"), F.lit(k).alias("depth"), "confidence", "via_line", "reason")
        )
        level = counted(step, "call-level", tiny=tiny) if k < depth else step
        out = level if out is None else out.unionByName(level)
    return (
        out.where("id <> root").groupBy("root", "id")
        .agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"), F.min("via_line").alias("via_line"), F.min("reason").alias("reason"))
    )


def neighbours(view: DataFrame, edges: DataFrame, root: int, direction: str = "callers", depth: int = 2, min_confidence: float = 0.5, limit: int = 50) -> DataFrame:
    """The walk from one symbol with the symbols' columns, by depth, rank, qualname and id."""
    roots = view.sparkSession.createDataFrame([(root,)], "root bigint")
    found = counted(walk(edges, roots, direction, depth, min_confidence, tiny=True).drop("root"), "neighbours", tiny=True)
    # a semi join goes down to the scan of the symbols, below the removal of rows that arrive twice
    return view.join(found.select("id"), "id", "left_semi").join(found, "id").orderBy("depth", F.desc("rank"), "qualname", "id").limit(limit)


def file_imports(imports: DataFrame) -> DataFrame:
    """(src_file, dst_file) of the resolved imports, each pair once."""
    return imports.where("dst_file_id IS NOT NULL").select(F.col("file_id").alias("src_file"), F.col("dst_file_id").alias("dst_file")).distinct()


def dependents(imports: DataFrame, roots: DataFrame, depth: int = 3, tiny: bool = False) -> DataFrame:
    """(root, id, depth): the files that import each root file, directly or through others.

    Only the least depth counts here, so files that were reached are not passed again.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    pairs = file_imports(imports)
    reached = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct()
    level = reached
    for k in range(1, depth + 1):
        level = (
            level.select("root", "id").join(pairs, F.col("id") == F.col("dst_file"))
            .select("root", F.col("src_file").alias("id")).distinct()
            .join(reached.select("root", "id"), ["root", "id"], "left_anti")
            .withColumn("depth", F.lit(k))
        )
        if k < depth:
            level = counted(level, "file-level", tiny=tiny)
        reached = reached.unionByName(level)
    return reached.where("depth > 0")


def dependent_files(files: DataFrame, imports: DataFrame, path: str, depth: int = 3, limit: int = 200) -> DataFrame:
    """(path, depth, is_test) of the transitive importers of a file, tests first within a depth."""
    roots = files.where(F.col("path") == path).select(F.col("id").alias("root"))
    found = counted(dependents(imports, counted(roots, "file-roots", tiny=True), depth, tiny=True).select("id", "depth"), "file-found", tiny=True)
    return files.join(found, "id").where(F.col("path") != path).select("path", "depth", "is_test").orderBy("depth", F.desc("is_test"), "path").limit(limit)
