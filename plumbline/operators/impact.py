"""What is affected if a file or a symbol changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.names import CALL_KINDS, is_test_path
from plumbline.operators.lookup import match_files, resolve_selector, symbols_in_file
from plumbline.operators.traverse import dependent_files, neighbours


@dataclass
class Impact:
    """target and kind (file or symbol); files: path, depth, is_test; symbols: as neighbours; tests: path.

    ``limit`` is what cut the answer, if ``truncated``.
    """

    target: str
    kind: str
    files: DataFrame
    symbols: DataFrame
    tests: DataFrame
    limit: int = 60

    @property
    def truncated(self) -> bool:
        """Whether files or symbols reach the limit, so that there may be more."""
        return any(t.limit(self.limit).count() >= self.limit for t in (self.files, self.symbols))


def outside_callers(view: DataFrame, edges: DataFrame, path: str, min_confidence: float = 0.3, limit: int = 60, first_symbols: int = 40, callers_each: int = 10) -> DataFrame:
    """Direct callers, outside of a file, of its first symbols: one join for all of them.

    The best ``callers_each`` callers of each symbol are taken, then those of the same file dropped; a caller
    found for several symbols keeps its surest row (ties: the symbol that comes first).
    """
    own = symbols_in_file(view, path, first_symbols).select(F.col("id").alias("target"), F.col("start_line").alias("target_line"))
    calls = (
        edges.where(F.col("kind").isin(*CALL_KINDS) & (F.col("confidence") >= min_confidence) & F.col("src_id").isNotNull())
        .select("src_id", F.col("dst_id").alias("target"), "confidence", "line", "reason")
        .join(own, "target")
        .where("src_id <> target")
        .groupBy("target", "target_line", F.col("src_id").alias("id"))
        .agg(F.max("confidence").alias("confidence"), F.min("line").alias("via_line"), F.min("reason").alias("reason"))
    )
    best = W.partitionBy("target").orderBy(F.desc("rank"), "qualname", "id")
    surest = W.partitionBy("id").orderBy(F.desc("confidence"), "target_line", "target")
    return (
        view.join(calls, "id")
        .withColumn("k", F.row_number().over(best)).where(F.col("k") <= callers_each)
        .where(F.col("path") != path)
        .withColumn("k", F.row_number().over(surest)).where("k = 1")
        .select(*view.columns, F.lit(1).alias("depth"), "confidence", "via_line", "reason")
        .orderBy(F.desc("confidence"), "qualname", "id")
        .limit(limit)
    )


def blast_radius(view: DataFrame, files: DataFrame, imports: DataFrame, edges: DataFrame, target: str, depth: int = 3, min_confidence: float = 0.3, limit: int = 60) -> Impact:
    """Impact of a file, if a path matches the target, else of the symbol it selects."""
    hit = match_files(files, target, 1).select("path").first()
    if hit is not None:
        path = hit[0]
        dependants = dependent_files(files, imports, path, depth, limit)
        return Impact(path, "file", dependants, outside_callers(view, edges, path, min_confidence, limit), dependants.where("is_test").select("path").distinct().orderBy("path"), limit)
    root = resolve_selector(view, target, 1).first()
    if root is None:
        raise LookupError(target)
    symbols = neighbours(view, edges, root["id"], "callers", depth, min_confidence, limit)
    touched = symbols.where(F.col("path") != root["path"]).select("path").distinct().select("path", F.lit(1).alias("depth"), is_test_path(F.col("path")).alias("is_test")).orderBy("path")
    return Impact(root["qualname"], "symbol", touched, symbols, touched.where("is_test").select("path"), limit)
