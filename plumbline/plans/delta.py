"""Incremental indexing: which files were added, changed, removed or left as they are, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(known: DataFrame, present: DataFrame) -> DataFrame:
    """(path, state) of two tables (path, sha256): added, removed, changed or unchanged.

    Paths should be unique in each; null paths are dropped.  A file whose hash is null (unreadable) on either side is changed.
    """
    old = known.where("path IS NOT NULL").select("path", F.col("sha256").alias("old"), F.lit(True).alias("was"))
    new = present.where("path IS NOT NULL").select("path", F.col("sha256").alias("new"), F.lit(True).alias("is"))
    state = (
        F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "unchanged").otherwise("changed")
    )
    return old.join(new, "path", "full").select("path", state.alias("state"))


def has_work(states: DataFrame) -> bool:
    """Whether anything has to be derived anew."""
    return not states.where("state <> 'unchanged'").isEmpty()


def merge_rows(kept: DataFrame, fresh: DataFrame, touched_paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows of files that weren't touched, and the new rows of those that were."""
    return kept.join(touched_paths.select(F.col("path").alias(path)).distinct(), path, "left_anti").unionByName(fresh)
