"""Readers for the Parquet tables of a workspace snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of ``folder``; a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def distinct_by_id(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that arrive twice count once.

    The copies are equal, so one of them stands for all, column by column: what a query doesn't use is pruned from the
    aggregate and from the scan, only the id is hashed, and joins on the id need no further shuffle.
    """
    return df.select("id", *[c for c in columns if c != "id"]).where(F.col("id").isNotNull()).dropDuplicates(["id"])


def latest_files(files: DataFrame, *columns: str) -> DataFrame:
    """The row of each file id with the latest ``indexed_at`` (ties: the greatest sha256, then the greatest rest).

    Every column is a maximum by that order, so it combines on the map side and columns that a query doesn't use are
    pruned from the scan; rows with a null id are dropped, a null ``indexed_at`` is older than any other.  Rows that tie in all
    but the rest are one state of a file; of their values the greatest is taken, column by column.
    """
    key = [F.col("indexed_at")] + ([F.col("sha256")] if "sha256" in files.columns else [])
    value = lambda c: F.max(F.struct(*key, F.col(c).alias("_v")))["_v"].alias(c)
    return files.where(F.col("id").isNotNull()).groupBy("id").agg(*[value(c) for c in columns if c != "id"]).select("id", *[c for c in columns if c != "id"])

