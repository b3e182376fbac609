"""Follow a folder of changed sources with Structured Streaming, each batch an incremental index run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.index import build

CHANGES = "path string, lang string, text string, changed_at timestamp"


def follow(spark: SparkSession, changes: str, index: str, checkpoint: str, every: str | None = None, rounds: int = 30) -> StreamingQuery:
    """Stream Parquet rows (:data:`CHANGES`) from ``changes`` into the index in ``index``.

    Of several rows of a path in a batch the latest holds.  A batch that is run again after a failure finds its
    hashes unchanged and does nothing, so every change is applied once.  Without ``every`` it takes what is there and ends.
    """

    def apply(batch: DataFrame, _: int) -> None:
        latest = batch.where("path IS NOT NULL AND text IS NOT NULL").groupBy("path").agg(F.max(F.struct("changed_at", "lang", "text")).alias("m")).select("path", "m.lang", "m.text")
        build(spark, latest, index, complete=False, rounds=rounds)

    writer = spark.readStream.schema(CHANGES).parquet(changes).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
