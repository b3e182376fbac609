"""Problem 5: per-key results when a few keys hold most records, by value-frequency compression.

Rows are grouped by key *and* value before they are grouped by key, so what reaches a key is one
weighted row per distinct value.  Counts, distinct counts, modes and percentiles follow from the
weights.  No step brings the rows, or all the values, of a key into one task: counts and modes combine on the map
side, percentiles narrow a range by counts of at most a fixed number of blocks, and where values have to meet their key's
range the keys that hold many of them are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import stage

#: Blocks into which a key's range of numbers is cut at once.
BLOCKS = 1024
#: A key with this share of the weighted values is salted; at most its inverse of them exist, which bounds the broadcast.
HOT_SHARE = 0.001
SALTS = 64


def compress(df: DataFrame, key: str, value: str, row_id: str | None = None) -> DataFrame:
    """(key, value, weight): rows per key and value.

    With ``row_id``, an id counts once for each key, with the least of the values it is seen with (null only if it has no
    other), and rows without an id don't count.  Null keys form one key and null values one value.  Empty input gives no rows.
    """
    if row_id is None:
        rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    else:
        rows = df.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("_id"), F.col(key).alias("key")).agg(F.min(value).alias("value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("weight"))


def heavy_keys(df: DataFrame, key: str, row_id: str, value: str, share: float = 0.01) -> DataFrame:
    """(key, n, share) of the keys that hold at least ``share`` of the distinct non-null ids.

    ``n`` is the sum of the weights of a key's values (:func:`compress`; any column with few values will do).  Keys are
    compared exactly as stored; a null key is a key.  An id counts once for each key that it is seen with, and once in the
    total.
    """
    counts = compress(df, key, value, row_id).groupBy("key").agg(F.sum("weight").alias("n"))
    ids = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id")).distinct()
    total = ids.agg(F.count("*").alias("_total"))
    return (
        counts.join(F.broadcast(total))  # one row
        .withColumn("share", F.col("n") / F.col("_total"))
        .where(F.col("n") >= F.col("_total") * F.lit(share))
        .drop("_total")
    )


def _narrow(blocks: int) -> dict[str, Column]:
    """Block of ``v`` in lo..hi, and the ends of the block; by halves where a difference could overflow."""
    half = "(shiftright(hi, 1) - shiftright(lo, 1))"
    exact = f"{half} < {1 << 40}"
    wide = f"({half} DIV {blocks} + 1)"
    fine = f"((hi - lo) DIV {blocks} + 1)"
    base = f"(shiftright(lo, 1) + blk * {wide})"
    return {
        "blk": F.expr(f"IF({exact}, (v - lo) DIV {fine}, (shiftright(v, 1) - shiftright(lo, 1)) DIV {wide})"),
        "lo": F.expr(f"IF({exact}, lo + blk * {fine}, greatest(lo, {base} * 2))"),
        "hi": F.expr(f"IF({exact}, least(hi, lo + blk * {fine} + {fine} - 1), least(hi, ({base} + {wide} - 1) * 2 + 1))"),
    }


def percentiles(weighted: DataFrame, percent: float = 0.5, blocks: int = BLOCKS) -> DataFrame:
    """(key, p): the least value at or above which ``percent`` of the weight of its key lies; ``weighted``: key, v, weight.

    Every round cuts the range of each key into at most ``blocks`` parts, sums the weights of the parts and keeps the part that
    the percentile lies in, until all ranges are single values: four rounds for 32-bit numbers, seven for any, however they
    are spread.  Null values don't count; null keys form one key.
    """
    vals = weighted.where("v IS NOT NULL").select("key", F.col("v").cast("bigint").alias("v"), F.col("weight").alias("w"))
    state = stage(
        vals.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("all"), F.count("*").alias("n"))
        .withColumn("want", F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(percent)))),
        "heavy-ranges",
    )
    many = state.agg(F.sum("n").alias("t"))
    hot = state.join(F.broadcast(many)).where(F.col("n") >= F.col("t") * HOT_SHARE).select("key", F.lit(True).alias("hot"))  # one row; at most 1 / HOT_SHARE rows
    state = state.alias("s").join(F.broadcast(hot).alias("h"), F.expr("s.key <=> h.key"), "left").select("s.key", "lo", "hi", "want", F.coalesce("hot", F.lit(False)).alias("hot"))
    salted = vals.alias("v").join(F.broadcast(hot).alias("h"), F.expr("v.key <=> h.key"), "left").select(
        "v.key", "v", "w", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).alias("salt")
    )
    narrow = _narrow(blocks)
    state = stage(state, "heavy-ranges")
    while not state.where("lo < hi").isEmpty():
        ranges = state.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        parts = (
            salted.alias("v").join(ranges.alias("r"), F.expr("v.key <=> r.key AND v.salt = r.salt")).where("v BETWEEN lo AND hi")
            .select("r.key", "lo", "hi", "want", "hot", narrow["blk"].alias("blk"), "w")
            .groupBy("key", "lo", "hi", "want", "hot", "blk").agg(F.sum("w").alias("bw"))
        )
        upto = F.sum("bw").over(W.partitionBy("key").orderBy("blk"))  # at most ``blocks`` rows a key
        state = stage(
            parts.withColumn("upto", upto).where("upto >= want AND upto - bw < want")
            .select("key", narrow["lo"].alias("lo"), narrow["hi"].alias("hi"), (F.col("want") - F.col("upto") + F.col("bw")).alias("want"), "hot"),
            "heavy-ranges",
        )
    # a range may have shrunk to one value that isn't there only if it held no weight, which ``want`` rules out
    return state.select("key", F.col("lo").alias("p"))


def key_profile(df: DataFrame, key: str, category: str, number: str, row_id: str, percent: float = 0.5, blocks: int = BLOCKS) -> DataFrame:
    """Per key, for all keys: n (distinct ids), n_<category> (distinct non-null), mode_<category>, p_<number>.

    mode: the most frequent non-null category, ties to the smaller.  p: the lower ``percent`` percentile
    of the non-null numbers (:func:`percentiles`).  Null keys form one key; a key without a category or number has null there.
    """
    rows = df.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).alias("_id"), F.col(key).alias("key"), F.col(category).alias("c"), F.col(number).cast("bigint").alias("v")
    ).distinct()
    cells = stage(rows.groupBy("key", "c", "v").agg(F.count("*").alias("w")), "heavy-cells")
    by_c = cells.groupBy("key", "c").agg(F.sum("w").alias("w"))
    cats = by_c.groupBy("key").agg(
        F.sum("w").alias("n"),
        F.count("c").alias("n_c"),
        F.min(F.when(F.col("c").isNotNull(), F.struct(-F.col("w"), F.col("c").alias("c"))))["c"].alias("mode"),
    )
    pct = percentiles(cells.groupBy("key", "v").agg(F.sum("w").alias("weight")), percent, blocks)
    return (
        cats.alias("a").join(pct.alias("q"), F.expr("a.key <=> q.key"), "left")
        .select(F.col("a.key").alias(key), "n", F.col("n_c").alias(f"n_{category}"), F.col("mode").alias(f"mode_{category}"), F.col("p").alias(f"p_{number}"))
    )
