"""Problem 7: a training mix that gives each source its target share of the tokens.

Sizes are summed, the largest total that all quotas allow is found, and each source's stream of texts is
cut into blocks of equal size.  Pfair scheduling orders the blocks: block i of a source with weight w is
released at slot floor(i / w) and due by slot ceil((i + 1) / w); in every slot the released block with
the earliest deadline runs.  At any prefix a source then is less than one block off its share.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of a schedule at most.  The block grows with the corpus, so the schedule's size has a proven bound.
MAX_SLOTS = 20_000

SHARES = "source string, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, quota_tokens bigint, mixed_tokens bigint, actual_share double, repeats double"


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) of each slot, by earliest deadline first among the released blocks.

    ``blocks`` gives the number of blocks of each source; its weight is its part of all slots.  Ties on
    deadlines go by the later next deadline's weight (heavier first), then by name.
    """
    slots = sum(blocks.values())
    release = lambda s, i: i * slots // blocks[s]  # noqa: E731  floor(i / w)
    deadline = lambda s, i: -(-(i + 1) * slots // blocks[s])  # noqa: E731  ceil((i + 1) / w)
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    order = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, i), -blocks[s], s, i))
        _, _, s, i = heapq.heappop(ready)
        order.append((s, i))
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (max(release(s, i + 1), slot + 1), s, i + 1))
    return order


def plan_quotas(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> list[tuple]:
    """Rows of the report before mixing: the quota in tokens of each listed source.

    ``sizes`` has (texts, tokens) of the sources present, ``targets`` (share, repetitions).  Shares count
    relative to those of the sources that have tokens; the total is the largest one for which no
    source needs more than its repetitions, so that all shares are met.  With ``total_tokens`` it is that number, and a
    source that its repetitions don't carry so far falls short; the report says by how much.
    """
    live = {s: Fraction(t) for s, (t, m) in targets.items() if t and t > 0 and m and m > 0 and sizes.get(s, (0, 0))[1] > 0}
    whole = sum(live.values())
    total = min((sizes[s][1] * targets[s][1] * whole / w for s, w in live.items()), default=Fraction(0))
    if total_tokens is not None:
        total = Fraction(total_tokens)
    return [
        (s, float(t or 0), int(m or 0), *sizes.get(s, (0, 0)), math.floor(min(live[s] / whole * total, sizes[s][1] * m)) if s in live else 0)
        for s, (t, m) in sorted(targets.items())
    ]


def mix_sources(
    sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens",
    max_slots: int = MAX_SLOTS, buckets: int | None = None, total_tokens: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of ``sized`` texts and ``targets(source, target_share, max_repeats)``.

    mix: one row per text and repetition: id, source, repetition (from 0), slot (place of its block in
    the mix), block (of its source), n_tokens.  report: :data:`SHARES`.

    Null and unlisted sources, and listed ones of no share, take no part; a listed source without tokens
    stays in the report with 0 and its share goes to the others in proportion.  Targets that are listed
    twice count once (the greatest share and repetitions).  Texts of size 0 take no part.  ``sized`` should
    be staged: it is read three times.  Ids must be unique; a repeated row counts as another text.

    ``total_tokens`` asks for a size (:func:`plan_quotas`); by default it is the largest that meets all shares.

    The order within a source is by hash of the id.  Places in it come from sums over hash buckets, so no
    source, however large, is ever sorted in one task.
    """
    spark = sized.sparkSession
    # bounded: a row per listed source
    wanted = {
        r[0]: (r[1], r[2])
        for r in targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()
    }
    texts = sized.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), F.col(size_col).cast("bigint").alias("_n")).where(
        F.col("_s").isin(sorted(wanted)) & (F.col("_n") > 0)
    )
    sums = {r[0]: (r[1], r[2]) for r in texts.groupBy("_s").agg(F.count("*"), F.sum("_n")).collect()}
    plan = plan_quotas(sums, wanted, total_tokens)
    quotas = {p[0]: p[5] for p in plan}
    total = sum(quotas.values())
    block = max(1, -(-total // max(1, max_slots - len(plan)))) if total else 1
    order = pfair({s: -(-q // block) for s, q in quotas.items()})
    slots = spark.createDataFrame([(s, i, t) for t, (s, i) in enumerate(order)], "_s string, block bigint, slot bigint")
    n_buckets = buckets or max(64, sum(n for n, _ in sums.values()) // 20_000)
    texts = texts.withColumn("_h", F.xxhash64(F.col("_id"))).withColumn("_b", F.pmod("_h", F.lit(n_buckets)))
    from pyspark.sql import Window as W

    # two-level running sum: over the buckets of a source, then inside a bucket
    before = (
        texts.groupBy("_s", "_b").agg(F.sum("_n").alias("_t"))
        .withColumn("_o", F.sum("_t").over(W.partitionBy("_s").orderBy("_b")) - F.col("_t"))
        .select("_s", "_b", "_o")
    )
    inside = W.partitionBy("_s", "_b").orderBy("_h", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    limits = spark.createDataFrame([(p[0], p[4], p[5]) for p in plan if p[5] > 0], "_s string, _a bigint, _q bigint")
    placed = (
        texts.withColumn("_i", F.sum("_n").over(inside) - F.col("_n"))
        .join(before, ["_s", "_b"])
        .join(F.broadcast(limits), "_s")
        .withColumn("_at", F.col("_o") + F.col("_i"))
        # a repetition belongs to the mix when its middle lies inside the quota
        .withColumn("_r", F.greatest(F.lit(0), F.ceil((2 * F.col("_q") - 2 * F.col("_at") - F.col("_n")) / (2 * F.col("_a")))).cast("int"))
        .where("_r > 0")
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)))
        .withColumn("block", F.floor((F.col("_at") + F.col("repetition").cast("bigint") * F.col("_a")) / F.lit(block)).cast("bigint"))
    )
    mix = placed.join(F.broadcast(slots), ["_s", "block"]).select(
        F.col("_id").alias(id_col), F.col("_s").alias("source"), "repetition", "slot", "block", F.col("_n").alias("n_tokens")
    )
    rows = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, quota_tokens bigint")
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    report = (
        rows.join(got, "source", "left")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("bigint"))
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0)))
        .withColumn("repeats", F.coalesce(F.try_divide("mixed_tokens", "available_tokens"), F.lit(0.0)))
    )
    return mix, report
