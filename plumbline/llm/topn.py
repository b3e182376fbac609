"""Problem 2: the N highest-scoring items of every group, by bisection of all groups at once.

A row's place is an order-preserving code: the bits of its score, made monotonic, then its identifier.
Each pass splits the open range of every unfinished group at the midpoints of equal steps, counts
the rows above each, and keeps the one step in which the N-th row lies; ranges shrink to the least and
greatest code really there, so ties on the score go straight to the identifier.  A group ends when its
range holds exactly the rows still wanted, which fixes its cutoff.  Counts combine on the map side and
rows leave the plan as soon as they are decided, so a group of millions is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import stage

#: Steps into which a pass splits a range.
STEPS = 16
#: Ranges of codes below this width are split exactly; wider ones at half the precision, which can't overflow.
EXACT = 1 << 40
LOWEST = -(1 << 63)


def score_code(score: str):
    """Signed 64-bit code that rises with a double; null and NaN come before all numbers, -0.0 equals 0.0."""
    x = F.col(score).cast("double")
    bits = F.expr(f"CAST(reflect('java.lang.Double', 'doubleToLongBits', CAST(`{score}` AS DOUBLE) + 0.0D) AS BIGINT)")
    code = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.when(x.isNull() | F.isnan(x), F.lit(LOWEST)).otherwise(code)


def _ends() -> list:
    return [F.min("s").alias("s_min"), F.max("s").alias("s_max"), F.min("k").alias("k_min"), F.max("k").alias("k_max")]


def _in_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows inside the range of their group, with its bounds.  AQE splits the partition of a hot group."""
    return (
        rows.select("g", "s", "k").alias("r")
        .join(ranges.alias("a"), F.expr("r.g <=> a.g"))
        .where("s BETWEEN s_min AND s_max AND (s_min < s_max OR k BETWEEN k_min AND k_max)")
        .select("r.g", "s", "k", "want", "s_min", "s_max", "k_min", "k_max")
    )


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, steps: int = STEPS) -> DataFrame:
    """(group, item) of the ``n`` rows of each group with the greatest score; all rows of smaller groups.

    Ties on the score go to the smaller item; null and NaN scores come last and are equal to each other.
    Repeated (group, item) rows count once, with their greatest score.  Rows whose item is null are
    dropped, rows whose group is null form one group.  ``item`` must be integral; ``n`` below 1 gives no
    rows.  Other columns are not read.
    """
    out_names = (group, item)
    if n < 1:
        return df.select(F.col(group), F.col(item).cast("bigint").alias(item)).where(F.lit(False))
    rows = stage(
        df.select(F.col(group).alias("g"), F.col(item).cast("bigint").alias("i"), F.col(score).cast("double").alias("v"))
        .where("i IS NOT NULL")
        .select("g", "i", score_code("v").alias("s"))
        .groupBy("g", "i").agg(F.max("s").alias("s"))
        # the identifier's part of the code rises as the identifier falls
        .select("g", "s", F.bitwise_not("i").alias("k")),
        "topn-rows",
    )
    found = stage(
        rows.groupBy("g").agg(F.count("*").alias("c"), *_ends()).withColumn("want", F.least("c", F.lit(n).cast("bigint"))),
        "topn-ranges",
    )
    cutoffs, left = [], rows
    while True:
        # everything from the lower end of a range on is in, once it holds just what is wanted
        cutoffs.append(found.where("c = want").selectExpr("g", "s_min AS cut_s", f"IF(s_min < s_max, {LOWEST + 1} - 1, k_min) AS cut_k"))
        active = found.where("c > want").drop("c")
        if active.isEmpty():
            break
        left = stage(_in_range(left, active), "topn-left")
        on_s = "s_min < s_max"
        parts = (
            left.selectExpr(
                "g", "s", "k", "want",
                f"IF({on_s}, s, k) AS v", f"IF({on_s}, s_min, k_min) AS lo", f"IF({on_s}, s_max, k_max) AS hi",
            )
            .withColumn("exact", F.expr(f"shiftright(hi, 1) - shiftright(lo, 1) < {EXACT}"))
            .withColumn("width", F.expr("IF(exact, hi - lo, shiftright(hi, 1) - shiftright(lo, 1))"))
            .withColumn("part", F.expr(f"IF(exact, v - lo, shiftright(v, 1) - shiftright(lo, 1)) DIV (width DIV {steps} + 1)"))
            .groupBy("g", "part").agg(F.count("*").alias("n"), F.first("want").alias("want"), *_ends())
        )
        above = F.sum("n").over(W.partitionBy("g").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1))
        found = stage(
            parts.withColumn("want", F.col("want") - F.coalesce(above, F.lit(0)))
            # the step of the N-th row: rows above don't fill the group, those down to here do
            .where("want > 0 AND want <= n")
            .select("g", F.col("n").alias("c"), "s_min", "s_max", "k_min", "k_max", "want"),
            "topn-ranges",
        )
    cut = cutoffs[0]
    for more in cutoffs[1:]:
        cut = cut.unionByName(more)
    return (
        rows.alias("r").join(cut.alias("c"), F.expr("r.g <=> c.g"))
        .where("s > cut_s OR (s = cut_s AND k >= cut_k)")
        .select(F.col("r.g").alias(out_names[0]), F.bitwise_not("k").alias(out_names[1]))
    )
