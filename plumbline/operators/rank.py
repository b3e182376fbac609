"""PageRank over weighted edges, and personalized PageRank from seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage

FLOOR = 1.0e-6
#: Nodes and edges together up to which a graph is ranked in one task: some tens of megabytes.  The same scores come out beyond it.
ONE_TASK = 1_000_000


def _in_one_task(rows: DataFrame, rounds) -> DataFrame:
    """(id, score) by ``rounds(src, dst, p, n)`` over places 0..n-1; only for a number of rows that was checked.

    ``rows``: src, dst, p; a row without dst is a node, with its p as its first score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        src, p = table.column("src").to_numpy(), table.column("p").to_numpy()
        dst = table.column("dst").fill_null(0).to_numpy()
        link = table.column("dst").is_valid().to_numpy()
        ids, first = src[~link], p[~link]
        order = np.argsort(ids)
        ids, first = ids[order], first[order]
        score = rounds(np.searchsorted(ids, src[link]), np.searchsorted(ids, dst[link]), p[link], first)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score)], ["id", "score"])

    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("p", pa.float64())])
    return rows.selectExpr("CAST(src AS BIGINT) AS src", "CAST(dst AS BIGINT) AS dst", "CAST(p AS DOUBLE) AS p").coalesce(1).mapInArrow(run, "id bigint, score double")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 30, tolerance: float = 1.0e-7, stage_every: int = 5, one_task: int = ONE_TASK) -> DataFrame:
    """(id, score) of every node of ``nodes(id)``; ``edges`` has src, dst, weight.

    Loops and edges from or to other nodes don't count, parallel edges add up, weights have a floor (null
    weights too).  The mass of nodes without edges out is spread over all.  Stops when the sum of changes falls below
    ``tolerance``; 0 runs all rounds.

    Links are kept partitioned by source and scores by id, so a round shuffles one row per node and partition, the
    partial sums, and is one job: it gives the change and the mass of the loose nodes too.  Scores are kept between rounds, and
    staged every ``stage_every`` rounds, so an executor's loss costs those since.  Up to ``one_task`` nodes and edges are ranked
    in one task instead.
    """
    spark = nodes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = stage(nodes.select("id").where("id IS NOT NULL").distinct(), "rank-nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    ids = nodes.withColumnRenamed("id", "k")
    clean = (
        edges.where("src <> dst").join(ids.withColumnRenamed("k", "src"), "src", "left_semi").join(ids.withColumnRenamed("k", "dst"), "dst", "left_semi")
        .groupBy("src", "dst").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(FLOOR))).alias("w"))
    )
    total = clean.groupBy("src").agg(F.sum("w").alias("t"))
    links = stage(clean.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "rank-links")
    if n + links.limit(one_task + 1).count() <= one_task:

        def rounds(src, dst, p, score):
            loose = np.ones(n, bool)
            loose[src] = False
            for _ in range(iterations):
                new = (1 - damping) / n + damping * (np.bincount(dst, p * score[src], n) + score[loose].sum() / n)
                moved = np.abs(new - score).sum()
                score = new
                if tolerance > 0 and moved < tolerance:
                    break
            return score

        return _in_one_task(links.unionByName(nodes.select(F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(1.0 / n).alias("p"))), rounds)
    # staged, so what an executor loses of the kept copy is read again
    links = links.repartition(width, "src").persist()
    score = nodes.join(links.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left").select("id", F.col("out").isNull().alias("loose"), F.lit(1.0 / n).alias("score"))
    score = score.repartition(width, "id").persist()
    kept = [score]
    lost = score.where("loose").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    for k in range(1, iterations + 1):
        got = links.join(score.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        after = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        new = score.select("id", "loose", F.col("score").alias("old")).join(got, "id", "left").select("id", "loose", after.alias("score"), F.abs(after - F.col("old")).alias("moved"))
        new = stage(new, "rank-scores") if k % stage_every == 0 or k == iterations else new.persist()
        moved, lost = new.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("loose"), F.col("score"))), F.lit(0.0))).first()
        score = new
        kept.append(new)
        if k % stage_every == 0:
            for old in kept:
                old.unpersist()
            kept = []
        if tolerance > 0 and moved < tolerance:
            break
    out = score if k % stage_every == 0 or k == iterations else stage(score, "rank-scores")
    for old in [*kept, links]:
        old.unpersist()
    return out.select("id", "score")


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.7, iterations: int = 20, undirected: bool = True, stage_every: int = 5) -> DataFrame:
    """(id, score) of the nodes near ``seeds(id)``, the seeds left out; no seeds, no rows.

    Loops and parallel edges count, and the mass of a node without edges out is lost.
    """
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(FLOOR)).alias("w"))
    if undirected:
        rows = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    sums = rows.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = sums.groupBy("src").agg(F.sum("w").alias("t"))
    links = stage(sums.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "near-links")
    seeds = stage(seeds.select("id").where("id IS NOT NULL").distinct(), "near-seeds")
    n = seeds.count()
    if n == 0:
        return seeds.withColumn("score", F.lit(0.0))
    score = seeds.withColumn("score", F.lit(1.0 / n))
    restart = seeds.withColumn("score", F.lit((1.0 - damping) / n))
    for k in range(1, iterations + 1):
        got = score.withColumnRenamed("id", "src").join(links, "src").select(F.col("dst").alias("id"), (F.lit(damping) * F.col("score") * F.col("p")).alias("score"))
        score = got.unionByName(restart).groupBy("id").agg(F.sum("score").alias("score"))
        if k % stage_every == 0:
            score = stage(score, "near-scores")
    return score.join(seeds, "id", "left_anti")


def related(view: DataFrame, edges: DataFrame, root: int, limit: int = 15) -> DataFrame:
    """Symbols near one symbol in the call graph, whatever the confidence, the nearest first (ties by id)."""
    spark = view.sparkSession
    calls = edges.where("dst_id IS NOT NULL AND kind IN ('calls', 'instantiates')").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("confidence").alias("weight"))
    near = personalized_pagerank(calls, spark.createDataFrame([(root,)], "id bigint"))
    best = near.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "id").limit(2 * limit)
    return view.join(best, "id").orderBy(F.desc("score"), "id").limit(limit)
