"""Strongly connected components and longest-path layers of a directed graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage

#: Edges up to which a graph is walked in one task: some tens of megabytes.  The same rows come out beyond it, by rounds of joins.
ONE_TASK = 1_000_000


def _in_one_task(edges: DataFrame, walk, schema: str) -> DataFrame:
    """Rows of ``walk(src, dst)`` over all edges; only for a number of edges that was checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for batch in batches:
            src += batch.column(0).to_pylist()
            dst += batch.column(1).to_pylist()
        rows = walk(src, dst)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names) if rows else pa.RecordBatch.from_pylist([], empty)

    kind = edges.schema["src"].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    empty = pa.schema([(x.split()[0], arrow if x.split()[1] == "K" else pa.int64()) for x in schema.split(", ")])
    return edges.select("src", "dst").coalesce(1).mapInArrow(run, schema.replace(" K", f" {kind}"))


def _components_of(src: list, dst: list) -> list[tuple]:
    """(node, component, size) by one walk that keeps its path: what leads back to the path joins its end."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict = {}
    path: list = []  # nodes seen and not yet in a component
    ends: list = []  # where on it components may still begin
    rows: list[tuple] = []
    done: set = set()
    for start in out:
        if start in order:
            continue
        todo = [(start, iter(out[start]))]
        order[start] = len(order)
        path.append(start)
        ends.append(start)
        while todo:
            node, rest = todo[-1]
            nxt = next(rest, None)
            if nxt is None:
                todo.pop()
                if ends[-1] == node:
                    ends.pop()
                    found = []
                    while not found or found[-1] != node:
                        found.append(path.pop())
                    done.update(found)
                    if len(found) > 1:
                        rows += [(x, min(found), len(found)) for x in found]
            elif nxt not in order:
                order[nxt] = len(order)
                path.append(nxt)
                ends.append(nxt)
                todo.append((nxt, iter(out[nxt])))
            elif nxt not in done:
                while order[ends[-1]] > order[nxt]:
                    ends.pop()
    return rows


def _layers_of(src: list, dst: list) -> list[tuple]:
    """(node, layer) by peeling nodes without edges in."""
    out: dict = {}
    waits: dict = {}
    for a, b in set(zip(src, dst)):
        out.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    layer = dict.fromkeys(waits, 0)
    free = deque(x for x, n in waits.items() if n == 0)
    while free:
        node = free.popleft()
        for b in out.get(node, ()):
            layer[b] = max(layer[b], layer[node] + 1)
            waits[b] -= 1
            if waits[b] == 0:
                free.append(b)
    return list(layer.items())


def _trim(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both in and out, until none is lost: only cycles and paths between them stay."""
    edges = stage(edges, "scc-edges")
    before, now = -1, edges.count()
    while now and now != before:
        heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = stage(edges.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"), "scc-edges")
        before, now = now, edges.count()
    return edges


def strongly_connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component, size) of the nodes in components of more than one; the component is named by its least node.

    ``edges``: src, dst.  Loops don't count; null ends are dropped.  Trimming leaves the cycles; then colours run forward
    (each node takes the greatest that reaches it) and a walk back inside a colour, from the node that gave it, is a component.
    Up to ``one_task`` edges are walked in one task instead.
    """
    clean = stage(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    if clean.limit(one_task + 1).count() <= one_task:
        return _in_one_task(clean, _components_of, "node K, component K, size bigint")
    left = _trim(clean)
    found: list[DataFrame] = []
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = stage(nodes.withColumn("colour", F.col("node")), "scc-colours")
        changed = True
        while changed:
            from_before = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            new = stage(colour.join(from_before, "node", "left").select("node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("moved")), "scc-colours")
            changed = not new.where("moved").isEmpty()
            colour = new.drop("moved")
        same = stage(
            left.join(colour.withColumnRenamed("node", "src"), "src").withColumnRenamed("colour", "cs")
            .join(colour.withColumnRenamed("node", "dst"), "dst").where("cs = colour").select("src", "dst", "colour"),
            "scc-same",
        )
        inside = stage(colour.where("node = colour"), "scc-inside")
        frontier = inside
        while not frontier.isEmpty():
            frontier = stage(
                same.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
                .join(inside, ["node", "colour"], "left_anti"),
                "scc-frontier",
            )
            inside = inside.unionByName(frontier)
        inside = stage(inside, "scc-inside")
        found.append(inside)
        gone = inside.select("node")
        left = _trim(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if not found:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("bigint").alias("size"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    sizes = out.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size")).where("size > 1")
    return out.join(sizes, "colour").select("node", "component", "size")


def cycles(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(component, size, members): one row per component, the largest first.  Members are sorted."""
    return strongly_connected(edges, one_task).groupBy("component", "size").agg(F.sort_array(F.collect_list("node")).alias("members")).orderBy(F.desc("size"), "component")


def layers(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, layer): the longest path that arrives, from nodes that no cycle reaches; 0 without one.

    Peels off the nodes without edges in, level by level; a node on or behind a cycle keeps what its peeled predecessors
    gave it.  Parallel edges count once; loops are cycles.  Up to ``one_task`` edges are walked in one task instead.
    """
    left = stage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "layer-edges")
    if left.limit(one_task + 1).count() <= one_task:
        return _in_one_task(left, _layers_of, "node K, layer bigint").withColumn("layer", F.col("layer").cast("int"))
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    given = [nodes.withColumn("layer", F.lit(0))]
    now = stage(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti"), "layer-now")
    level = 0
    while not now.isEmpty():
        level += 1
        peeled = now.withColumnRenamed("node", "src")
        reached = stage(left.join(peeled, "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "layer-reached")
        given.append(reached.withColumn("layer", F.lit(level)))
        left = stage(left.join(peeled, "src", "left_anti"), "layer-edges")
        # of the nodes just reached, those with no edge in left
        now = stage(reached.join(left.select(F.col("dst").alias("node")), "node", "left_anti"), "layer-now")
    out = given[0]
    for x in given[1:]:
        out = out.unionByName(x)
    return out.groupBy("node").agg(F.max("layer").alias("layer"))
