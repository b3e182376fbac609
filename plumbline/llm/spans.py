"""Problem 8: long exact spans shared between records.

The required result is exact to the position for spans of any alignment, also inside paragraphs of tens of
thousands of characters, which banded paragraph MinHash can only find with a probability (see the README);
so candidates come from winnowing instead: every window of ``length`` code points elects the k-gram
with the least hash inside it, its anchor.  The choice depends on the window's content alone, so equal windows of
different texts elect equal anchors, and only windows with an anchor seen in two texts can be shared.

1. Each text gives its anchors with the run of windows that elected them and a hash of the run's text.
2. Anchors of one text only end there.  A run whose whole text occurs in two texts is shared whole; that
   settles the inside of every copy by a count of texts per hash, without pairs.
3. What is left are the runs at the borders of copies: one representative of each different run gives
   a hash for each of its windows; windows seen in two texts are shared.

All grouping is by hash with minima and maxima of text ids, which combine on the map side, so a passage
in a third of all texts costs one row per task, and no pair of texts is ever formed.  Hashes have
64 bits; a window is compared by its own hash and that of its anchor together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import spread, stage

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: Code points hashed at once; longer texts are one piece by themselves.
CHUNK = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Prefix:
    """Polynomial prefix sums of code points: the hash of any substring in constant time."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        power = np.full(n + 1, _BASE, U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.inverse = np.full(n + 1, _INVERSE, U)
        self.inverse[0] = 1
        self.inverse = np.multiply.accumulate(self.inverse)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_mix(points.astype(U) + U(0x1234567)) * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``, from running minima of blocks in both directions."""
    n = len(a)
    m = -(-n // width) * width
    b = np.full(m, np.iinfo(a.dtype).max, a.dtype)
    b[:n] = a
    b = b.reshape(-1, width)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchors_of(texts: list[str], length: int, gram: int):
    """For texts hashed together: text index, first window, windows, anchor hash, hash of the run's text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = _points("".join(texts))
    ends = np.cumsum(sizes)
    p = _Prefix(points)
    n = len(points) - gram + 1
    at = np.arange(n)
    h = p.of(at, at + gram)
    bits = U(max(1, int(n).bit_length()))  # place in the low bits: the leftmost of equal hashes wins
    least = _sliding_min(((h >> bits) << bits) | at.astype(U), length - gram + 1)
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.flatnonzero(np.arange(len(anchor)) + length <= ends[owner[: len(anchor)]])
    anchor = anchor[first]
    if not len(first):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U), e.astype(U)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[first[1:]] != owner[first[:-1]])])
    lo, hi = first[new], np.r_[first[new[1:] - 1], first[-1]]
    who = owner[lo]
    return who, lo - (ends - sizes)[who], hi - lo + 1, h[anchor[new]], p.of(lo, hi + length)


def _pieces(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    some_ids, some, total = [], [], 0
    for i, t in zip(ids, texts):
        if some and total + len(t) > CHUNK:
            yield some_ids, some
            some_ids, some, total = [], [], 0
        some_ids.append(i)
        some.append(t)
        total += len(t)
    if some:
        yield some_ids, some


def _find_anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for ids, texts in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                who, at, n, h, z = _anchors_of(texts, length, gram)
                doc = np.array(ids, np.int64)[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(z.view(np.int64))],
                    ["doc", "at", "n", "h", "z"],
                )

    return run


def _hash_windows(length: int):
    """Of each text and its list of runs: (run's hash, anchor, offset, hash of the window there)."""

    def run(batches):
        for batch in batches:
            runs = batch.column(1)
            bounds = np.asarray(runs.offsets, np.int64)
            flat = runs.values
            at = np.asarray(pc.struct_field(flat, "at"), np.int64)
            n = np.asarray(pc.struct_field(flat, "n"), np.int64)
            z, h, lo, hi = (np.asarray(pc.struct_field(flat, c), np.int64) for c in ("z", "h", "lo", "hi"))
            for i, text in enumerate(batch.column(0).to_pylist()):
                s = slice(bounds[i], bounds[i + 1])
                p = _Prefix(_points(text))
                offset = np.concatenate([np.arange(x) for x in n[s]])
                start = np.repeat(at[s], n[s]) + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(x[s], n[s])) for x in (z, h, lo, hi)]
                    + [pa.array(offset.astype(np.int32)), pa.array(p.of(start, start + length).view(np.int64))],
                    ["z", "h", "lo", "hi", "o", "wh"],
                )

    return run


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 72) -> DataFrame:
    """(id, span_start, span_end): the maximal runs of positions that lie in a substring of at least
    ``length`` code points found in the text of another id too.

    Positions count code points from 0, the end is exclusive, runs that touch are one run.  A repetition
    within one text is not shared.  Null texts and ids and texts shorter than ``length`` have no spans; rows with
    the same id and text count as one record, rows with the same id and other texts as one record too
    (their spans are merged), so ids should be unique.  ``gram`` trades anchors (fewer if small) against
    borders to be compared window by window (fewer if large); it doesn't change the result.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    texts = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(
        F.col("doc").isNotNull() & (F.length("text") >= length)
    )
    anchors = stage(spread(texts).mapInArrow(_find_anchors(length, gram), "doc bigint, at int, n int, h bigint, z bigint"), "anchors")
    common = anchors.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    runs = stage(anchors.join(common, "h", "left_semi"), "runs")
    kinds = stage(
        runs.groupBy("h", "z", "n").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "at")).alias("one")),
        "kinds",
    )
    whole = kinds.where("lo < hi").select("h", "z", "n", F.lit(0).alias("f"), (F.col("n") - 1).alias("t"))
    # anchors under which some run is in one text only: all their kinds are compared window by window
    open_h = kinds.groupBy("h").agg(F.count("*").alias("c"), F.min(F.expr("lo = hi")).alias("all_single"), F.max(F.expr("lo = hi")).alias("any_single")).where("any_single AND c > 1").select("h")
    reps = (
        kinds.join(open_h, "h", "left_semi")
        .withColumn("id", F.xxhash64("h", "z", "n"))
        .groupBy(F.col("one.doc").alias("doc"))
        .agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "n", F.col("id").alias("z"), "h", "lo", "hi")).alias("runs"))
    )
    windows = stage(
        texts.join(reps, "doc").select("text", "runs").mapInArrow(_hash_windows(length), "z bigint, h bigint, lo bigint, hi bigint, o int, wh bigint"),
        "windows",
    )
    seen = windows.groupBy("h", "wh").agg(F.min("lo").alias("l"), F.max("hi").alias("m")).where("l < m").select("h", "wh")
    hits = windows.where("lo = hi").join(seen, ["h", "wh"], "left_semi").select("z", "o").distinct()
    of_kind = W.partitionBy("z").orderBy("o")
    parts = (
        hits.withColumn("g", F.col("o") - F.row_number().over(of_kind))
        .groupBy("z", "g").agg(F.min("o").alias("f"), F.max("o").alias("t"))
        .select(F.col("z").alias("id"), "f", "t")
    )
    border = kinds.where("lo = hi").withColumn("id", F.xxhash64("h", "z", "n")).join(parts, "id").select("h", "z", "n", "f", "t")
    spans = runs.join(whole.unionByName(border), ["h", "z", "n"]).select(
        "doc", (F.col("at") + F.col("f")).alias("b"), (F.col("at") + F.col("t") + length).alias("e")
    )
    ordered = W.partitionBy("doc").orderBy("b", "e")
    reach = F.max("e").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    return (
        spans.withColumn("new", F.when(F.col("b") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
        .withColumn("k", F.sum("new").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("doc", "k").agg(F.min("b").alias("span_start"), F.max("e").alias("span_end"))
        .select(F.col("doc").alias(id_col), "span_start", "span_end")
    )


def shared_portion(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, shared_chars, shared): how much of each text lies in the spans; 0 for null and empty texts."""
    sums = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    return (
        df.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"))
        .join(sums, id_col, "left")
        .withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint"))
        .withColumn("shared", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
    )
