"""Problem 8, whole paragraphs: all near copies by their least shingles, verified exactly and clustered.

1. Texts are cut at blank lines where they are read.  The shingles of ``shingle`` words of a paragraph are put in one order for
   all texts, by hash, those that a sample shows to be common last.  Of n shingles the first n - o + 1 are its keys, o being the least
   overlap that can meet the threshold: two paragraphs that meet it have a key in common, always, whatever the order.
   (Bands of MinHash have one with a probability only: 10 of 4 leave out one pair of similarity 0.8 in 200.)
2. Equal paragraphs are one class, whatever their number; keys of a single class end here.
3. Classes with a key in common meet, in keys of many classes some sixteen pivots first, and then four times as many a round, those
   that already are in one component no more.  A key ends when all its classes have met or are in one component.
4. A pair is verified by the exact Jaccard similarity of its shingles if its sizes, the places of the key and a bitmap of
   the shingles allow for the threshold; they bound the overlap from above, so no pair is lost by them.
5. Verified pairs are joined to components; the first paragraph of a component stays, the others can be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.structure import strongly_connected
from plumbline.session import counted, spread, stage

U = np.uint64
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
#: About so many classes of a key are compared with all others of it in the first round, and times GROWTH in each further one.
PIVOTS, GROWTH = 16, 4
#: About so many texts are searched for common shingles, and so many of those are ordered by their number; neither changes results.
SAMPLE, COMMON = 10_000, 100_000
#: Texts up to which the places of the paragraphs to be verified are broadcast: some megabytes.
WANTED_TEXTS = 20_000
#: Words whose hashes a worker keeps; beyond it the store starts anew (results are the same).
CACHED_WORDS = 600_000
_words: dict[str, int] = {}


def paragraphs_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs between blank lines, without white space around them."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        if part.strip():
            left = len(part) - len(part.lstrip())
            out.append((at + left, at + len(part.rstrip())))
        at = m.end() if m else end
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_words) > CACHED_WORDS:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = _hash(w)
    return np.fromiter((_words[w] for w in words), U, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles_of(text: str, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, or of all words of a shorter text, in order."""
    return _shingles([text], size)[0]


def _shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts in one array, and where each text's begin."""
    split = [t.split() for t in texts]
    words = _word_hashes([w for ws in split for w in ws])
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    counts = np.maximum(1, lengths - size + 1)
    starts = np.cumsum(counts) - counts
    # the word that each shingle begins with, and how many words it has
    at = np.arange(counts.sum()) - np.repeat(starts - (np.cumsum(lengths) - lengths), counts)
    width = np.repeat(np.minimum(lengths, size), counts)
    out = np.zeros(len(at), U)
    for k in range(size):
        more = width > k
        out[more] = _mix(out[more] * U(0x9E3779B97F4A7C15) + words[at[more] + k])
    return out, starts


@lru_cache
def _factors(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def band_keys(texts: list[str], size: int, bands: int, rows: int) -> np.ndarray:
    """One key for each text and band: a hash of the least values of ``rows`` permutations of the text's shingles.

    A measure of likely similarity only; :func:`near_paragraphs` doesn't rely on it, as pairs would be left to chance.
    """
    shingles, starts = _shingles(texts, size)
    keys = np.tile(np.arange(bands, dtype=U), (len(texts), 1))
    factors = _factors(bands * rows)
    for band in range(bands):
        for k in range(rows):
            least = np.minimum.reduceat(_mix(shingles * factors[band * rows + k]), starts)
            keys[:, band] = _mix(keys[:, band] * U(0x9E3779B97F4A7C15) + least)
    return keys


def least_overlap(n: np.ndarray, similarity: float) -> np.ndarray:
    """The least number of shingles that a text of ``n`` shingles shares with any text of that similarity."""
    o = np.maximum(1, np.ceil(similarity * n).astype(np.int64))
    o -= (o > 1) & ((o - 1) / n >= similarity)
    return o + (o / n < similarity)


def _sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    flat, starts = _shingles(texts, size)
    return [np.unique(x) for x in np.split(flat, starts[1:])] if texts else []


def _in_order(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Numbers for shingles that sort as the shingles do in the one order of all texts: ``common`` ones after all others, by rank."""
    out = shingles >> U(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, out), len(common) - 1)
        hit = common[at] == out
        out[hit] = (U(1) << U(63)) | ranks[at[hit]]
    return out


def least_keys(texts: list[str], size: int, similarity: float, common: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of its shingles, a bitmap with the parity of 64 parts of them, and its number of keys; and all keys in order."""
    flat, starts = _shingles(texts, size)
    flat = _in_order(flat, common, ranks)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(flat))))
    flat = flat[np.lexsort((flat, owner))]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[new], owner[new]
    n = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(n) - n
    bits = np.bitwise_xor.reduceat(U(1) << (_mix(flat) >> U(58)), starts)
    keep = n - least_overlap(n, similarity) + 1
    return n, bits, keep, flat[np.arange(len(flat)) - np.repeat(starts, n) < np.repeat(keep, n)]


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([t[a:b] for t in batch.column(0).to_pylist() for a, b in paragraphs_of(t)], pa.string())], ["part"])


def _all_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.concatenate([np.zeros(0, U), *_sets(batch.column(0).to_pylist(), size)])
            yield pa.RecordBatch.from_arrays([pa.array((flat >> U(1)).view(np.int64))], ["s"])

    return run


def _common_shingles(texts: DataFrame, number: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several paragraphs of a sample have, ascending, and their ranks from the rarest to the commonest."""
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, number // SAMPLE))) == 0)
    parts = some.select("text").mapInArrow(_paragraphs, "part string").distinct()
    rows = parts.mapInArrow(_all_shingles(size), "s bigint").groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).collect()
    common = np.fromiter((r["s"] for r in rows), np.int64, len(rows)).view(U)
    by = np.argsort(common)
    return common[by], np.arange(len(rows) - 1, -1, -1).astype(U)[by]


#: Characters whose paragraphs are hashed at once.
CHUNK = 1_000_000
_PARAGRAPHS = "doc bigint, at int, to int, h1 bigint, h2 bigint, n int, bits bigint, keys array<bigint>"


def _digest(part: str) -> bytes:
    return blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _signatures(size: int, similarity: float, common: np.ndarray, ranks: np.ndarray):
    """Of each paragraph its place and hash; the first of equal ones that a task sees has the keys, the others have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            doc, start, end, digests, new, places = [], [], [], [], [], []
            held = 0

            def flush() -> pa.RecordBatch:
                n, bits, ends = np.zeros(len(doc), np.int32), np.zeros(len(doc), U), np.zeros(len(doc) + 1, np.int32)
                keys = np.zeros(0, U)
                if new:
                    n[places], bits[places], ends[np.array(places) + 1], keys = least_keys(new, size, similarity, common, ranks)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.view(np.int64)))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(n), pa.array(bits.view(np.int64)), lists],
                    ["doc", "at", "to", "h1", "h2", "n", "bits", "keys"],
                )

            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in paragraphs_of(text):
                    part = text[a:b]
                    digest = _digest(part)
                    if digest not in seen:
                        seen.add(digest)
                        places.append(len(doc))
                        new.append(part)
                        held += len(part)
                    doc.append(d)
                    start.append(a)
                    end.append(b)
                    digests.append(digest)
                if held > CHUNK:
                    yield flush()
                    if len(seen) > 200_000:
                        seen.clear()
                    doc, start, end, digests, new, places, held = [], [], [], [], [], [], 0
            yield flush()

    return run


def _shingle_sets(size: int):
    """Of each text and its places: the class and the sorted set of its shingles, where the text has the class's paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # of rows that have an id but not their text in common, one has it
                here = [p for p in places if _digest(text[p["at"] : p["to"]]) == np.array([p["h1"], p["h2"]], np.int64).tobytes()]
                if here:
                    sets = [x.view(np.int64) for x in _sets([text[p["at"] : p["to"]] for p in here], size)]
                    yield pa.RecordBatch.from_arrays([pa.array([p["c"] for p in here], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["c", "s"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose shingles have the similarity."""
    needed = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    one = [F.col(f"one.{x}").alias(x) for x in ("at", "to", "h1", "h2")]
    wanted = counted(classes.join(needed, "c", "left_semi").groupBy(F.col("one.doc").alias("doc")).agg(F.collect_list(F.struct("c", *one)).alias("places")), "paragraph-wanted", WANTED_TEXTS)
    sets = stage(texts.join(wanted, "doc").select("text", "places").mapInArrow(_shingle_sets(shingle), "c bigint, s array<bigint>").dropDuplicates(["c"]), "paragraph-sets")
    both = F.size(F.array_intersect("x", "y"))
    return stage(
        pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
        .where(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b"),
        "paragraph-links",
    )


def _joined(links: DataFrame) -> DataFrame:
    """(c, k) of the classes that links join to components."""
    ways = links.selectExpr("a AS src", "b AS dst").unionByName(links.selectExpr("b AS src", "a AS dst"))
    return strongly_connected(ways).selectExpr("node AS c", "component AS k")


def near_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(id, span_start, span_end, class_id, class_start, copies): every paragraph with the first one of its component.

    Two paragraphs are linked if their shingles have at least the Jaccard ``similarity`` (above 0), without exception.
    class_id and class_start name the component's least paragraph by id, then place (its own for a paragraph without near
    copies); copies counts the component's paragraphs.  A paragraph whose class isn't itself can be removed.  Null and blank
    texts and null ids have no paragraphs; rows that arrive twice count once.
    """
    texts = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    common, ranks = _common_shingles(texts, df.select(id_col).count(), shingle)
    found = stage(spread(texts).mapInArrow(_signatures(shingle, similarity, common, ranks), _PARAGRAPHS).withColumn("c", F.xxhash64("h1", "h2")), "paragraphs")
    classes = stage(found.groupBy("c").agg(F.min(F.struct("doc", "at", "to", "h1", "h2")).alias("one")), "paragraph-classes")
    # equal paragraphs have equal keys, so the keys of two classes show without removing copies first
    keyed = found.select("c", "n", "bits", F.posexplode("keys").alias("pos", "key"))
    shared = counted(keyed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "paragraph-shared")
    members = stage(keyed.join(shared, "key", "left_semi").distinct().withColumn("k", F.col("c")), "paragraph-keys")
    links, pivots = None, PIVOTS
    while not members.isEmpty():
        # keys of one component have nothing left to tell; of the others the least class is a pivot, so that every round has one
        sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.min("k").alias("k0"), F.max("k").alias("k1")).where("k0 < k1").select("key", "m", "lo")
        chosen = (F.col("c") == F.col("lo")) | (F.pmod(F.xxhash64("c", F.lit(pivots)), F.ceil(F.col("m") / pivots)) == 0)
        sized = stage(members.join(sizes, "key").select(*members.columns, chosen.alias("pivot")), "paragraph-sized")
        x, y = sized.alias("x"), sized.where("pivot").alias("y")
        # the key that two classes have first has all that they share behind it in both; parities differ by what they don't share only
        most = F.expr("least(x.n - x.pos, y.n - y.pos, (x.n + y.n - bit_count(x.bits ^ y.bits)) div 2)")
        near = (F.col("x.key") == F.col("y.key")) & (F.col("x.k") != F.col("y.k")) & (~F.col("x.pivot") | (F.col("x.c") < F.col("y.c"))) & (most / (F.col("x.n") + F.col("y.n") - most) >= similarity)
        pairs = stage(x.join(y, near).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct(), "paragraph-pairs")
        if not pairs.isEmpty():
            good = _verified(pairs, texts, classes, similarity, shingle)
            links = good if links is None else links.unionByName(good)
        # pivots have met all of their keys
        rest = sized.where("NOT pivot").drop("pivot")
        if rest.isEmpty():
            break
        if links is not None:
            rest = rest.drop("k").join(_joined(links), "c", "left").withColumn("k", F.coalesce("k", "c")).select(*members.columns)
        members = stage(rest, "paragraph-keys")
        pivots *= GROWTH
    if links is None:
        component = classes.select("c", F.col("c").alias("k"))
    else:
        component = classes.select("c").join(_joined(links), "c", "left").select("c", F.coalesce("k", "c").alias("k"))
    placed = stage(found.select("doc", "at", "to", "c").distinct().join(component, "c"), "paragraph-components")
    first = placed.groupBy("k").agg(F.min(F.struct("doc", "at")).alias("one"), F.count("*").alias("copies"))
    return placed.join(first, "k").select(
        F.col("doc").alias(id_col), F.col("at").alias("span_start"), F.col("to").alias("span_end"), F.col("one.doc").alias("class_id"), F.col("one.at").alias("class_start"), "copies"
    )
