"""Problem 6: the whole corpus as token ids of a public byte-level BPE vocabulary.

Words never influence each other in byte-level BPE, so the corpus is replayed block by block: the
JVM splits texts into words, Arrow's dictionary encoding finds the distinct words of a block, and the
merges are applied to all of them together, in rank order, through an inverted index from token pair to
word positions; a merge only touches its neighbours.  Nothing is shuffled and no dictionary of the
corpus is broadcast, so the plan is one narrow stage at any size.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

#: Fixed value: the word pattern of the byte_bpe vocabularies, with Unicode classes for Java.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept between the blocks of one Python worker; beyond it the store starts anew (results are the same).
CACHED_WORDS = 600_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json: ``PLUMBLINE_TOKENIZERS`` or the installed public_tokenizers package."""
    folder = os.environ.get("PLUMBLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, "byte_bpe_50k.json")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    stands = {b: chr(b) for b in plain}
    return [stands[b] if b in stands else chr(next(spare)) for b in range(256)]


class MergeReplay:
    """Encodes words; keeps what it encoded in one pool of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[s] for s in _byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        keys = (np.array(self.left, np.int64) << 20) | np.array(self.right, np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.sorted_ranks = keys[order], order
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids) of distinct words, by merges in rank order."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        token = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(token)
        if not n:
            return sizes, token.astype(np.int32)
        ends = np.cumsum(sizes)
        first = np.zeros(n, bool)
        first[(ends - sizes)[sizes > 0]] = True
        # inverted index of the first pairs: positions by rank of the merge that joins them
        at = np.flatnonzero(~first[1:])
        keys = (token[at] << 20) | token[at + 1]
        where = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        hit = self.sorted_keys[where] == keys
        at, ranks = at[hit], self.sorted_ranks[where[hit]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, np.int64)
        places = at.tolist()
        bounds = [*cuts.tolist(), len(places)]
        index = {int(ranks[c]): places[c:bounds[i + 1]] for i, c in enumerate(cuts.tolist())}
        heap = list(index)  # sorted, hence a heap
        tok = token.tolist()
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[first] = -1
        nxt, prv, rank_of = after.tolist(), before.tolist(), self.rank_of
        while heap:
            r = heapq.heappop(heap)
            a, b, made = self.left[r], self.right[r], self.made[r]
            for i in sorted(index.pop(r)):
                j = nxt[i]
                if tok[i] != a or j < 0 or tok[j] != b:
                    continue  # one of the two was taken by an earlier merge
                k = nxt[j]
                tok[i], tok[j], nxt[i] = made, -1, k
                if k >= 0:
                    prv[k] = i
                    s = rank_of.get((made << 20) | tok[k])
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(heap, s)
                p = prv[i]
                if p >= 0:
                    s = rank_of.get((tok[p] << 20) | made)
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(heap, s)
        ids = np.array(tok, np.int32)
        kept = ids >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        return total[ends] - total[ends - sizes], ids[kept]

    def locate(self, words: list[str]) -> np.ndarray:
        """Index of each word in the pool; encodes those it hasn't seen."""
        if len(self.index) > CACHED_WORDS:
            self.clear()
        known, new = self.index, []
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = known.get(w)
            if k is None:
                k = known[w] = len(known)
                new.append(w)
            out[i] = k
        if new:
            sizes, ids = self.replay(new)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, ids])
        return out


@lru_cache(maxsize=2)
def _replayer(path: str) -> MergeReplay:
    return MergeReplay(path)


def _encode(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _replayer(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_words"))
            offsets = np.asarray(lists.offsets, np.int64)
            words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            coded = words.dictionary_encode()
            spot = bpe.locate(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
            sizes = bpe.sizes[spot]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bounds = ends[offsets]
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_words"]
            names = [name for name in batch.schema.names if name != "_words"]
            if counts_only:
                value = pa.array(np.diff(bounds), pa.int64())
            else:
                shift = np.repeat(bpe.starts[spot] - ends[:-1], sizes)
                ids = bpe.pool[shift + np.arange(ends[-1])]
                value = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*keep, value], [*names, "n_tokens" if counts_only else "ids"])

    return run


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0)))


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``ids array<int>``: each text by the vocabulary, without special tokens.

    Null and empty texts give an empty list; blank ones are encoded as they are.  Rows are neither
    dropped nor merged, repeated rows stay repeated, other columns are not read.
    """
    out = _words(spread(df.select(*keep, F.col(text).alias("_text"))), "_text").select(*keep, "_words")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "_words")
    return out.mapInArrow(_encode(vocabulary or default_vocabulary(), False), f"{fields}, ids array<int>")


def token_sizes(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens bigint``: the length of :func:`encode_corpus`' list (0 for null)."""
    out = _words(spread(df.select(*keep, F.col(text).alias("_text"))), "_text").select(*keep, "_words")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "_words")
    return out.mapInArrow(_encode(vocabulary or default_vocabulary(), True), f"{fields}, n_tokens bigint")
