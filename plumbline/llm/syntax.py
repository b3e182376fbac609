"""Problem 3: source files that are not valid in the language they claim.

1. Every text is lexed where it is read, into token classes; they become rows, one for each token and the one after it.
2. The rows are anti-joined against the pairs that the language's grammar permits (:mod:`.grammar.pairs` derives
   them from the first and last tokens of its rules).  What is left names files with an impossible pair; what a lexer
   can't read is a token that no pair permits.
3. The brackets (and Python's indented suites) become rows, each with the tokens before it.  Windows over a
   text give the depth, the bracket that opened each group, and thereby the nesting; windows over a text's depth give the
   groups; their tokens are joined to one production a group, nested groups being one symbol.
4. Productions are validated, each different one once a worker; a valid one says what its nested groups have to be.

Texts aren't shuffled; what leaves the lexing tasks is token classes.  Windows are over one text each, so none is
larger than a text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.grammar import CLOSES, END, START, golang, pairs, pylang, script, validate
from plumbline.session import spread, stage
from plumbline.sources.tables import latest_files

LANGUAGES = ("python", "javascript", "typescript", "tsx", "go")
#: The bracket that ends what a token class opens.
OPENS = {**pylang.OPENS, **golang.OPENS, **script.OPENS}
_PIECE = re.compile(f"[^{re.escape(''.join(OPENS) + CLOSES)}]*[{re.escape(''.join(OPENS) + CLOSES + END)}]")


#: A text's first piece begins with its language, as a character from here on that no token class has.
_LANGUAGE = 0xF00


def lex(text: str, lang: str) -> str:
    """One character for each token class of a text."""
    if lang == "python":
        return pylang.lex(text)
    return golang.lex(text) if lang == "go" else script.lex(text, lang)


def productions_hold(groups: list[tuple[int, str]], lang: str, memory: dict) -> bool:
    """Whether the groups, (depth, symbols) in the order of their openings, are valid productions."""
    if lang == "python":
        return validate(groups, pylang.parse, pylang.cut, memory)
    if lang == "go":
        return validate(groups, golang.parse, golang.cut, memory)
    return validate(groups, lambda s, k: script.parse(s, k, lang), script.cut, memory)


def _code(lang: str, a: str, b: str) -> int:
    """A pair of token classes as one number."""
    return LANGUAGES.index(lang) << 32 | ord(a) << 16 | ord(b)


def permissible_pairs(spark) -> DataFrame:
    """(pair): some thousand rows of each language, whatever the data."""
    return spark.createDataFrame([(_code(lang, a, b),) for lang in LANGUAGES for a, b in sorted(pairs.permitted(lang))], "pair bigint")


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, lang = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "lang"))
        flat = [START + lex(t, x) + END for t, x in zip(text, lang)]
        sizes = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        # all classes are below 2 ** 16, so a code unit is a token
        tokens = np.frombuffer("".join(flat).encode("utf-16-le"), np.uint16).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("file_id")),
                batch.column(batch.schema.get_field_index("lang")),
                pa.ListArray.from_arrays(pa.array(sizes), pa.array(tokens)),
                pa.array([_PIECE.findall(chr(_LANGUAGE + LANGUAGES.index(x)) + s[1:]) for s, x in zip(flat, lang)], pa.list_(pa.string())),
            ],
            ["file_id", "lang", "tokens", "pieces"],
        )


def lexed_files(documents: DataFrame) -> DataFrame:
    """(doc, file_id, lang, tokens, pieces) of every non-null source text in one of :data:`LANGUAGES`, as a staged table.

    tokens: the classes, from :data:`START` to :data:`END`; pieces: the same cut after each bracket, with the language in
    place of the start.
    """
    texts = documents.where(F.col("file_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*LANGUAGES)).select("file_id", "lang", "text")
    lexed = spread(texts).mapInArrow(_lex, "file_id bigint, lang string, tokens array<int>, pieces array<string>")
    return stage(lexed.withColumn("doc", F.monotonically_increasing_id()), "tokens")


def impossible_pairs(lexed: DataFrame) -> DataFrame:
    """(file_id, pair): a row for each token of a text that can't stand before the next one in any valid text."""
    n = F.size("tokens") - 1
    code = F.lit(0)
    for lang in LANGUAGES[1:]:
        code = F.when(F.col("lang") == lang, LANGUAGES.index(lang)).otherwise(code)
    rows = lexed.select("file_id", code.alias("l"), F.inline(F.arrays_zip(F.slice("tokens", F.lit(1), n).alias("a"), F.slice("tokens", F.lit(2), n).alias("b"))).alias("a", "b"))
    rows = rows.select("file_id", (F.shiftleft(F.col("l").cast("bigint"), 32) + F.col("a") * 65536 + F.col("b")).alias("pair"))
    return rows.join(F.broadcast(permissible_pairs(lexed.sparkSession)), "pair", "left_anti")


def bracket_groups(lexed: DataFrame) -> DataFrame:
    """(doc, file_id, depth, nth, at, symbols, fits) of every bracket group: ``at`` orders the groups of a text by their
    openings, ``symbols`` has the opening of each group inside it, ``fits`` is false where a bracket ends what it didn't begin.
    """
    # by text before anything is derived, so that only what can't be derived is shuffled
    rows = lexed.select("doc", "file_id", F.posexplode("pieces").alias("at", "piece")).repartition("doc").withColumn("edge", F.right("piece", F.lit(1)))
    opens = F.col("edge").isin(*OPENS)
    closes = F.col("edge").isin(*CLOSES)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    text = W.partitionBy("doc").orderBy("at")
    upto = text.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("depth", (F.sum(step).over(upto) - step).cast("int")).withColumn("before", F.lag("edge").over(text))
    rows = rows.withColumn("began", F.when(F.col("before").isin(*OPENS), F.col("before")))
    level = W.partitionBy("doc", "depth").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", F.last("began", ignorenulls=True).over(level).alias("opened"), F.count("began").over(level).alias("nth"))
    ends = F.lit(END)
    for k, v in OPENS.items():
        ends = F.when(F.col("opened") == k, v).otherwise(ends)
    own = F.when(opens, F.col("piece")).otherwise(F.expr("left(piece, length(piece) - 1)"))
    return rows.groupBy("doc", "depth", "nth").agg(
        F.min("file_id").alias("file_id"),
        F.min("at").alias("at"),
        F.array_join(F.sort_array(F.collect_list(F.struct("at", own.alias("own"))))["own"], "").alias("symbols"),
        F.min((F.col("depth") >= 0) & (opens | (F.col("edge") == ends))).alias("fits"),
    )


_memories: dict[str, dict] = {}


def _validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    for batch in batches:
        groups = batch.column(batch.schema.get_field_index("groups"))
        depth, symbols = groups.flatten().field("depth").to_pylist(), groups.flatten().field("symbols").to_pylist()
        bounds = groups.offsets.to_pylist()
        shift = bounds[0]
        kept = []
        for a, b in zip(bounds, bounds[1:]):
            a, b = a - shift, b - shift
            if a == b:
                kept.append(True)
                continue
            lang, symbols[a] = LANGUAGES[ord(symbols[a][0]) - _LANGUAGE], symbols[a][1:]
            kept.append(not productions_hold(list(zip(depth[a:b], symbols[a:b])), lang, _memories.setdefault(lang, {})))
        yield batch.select(["file_id"]).filter(pa.array(kept, pa.bool_()))


def invalid_files(documents: DataFrame) -> DataFrame:
    """(file_id) of the files with a text that is not syntactically valid in the language of its row.

    Python 3.13, ECMAScript 2022 modules with JSX, TypeScript 5 without and with JSX, Go 1.22 files.  Only
    syntax counts.  Empty and blank texts are valid except in Go; null texts, null ids and other languages aren't judged; a file
    with several texts is invalid if one is.  A text nested too deeply for a parser is taken as valid, in every language.
    """
    lexed = lexed_files(documents)
    texts = bracket_groups(lexed).groupBy("doc").agg(
        F.min("file_id").alias("file_id"), F.min("fits").alias("fits"), F.sort_array(F.collect_list(F.struct("at", "depth", "symbols"))).alias("groups")
    )
    # one pass for both: the groups of a text whose brackets don't fit aren't parsed
    wrong = texts.select("file_id", F.when(F.col("fits"), F.col("groups")).alias("groups")).mapInArrow(_validate, "file_id bigint")
    return impossible_pairs(lexed).select("file_id").unionByName(wrong).distinct()


def invalid_rates(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_invalid, rate) over the files with a non-null text; the repository is the path's first segment."""
    judged = documents.where(F.col("file_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*LANGUAGES)).select("file_id", "lang").distinct()
    paths = latest_files(files, "id", "path").select(F.col("id").alias("file_id"), F.substring_index("path", "/", 1).alias("repo"))
    bad = invalid_files(documents).withColumn("bad", F.lit(1))
    return (
        judged.join(paths, "file_id").join(bad, "file_id", "left")
        .groupBy("repo", "lang")
        .agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
