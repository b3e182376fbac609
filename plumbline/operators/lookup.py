"""Ranked lookup of symbols and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import like, plain_rank

SYMBOL_COLUMNS = ["id", "name", "qualname", "kind", "lang", "path", "start_line", "end_line", "signature", "docstring", "rank"]


def symbol_view(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path of their file and a plain rank; symbols without a file row are left out."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("rank", plain_rank(F.col("rank"))).select(*SYMBOL_COLUMNS)


def find_symbols(view: DataFrame, name: str, kind: str | None = None, lang: str | None = None, limit: int = 20, exact: bool = False) -> DataFrame:
    """Symbols by name or qualname, exact ones first, then qualname suffixes, then other hits; then by rank.

    Ties go to the shorter qualname, then its order, then the smaller id.  Matching beyond equality is
    case-insensitive with live wildcards.  Rows of ``view`` that arrive twice count once, after the filter.
    """
    name_, qual = F.col("name"), F.col("qualname")
    hit = (name_ == name) | (qual == name)
    if not exact:
        hit = hit | like(name_, name + "%") | like(qual, "%" + name)
    rows = view.where(hit)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    tier = F.when((name_ == name) | (qual == name), 0).when(like(qual, "%" + name), 1).otherwise(2)
    return rows.dropDuplicates(["id"]).withColumn("tier", tier).orderBy("tier", F.desc("rank"), F.length("qualname"), "qualname", "id").limit(limit)


def resolve_selector(view: DataFrame, selector: str, limit: int = 5) -> DataFrame:
    """Symbols that a selector means: an id, a qualname, ``path:name``, else what :func:`find_symbols` gives.

    Each form is tried only if the one before it has no rows.
    """
    selector = selector.strip()
    if selector.isdigit():
        return view.where(F.col("id") == int(selector))
    if ":" in selector:
        rows = view.where(F.col("qualname") == selector).orderBy(F.desc("rank"), "id").limit(limit)
        if not rows.isEmpty():
            return rows
        path, _, name = selector.rpartition(":")
        rows = (
            view.where(((F.col("path") == path) | like(F.col("path"), "%" + path)) & ((F.col("name") == name) | like(F.col("qualname"), "%" + name)))
            .orderBy(F.desc("rank"), "id").limit(limit)
        )
        if not rows.isEmpty():
            return rows
    return find_symbols(view, selector, limit=limit).drop("tier")


def match_files(files: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Files whose path is or contains the pattern, the shortest first (ties by path)."""
    return files.where((F.col("path") == pattern) | like(F.col("path"), f"%{pattern}%")).orderBy(F.length("path"), "path").limit(limit)


def symbols_in_file(view: DataFrame, path: str, limit: int = 200) -> DataFrame:
    """Symbols of a file by line (ties by id)."""
    return view.where(F.col("path") == path).orderBy("start_line", "id").limit(limit)


def members(symbols: DataFrame) -> DataFrame:
    """(owner_id, id) of symbols whose qualname goes on after another one's in the same file."""
    child = symbols.where(F.instr(F.substring_index("qualname", ":", -1), ".") > 0).select(
        "file_id", F.col("id").alias("child"), F.regexp_replace("qualname", r"\.[^.:]*$", "").alias("q")
    )
    owner = symbols.select("file_id", F.col("id").alias("owner_id"), F.col("qualname").alias("q"))
    return child.join(owner, ["file_id", "q"]).select("owner_id", F.col("child").alias("id"))


def symbol_source(symbols: DataFrame, texts: DataFrame, context: int = 0) -> DataFrame:
    """(id, source): lines start_line - context to end_line + context of the file's text.

    ``texts`` has (file_id, text); symbols of files without a text have a null source.
    """
    first = F.greatest(F.lit(1), F.col("start_line") - context)
    size = F.greatest(F.lit(0), F.col("end_line") + context - first + 1)
    # lines are split before the join: a file's text is split once, not once for each of its symbols
    split = texts.select("file_id", F.split("text", "\n").alias("lines"))
    return symbols.select("id", "file_id", "start_line", "end_line").join(split, "file_id", "left").select("id", F.array_join(F.slice("lines", first, size), "\n").alias("source"))
