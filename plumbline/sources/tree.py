"""Source trees: which files to index, and their contents, read by the executors."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.names import is_test_path, language_of, module_key

#: Directories that are never indexed.
IGNORED_DIRS = (
    ".git .hg .svn .venv venv env node_modules vendor __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox dist build target out .next .nuxt .svelte-kit"
    " site-packages third_party .idea .vscode coverage .plumbline"
).split()
#: Suffixes of generated and bundled files.
SKIPPED_SUFFIXES = (".min.js", ".min.mjs", ".bundle.js", "_pb2.py", "_pb2.pyi", ".pb.go", "_pb.js")
#: Fixed value: larger files are left out unless ``max_bytes`` says otherwise.
MAX_BYTES = 1_500_000


def git_files(root: str) -> list[str] | None:
    """Paths that git tracks or would track below ``root``; None where git has no answer within a minute."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return [p for p in out.stdout.decode(errors="replace").split("\0") if p]


def indexable(files: DataFrame, languages: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (path, length, ...) of source files: known language, no ignored or hidden directory, no skipped suffix, not too large."""
    path = F.col("path")
    rows = files.withColumn("lang", language_of(path)).where(F.col("lang").isNotNull() & (F.col("length") <= max_bytes))
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    rows = rows.where(~F.exists(folders, lambda x: x.isin(*IGNORED_DIRS) | F.startswith(x, F.lit("."))))
    for suffix in SKIPPED_SUFFIXES:
        rows = rows.where(~F.endswith(path, F.lit(suffix)))
    return rows if languages is None else rows.where(F.col("lang").isin(*languages))


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, lang, length, content) of the files to index below ``root``; paths are relative to it.

    Spark lists the files, names and sizes decide which of them are indexed, and only those are opened, by the
    executors; a file that can't be read has a null content.  What git ignores is left out where ``root`` is a checkout.
    """
    root = os.path.abspath(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    prefix = f"file:{root}/"
    rows = found.withColumn("path", F.expr(f"substring(path, {len(prefix) + 1})")).select("path", "length")  # no contents here
    tracked = git_files(root)
    if tracked is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in tracked] or [("",)], "path string"), "path", "left_semi")
    chosen = indexable(rows, languages, max_bytes).select("path", "lang", "length")
    return chosen.mapInArrow(_reader(root), "path string, lang string, length bigint, content binary")


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.binary())], [*one.schema.names, "content"])

    return run


def file_facts(sources: DataFrame) -> DataFrame:
    """(path, lang, module, sha256, size, lines, is_test, text) of (path, lang, content)."""
    text = F.decode("content", "UTF-8") if dict(sources.dtypes).get("content") == "binary" else F.col("text")
    rows = sources.withColumn("text", text)
    raw = F.col("content") if "content" in sources.columns else F.encode("text", "UTF-8")
    return rows.select(
        "path", "lang", module_key(F.col("path"), F.col("lang")).alias("module"), F.sha2(raw, 256).alias("sha256"), F.length(raw).cast("bigint").alias("size"),
        F.when(F.length("text") == 0, 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint").alias("lines"),
        is_test_path(F.col("path")).alias("is_test"), "text",
    )
