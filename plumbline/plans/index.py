"""Index build: sources to files, symbols, refs, imports, edges and ranks, in whole or by what changed."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.names import CALL_KINDS
from plumbline.operators.imports import resolve_imports
from plumbline.operators.rank import pagerank
from plumbline.operators.resolve import resolve_references
from plumbline.plans.delta import classify, has_work
from plumbline.session import scratch, stage
from plumbline.sources.tables import load
from plumbline.sources.tree import file_facts

TABLES = ("files", "symbols", "refs", "imports", "edges")
_S = "struct<name:string,local:string,kind:string,start_line:int,end_line:int,signature:string,docstring:string,parent:string,exported:boolean>"
_R = "struct<src_local:string,dst_name:string,kind:string,line:int>"
_I = "struct<raw:string,module:string,symbol:string,alias:string,line:int>"
_FACTS = f"path string, lang string, symbols array<{_S}>, refs array<{_R}>, imports array<{_I}>, error string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from plumbline.extract import extractor_for, indexed

    s = pa.struct([("name", pa.string()), ("local", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("parent", pa.string()), ("exported", pa.bool_())])
    r = pa.struct([("src_local", pa.string()), ("dst_name", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
    i = pa.struct([("raw", pa.string()), ("module", pa.string()), ("symbol", pa.string()), ("alias", pa.string()), ("line", pa.int32())])
    names = lambda t: [f.name for f in t]
    for batch in batches:
        path, lang, text = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "lang", "text"))
        rows: list[tuple] = []
        for p, x, t in zip(path, lang, text):
            try:
                extractor = extractor_for(x)
                if extractor is None:
                    raise ValueError(f"no extractor for {x}")
                f = extractor(p, t)
                rows.append(([{k: getattr(d, k) for k in names(s)} for d in map(indexed, f.symbols)], [dict(zip(names(r), v)) for v in f.refs], [dict(zip(names(i), v)) for v in f.imports], None))
            except Exception as e:  # one bad file is a failure row, not a failed job
                rows.append(([], [], [], f"{type(e).__name__}: {e}"))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("path")), batch.column(batch.schema.get_field_index("lang")), pa.array(cols[0], pa.list_(s)), pa.array(cols[1], pa.list_(r)), pa.array(cols[2], pa.list_(i)), pa.array(cols[3], pa.string())],
            ["path", "lang", "symbols", "refs", "imports", "error"],
        )


def extract_facts(files: DataFrame) -> DataFrame:
    """One row per file of (path, lang, text): arrays of symbols, refs and imports, and an error for those that failed."""
    return files.select("path", "lang", "text").where("text IS NOT NULL").mapInArrow(_extract, _FACTS)


def stable_id(*columns):
    """A positive 64-bit id from the columns: the same wherever and whenever it is computed."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def fact_tables(facts: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, refs and imports of extracted facts; ids are hashes, so untouched files keep theirs."""
    head = files.withColumn("id", stable_id("path")).withColumn("indexed_at", F.current_timestamp().cast("timestamp_ntz"))
    modules = head.select("path", F.col("id").alias("file_id"), "module")
    rows = facts.join(modules, "path")
    sym = rows.select("path", "file_id", "module", "lang", F.posexplode("symbols").alias("k", "x")).select("path", "file_id", "module", "lang", "k", "x.*")
    sid = lambda local, line: stable_id(F.col("path"), local, line)
    sym = sym.withColumn("id", sid(F.col("local"), F.col("start_line")))
    parents = sym.groupBy("path", F.col("local").alias("parent")).agg(F.min("id").alias("parent_id"))
    symbols = sym.join(parents, ["path", "parent"], "left").select(
        "id", "file_id", "parent_id", "name", F.concat(F.coalesce("module", F.lit("")), F.lit(":"), F.col("local")).alias("qualname"), "kind", "lang", "start_line", "end_line", "signature", "docstring", "exported", F.lit(0.0).alias("rank")
    ).dropDuplicates(["id"])
    refs = rows.select("path", "file_id", F.posexplode("refs").alias("k", "x")).select(stable_id(F.col("path"), F.lit("ref"), F.col("k")).alias("id"), "file_id", "x.*")
    imports = rows.select("path", "file_id", F.posexplode("imports").alias("k", "x")).select(
        stable_id(F.col("path"), F.lit("import"), F.col("k")).alias("id"), "file_id", "x.raw", "x.module", "x.symbol", "x.alias", F.lit(None).cast("bigint").alias("dst_file_id"), F.lit(True).alias("external"), "x.line"
    )
    return {"files": head.select("id", "path", "lang", "module", "sha256", "size", "lines", "is_test", "indexed_at"), "symbols": symbols, "refs": refs, "imports": imports}


def derive(tables: dict[str, DataFrame], rounds: int = 30) -> dict[str, DataFrame]:
    """The tables with import targets, edges and ranks, all derived anew from the facts."""
    asked = tables["imports"].drop("dst_file_id", "external")
    imports = stage(asked.join(resolve_imports(asked, tables["files"]), "id"), "imports").select("id", "file_id", "raw", "module", "symbol", "alias", "dst_file_id", "external", "line")
    edges = stage(
        resolve_references(tables["refs"], tables["symbols"], tables["files"], imports)
        .withColumn("id", stable_id("ref_id", F.coalesce("dst_id", F.lit(0)))).select("id", "src_id", "dst_id", "dst_name", "kind", "line", "confidence", "reason"),
        "edges",
    )
    calls = edges.where(F.col("kind").isin(*CALL_KINDS) & F.col("dst_id").isNotNull()).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("confidence").alias("weight"))
    scores = pagerank(calls, tables["symbols"].select("id"), iterations=rounds)
    symbols = tables["symbols"].drop("rank").join(scores.withColumnRenamed("score", "rank"), "id", "left").fillna(0.0, ["rank"])
    return {**tables, "imports": imports, "edges": edges, "symbols": symbols}


class Snapshots:
    """Immutable versions of the tables below one folder; a pointer names the current one, so readers see all or nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self):
        return self._path(f"{self.folder}/CURRENT.json")

    def meta(self) -> dict | None:
        """The pointer's contents, or None before the first version."""
        if not self._fs.exists(self._pointer()):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/CURRENT.json", wholetext=True).collect()))

    def current(self) -> str:
        """Folder of the current version; FileNotFoundError before the first."""
        meta = self.meta()
        if meta is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return f"{self.folder}/v{meta['version']}"

    def commit(self, tables: dict[str, DataFrame], **meta) -> str:
        """Write a new version and make it current."""
        version = self._last() + 1  # a folder that a failed run left is never written again
        target = f"{self.folder}/v{version}"
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        self.put(version=version, schema=1, built_at=int(time.time()), **meta)
        return target

    def _last(self) -> int:
        if not self._fs.exists(self._path(self.folder)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def put(self, **values) -> None:
        """Set keys of the pointer.  It is written aside and renamed over the old one, so there always is a whole one."""
        draft = self._path(f"{self.folder}/CURRENT.next")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({**(self.meta() or {}), **values}).encode()))
        out.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._pointer()), over)

    def get(self, key: str, default=None):
        return (self.meta() or {}).get(key, default)

    def size(self) -> int:
        """Bytes of the folder."""
        return self._fs.getContentSummary(self._path(self.folder)).getLength()

    def compact(self, rows_per_file: int = 2_000_000) -> str:
        """Write the current version anew in files of about so many rows, with their numbers in the pointer."""
        old = self.current()
        tables, rows = {}, {}
        for name in TABLES:
            table = load(self.spark, old, name)
            rows[name] = table.count()
            tables[name] = table.repartition(max(1, -(-rows[name] // rows_per_file)))
        return self.commit(tables, rows=rows)

    def expire(self, keep: int = 2) -> list[int]:
        """Delete all but the last ``keep`` versions; never the current one.  Returns those that went."""
        current = self.get("version", 0)
        gone = [v for v in range(1, self._last() + 1) if v <= current - keep and self._fs.exists(self._path(f"{self.folder}/v{v}"))]
        for v in gone:
            self._fs.delete(self._path(f"{self.folder}/v{v}"), True)
        return gone


def build(spark: SparkSession, sources: DataFrame, folder: str, force: bool = False, complete: bool = True, rounds: int = 30) -> dict:
    """Bring the index in ``folder`` up to (path, lang, content or text) of ``sources``.

    Only files whose hash changed are extracted; edges and ranks are derived anew if any file was, since a new symbol can
    change how any reference resolves, and left alone otherwise.  Files that fail are reported and tried again by the next run.  ``complete`` sources are the whole tree: files
    that aren't in it are removed.  ``rounds`` bounds the ranking.  Returns counts by state, and failures as (path, error).
    What is staged on the way is deleted at the end.
    """
    with scratch(spark):
        return _build(spark, sources, folder, force, complete, rounds)


def _build(spark: SparkSession, sources: DataFrame, folder: str, force: bool, complete: bool, rounds: int) -> dict:
    shots = Snapshots(spark, folder)
    files = stage(file_facts(sources), "sources")
    unread = files.where("sha256 IS NULL").select("path")
    files = files.where("sha256 IS NOT NULL")
    known = None if force or shots.meta() is None else shots.current()
    old = {n: load(spark, known, n) for n in TABLES} if known else None
    # what can't be read now keeps the rows it has
    before = old["files"].select("path", "sha256").join(unread, "path", "left_anti") if old else spark.createDataFrame([], "path string, sha256 string")
    states = classify(before, files.select("path", "sha256"))
    if not complete:
        states = states.where("state <> 'removed'")
    states = stage(states, "states")
    counts = {r[0]: r[1] for r in states.groupBy("state").agg(F.count("*")).collect()}  # at most four rows
    tally: dict[str, dict[str, int]] = {}  # a row for each language and state
    langs = files.select("path", "lang") if not old else files.select("path", "lang").unionByName(old["files"].select("path", "lang").join(files.select("path"), "path", "left_anti"))
    for r in states.join(langs, "path").groupBy("lang", "state").agg(F.count("*").alias("n")).collect():
        tally.setdefault(r["lang"], {})[r["state"]] = r["n"]
    if old and not has_work(states):
        return {"version": shots.meta()["version"], "states": counts, "languages": tally, "failures": []}
    fresh = files.join(states.where("state IN ('added', 'changed')"), "path", "left_semi")
    facts = stage(extract_facts(fresh), "facts")
    failed = facts.where("error IS NOT NULL").select("path", "error")
    failures = [tuple(r) for r in failed.toLocalIterator()]
    if old and not counts.get("changed") and not counts.get("removed") and facts.where("error IS NULL").isEmpty():
        # only files that failed before and failed again
        return {"version": shots.meta()["version"], "states": counts, "languages": tally, "failures": failures}
    tables = fact_tables(facts.where("error IS NULL"), fresh.join(failed, "path", "left_anti"))
    if old:
        gone = old["files"].join(states.where("state <> 'unchanged'"), "path", "left_semi").select(F.col("id").alias("file_id"))
        keep = lambda t, key: old[t].join(gone.withColumnRenamed("file_id", key), key, "left_anti")
        tables = {
            "files": keep("files", "id").unionByName(tables["files"]),
            "symbols": keep("symbols", "file_id").unionByName(tables["symbols"]),
            "refs": keep("refs", "file_id").unionByName(tables["refs"]),
            "imports": keep("imports", "file_id").unionByName(tables["imports"]),
        }
    tables = {n: stage(t, n) for n, t in tables.items()}
    target = shots.commit(derive(tables, rounds), files=counts)
    return {"version": int(target.rsplit("/v", 1)[1]), "states": counts, "languages": tally, "failures": failures}
