"""Resolution of references to symbols by a cascade of rules, each with its confidence.

For every rule the candidates are brought down to the one that would be chosen per key *before* the references are joined:
(file, name), (file, container, name), (container, name), (module, name), name.  A reference so meets at
most one row per rule, and a name that is defined and used very often never multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.names import CONTAINER_KINDS, TYPE_KINDS, local_qualname, receiver_of, tail_of
from plumbline.session import counted, stage

#: Confidence of each reason.
CONFIDENCE = {"same-file": 0.95, "import": 0.9, "receiver-type": 0.85, "same-module": 0.75, "unique-global": 0.6, "name-only": 0.45}
AMBIGUOUS_CONFIDENCE = 0.4
MAX_AMBIGUOUS = 3
EDGE_COLUMNS = ["ref_id", "src_id", "dst_id", "dst_name", "kind", "line", "confidence", "reason"]


def _pick(condition: Column | None = None) -> Column:
    """The candidate with the shortest, then first qualname, then id."""
    key = F.struct(F.length("qualname").alias("l"), F.col("qualname").alias("q"), F.col("id").alias("i"))
    return F.min(key if condition is None else F.when(condition, key))["i"]


def _table(symbols: DataFrame, keys: list[str], typed: bool) -> DataFrame:
    """Per key the pick of all symbols and, if ``typed``, of the type-like ones."""
    aggs = [_pick().alias("pick")]
    if typed:
        aggs.append(_pick(F.col("kind").isin(*TYPE_KINDS)).alias("pick_type"))
    return symbols.groupBy(*keys).agg(*aggs)


def resolve_references(refs: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges (:data:`EDGE_COLUMNS`) of the references that lie in a symbol; those at module level give none.

    ``imports`` needs dst_file_id.  Of duplicate symbols (file, qualname) and aliases (file, name) the last row,
    by id, holds.  Ambiguous references give up to three edges, all others one.
    """
    modules = files.select(F.col("id").alias("file_id"), "module")
    parents = symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    syms = stage(
        symbols.select("id", "file_id", "parent_id", "name", "qualname", "kind").join(parents, "parent_id", "left").join(modules, "file_id").drop("parent_id"),
        "resolve-symbols",
    )
    owners = syms.groupBy("file_id", local_qualname(F.col("qualname")).alias("src_local")).agg(F.max("id").alias("src_id"))
    alias_key = F.coalesce("alias", "symbol")
    latest = (
        imports.select("file_id", alias_key.alias("key"), F.struct("id", F.col("dst_file_id").alias("to"), F.col("symbol").alias("sym")).alias("v"))
        .where("key IS NOT NULL").groupBy("file_id", "key").agg(F.max("v").alias("v"))
        .select("file_id", "key", F.col("v.to").alias("to"), F.col("v.sym").alias("sym"))
    )
    name = F.col("dst_name")
    base = (
        refs.select(F.col("id").alias("ref_id"), "file_id", "src_local", "dst_name", "kind", "line")
        .join(owners, ["file_id", "src_local"]).join(modules, "file_id")
        .withColumn("tail", tail_of(name)).withColumn("receiver", receiver_of(name))
        .withColumn("rt", tail_of(F.col("receiver")))
        .withColumn("owner", receiver_of(F.col("src_local")))
    )
    by_name = syms.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(*TYPE_KINDS)).alias("n_type"))
    base = stage(base.join(by_name.withColumnRenamed("name", "tail"), "tail", "left"), "resolve-refs")
    # --- references without any symbol of their name ------------------------------------------
    outside = imports.where("external").select("file_id", F.explode(F.array(alias_key, "symbol", F.substring_index(F.substring_index("module", ".", 1), "/", 1))).alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    lost = base.where("n IS NULL").withColumn("root", F.substring_index("dst_name", ".", 1))
    ext = (
        lost.select("ref_id", "file_id", F.explode(F.array_distinct(F.array("root", "tail"))).alias("word"))
        .join(outside, ["file_id", "word"], "left_semi").select("ref_id").distinct().withColumn("ext", F.lit(True))
    )
    misses = lost.join(ext, "ref_id", "left").select(
        "ref_id", "src_id", F.lit(None).cast("bigint").alias("dst_id"), "dst_name", "kind", "line", F.lit(0.0).alias("confidence"),
        F.when(F.col("ext"), "external").otherwise("unresolved").alias("reason"),
    )
    # --- one candidate per rule ---------------------------------------------------------------
    hits = base.where("n IS NOT NULL").withColumn("typed", F.col("kind").isin("inherits", "instantiates") & (F.col("n_type") > 0))
    g = lambda p: F.when(F.col("typed"), F.col(f"{p}.pick_type")).otherwise(F.col(f"{p}.pick"))
    # written once, as several rules read them, and sent to every task where they were counted to be small
    in_file = counted(_table(syms, ["file_id", "name"], True), "resolve-in-file")
    in_container = counted(_table(syms.where("parent IS NOT NULL"), ["file_id", "parent", "name"], False), "resolve-in-container")
    of_container = counted(_table(syms.where("parent IS NOT NULL"), ["parent", "name"], False), "resolve-of-container")
    in_module = counted(_table(syms, ["module", "name"], True), "resolve-in-module")
    containers = syms.where(F.col("kind").isin(*CONTAINER_KINDS)).select(F.col("name").alias("container")).distinct()
    latest = counted(latest, "resolve-aliases")

    def look(df: DataFrame, table: DataFrame, on: dict[str, str], out: str, grouped: bool) -> DataFrame:
        cond = None
        for left, right in on.items():
            c = F.col(f"r.{left}") == F.col(f"{out}.{right}")
            cond = c if cond is None else cond & c
        value = g(out) if grouped else F.col(f"{out}.pick")
        return df.alias("r").join(table.alias(out), cond, "left").select("r.*", value.alias(out))

    rows = look(hits, in_file, {"file_id": "file_id", "tail": "name"}, "c1", True)
    for key, k in (("receiver", "ar"), ("tail", "al")):
        rows = (
            rows.alias("r").join(latest.alias("m"), (F.col("r.file_id") == F.col("m.file_id")) & (F.col(f"r.{key}") == F.col("m.key")), "left")
            .select("r.*", F.col("m.to").alias(f"{k}_to"), F.col("m.sym").alias(f"{k}_sym"))
        )
        rows = look(rows, in_file, {f"{k}_to": "file_id", "tail": "name"}, f"{k}_file", True)
        rows = look(rows, in_container, {f"{k}_to": "file_id", f"{k}_sym": "parent", "tail": "name"}, f"{k}_member", False)
    rows = rows.alias("r").join(containers.alias("k"), F.col("r.rt") == F.col("k.container"), "left").select("r.*", F.col("k.container"))
    rows = look(rows, of_container, {"container": "parent", "tail": "name"}, "c3", False)
    rows = rows.withColumn("self_owner", F.when(F.col("rt").isin("self", "this", "cls"), F.col("owner")))
    rows = look(rows, of_container, {"self_owner": "parent", "tail": "name"}, "c3b", False)
    rows = look(rows, in_module, {"module": "module", "tail": "name"}, "c4", True)
    imported = F.coalesce("ar_file", "ar_member", "al_file", "al_member")
    typed_receiver = F.coalesce("c3", "c3b")
    rows = rows.withColumn("dst_id", F.coalesce("c1", imported, typed_receiver, "c4")).withColumn(
        "reason",
        F.when(F.col("c1").isNotNull(), "same-file").when(imported.isNotNull(), "import").when(typed_receiver.isNotNull(), "receiver-type").when(F.col("c4").isNotNull(), "same-module"),
    )
    rows = stage(rows.select("ref_id", "src_id", "dst_id", "dst_name", "kind", "line", "reason", "tail", "receiver", "typed", F.when(F.col("typed"), F.col("n_type")).otherwise(F.col("n")).alias("count")), "resolved")
    conf = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    sure = rows.where("dst_id IS NOT NULL").withColumn("confidence", conf[F.col("reason")]).select(*EDGE_COLUMNS)
    # --- by name alone: the first three of each name, all or type-like ------------------------
    order = [F.when(F.col("kind") == "function", 0).otherwise(1), F.col("qualname"), F.col("id")]
    both = syms.select("id", "name", "qualname", "kind", F.lit(False).alias("typed")).unionByName(
        syms.where(F.col("kind").isin(*TYPE_KINDS)).select("id", "name", "qualname", "kind", F.lit(True).alias("typed"))
    )
    first = (
        both.withColumn("k", F.row_number().over(W.partitionBy("name", "typed").orderBy(*order))).where(F.col("k") <= MAX_AMBIGUOUS)
        .select(F.col("name").alias("tail"), "typed", F.col("id").alias("dst_id"))
    )
    single = F.col("count") == 1
    loose = (
        rows.where("dst_id IS NULL").drop("dst_id", "reason").join(first, ["tail", "typed"])
        .withColumn("reason", F.when(~single, "ambiguous").when(F.col("receiver").isNull(), "unique-global").otherwise("name-only"))
        .withColumn("confidence", F.when(single, conf[F.col("reason")]).otherwise(F.least(F.lit(AMBIGUOUS_CONFIDENCE), F.lit(1.0) / F.col("count"))))
        .select(*EDGE_COLUMNS)
    )
    return sure.unionByName(loose).unionByName(misses)


def resolution_report(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(reason, n) of the edges, and the references that lie in no symbol as module-level."""
    dropped = refs.select(F.col("id").alias("ref_id")).join(edges.select("ref_id"), "ref_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("module-level").alias("reason"), "n")
    return edges.groupBy("reason").agg(F.count("*").alias("n")).unionByName(dropped)
