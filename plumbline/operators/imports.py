"""Import resolution: which file an import means.

Every rule is an equality join: the suffix rule meets a table of all suffixes of the module keys, each with
the number of keys that have it, instead of comparing every import with every module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage


def module_map(files: DataFrame) -> DataFrame:
    """(module, path): the last path, in order, of each module."""
    return files.where("module IS NOT NULL").groupBy("module").agg(F.max("path").alias("path"))


def suffixes(modules: DataFrame, sep: str) -> DataFrame:
    """Every suffix of the module keys cut at ``sep``, with the number of keys that end in it after a separator
    (n_proper) and of keys of which it is the last segment (n_last), and the greatest path of either.
    """
    parts = F.split("module", "\\" + sep if sep == "." else sep)
    n = F.size("p")
    rows = modules.select("path", parts.alias("p")).select(
        "path", "p", F.explode(F.sequence(F.lit(1), n)).alias("k")
    ).select("path", F.array_join(F.slice("p", F.col("k"), n - F.col("k") + 1), sep).alias("suffix"), (F.col("k") > 1).alias("proper"), (F.col("k") == n).alias("last"))
    return rows.groupBy("suffix").agg(
        F.count_if("proper").alias("n_proper"),
        F.max(F.when(F.col("proper"), F.col("path"))).alias("path_proper"),
        F.count_if("last").alias("n_last"),
        F.max(F.when(F.col("last"), F.col("path"))).alias("path_last"),
    )


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target, sep, symbol): what each import asks for; target is null for packages outside.

    Python: a relative import starts at the importer's own module key and drops a segment for each dot after
    the first.  Scripts: relative paths are normalised, ``@/``, ``~/`` and ``#/`` mean the source root, bare names
    are outside.  Go: the import path.
    """
    src = files.select(F.col("id").alias("file_id"), "path", "lang", F.col("module").alias("own"))
    rows = imports.select("id", "file_id", F.coalesce("module", F.lit("")).alias("m"), "symbol").join(src, "file_id")
    dots = F.length("m") - F.length(F.regexp_replace("m", r"^\.+", ""))
    rest = F.regexp_replace("m", r"^\.+", "")
    own = F.split("own", r"\.")
    base = F.when(dots <= F.size(own), F.array_join(F.slice(own, F.lit(1), F.greatest(F.lit(0), F.size(own) - dots + 1)), ".")).otherwise(F.lit(""))
    relative = F.when(rest == "", base).when(base == "", rest).otherwise(F.concat(base, F.lit("."), rest))
    python = F.when(F.startswith(F.col("m"), F.lit(".")), relative).otherwise(F.col("m"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit("."))
    steps = F.split(F.concat(folder, F.lit("/"), F.col("m")), "/")
    walked = F.aggregate(
        steps,
        F.expr("CAST(array() AS array<string>)"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)))
        .otherwise(F.array_append(acc, x)),
    )
    script = F.when(F.startswith(F.col("m"), F.lit(".")), F.array_join(walked, "/")).when(F.col("m").rlike("^[@~#]/"), F.col("m").substr(F.lit(3), F.length("m")))
    target = F.when(F.col("lang") == "python", python).when(F.col("lang") == "go", F.col("m")).otherwise(script)
    return rows.select("id", "lang", target.alias("target"), F.when(F.col("lang") == "python", ".").otherwise("/").alias("sep"), "symbol")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, dst_file_id, external) of every import of a known file.

    Tried in order: the named submodule (Python), the module itself, its index (scripts), the only module key that ends in
    it, the only key whose last segment is its last.  More than one key is no answer.
    """
    modules = stage(module_map(files), "modules")
    asked = stage(import_targets(imports, files), "imports-asked")
    exact = modules.select(F.col("module").alias("key"), F.col("path").alias("hit"))
    wanted = asked.where("target IS NOT NULL AND target <> ''")
    named = F.when(F.col("lang") == "python", F.concat(F.col("target"), F.lit("."), F.col("symbol"))).when(F.col("lang") == "go", F.lit(None)).otherwise(F.concat(F.col("target"), F.lit("/index")))
    itself = F.when(F.col("lang") != "go", F.col("target"))
    # the order of the two exact forms differs by language, so both are fetched
    rows = (
        wanted.withColumn("k1", named).withColumn("k2", itself)
        .join(exact.withColumnsRenamed({"key": "k1", "hit": "h1"}), "k1", "left")
        .join(exact.withColumnsRenamed({"key": "k2", "hit": "h2"}), "k2", "left")
        .withColumn("hit", F.when(F.col("lang") == "python", F.coalesce("h1", "h2")).otherwise(F.coalesce("h2", "h1")))
    )
    rows = rows.select("id", "target", "sep", "hit", F.substring_index("target", ".", -1).alias("t1"), F.substring_index("target", "/", -1).alias("t2"))
    rows = rows.withColumn("last", F.when(F.col("sep") == ".", F.col("t1")).otherwise(F.col("t2"))).drop("t1", "t2")
    table = suffixes(modules, ".").withColumn("sep", F.lit(".")).unionByName(suffixes(modules, "/").withColumn("sep", F.lit("/")))
    by_suffix = table.where("n_proper = 1").select("sep", F.col("suffix").alias("target"), F.col("path_proper").alias("s1"))
    by_last = table.where("n_last = 1").select("sep", F.col("suffix").alias("last"), F.col("path_last").alias("s2"))
    path = (
        rows.join(by_suffix, ["sep", "target"], "left").join(by_last, ["sep", "last"], "left")
        .select("id", F.coalesce("hit", "s1", "s2").alias("path"))
    )
    ids = files.select(F.col("id").alias("dst_file_id"), "path")
    found = path.where("path IS NOT NULL").join(ids, "path").select("id", "dst_file_id")
    return asked.select("id").join(found, "id", "left").select("id", "dst_file_id", F.col("dst_file_id").isNull().alias("external"))
