"""The tables of an indexed workspace, cleaned of repeated and outdated rows, ready for the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.lookup import symbol_view
from plumbline.sources.tables import distinct_by_id, latest_files, load


@dataclass
class Workspace:
    """Lazily read tables of a folder; the columns that a query doesn't use are pruned from the scans."""

    spark: SparkSession
    folder: str

    @cached_property
    def files(self) -> DataFrame:
        return latest_files(load(self.spark, self.folder, "files"), "id", "path", "lang", "module", "sha256", "size", "lines", "is_test", "indexed_at")

    @cached_property
    def symbols(self) -> DataFrame:
        return distinct_by_id(
            load(self.spark, self.folder, "symbols"), "file_id", "parent_id", "name", "qualname", "kind", "lang", "start_line", "end_line", "signature", "docstring", "exported", "rank"
        )

    @cached_property
    def refs(self) -> DataFrame:
        return distinct_by_id(load(self.spark, self.folder, "refs"), "file_id", "src_local", "dst_name", "kind", "line")

    @cached_property
    def imports(self) -> DataFrame:
        return distinct_by_id(load(self.spark, self.folder, "imports"), "file_id", "raw", "module", "symbol", "alias", "dst_file_id", "external", "line")

    @cached_property
    def edges(self) -> DataFrame:
        return distinct_by_id(load(self.spark, self.folder, "edges"), "src_id", "dst_id", "dst_name", "kind", "line", "confidence", "reason")

    @cached_property
    def view(self) -> DataFrame:
        return symbol_view(self.symbols, self.files)

    @cached_property
    def arrivals(self) -> DataFrame:
        """The view with rows that arrive twice still in it, for operators that filter before they remove them."""
        return symbol_view(load(self.spark, self.folder, "symbols").where("id IS NOT NULL"), self.files)

    @cached_property
    def calls(self) -> DataFrame:
        """The edges as they arrive, for operators that take least and greatest values only."""
        return load(self.spark, self.folder, "edges")

    @cached_property
    def texts(self) -> DataFrame:
        """(file_id, text) of source documents; of several texts of a file the greatest."""
        docs = load(self.spark, self.folder, "documents").where("file_id IS NOT NULL AND text IS NOT NULL")
        return docs.groupBy("file_id").agg(F.max("text").alias("text"))

    def top_symbol(self) -> int:
        """The symbol that most calls of at least half confidence arrive at (ties: the smaller id)."""
        return (
            self.edges.where("dst_id IS NOT NULL AND kind IN ('calls', 'instantiates') AND confidence >= 0.5")
            .groupBy("dst_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst_id").first()["dst_id"]
        )

    def top_file(self) -> str:
        """The path of the file that most imports mean (ties: the smaller path)."""
        n = self.imports.where("dst_file_id IS NOT NULL").groupBy(F.col("dst_file_id").alias("id")).agg(F.count("*").alias("n"))
        return self.files.join(n, "id").orderBy(F.desc("n"), "path").first()["path"]
