"""A catalogue of documents as a source: `spark.read.format("shelf_catalogue")`.

A catalogue is a folder of shards (shard=...) of Parquet files with (id, json), as `write_documents` leaves it; a document
holds all of a book: import time, file, fields with their sources, history of its title, cover. The source plans a
partition a shard, reads only the shards that filters on id leave (=, in), and rebuilds rows from the documents.
Rows whose document is broken are null but for the id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Of a book beside its fields.
REST = {
    "imported_at": "string",
    "file": "struct<name: string, size: long, sha256: string, path: string, format: string>",
    "title_history": "array<struct<title: string, rules: array<string>, at: string>>",
    "cover": "struct<path: string, source: string>",
}
DIGITS = 4


def to_documents(books: DataFrame, fields: list[str], source: str = "embedded") -> DataFrame:
    """(id, json): a document for each book (id, fields, and of REST what it has) from which its row can be rebuilt."""
    metadata = F.struct(*[F.struct(F.col(f).alias("value"), F.lit(source).alias("source")).alias(f) for f in fields])
    rest = [(F.col(c) if c in books.columns else F.lit(None)).cast(t).alias(c) for c, t in REST.items()]
    named = {"imported_at": "import", "title_history": "title_cleanup_history"}
    parts = [F.lit(2).alias("schema_version"), metadata.alias("metadata"), *[c.alias(named.get(n, n)) for c, n in zip(rest, REST, strict=True)]]
    return books.select("id", F.to_json(F.struct(*parts)).alias("json"))


def write_documents(documents: DataFrame, path: str, digits: int = DIGITS) -> None:
    """Documents (id, json) in shards by the first characters of the id after its prefix of three, each shard's rows by id."""
    shard = F.substring("id", 4, digits)
    documents.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "id").write.partitionBy("shard").parquet(path)


class Shard(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class CatalogueReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, digits: int):
        self.schema, self.path, self.digits = schema, re.sub("^file:/(?!/)", "file:///", path), digits
        self.ids: set[str] | None = None
        self.opened = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("id",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = asked if self.ids is None else self.ids & asked
            yield f  # Spark tests the rows as well

    def partitions(self) -> list[Shard]:
        system, root = fs.FileSystem.from_uri(self.path)
        shards: dict[str, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.path.endswith(".parquet"):
                shard = info.path.rpartition("/")[0].rpartition("shard=")[2]
                shards.setdefault(shard, []).append(info.path)
        wanted = None if self.ids is None else {i[3 : 3 + self.digits] for i in self.ids if i is not None}
        return [Shard(sorted(v)) for k, v in sorted(shards.items()) if wanted is None or k in wanted]

    def _row(self, key: str, text: str | None) -> dict:
        try:
            held = json.loads(text or "null") or {}
            values = {f: (held.get("metadata") or {}).get(f, {}).get("value") for f in self.schema.names}
            return {**values, "id": key, "imported_at": held.get("import"), "title_history": held.get("title_cleanup_history"), "file": held.get("file"), "cover": held.get("cover")}
        except (ValueError, AttributeError):
            return {"id": key}

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        system, _ = fs.FileSystem.from_uri(self.path)
        for file in partition.files:
            table = pq.read_table(file, filesystem=system, columns=["id", "json"], partitioning=None)
            if self.ids is not None:
                table = table.filter(pc.is_in(table["id"], pa.array(sorted(i for i in self.ids if i is not None), pa.string())))
            for batch in table.to_batches(max_chunksize=4096):
                rows = [self._row(k, j) for k, j in zip(batch["id"].to_pylist(), batch["json"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


class Catalogue(DataSource):
    """Options: path, fields (names and types, as "title string, year int"), digits of a shard."""

    @classmethod
    def name(cls) -> str:
        return "shelf_catalogue"

    def schema(self) -> str:
        return ", ".join(["id string", self.options.get("fields", "title string"), *[f"{n} {t}" for n, t in REST.items()]])

    def reader(self, schema: T.StructType) -> CatalogueReader:
        return CatalogueReader(schema, self.options["path"], int(self.options.get("digits", DIGITS)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Catalogue)
