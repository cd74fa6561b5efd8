"""Tables and their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One relation with its declared schema; others with the file's own. Missing columns come as null."""
    declared = schema or SCHEMAS.get(name)
    reader = spark.read if declared is None else spark.read.schema(declared)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; a broken line is a row of nulls."""
    return spark.read.schema(schema).json(path)


def to_document(books: DataFrame, fields: list[str], source: str = "embedded") -> DataFrame:
    """(id, json): a document for each book from which its row can be rebuilt."""
    metadata = F.struct(*[F.struct(F.col(f).alias("value"), F.lit(source).alias("source")).alias(f) for f in fields])
    return books.select("id", F.to_json(F.struct(F.lit(1).alias("schema_version"), metadata.alias("metadata"))).alias("json"))


def from_document(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The rows of documents made by to_document; fields: names and types."""
    inner = ", ".join(f"{n}: struct<value: {t}, source: string>" for n, t in fields.items())
    parsed = docs.select("id", F.from_json("json", f"schema_version int, metadata struct<{inner}>").alias("d"))
    return parsed.select("id", *[F.col(f"d.metadata.{n}.value").alias(n) for n in fields])


def write_catalogue(books: DataFrame, path: str, digits: int = 4) -> None:
    """Parquet in shards by the first characters of the id after its prefix of three."""
    books.withColumn("shard", F.substring("id", 4, digits)).write.partitionBy("shard").parquet(path)
