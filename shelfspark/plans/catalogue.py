"""Catalogue queries: parts stand for books, suppliers for authors, documents for texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import language_label, normalize_language_plain
from shelfspark.operators import catalogue as c
from shelfspark.plans.registry import query
from shelfspark.shared import new_folder
from shelfspark.sources import catalogue
from shelfspark.sources.tables import from_document, read_table, to_document


@query("""
SELECT p_partkey, p_name, p_brand, p_size FROM part p
WHERE p_size BETWEEN 10 AND 30 AND p_brand = (SELECT min(p_brand) FROM part)
  AND EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_partkey = p.p_partkey AND s.s_acctbal > 5000)""")
def filter_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line, supplier = (read_table(spark, sf_dir, n) for n in ("part", "lineitem", "supplier"))
    brand = part.agg(F.min("p_brand").alias("b"))
    books = part.withColumnsRenamed({"p_size": "year", "p_partkey": "book"}).join(F.broadcast(brand), F.col("p_brand") == F.col("b"), "left_semi")
    books = c.filter_books(books, year=(10, 30))
    bridge = line.select(F.col("l_partkey").alias("book"), F.col("l_suppkey").alias("s_suppkey"))
    found = c.having(books, bridge, supplier, "book", "s_suppkey", F.col("s_acctbal") > 5000)
    return found.select(F.col("book").alias("p_partkey"), "p_name", "p_brand", F.col("year").alias("p_size"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def page_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return c.page(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50, 100)


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS book_count FROM supplier")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return c.count_children(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), bridge, "s_suppkey")


@query("""
SELECT 'publisher' AS facet, p_brand AS value, count(*) AS book_count FROM part GROUP BY p_brand
UNION ALL SELECT 'series', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'year', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size
UNION ALL SELECT 'author', s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) FROM supplier""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.facets(read_table(spark, sf_dir, "part"), {"publisher": "p_brand", "series": "p_type", "year": "p_size"}, {"author": (author_counts(spark, sf_dir), "s_name")})


@query("""
WITH l AS (SELECT CASE lang WHEN 'ger' THEN 'de' ELSE lang END AS code FROM documents WHERE trim(lang) <> '')
SELECT code, CASE code WHEN 'de' THEN 'Deutsch' WHEN 'en' THEN 'Englisch' WHEN 'fr' THEN 'Französisch' WHEN 'es' THEN 'Spanisch' ELSE upper(code) END AS label, count(*) AS book_count
FROM l GROUP BY 1, 2""")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = c.value_counts(read_table(spark, sf_dir, "documents"), "lang")
    code = normalize_language_plain(F.col("value"))
    return raw.groupBy(code.alias("code")).agg(F.sum("book_count").alias("book_count")).select("code", language_label(F.col("code")).alias("label"), "book_count")


@query("""
SELECT p_partkey, p_name, coalesce((SELECT string_agg(n, '|' ORDER BY n) FROM (SELECT DISTINCT s_name AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey)), '') AS authors FROM part""")
def book_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    books = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = c.with_children(books, bridge, read_table(spark, sf_dir, "supplier"), "p_partkey", "s_suppkey", "s_name", "authors")
    return found.select("p_partkey", "p_name", F.array_join("authors", "|").alias("authors"))


@query("SELECT o_orderkey, o_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    one = orders.join(F.broadcast(orders.agg(F.max("o_orderkey").alias("k"))), F.col("o_orderkey") == F.col("k"), "left_semi")
    return one.join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return c.latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents ORDER BY 2, 1 LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return c.page(docs, [F.col("sha256"), F.col("doc_id")], 100)


@query("""
WITH known AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size < 25), names AS (SELECT DISTINCT p_type AS name FROM part)
SELECT name, name IN (SELECT name FROM known) AS existed, (SELECT count(*) FROM part WHERE p_type = name AND p_size >= 25) AS book_count FROM names""")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    known = part.where("p_size < 25").select(F.col("p_type").alias("name")).distinct().withColumn("id", F.xxhash64("name"))
    incoming = part.where("p_size >= 25").select(F.col("p_type").alias("name"))
    both = c.get_or_create(known, incoming, "name")
    flagged = both.join(known.select("name", F.lit(True).alias("existed")), "name", "left")
    return c.count_children(flagged, incoming, "name").select("name", F.coalesce("existed", F.lit(False)).alias("existed"), "book_count")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def document_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
    books = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return from_document(to_document(books, list(fields)), fields).withColumnRenamed("id", "p_partkey")


@query("SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 IN (SELECT DISTINCT 0) OR row_number() OVER (PARTITION BY lang ORDER BY doc_id) = count(*) OVER (PARTITION BY lang)")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return c.spread_sample(docs, ["lang"], [F.col("doc_id")], 2)


@query("""SELECT p_partkey, p_name, p_size, p_name || '.epub' AS file_name, p_size % 2 = 0 AS has_cover, CASE WHEN p_size % 3 = 0 THEN upper(p_name) END AS old_title FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, FALSE, NULL FROM part WHERE p_partkey % 7 = 0""")
def catalogue_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as books with file, history and cover, written as a catalogue of documents and rebuilt by the source; every seventh document is broken."""
    part = read_table(spark, sf_dir, "part")
    size, name = F.col("p_size"), F.col("p_name")
    books = part.select(
        F.concat(F.lit("bk_"), F.md5(F.col("p_partkey").cast("string")), F.lit("_"), F.col("p_partkey").cast("string")).alias("id"), "p_name", "p_size",
        F.struct(F.concat(name, F.lit(".epub")).alias("name"), size.cast("long").alias("size"), F.lit("ab").alias("sha256"), F.lit("p").alias("path"), F.lit("epub").alias("format")).alias("file"),
        F.when(size % 2 == 0, F.struct(F.lit("c.png").alias("path"), F.lit("embedded").alias("source"))).alias("cover"),
        F.when(size % 3 == 0, F.array(F.struct(F.upper(name).alias("title"), F.array(F.lit("nfc")).alias("rules"), F.lit("2024").alias("at")))).alias("title_history"),
    )
    key = lambda c: F.substring_index(c, "_", -1).cast("long")
    documents = catalogue.to_documents(books, ["p_name", "p_size"]).withColumn("json", F.when(key("id") % 7 == 0, F.lit("{broken")).otherwise(F.col("json")))
    folder = new_folder(spark, "catalogue")
    catalogue.write_documents(documents, folder, 1)
    catalogue.register(spark)
    made = spark.read.format("shelf_catalogue").option("fields", "p_name string, p_size int").option("digits", 1).load(folder)
    return made.select(key("id").alias("p_partkey"), "p_name", "p_size", F.col("file.name").alias("file_name"), F.col("cover").isNotNull().alias("has_cover"), F.get("title_history", F.lit(0))["title"].alias("old_title"))
