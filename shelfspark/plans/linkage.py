"""Linkage queries: candidates of providers, editions of a work, links to a catalogue. Parts are the books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import linkage as k
from shelfspark.plans.registry import query
from shelfspark.shared import stored
from shelfspark.sources.tables import read_table


def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for each part and three providers' rows: a whole one, one without edition facts for even keys, and another book for every third."""
    p = F.col("p_partkey")
    part = read_table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    asked = [F.col("p_name").alias("q_title"), F.lit("Ann Bee").alias("q_author"), F.lit("ger").alias("q_language"), (F.col("p_size") + 1970 + (p % 4).cast("int")).alias("q_year"), F.col("p_brand").alias("q_publisher")]
    a = part.select(p.alias("book_id"), *asked, F.concat(F.lit("A"), p.cast("string")).alias("isbn13"), F.col("p_name").alias("title"), F.array(F.lit("Ann Bee")).alias("authors"), F.lit("deu").alias("language"), (F.col("p_size") + 1970).alias("year"), F.col("p_brand").alias("publisher"), F.array("p_type").alias("subjects"), none.alias("series"), F.array(F.lit("a")).alias("sources"), F.array(F.concat(F.lit("w"), p.cast("string"))).alias("source_ids"), F.lit(1).alias("arrival"))
    b = a.where("book_id % 2 = 0").withColumns({"authors": F.array(F.lit("ANN  BEE"), F.lit("Co")), "language": F.lit(None).cast("string"), "year": F.lit(None).cast("int"), "publisher": F.lit(None).cast("string"), "subjects": F.array(F.lit("x")), "sources": F.array(F.lit("b")), "source_ids": none, "arrival": F.lit(2)})
    c = a.where("book_id % 3 = 0").withColumns({"isbn13": F.concat(F.lit("C"), F.col("book_id").cast("string")), "title": F.lit("0000"), "authors": F.array(F.lit("~~")), "language": F.lit(None).cast("string"), "publisher": F.lit("xyz"), "sources": F.array(F.lit("c")), "arrival": F.lit(3)})
    return a.unionByName(b).unionByName(c)


SEARCHED = """
s AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_partkey % 3 = 0 AS c FROM part),
m AS (SELECT id, 'A' || id AS isbn13, [100.0, 96.0, 100.0, 90.0][k + 1] AS score, 100.0 AS work_score, CASE WHEN k < 2 THEN 'edition' ELSE 'reference' END AS match_type, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS n_sources,
    CASE WHEN id % 2 = 0 THEN 'Ann Bee|ANN  BEE|Co' ELSE 'Ann Bee' END AS authors, CASE WHEN k = 0 OR (k = 1 AND NOT c) THEN 'edition' WHEN k > 1 THEN 'reference' END AS accepted FROM s
  UNION ALL SELECT id, 'C' || id, [11.1, 6.7, 0.0, 0.0][k + 1], 0.0, 'reference', 1, '~~', NULL FROM s WHERE c)"""


@query(f"WITH {SEARCHED} SELECT id AS book_id, isbn13, score, work_score, match_type, n_sources, authors, accepted FROM m")
def isbn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers' rows scored, merged by ISBN, scored again and accepted."""
    made = k.search_candidates(provider_rows(spark, sf_dir))
    return made.select("book_id", "isbn13", "score", "work_score", "match_type", F.size("sources").alias("n_sources"), F.array_join("authors", "|").alias("authors"), "accepted")


@query(f"WITH {SEARCHED} SELECT id AS book_id, isbn13, score FROM m ORDER BY score DESC, isbn13 LIMIT 100")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred candidates by score."""
    return k.order_candidates(k.search_candidates(provider_rows(spark, sf_dir)).select("book_id", "isbn13", "score")).limit(100)


EDITIONS = """
c AS (SELECT p_partkey AS i, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_partkey // 6 ELSE ' x' || p_partkey END AS title, p_brand AS author, 'w' || p_partkey // 5 AS w, p_type AS subject FROM part),
e AS (SELECT x.i AS a, y.i AS b FROM c x JOIN c y ON x.i < y.i AND (x.w = y.w OR (x.title = y.title AND x.author = y.author)))"""


@query(f"WITH {EDITIONS} SELECT a, b FROM e")
def related_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of a work: five parts share a source id, some share title and author."""
    return k.related_editions(editions(spark, sf_dir))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    title = F.concat("p_name", F.when(p % 2 == 0, F.concat(F.lit(" "), F.floor(p / 6).cast("string"))).otherwise(F.concat(F.lit(" x"), p.cast("string"))))
    return read_table(spark, sf_dir, "part").select(p.alias("isbn13"), title.alias("title_key"), F.array("p_brand").alias("authors"), F.array(F.concat(F.lit("w"), F.floor(p / 5).cast("string"))).alias("source_ids"), F.array("p_type").alias("subjects"), F.array("p_brand").alias("series"))


@query(f"""WITH {EDITIONS}, r AS (SELECT a AS i, b AS o FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT i, i FROM c)
SELECT r.i AS isbn13, count(*) AS n_references, count(DISTINCT c.subject) AS n_subjects, count(DISTINCT c.author) AS n_series FROM r JOIN c ON c.i = r.o GROUP BY r.i""")
def work_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a work's editions bring together."""
    cands = stored(editions(spark, sf_dir), "editions")
    made = k.reference_record(cands, k.related_editions(cands))
    return made.select("isbn13", F.size("reference_isbns").cast("long").alias("n_references"), F.size("subjects").cast("long").alias("n_subjects"), F.size("series").cast("long").alias("n_series"))


@query("""WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'i' || p_partkey END AS isbn, p_name || ' n' || p_partkey AS title FROM part)
SELECT id, CASE WHEN isbn IS NOT NULL THEN CASE WHEN id % 3 = 0 THEN 'second' ELSE 'first' END WHEN id % 5 = 0 THEN 'second' ELSE 'first' END AS source, id AS entry, CASE WHEN isbn IS NOT NULL THEN 'isbn' ELSE 'title' END AS "by" FROM b
WHERE isbn IS NOT NULL OR id % 5 = 0 OR id % 7 <> 0""")
def link_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with and without ISBN against two catalogues: the first lacks some, and some of its titles or authors do not fit."""
    p = F.col("p_partkey")
    part = read_table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" n"), p.cast("string"))
    isbn = F.when(p % 2 == 0, F.concat(F.lit("i"), p.cast("string")))
    books = part.select(p.alias("id"), isbn.alias("isbn"), title.alias("title"), F.lit("Ann Bee").alias("author"))
    first = part.where("not (p_partkey % 2 = 0 and p_partkey % 3 = 0)").select(F.lit("first").alias("source"), p.alias("entry"), isbn.alias("isbn"), F.when((p % 2 == 1) & (p % 5 == 0), F.concat(F.lit("other words n"), p.cast("string"))).otherwise(F.upper(title)).alias("title"), F.when((p % 2 == 1) & (p % 7 == 0), "Somebody Else").otherwise("Dr. Ann Bee").alias("author"), p.alias("rank"))
    second = part.where("(p_partkey % 2 = 0 and p_partkey % 3 = 0) or (p_partkey % 2 = 1 and p_partkey % 5 = 0)").select(F.lit("second").alias("source"), p.alias("entry"), isbn.alias("isbn"), title.alias("title"), F.lit(None).cast("string").alias("author"), p.alias("rank"))
    priority = spark.createDataFrame([("second", 2), ("first", 1)], "source string, place int")
    return k.link_catalogue(books, first.unionByName(second), priority)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 1 THEN 'web' WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'embedded' END AS title_source,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'P' END AS publisher, 'i1' AS isbn FROM part""")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a book after a provider's are merged: titles by hand, from a filename or embedded; some publishers are missing."""
    p = F.col("p_partkey")
    field = lambda v, s: F.struct(v.alias("value"), s.alias("source"))
    source = F.when(p % 3 == 0, "manual").when(p % 3 == 1, "filename").otherwise("embedded")
    target = F.struct(field(F.col("p_name"), source).alias("title"), field(F.lit("old"), F.lit("embedded")).alias("publisher"), field(F.lit("i1"), F.lit("embedded")).alias("isbn"))
    given = F.struct(field(F.upper("p_name"), F.lit("web")).alias("title"), field(F.when(p % 4 == 0, F.col("p_brand")).otherwise("P"), F.lit("web")).alias("publisher"), field(F.lit("i2"), F.lit("web")).alias("isbn"))
    made = read_table(spark, sf_dir, "part").select(p.alias("id"), k.merge_fields(target, given, {"title": "string", "publisher": "string", "isbn": "string"}).alias("m"))
    return made.select("id", "m.title.value", "m.title.source", "m.publisher.value", "m.isbn.value").toDF("id", "title", "title_source", "publisher", "isbn")
