"""Linkage, ISBN, cleaning, search and quality queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import isbn as i
from shelfspark.functions import text as t
from shelfspark.operators import books as b
from shelfspark.operators import fingerprint as fp
from shelfspark.operators import growing_index
from shelfspark.operators import linkage as k
from shelfspark.operators import search as s
from shelfspark.operators.usage import per_million, provenance_log as provenance
from shelfspark.plans.registry import query
from shelfspark.shared import new_folder, small_side, spread, stored
from shelfspark.sources.tables import read_table

DIGIT = "CAST(substr({c}, {i}, 1) AS INTEGER)"
STEM = "'978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"


def _check(c: str) -> str:
    return "((10 - (" + " + ".join(f"{DIGIT.format(c=c, i=n + 1)} * {1 + 2 * (n % 2)}" for n in range(12)) + ") % 10) % 10)"


def part_isbn() -> Column:
    """ISBN-13 of a part by its key; every seventh has a wrong check digit, every fifth is spelt with hyphens."""
    stem = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    digit = (i.check13(stem).cast("int") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)) % 10
    return F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("978-"), F.substring(stem, 4, 9), F.lit("-"), digit.cast("string"))).otherwise(F.concat(stem, digit.cast("string")))


@query(f"""
WITH a AS (SELECT p_partkey, {STEM} AS stem FROM part), b AS (SELECT *, {_check('stem')} AS d FROM a)
SELECT p_partkey, stem || CAST((d + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS plain, p_partkey % 7 <> 0 AS valid,
  CASE WHEN p_partkey % 7 <> 0 THEN stem || CAST(d AS VARCHAR) END AS canonical FROM b""")
def isbn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select("p_partkey", part_isbn().alias("raw"))
    return rows.select("p_partkey", i.normalize_isbn(F.col("raw")).alias("plain"), i.valid_isbn13(i.normalize_isbn(F.col("raw"))).alias("valid"), i.canonical_isbn13(F.col("raw")).alias("canonical"))


@query("""
WITH a AS (SELECT p_partkey, p_name AS title, p_brand AS publisher, p_size AS year, 1 AS arrival FROM part),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END, p_brand, p_size + p_partkey % 4, 2 FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b),
s AS (SELECT c.*, p.p_name, p.p_size, CASE WHEN title = p_name THEN 1.0 ELSE len(list_intersect(list_distinct(string_split(title, ' ')), list_distinct(string_split(p_name, ' ')))) / greatest(len(list_distinct(string_split(title, ' '))), len(list_distinct(string_split(p_name, ' ')))) END AS sim,
  CASE WHEN c.year = p_size THEN 1.0 WHEN abs(c.year - p_size) = 1 THEN 0.6 ELSE 0.0 END AS yp FROM c JOIN part p USING (p_partkey)),
z AS (SELECT *, round_even(100 * (sim * 40 + yp * 10 + 1.0 * 5) / 55, 1) AS score FROM s)
SELECT p_partkey, max(score) AS score, arg_max(title, score * 10 - arrival) AS title, arg_max(year, score * 10 - arrival) AS year, count(*) AS n_sources FROM z GROUP BY p_partkey""")
def isbn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of each part's record, scored against it and merged by key."""
    part = read_table(spark, sf_dir, "part")
    first = part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.col("p_size").alias("year"), F.lit(1).alias("arrival"))
    short = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    second = part.where("p_partkey % 2 = 0").select("p_partkey", short.alias("title"), F.col("p_brand").alias("publisher"), (F.col("p_size") + F.col("p_partkey") % 4).cast("int").alias("year"), F.lit(2).alias("arrival"))
    cands = first.unionByName(second).join(part.select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    parts = {"title": k.token_similarity(F.col("title"), F.col("p_name")), "authors": F.lit(None).cast("double"), "language": F.lit(None).cast("double"), "year": k.year_part(F.col("year"), F.col("p_size")), "publisher": k.token_similarity(F.col("publisher"), F.col("p_brand"))}
    scored = cands.withColumn("score", k.weighted_score(parts, k.EDITION_WEIGHTS)).withColumn("sources", F.array(F.col("arrival").cast("string")))
    merged = k.merge_candidates(scored, "p_partkey", "score", "arrival", ["title", "year"], ["sources"])
    return merged.select("p_partkey", "score", "title", "year", F.size("sources").cast("long").alias("n_sources"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title FROM pages),
q AS (SELECT * FROM p WHERE title <> '')
SELECT a.page_id, min(b.page_id) AS first_match, count(*) AS n_matches FROM q a JOIN q b ON a.title = b.title AND a.host <> b.host GROUP BY a.page_id""")
def link_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the pages of other hosts with its title: counts by title and host, joined; no pairs of a title."""
    title = F.lower(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    rows = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), title.alias("title")).where("title <> ''")
    by_host = rows.groupBy("title", "host").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    w = Window.partitionBy("title")
    ends = w.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lows = by_host.withColumns({"all": F.sum("n").over(w), "r": F.row_number().over(w.orderBy("first")), "low": F.min("first").over(w), "second": F.nth_value("first", 2).over(ends)})
    other = lows.select("title", "host", (F.col("all") - F.col("n")).alias("n_matches"), F.when(F.col("r") == 1, F.col("second")).otherwise(F.col("low")).alias("first_match"))
    return rows.join(other.where("n_matches > 0"), ["title", "host"]).select("page_id", "first_match", "n_matches")


@query()
def string_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each part's name to the first name of its brand and type."""
    part = read_table(spark, sf_dir, "part")
    first = part.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("first_name"))
    return part.join(first, ["p_brand", "p_type"]).select("p_partkey", F.bround(k.similarity(F.lower("p_name"), F.lower("first_name")), 6).alias("similarity"))


@query(r"""
WITH r AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw FROM pages)
SELECT page_id, nullif(trim(regexp_replace(regexp_replace(raw, '[\t\n\r\x0B\x0C\x{85}\x{A0}]', ' ', 'g'), ' +', ' ', 'g')), '') AS title FROM r""")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read_table(spark, sf_dir, "pages").select("page_id", t.clean_title(raw)["title"].alias("title"))


@query(r"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^\p{L}\p{N}_\p{M}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS author_key FROM supplier""")
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", t.author_key(F.col("s_name")).alias("author_key"))


@query()
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read_table(spark, sf_dir, "pages").select("page_id", t.normalize_text(title).alias("plain"), t.key(title).alias("key"), t.search_key(title).alias("search_key"), t.normalize_tag_name(title).alias("tag"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS f, url FROM pages)
SELECT page_id, NOT (starts_with(url, '/') OR contains(url, '..') OR contains(url, '\') OR regexp_matches(url, '^[A-Za-z]+:')) AS safe,
  coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(f, '[<>:"/\\|?*\x00-\x1F]', ' ', 'g'), '\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g'), 'zzzz', 'zzzz'), ''), 'Unbekannt') AS name FROM u""")
def path_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    safe = ~(url.startswith("/") | F.contains(url, F.lit("..")) | F.contains(url, F.lit("\\")) | url.rlike("^[A-Za-z]+:"))
    return read_table(spark, sf_dir, "pages").select("page_id", safe.alias("safe"), t.sanitize_component(F.regexp_extract(url, "([^/]*)$", 1)).alias("name"))


@query(r"SELECT page_id, CAST(nullif(regexp_extract(html, '((?:18|19|20)[0-9]{2})', 1), '') AS INTEGER) AS year FROM pages")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", t.year_from(F.col("html")).alias("year"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '\p{Cc}', ' ', 'g'), '\s+', ' ', 'g')), 1, 80) AS shown FROM documents WHERE length(regexp_replace(text, '\p{Cc}', '', 'g')) >= greatest(3, length(text) / 2)")
def printable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", t.printable_text(F.col("text"), 80).alias("shown")).where("shown is not null")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_retailprice / 10000 BETWEEN 0 AND 1 THEN round(p_retailprice / 10000 * 1000000, 6) END AS per_million FROM part")
def price_per_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = F.when(F.col("p_size") % 2 == 0, "USD").otherwise("EUR")
    return read_table(spark, sf_dir, "part").select("p_partkey", F.round(per_million((F.col("p_retailprice") / 10000).cast("string"), currency), 6).alias("per_million"))


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), '') AS label FROM events""")
def provider_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("label"))


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER w AS before, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
WHERE n = 1 OR o_orderstatus IS DISTINCT FROM before""")
def provenance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return provenance(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").drop("o_orderdate")


@query("""
SELECT 'order_without_customer' AS "check", o_orderkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'line_without_order', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0)""")
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent is missing; the parents divisible by 50 and 100 play the lost ones."""
    orders, line, customer = (read_table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    lines = line.withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    made = b.integrity_audit({
        "order_without_customer": (orders, "o_custkey", customer.where("c_custkey % 50 <> 0"), "c_custkey", "o_orderkey"),
        "line_without_order": (lines, "l_orderkey", orders.where("o_orderkey % 100 <> 0"), "o_orderkey", "line"),
    })
    return made.select("check", F.col("key").cast("long").alias("key"))


@query("""
WITH e AS (SELECT doc_id, length(text) AS n, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 17 <> 0)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS state
FROM e FULL JOIN a ON e.doc_id = a.doc_id WHERE e.h IS DISTINCT FROM a.h""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests of the texts, the second as if some were lost, added and changed."""
    docs = read_table(spark, sf_dir, "documents")
    listed = lambda text: ("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    other = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return b.manifest_diff(docs.where("doc_id % 11 <> 0").select(*listed(F.col("text"))), docs.where("doc_id % 17 <> 0").select(*listed(other)), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a derived row of the current version: those divisible by 4 have none, those by 5 an old one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    derived = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(3).alias("version"))
    return fp.stale(docs, derived, 3, "doc_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'title_blank' WHEN c_custkey % 10 = 1 THEN 'author_blank' WHEN c_acctbal < 0 THEN 'year' WHEN c_custkey % 10 = 2 THEN 'isbn' END AS error,
  CASE WHEN c_custkey % 10 = 1 THEN '|A b' ELSE 'A b' END AS authors FROM customer WHERE c_custkey % 10 < 3 OR c_acctbal < 0""")
def edit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits with their first failing rule: blank titles, blank authors, balances below 0 as years, wrong ISBNs."""
    k, none = F.col("c_custkey") % 10, F.lit(None).cast("string")
    edits = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 0, " ").otherwise(F.col("c_name")).alias("title"), F.when(k == 1, F.array(F.lit(" "), F.lit("A b"))).otherwise(F.array(F.lit("A  b"), F.lit("a b"))).alias("authors"),
        F.floor("c_acctbal").cast("int").alias("year"), none.alias("language"), F.when(k == 2, "9783608938145").otherwise(none).alias("isbn"),
    )
    return b.split_valid(b.validate_edits(edits))[1].select("c_custkey", "error", F.array_join("authors", "|").alias("authors"))


@query("""WITH p AS (SELECT p_partkey, list_append(list_append(string_split(p_type, ' '), 'a b'), 'rest') AS ws FROM part)
SELECT p_partkey, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i), 1, 2), '|') AS tags FROM p""")
def tag_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a part's type as tags, again in lower case, blank, and with control characters; two at most."""
    words = F.split("p_type", " ")
    tags = F.concat(words, F.transform(words, lambda w: F.concat(F.lit(" "), F.lower(w))), F.array(F.lit(" "), F.lit("\x07"), F.lit(" a\tb "), F.lit("A B"), F.lit("rest")))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(t.dedupe_tags(tags, 2), "|").alias("tags"))


BM25 = r"""
WITH tk AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[\p{L}\p{N}_]+')) AS tok FROM part),
le AS (SELECT id, count(*) AS len FROM tk GROUP BY id), st AS (SELECT count(*) AS n_all, avg(len) AS av FROM le),
qt AS (SELECT unnest(['s', 'brand']) AS term), f AS (SELECT id, term, count(*) AS f FROM tk JOIN qt ON starts_with(tok, term) GROUP BY id, term),
nn AS (SELECT term, count(*) AS n FROM f GROUP BY term)
SELECT id AS p_partkey, round(sum(-greatest(1e-6, ln((n_all - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score
FROM f JOIN nn USING (term) JOIN le USING (id), st GROUP BY id HAVING count(*) = 2 ORDER BY sum(-greatest(1e-6, ln((n_all - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))), id LIMIT 100"""


@query(BM25.replace("FROM part)", "FROM part WHERE p_partkey % 5 <> 0)"))
def search_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index of three inserts, of which the last two replace rows of the first, and a deletion."""
    part = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    index, columns = growing_index.GrowingIndex(spark, new_folder(spark, "growing"), most_segments=2), ["p_name", "p_brand", "p_type"]
    index.insert(part.where("id % 3 = 0 or id % 5 = 0").withColumn("p_name", F.lit("old spelling s")), columns)
    for half in (0, 1):
        index.insert(part.where(F.col("id") % 2 == half), columns)
    index.delete(part.where("id % 5 = 0"))
    return s.search(index.open(), "s* brand*").select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


@query(BM25)
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = s.build_index(read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), ["p_name", "p_brand", "p_type"])
    index = s.save_index(made, new_folder(spark, "index"))
    return s.search(index, "s* brand*").select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


@query(r"SELECT p_partkey, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS t FROM part) WHERE t = (SELECT min(t) FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS t FROM part)) GROUP BY p_partkey")
def search_title_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = s.build_index(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), ["title"])
    index = s.save_index(made, new_folder(spark, "index"))
    least = index.postings.agg(F.min("token")).first()[0]
    return s.search_title(index, least).select(F.col("id").alias("p_partkey"), "tf")


@query(r"""
WITH tk AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok FROM documents), f AS (SELECT id, count(DISTINCT CASE WHEN starts_with(tok, 'apache') THEN 1 WHEN starts_with(tok, 'licen') THEN 2 END) AS n FROM tk GROUP BY id)
SELECT id AS doc_id, substr(text, greatest(1, strpos(lower(text), 'apache') - 20), 60) AS snippet FROM f JOIN documents ON id = doc_id WHERE n = 2""")
def content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    texts = spread(docs.select(F.col("doc_id").alias("id"), "text"))
    index = s.save_index(s.build_index(texts, ["text"]), new_folder(spark, "index"))
    hits = small_side(stored(s.search(index, "apache licen", limit=None).select("id"), "hits"))
    at = F.greatest(F.lit(1), F.locate("apache", F.lower("text")) - 20)
    return docs.join(hits, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", F.substring("text", at, F.lit(60)).alias("snippet"))


@query(r"""WITH t AS (SELECT s_suppkey AS id, unnest(['Éric', 'Nuñez', 'straße', 'x']) AS w, unnest([1, 2, 3, 0]) AS k, s_suppkey % 4 AS own FROM supplier) SELECT id FROM t WHERE k = own AND w = 'Nuñez'""")
def search_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lists found without their marks."""
    word = F.get(F.array(*map(F.lit, ("x", "Éric", "Nuñez", "straße"))), (F.col("s_suppkey") % 4).cast("int"))
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(word, F.lit("other")).alias("authors"), F.lit("9783404105311").alias("isbn"))
    index = s.save_index(s.build_index(rows, ["authors", "isbn"]), new_folder(spark, "index"))
    return s.search(index, "NUNE* 97834", limit=None).select("id")
