"""Queries of book records: parts stand for books, suppliers for authors, words of the type for tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import books as b
from shelfspark.operators import catalogue as c
from shelfspark.plans.registry import query
from shelfspark.sources.tables import read_table

LANGS = ("ger", "EN", "fr-FR", "Czech", None)
FORMATS = ("EPUB", "pdf", "fb2")
L = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in LANGS) + "]"


def pick(values: tuple, k: Column) -> Column:
    """The k-th of some fixed values."""
    return F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, publisher, series, year, language, format, has_cover, cover_path, description, work_match, document) of the parts."""
    k = F.col("p_partkey")
    doc = F.concat(F.lit('{"metadata": {"description": {"value": "about '), k.cast("string"), F.lit('", "source": "embedded"}}}'))
    return read_table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("series"), (F.col("p_size") + 1970).alias("year"), pick(LANGS, k % 5).alias("language"),
        pick(FORMATS, k % 3).alias("format"), (k % 2 == 0).alias("has_cover"), F.when(k % 3 != 0, F.concat(F.lit("c/"), k.cast("string"))).alias("cover_path"),
        F.when(k % 4 == 0, F.concat(F.lit("own "), k.cast("string"))).alias("description"), F.lit(None).cast("string").alias("work_match"), doc.alias("document"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey").distinct()
    return line.join(read_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("id", F.col("s_name").alias("name"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("name"))


VIEW = f"""
bk AS (SELECT p_partkey AS id, p_name AS title, p_brand AS publisher, p_type AS series, p_size + 1970 AS year, {L}[p_partkey % 5 + 1] AS raw, ['EPUB', 'pdf', 'fb2'][p_partkey % 3 + 1] AS format FROM part),
au AS (SELECT l_partkey AS id, string_agg(n, '|' ORDER BY n) AS authors FROM (SELECT DISTINCT l_partkey, s_name AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1),
tg AS (SELECT id, string_agg(n, '|' ORDER BY n) AS tags FROM (SELECT DISTINCT id, unnest(string_split(title, ' ')) AS n FROM bk) GROUP BY 1),
vw AS (SELECT bk.id, title, CASE raw WHEN 'ger' THEN 'de' WHEN 'EN' THEN 'en' WHEN 'fr-FR' THEN 'fr' WHEN 'Czech' THEN 'cs' END AS language,
  CASE raw WHEN 'ger' THEN 'Deutsch' WHEN 'EN' THEN 'Englisch' WHEN 'fr-FR' THEN 'Französisch' WHEN 'Czech' THEN 'Tschechisch' END AS language_label,
  bk.id % 2 = 0 AND bk.id % 3 <> 0 AS has_cover, coalesce(authors, '') AS authors, coalesce(tags, '') AS tags, CASE WHEN bk.id % 4 = 0 THEN 'own ' ELSE 'about ' END || bk.id AS description
  FROM bk LEFT JOIN au ON au.id = bk.id LEFT JOIN tg ON tg.id = bk.id)"""


def _flat(view: DataFrame) -> DataFrame:
    return view.select("id", "title", "language", "language_label", "has_cover", F.array_join("authors", "|").alias("authors"), F.array_join("tags", "|").alias("tags"), "description")


@query(f"WITH {VIEW} SELECT * FROM vw")
def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(b.book_view(books(spark, sf_dir), authors(spark, sf_dir), tags(spark, sf_dir), detail=True))


@query(f"WITH {VIEW} SELECT * FROM vw WHERE id = 77")
def get_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(b.get_book(books(spark, sf_dir), authors(spark, sf_dir), tags(spark, sf_dir), 77))


@query(f"""WITH {VIEW} SELECT bk.id FROM bk JOIN tg ON tg.id = bk.id WHERE year BETWEEN 1980 AND 2005 AND raw = 'Czech' AND format = 'pdf' AND list_contains(string_split(tags, '|'), (SELECT min(split_part(p_name, ' ', 1)) FROM part))""")
def find_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by tag (in another case), language name, format and years."""
    word = read_table(spark, sf_dir, "part").agg(F.min(F.split("p_name", " ")[0])).first()[0]
    return b.find_books(books(spark, sf_dir), tags=tags(spark, sf_dir), tag=f" {word.upper()}", language="Tschechisch", format="PDF", year_from=1980, year_to=2005).select("id")


@query(f"""WITH {VIEW} SELECT (SELECT count(*) FROM bk) AS all_books, (SELECT count(*) FROM bk WHERE raw = 'ger') AS german, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = 3) AS by_author""")
def count_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    one = lambda name, **f: b.count_books(rows, **f).withColumnRenamed("books", name)
    made = one("all_books").crossJoin(one("german", language="deutsch"))  # one row each
    return made.crossJoin(one("by_author", authors=authors(spark, sf_dir), author="Supplier#000000003"))


@query(f"""WITH {VIEW}, v AS (SELECT 'publisher' AS facet, publisher AS value, publisher AS label FROM bk UNION ALL SELECT 'series', series, series FROM bk UNION ALL SELECT 'year', CAST(year AS VARCHAR), CAST(year AS VARCHAR) FROM bk
  UNION ALL SELECT 'format', format, format FROM bk UNION ALL SELECT 'language', language, language_label FROM vw WHERE language IS NOT NULL
  UNION ALL SELECT 'author', n, n FROM (SELECT DISTINCT l_partkey, s_name AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) UNION ALL SELECT 'tag', n, n FROM (SELECT DISTINCT id, unnest(string_split(title, ' ')) AS n FROM bk))
SELECT facet, value, label, count(*) AS book_count FROM v GROUP BY ALL""")
def all_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven facets; languages by code with a label."""
    count = lambda rows: rows.distinct().groupBy("name").agg(F.count("*").alias("book_count"))
    rows = books(spark, sf_dir).withColumn("code", t.normalize_language(F.col("language")))
    found = c.facets(rows, {"publisher": "publisher", "series": "series", "year": "year", "format": "format", "language": "code"}, {"author": (count(authors(spark, sf_dir)), "name"), "tag": (count(tags(spark, sf_dir)), "name")})
    return found.withColumn("label", F.when(F.col("facet") == "language", t.language_label(F.col("value"))).otherwise(F.col("value")))


@query("SELECT p_size + 1970 AS value, count(*) AS book_count FROM part GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest years."""
    return c.value_counts(books(spark, sf_dir), "year").select(F.col("value").cast("int").alias("value"), "book_count").orderBy(F.desc("value")).limit(20)


@query("""SELECT n, row_number() OVER (ORDER BY translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), n) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) QUALIFY place <= 50""")
def order_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty titles in an order that folds ASCII letters; every other one is in capitals."""
    names = read_table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("n")).distinct()
    from shelfspark.shared import numbered

    first = c.page(names.withColumn("k", c.nocase(F.col("n"))), [F.col("k"), F.col("n")], 50)
    return numbered(first, ["k", "n"], "place").select("n", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.keyset_page(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def orphan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without a line of fifty pieces, as tags without books."""
    bridge = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return c.orphans(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), bridge, "s_suppkey")


@query(r"""WITH g AS (SELECT p_partkey AS book, trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE '  ' || p_type || ' ' END, '\s+', ' ', 'g')) AS name FROM part),
k AS (SELECT min(p_type) AS name FROM part), n AS (SELECT lower(name) AS key, min(name) AS name FROM g WHERE lower(name) <> (SELECT lower(name) FROM k) GROUP BY 1 UNION ALL SELECT lower(name), name FROM k)
SELECT n.name, count(DISTINCT g.book) AS books FROM n JOIN g ON lower(g.name) = n.key GROUP BY n.name""")
def genres_to_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as genres, some in capitals or with blanks; the first type is a tag already and linked to its parts of even number."""
    part = read_table(spark, sf_dir, "part")
    genres = part.select(F.col("p_partkey").alias("book"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("name"))
    known = part.agg(F.min("p_type").alias("name")).select(F.lit(1).cast("long").alias("id"), "name")
    links = part.join(F.broadcast(known), F.col("p_type") == F.col("name")).where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("book"), F.col("id").alias("tag"))
    made, linked = b.genres_to_tags(genres, known, links)
    return linked.join(made, F.col("tag") == F.col("id")).groupBy("name").agg(F.count_distinct("book").alias("books"))


EDITS = """
ed AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 31 = 0 THEN repeat('x', 501) ELSE c_name END AS title,
  CASE WHEN c_custkey % 17 = 0 THEN ['A', ' '] WHEN c_custkey % 19 = 0 THEN list_transform(range(31), lambda i: 'n' || i) ELSE ['Ann  Bee', 'ann bee', 'C'] END AS authors,
  CAST(c_acctbal AS INTEGER) AS year, CASE c_custkey % 6 WHEN 0 THEN 'German' WHEN 1 THEN 'klingon' ELSE 'en' END AS language, CASE WHEN c_custkey % 4 = 0 THEN '9783404105311' WHEN c_custkey % 4 = 1 THEN '3-608-93814-2' ELSE '' END AS isbn FROM customer)"""


@query(f"""WITH {EDITS} SELECT id, CASE WHEN trim(title) = '' THEN 'title_blank' WHEN length(title) > 500 THEN 'title_long' WHEN authors[2] = ' ' THEN 'author_blank' WHEN len(authors) > 30 THEN 'authors_many' WHEN year NOT BETWEEN 0 AND 9999 THEN 'year'
  WHEN language = 'klingon' THEN 'language' WHEN isbn = '3-608-93814-2' THEN 'isbn' END AS error,
  CASE WHEN authors[2] = ' ' THEN 'A|' WHEN len(authors) > 30 THEN array_to_string(authors, '|') ELSE 'Ann Bee|C' END AS authors FROM ed""")
def validate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits made up from customers, with the first rule that fails."""
    k = F.col("c_custkey")
    names = F.when(k % 17 == 0, F.array(F.lit("A"), F.lit(" "))).when(k % 19 == 0, F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("n"), i.cast("string")))).otherwise(F.array(F.lit("Ann  Bee"), F.lit("ann bee"), F.lit("C")))
    edits = read_table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 10 == 0, " ").when(k % 31 == 0, F.repeat(F.lit("x"), 501)).otherwise(F.col("c_name")).alias("title"), names.alias("authors"), F.bround("c_acctbal").cast("int").alias("year"),
        F.when(k % 6 == 0, "German").when(k % 6 == 1, "klingon").otherwise("en").alias("language"), F.when(k % 4 == 0, "9783404105311").when(k % 4 == 1, "3-608-93814-2").otherwise("").alias("isbn"),
    )
    return b.validate_edits(edits).select("id", "error", F.array_join("authors", "|").alias("authors"))


@query("""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS year, p_brand AS publisher FROM part)
SELECT id, 'title' AS field, p_name AS old, title AS new, 'manual' AS source FROM n JOIN part ON id = p_partkey WHERE title IS DISTINCT FROM p_name
UNION ALL SELECT id, 'year', CAST(p_size AS VARCHAR), CAST(year AS VARCHAR), 'manual' FROM n JOIN part ON id = p_partkey WHERE year <> p_size""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("publisher"))
    new = old.withColumns({"title": F.when(F.col("id") % 5 != 0, F.col("title")), "year": F.when(F.col("id") % 7 == 0, F.col("year") + 1).otherwise(F.col("year"))})
    return b.changed_fields(old, new, ["title", "year", "publisher"])


@query("""SELECT p_partkey AS id, p_partkey % 4 > 1 AND p_partkey % 3 <> 0 AS free FROM part""")
def protect_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job may rewrite a title: a quarter each by hand, by a user, embedded and unknown; a third is confirmed."""
    k = F.col("p_partkey")
    source = pick(("manual", "user", "embedded", None), k % 4)
    return read_table(spark, sf_dir, "part").select(k.alias("id"), b.may_rewrite(source, k % 3 == 0).alias("free"))


@query("""SELECT c_custkey AS id, c_custkey % 4 = 2 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS has_identity FROM customer""")
def has_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = read_table(spark, sf_dir, "customer").select(k.alias("id"), pick(("Unbekannter Titel", " UNKNOWN title!", "Real", None), k % 4).alias("title"), F.when(k % 5 == 0, "a story").otherwise("").alias("description"), none.alias("genres"), F.when(k % 7 == 0, F.array(F.lit("X"))).otherwise(none).alias("authors"))
    return b.has_identity(rows, ["title", "description"], ["genres"]).select("id", "has_identity")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'a\b' WHEN 3 THEN 'c:/x' WHEN 4 THEN 'a//b' WHEN 5 THEN './a' WHEN 6 THEN 'a/b:c.txt' ELSE split_part(url, '://', 2) END AS path FROM pages)
SELECT page_id, path, page_id % 8 >= 6 AND NOT contains(path, '//') AND path NOT LIKE '%/' AS safe FROM p""")
def safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.substring_index("url", "://", -1)
    path = F.coalesce(pick(("/abs/x", "a/../b", "a\\b", "c:/x", "a//b", "./a", "a/b:c.txt", None), F.col("page_id") % 8), own)
    return read_table(spark, sf_dir, "pages").select("page_id", path.alias("path"), b.safe_path(path).alias("safe"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Rowling, Joanne Kathleen' ELSE 'Leo Tolstoy' END AS names FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def canonical_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by one author in Cyrillic letters with a work match in Latin ones; a fifth is protected, a seventh has too little confidence."""
    k = F.col("p_partkey")
    names = F.when(k % 4 < 2, F.when(k % 3 == 0, "Джоан Роулинг").otherwise("Лев Толстой")).otherwise(F.lit("Plain Name"))
    latin = F.when(k % 3 == 0, "Rowling, J.K.").otherwise(F.lit("Leo Tolstoy"))
    match = F.struct(F.upper("p_name").alias("title"), F.array(latin).alias("authors"), F.when(k % 7 == 0, 59.0).otherwise(60.0).alias("confidence"))
    rows = read_table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("title"), F.array(names).alias("authors"), F.when(k % 5 == 0, "manual").otherwise("embedded").alias("source"), F.lit(False).alias("confirmed"), match.alias("match"))
    known = spark.createDataFrame([("Rowling, J. K.",), ("Rowling, Joanne Kathleen",), ("J.K. Rowling",), ("Rowling, Kate",)], "name string")
    return b.canonical_authors(rows, known).select("id", F.array_join("names", "|").alias("names"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name WHEN 1 THEN chr(65279) || p_name WHEN 2 THEN replace(p_name, ' ', chr(160)) ELSE p_name END AS raw, p_partkey % 5 = 0 AS hand, p_name FROM part)
SELECT id, CASE WHEN hand THEN raw ELSE p_name END AS title, CASE WHEN hand OR raw = p_name THEN '' WHEN id % 4 = 1 THEN 'leading_bom' ELSE 'whitespace' END AS rules FROM r""")
def title_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with blanks, marks and hard blanks, a fifth of them given by hand."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("  "), "p_name")).when(k % 4 == 1, F.concat(F.lit("\ufeff"), "p_name")).when(k % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("\u00a0"))).otherwise(F.col("p_name"))
    rows = read_table(spark, sf_dir, "part").select(k.alias("id"), raw.alias("title"), F.when(k % 5 == 0, "manual").otherwise("filename").alias("title_source"), F.lit(None).cast(b.HISTORY).alias("history"))
    made = b.clean_title_history(rows)
    return made.select("id", "title", F.coalesce(F.array_join(F.try_element_at("history", F.lit(-1))["rules"], ","), F.lit("")).alias("rules"))


@query("""SELECT p_partkey AS id, sha256('{"lang":' || CASE WHEN p_partkey % 2 = 0 THEN '"de"' ELSE 'null' END || ',"size":' || p_size || ',"title":"' || p_name || '","version":"5"}') AS print FROM part""")
def context_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": F.col("p_name"), "size": F.col("p_size"), "lang": F.when(F.col("p_partkey") % 2 == 0, "de")}
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), b.context_fingerprint(fields, "5").alias("print"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_name || '|' || p_brand ELSE '' END AS labels, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_name END AS first_label FROM part""")
def provider_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars, objects and lists of both as a provider's values."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    obj = F.to_json(F.struct(F.lit("").alias("label"), brand.alias("name")))
    many = F.concat(F.lit("["), F.to_json(F.struct(name.alias("id"))), F.lit(","), obj, F.lit(',"'), name, F.lit('",null,""]'))
    value = F.when(k % 4 == 0, name).when(k % 4 == 1, obj).when(k % 4 == 2, many)
    return read_table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(b.labels(value), "|").alias("labels"), b.first_label(value).alias("first_label"))


@query("""SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 6 <> 0 THEN 'Fantasy Roman' END, CASE WHEN p_partkey % 6 = 0 THEN 'FANTASY' END, upper(split_part(p_name, ' ', 1)) || ' x', CASE WHEN p_partkey % 4 = 0 THEN 'Zauber' END], lambda x: x IS NOT NULL), ';') AS subjects FROM part""")
def subjects_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with shelf paths, noise, names, repeats and two of a broad group."""
    k = F.col("p_partkey")
    first = F.when(k % 6 == 0, "FANTASY").otherwise(F.lit("Fantasy Roman"))
    values = F.array(F.concat(first, F.lit("| England |ab|-"), F.upper(F.split("p_name", " ")[0]), F.lit(" x:")), F.lit("Spiegel Bestseller 2020"), F.concat(F.split("p_name", " ")[0], F.lit("  X")), F.when(k % 4 == 0, "Zauber"), F.when(k % 4 == 0, "Magie"), F.col("p_brand"), F.lit("zeitgenössische Fantasyromane"))
    rows = read_table(spark, sf_dir, "part").select(k.alias("id"), values.alias("values"), F.array(F.lower("p_brand")).alias("known"))
    return t.clean_subjects(rows, "values", "known").select("id", F.array_join("subjects", ";").alias("subjects"))


@query(r"""WITH r AS (SELECT p_partkey AS id, ['CON', 'nul.txt', 'a<b>:c?', ' . ', 'lpt1', 'x/y.epub'][p_partkey % 6 + 1] AS name FROM part)
SELECT id, ['_CON', 'nul.txt', 'a b c', 'Unbekannt', '_lpt1', 'x y.epub'][id % 6 + 1] AS part_name, ['_CON', '_nul', 'a b c', 'Unbekannter Titel', '_lpt1', 'y'][id % 6 + 1] AS title FROM r""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(("CON", "nul.txt", "a<b>:c?", " . ", "lpt1", "x/y.epub"), F.col("p_partkey") % 6)
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.sanitize_component(name).alias("part_name"), t.fallback_title(name).alias("title"))


@query("""SELECT p_partkey AS id, ['de', 'de', 'cs', 'es', 'pt', 'klingon', 'xx', NULL][p_partkey % 8 + 1] AS code, ['Deutsch', 'Deutsch', 'Tschechisch', 'Spanisch', 'Portugiesisch', 'klingon', 'XX', NULL][p_partkey % 8 + 1] AS label FROM part""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(("de_AT", "German", "Tschechisch", "Español", "pt-BR", "Klingon", "xx-Y", " "), F.col("p_partkey") % 8)
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.normalize_language(name).alias("code"))
    return rows.select("id", "code", t.language_label(F.col("code")).alias("label"))


@query("""SELECT s_suppkey AS id, lower(s_name) AS publisher_key, replace(lower(s_name), '#', ' ') AS author_key, 'supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS tag FROM supplier""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias keys by field and tags of suppliers' names."""
    name = F.concat(F.lit(" "), "s_name", F.lit("  "))
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), t.alias_key(F.lit("publisher"), name).alias("publisher_key"), t.alias_key(F.lit("author"), name).alias("author_key"), t.normalize_tag_name(name).alias("tag"))


@query("""WITH s AS (SELECT o_custkey AS book, o_orderkey AS seq, 'status' AS field, o_orderstatus AS value, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'x' END AS source FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'priority', o_orderpriority, 'y' FROM orders),
l AS (SELECT *, lag(value) OVER w AS v, lag(source) OVER w AS c, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY book, field ORDER BY seq))
SELECT book, seq, field, value, source FROM l WHERE n = 1 OR v IS DISTINCT FROM value OR c IS DISTINCT FROM source""")
def record_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books, their orders as snapshots of two fields."""
    orders = read_table(spark, sf_dir, "orders")
    one = lambda field, col, source: orders.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("seq"), F.lit(field).alias("field"), F.col(col).alias("value"), source.alias("source"))
    return b.record_sources(one("status", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, "x")).unionByName(one("priority", "o_orderpriority", F.lit("y"))))


@query("""SELECT s_suppkey AS id, ['tolstoy', 'tolstoy', 'bee', NULL, ''][s_suppkey % 5 + 1] AS family, ['ln', 'l', 'am', NULL, ''][s_suppkey % 5 + 1] AS initials, s_suppkey % 5 <> 4 AS latin FROM supplier WHERE s_suppkey % 5 < 4
UNION ALL SELECT s_suppkey, 'толстои', 'л', FALSE FROM supplier WHERE s_suppkey % 5 = 4""")
def person_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names in both orders, of one word alone and in other letters."""
    name = pick(("Tolstoy, Leo N.", "Leo Tolstoy", "Anna-Maria Bee", "Plato", "Лев Толстой"), F.col("s_suppkey") % 5)
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"))
    made = rows.withColumn("key", t.person_key(F.col("name"), t.family_first("name")))
    return made.select("id", "key.family", "key.initials", t.is_latin(F.col("name")).alias("latin"))
