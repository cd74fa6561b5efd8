"""Expected values of text and ISBN columns, ledger folds, evidence and merging."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark import sqlnames
from shelfspark.functions import isbn as i
from shelfspark.functions import text as t
from shelfspark.operators import duplicates as d
from shelfspark.operators import fingerprint as fp
from shelfspark.operators import linkage as k
from shelfspark.operators import usage as u


def value(spark, column, **inputs):
    row = {n: v for n, v in inputs.items()}
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for n, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("3-404-10531-1", "9783404105311"), ("978-3-404-10531-1", "9783404105311"), ("3-608-93814-2", None), ("9783608938145", None), ("not-an-isbn", None), (None, None), ("", None)])
def test_canonical_isbn(spark, raw, want):
    assert value(spark, i.canonical_isbn13(F.col("c")), c=raw) == want


def test_isbn_keeps_spelling_without_checksum(spark):
    assert value(spark, i.normalize_isbn(F.col("c")), c="978-3-608-93814-5") == "9783608938145"
    assert value(spark, i.isbn13_to_isbn10(F.col("c")), c="9783404105311") == "3404105311"


@pytest.mark.parametrize(("raw", "want"), [("  DÉR   Hobbit! ", "der hobbit"), (None, ""), ("Straße", "strasse")])
def test_normalize_text(spark, raw, want):
    assert value(spark, t.normalize_text(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("de", "de"), ("de-DE", "de"), ("de_DE", "de"), ("de de", "de"), ("deu", "de"), ("ger", "de"), ("Deutsch", "de"), ("German", "de"), ("spa", "es"), ("cze", "cs"), ("Tschechisch", "cs"), ("pt-BR", "pt"), ("xx-Y", "xx"), ("Klingonisch", "klingonisch"), (None, None), (" ", None)])
def test_language(spark, raw, want):
    assert value(spark, t.normalize_language(F.col("c")), c=raw) == want


def test_author_key_turns_names(spark):
    a, b = (value(spark, t.author_key(F.col("c")), c=x) for x in ("Tolkien, J. R. R.", "J. R. R. Tolkien"))
    assert a == b == "j r r tolkien"


@pytest.mark.parametrize(("raw", "title", "rules"), [("  Der   Zauberberg  ", "Der Zauberberg", ["whitespace"]), ("Cafe\u0301", "Caf\u00e9", ["nfc"]), ("\ufeffA", "A", ["leading_bom"]), ("Plain?", "Plain?", [])])
def test_clean_title(spark, raw, title, rules):
    got = value(spark, t.clean_title(F.col("c")), c=raw)
    assert (got["title"], got["rules"], got["error"]) == (title, rules, None)
    assert value(spark, t.clean_title(F.col("c")), c=title)["rules"] == []


@pytest.mark.parametrize(("raw", "error"), [(" ", "empty"), (None, "empty"), ("a\x07b", "control_character"), ("x" * 501, "too_long")])
def test_clean_title_errors(spark, raw, error):
    assert value(spark, t.clean_title(F.col("c")), c=raw)["error"] == error


def test_tags_keep_punctuation(spark):
    assert value(spark, t.normalize_tag_name(F.col("c")), c=" C++ ") == "c++"
    assert value(spark, t.dedupe_tags(F.col("c")), c=["A", "a", "B ", ""]) == ["A", "B"]


def test_minhash_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 1000, 5000):
        v = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = [min((int(x) * (2 * s + 1) + s * fp.GOLDEN) % 2**64 for x in v) for s in range(32)]
        assert fp.signature_of(v).tolist() == want
    assert not len(fp.signature_of(np.empty(0, np.uint64)))


def test_budget_rejected_requests_hold_nothing(spark):
    rows = [(1, "2024-01-01 00:00:00", 0.02), (2, "2024-01-01 01:00:00", 0.03), (3, "2024-01-01 02:00:00", 0.01), (4, "2024-01-02 00:00:00", 0.02)]
    df = spark.createDataFrame(rows, "id long, created_at string, estimate double").withColumn("created_at", F.to_timestamp("created_at"))
    got = {r["id"]: r["admitted"] for r in u.admit_by_budget(df, 0.03, 0.045).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_batches_close_by_count_or_size(spark):
    df = spark.createDataFrame([(1, n, s) for n, s in enumerate([5.0, 5.0, 1.0, 20.0, 1.0, 1.0, 1.0])], "k int, n int, size double")
    got = [r["batch"] for r in u.pack_batches(df, "k", ["n"], "size", 3, 10).orderBy("n").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3]


def test_evidence_rules(spark):
    schema = "left int, right int, l_title string, r_title string, l_authors array<string>, r_authors array<string>, l_isbn string, r_isbn string, l_language string, r_language string, l_year int, r_year int, l_publisher string, r_publisher string, l_series string, r_series string, l_words int, r_words int, relation string"
    def row(n, **x):
        base = {"l_title": "der hobbit", "r_title": "der hobbit", "l_authors": ["a"], "r_authors": ["a"], "l_isbn": None, "r_isbn": None, "l_language": "de", "r_language": "de", "l_year": None, "r_year": None, "l_publisher": None, "r_publisher": None, "l_series": None, "r_series": None, "l_words": 2000, "r_words": 2000, "relation": None}
        return (n, n + 100, *(base | x).values())
    rows = [row(1), row(2, r_language="en"), row(3, relation="same"), row(4, relation="same", l_words=10), row(5, l_isbn="9", r_isbn="9", r_language="en"), row(6, r_authors=["b"]), row(7, relation="partial", r_title="x"), row(8, l_year=2000, r_year=2010, l_publisher="p", r_publisher="q")]
    got = {r["left"]: r["kind"] for r in d.evidence(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "metadata", 3: "content", 4: "short_content", 5: "edition", 7: "partial_content"}


def test_merge_keeps_best_scalars_and_order(spark):
    rows = [("x", 1, 90.0, "A", ["s1"]), ("x", 2, 95.0, "B", ["s2", "s1"]), ("x", 3, 95.0, "C", ["s3"])]
    df = spark.createDataFrame(rows, "isbn13 string, arrival int, score double, title string, sources array<string>")
    got = k.merge_candidates(df, "isbn13", "score", "arrival", ["title"], ["sources"]).first()
    assert (got["title"], got["sources"], got["score"]) == ("B", ["s1", "s2", "s3"], 95.0)


def test_reconcile(spark):
    found = "left int, right int, kind string, reasons array<string>, conflicts array<string>"
    a, b = ["same_text"], ["near_text"]
    now = spark.createDataFrame([(1, 2, "content", a, []), (1, 3, "metadata", a, []), (5, 6, "content", a, []), (2, 3, "content", b, []), (2, 4, "content", a, ["title"]), (2, 5, None, None, None)], found)
    old = spark.createDataFrame(
        [(1, 2, "content", a, [], "keep_both"), (1, 3, "content", a, [], "confirmed"), (7, 8, "content", a, [], None), (2, 3, "content", a, [], "keep_both"), (2, 4, "content", a, [], None), (2, 5, None, None, None, "confirmed")], found + ", decision string"
    )
    got = {(r["left"], r["right"]): (r["state"], r["decision"], r["event"]) for r in d.reconcile(now, old).collect()}
    assert got == {(1, 2): ("kept", "keep_both", None), (1, 3): ("changed", None, "reset"), (5, 6): ("inserted", None, None), (7, 8): ("deleted", None, None), (2, 3): ("changed", None, "reset"), (2, 4): ("changed", None, None), (2, 5): ("kept", "confirmed", None)}


@pytest.mark.parametrize(("raw", "want"), [("CON", "_CON"), ("nul.txt", "nul.txt"), ("a/b:c*?", "a b c"), (" . ", "Unbekannt"), (None, "Unbekannt"), ("x" * 130, "x" * 120), ("Cafe\u0301", "Caf\u00e9")])
def test_file_name_parts(spark, raw, want):
    assert value(spark, t.sanitize_component(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("a/b/Der Hobbit.epub", "Der Hobbit"), (".hidden", "hidden"), ("x.tar.gz", "x.tar"), ("", "Unbekannter Titel")])
def test_fallback_titles(spark, raw, want):
    assert value(spark, t.fallback_title(F.col("c")), c=raw) == want


def test_subjects(spark):
    rows = [(["Fantasy | Geschenkbuch|  Drachen -", "fantasy roman", "Zauber", "Magie", "England", "ab", "Drachen!", None, "Tolkien"], ["J. R. R. Tolkien", "TOLKIEN"]), (None, None), ([], [])]
    df = spark.createDataFrame(rows, "v array<string>, k array<string>")
    assert [r["subjects"] for r in t.clean_subjects(df, "v", "k").collect()] == [["Fantasy", "Drachen", "Zauber"], [], []]
    assert [r["subjects"] for r in t.clean_subjects(df, "v", most=1).collect()] == [["Fantasy"], [], []]


def test_fingerprints_fold_compatible_forms(spark):
    """Ligatures, sharp s, full-width letters and soft hyphens do not tell texts apart."""
    texts = ["The ﬁrst straße of ＷＯＲＤＳ co\u00adoperates", "the first strasse of words cooperates", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r["id"]: r for r in fp.fingerprint(df, 0).collect()}
    assert rows[0]["text_hash"] == rows[1]["text_hash"] is not None and rows[0]["shingles"] == rows[1]["shingles"] and len(rows[0]["shingles"]) == 2
    assert [rows[i]["status"] for i in range(4)] == ["complete", "complete", "unavailable", "unavailable"]


def test_any_longest_token_makes_a_candidate(spark):
    rows = [(1, "der kleine hobbit reise"), (2, "reise um die welt"), (3, "der hobbit"), (4, "hobbitse kleinen"), (5, "")]
    got = {tuple(r) for r in d.pairs_by_rare_tokens(spark.createDataFrame(rows, "id long, title_key string")).collect()}
    assert got == {(1, 2), (1, 3)}


def test_pairs_of_a_hot_key(spark):
    got = d.ordered_pairs(spark.range(700).select("id", F.lit("k").alias("key")), "key")
    assert got.count() == 700 * 699 // 2 and got.where("left >= right").count() == 0


def test_similarity(spark):
    df = spark.createDataFrame([("Der Hobbit", "der hobbit!", ["x", "HOBBIT der"]), ("abc", None, None), ("wort eins", "wort zwei", [])], "a string, b string, bs array<string>")
    got = [tuple(r) for r in df.select(k.name_similarity("a", "b"), k.best_similarity("a", "bs")).collect()]
    assert got[0] == (1.0, 1.0) and got[1] == (0.0, 0.0) and 0.5 <= got[2][0] < 1


def test_redaction_is_recursive():
    got = u.redact_json('{"a": {"Authorization": "x", "n": [{"api_key": 1, "tokens": 7, "access_token": "y"}]}, "url": "http://h/p?token=abc&q=1"}')
    assert got == '{"a": {"Authorization": "[REDACTED]", "n": [{"api_key": "[REDACTED]", "tokens": 7, "access_token": "[REDACTED]"}]}, "url": "http://h/p?token=[REDACTED]&q=1"}'
    assert u.redact_json("no json") == "no json" and u.redact_json(None) is None


TEXTS = ["  a   b ", "x" * 300, "J. R. R. Tolkien", "Tolkien, J. R. R.", "DÉR   Hobbit!", "", None, "CON", "c1999", "de_DE", "Caf\u0065\u0301", "a\x07b", "tiﬁ C++"]


def test_names_in_sql_are_the_functions(spark):
    sqlnames.register(spark)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    df.createOrReplaceTempView("texts")
    for name, f in {**sqlnames.COLUMNS, "normalize_tag_name": t.normalize_tag_name, "alias_key": lambda c: t.alias_key(F.lit("author"), c)}.items():
        call = "alias_key('author', x)" if name == "alias_key" else f"{name}(x)"
        got, want = spark.sql(f"SELECT {call} AS r FROM texts ORDER BY i").collect(), df.orderBy("i").select(f(F.col("x")).alias("r")).collect()
        assert [r[0] if not isinstance(r[0], tuple) else tuple(r[0]) for r in got] == [r[0] if not isinstance(r[0], tuple) else tuple(r[0]) for r in want], name
    numbers = spark.sql("SELECT isbn10_to_isbn13('3404105311') a, isbn13_to_isbn10('9783404105311') b, isbn13_to_isbn10('9791090636071') c, isbn10_to_isbn13('3404105312') d").first()
    assert numbers["a"] == spark.range(1).select(i.isbn10_to_isbn13(F.lit("3404105311"))).first()[0] and numbers["b"] == spark.range(1).select(i.isbn13_to_isbn10(F.lit("9783404105311"))).first()[0]
    assert numbers["c"] is None and numbers["d"] is None


@pytest.mark.parametrize("size", ["7", "10000"])
def test_a_null_key_is_one_key(spark, size):
    """30,000 rows of one null key, eight a batch, and a null size among them, whatever Arrow's batches are."""
    rows = spark.range(30_000 if size == "10000" else 300).select(F.lit(None).cast("string").alias("k"), "id", F.when(F.col("id") % 10 > 0, F.lit(1.0)).alias("size"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = u.pack_batches(rows, "k", ["id"], "size", 8, 100.0).collect()
        admitted = u.spend(rows.withColumn("most", F.lit(50.0)).fillna(1.0, "size"), "k", ["id"], "size", "most").where("admitted").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r["batch"] for r in sorted(got, key=lambda r: r["id"])] == [i // 8 for i in range(len(got))] and admitted == 50
