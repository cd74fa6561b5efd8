"""Benchmark decontamination (operator 12): a prefix-filtered set join of item windows with documents.

Words are runs of ASCII digits and letters and of all characters beyond ASCII, A-Z lower-cased. A
window is WINDOW consecutive words of an item, or all words of a shorter one. A document holds a
window only if it holds each of its shingles (SHINGLE words), so one of them, the necessary prefix at
containment 1, suffices to find it: the one that is rarest in all documents. Shingles of documents are
joined with these prefixes; a candidate's window must begin and end inside the document (positional
and length bound); what is left is verified word by word over a slice as long as the window.

Built-in expressions only. Documents are read twice: once to count the items' shingles, once to join.
The windows are sent to all tasks if their counted bytes are few; else shingles without texts are
shuffled, and candidates meet their documents by a second join.

Defined results: a null text has no words, and an item without words no windows. Repeated rows of
documents give a row each. Items that share an id are one item; an item with a null id hits words but
is not listed. Empty tables give no rows, or documents without hits. Other columns are not read, so
that their names cannot clash. Rows that share id and text are told by count, not by order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import few_rows, stored

WINDOW = 10
#: Words of a shingle; windows of fewer words are their own shingle.
SHINGLE = 3
#: Bytes of windows, texts included, up to which they are sent to all tasks.
SENT_BYTES = 16 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words of a text, in order; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _hash(of: Column, at: Column, n: int) -> Column:
    """64 bits of the n words of an array from place at (from 0) on."""
    return F.xxhash64(F.lit(n), *[F.get(of, at + k) for k in range(n)])


def _shingles(of: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    places = F.sequence(F.lit(0), F.size(of) - n)
    return F.when(F.size(of) >= n, F.transform(places, lambda i: _hash(of, i, n))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, item): each window with the id of each item that has it."""
    held = items.select(F.col(id_col).alias("item"), words(F.col(text)).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    cut = F.when(F.size("w") > 0, F.transform(starts, lambda i: F.slice("w", i, size)))
    return held.select("item", F.explode(cut).alias("words")).distinct()


def _numbered_windows(pairs: DataFrame) -> DataFrame:
    """(window, words): distinct windows under 64-bit names."""
    return pairs.select(F.xxhash64("words").alias("window"), "words").distinct()


def rarest_prefix(windows: DataFrame, docs: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """(window, words, key, at): each window's rarest shingle over all documents and its first place in the window.

    docs has an array w. Shingles are ordered by the number of their occurrences, ties by hash, then place.
    """
    arms = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for n in sizes:
        arms = arms.when(F.least(F.size("words"), F.lit(SHINGLE)) == n, _shingles(F.col("words"), n))
    placed = stored(windows.select("window", "words", F.posexplode(arms).alias("at", "key")), "shingles")
    wanted = _sent(placed.select("key").distinct())
    runs = F.concat(*[_shingles(F.col("w"), n) for n in sizes])
    seen = docs.select(runs.alias("keys")).select(F.explode_outer("keys").alias("key")).join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    ranked = placed.join(seen, "key", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at"))
    first = ranked.groupBy("window").agg(F.min("rank").alias("r"))
    return windows.join(first, "window").select("window", "words", F.col("r.key").alias("key"), F.col("r.at").alias("at"))


def _sent(keys: DataFrame) -> DataFrame:
    """One column of 8-byte keys, marked for broadcast if they take SENT_BYTES at most (32 bytes a row)."""
    held = stored(keys, "keys")
    return F.broadcast(held) if few_rows(held, SENT_BYTES // 32) else held


def find_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, sent_bytes: int = SENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(places, pairs): for each row of docs a row (doc, print, n_words, start null), and one (doc, print, n_words, start, end, window)
    for each occurrence of a window, by places of words from 0, end exclusive; and the items of each window (window, item). Both are stored tables.
    """
    pairs = stored(item_windows(items, item_id, item_text, window), "windows")
    windows = stored(_numbered_windows(pairs), "window-words")
    read = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text)).alias("print"), words(F.col(text)).alias("w"))
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # of 1 to SHINGLE
    # Shingles are a column before they are rows, as a generator with lambdas inside would copy all words for each row; and the
    # generators are outer ones, as for others a test of the size is pushed down, and the words split anew for each shingle in it.
    per_doc = ["doc", "print", F.size("w").cast("long").alias("n_words")]
    none = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("bigint").alias("window")]
    if not sizes:
        return stored(read.select(*per_doc, *none), "places"), pairs.select(F.xxhash64("words").alias("window"), "item")
    prefix = stored(rarest_prefix(windows, read, sizes), "prefixes")
    held = prefix.agg(F.coalesce(F.sum(96 + F.size("words") * 16 + F.length(F.array_join("words", "")) * 4), F.lit(0))).first()[0]
    run = F.concat(*[F.transform(_shingles(F.col("w"), n), lambda h, i: F.struct(i.alias("place"), h.alias("key"))) for n in sizes])
    begins = F.col("place") - F.col("at")
    inside = (begins >= 0) & (begins + F.size("words") <= F.col("n_words"))
    found = [begins.alias("start"), (begins + F.size("words")).alias("end"), "window"]
    if held <= sent_bytes:
        # A row of its own, with a null key, carries each document through the join: it meets the one prefix of no words.
        run = F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("bigint").alias("key"))), run)
        itself = prefix.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("window"), F.array().cast("array<string>").alias("words"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("at"))
        sides = F.broadcast(prefix.unionByName(itself))
        met = read.select(*per_doc, "w", run.alias("run")).select("doc", "print", "n_words", "w", F.inline_outer("run")).join(sides, "key")
        own = (F.col("place") < 0) & (F.size("words") == 0)
        same = own | ((F.col("place") >= 0) & (F.size("words") > 0) & inside & (F.slice("w", F.greatest(begins, F.lit(0)) + 1, F.size("words")) == F.col("words")))
        hit = lambda c, name: F.when(~own, c).alias(name)
        places = met.where(same).select("doc", "print", "n_words", hit(begins, "start"), hit(begins + F.size("words"), "end"), "window")
        return stored(places, "places"), pairs.select(F.xxhash64("words").alias("window"), "item")
    slim = prefix.select("window", F.size("words").alias("n"), "key", "at")
    fits = (begins >= 0) & (begins + F.col("n") <= F.col("n_words"))
    candidates = read.select(*per_doc, run.alias("run")).select("doc", "print", "n_words", F.inline_outer("run")).join(slim, "key").where(fits).select("doc", "print", begins.alias("begin"), "window", "n").distinct()
    by_doc = candidates.groupBy("doc", "print").agg(F.collect_list(F.struct("begin", "window", "n")).alias("found")).withColumnRenamed("doc", "d").withColumnRenamed("print", "p")
    texts = read.dropDuplicates(["doc", "print"]).join(by_doc, F.col("doc").eqNullSafe(F.col("d")) & F.col("print").eqNullSafe(F.col("p")))
    slices = texts.select(*per_doc, "w", F.inline("found")).select("doc", "print", "n_words", F.col("begin").alias("start"), (F.col("begin") + F.col("n")).alias("end"), "window", F.slice("w", F.col("begin") + 1, F.col("n")).alias("cut"))
    hits = slices.join(windows, "window").where("cut = words").select("doc", "print", "n_words", "start", "end", "window")
    return stored(read.select(*per_doc, *none).unionByName(hits), "places"), pairs.select(F.xxhash64("words").alias("window"), "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_hit (words inside any occurrence), spans (maximal runs of hit words: start,
    end, by place from 0, end exclusive) and items (ids, as strings, of the items with occurring windows, in order).
    """
    places, pairs = find_windows(docs, items, id_col, text, item_id, item_text, window, sent_bytes)
    key = ["doc", "print"]
    one = places.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("found"),
    )
    asked = pairs.select("window", F.col("item").cast("string").alias("item")).where("item is not null").distinct()
    named = places.where("start is not null").select(*key, "window").distinct().join(asked, "window").select(*key, "item").distinct()
    listed = named.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items")).withColumnsRenamed({"doc": "d", "print": "p"})
    both = one.join(listed, F.col("doc").eqNullSafe(F.col("d")) & F.col("print").eqNullSafe(F.col("p")), "left")
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    held = both.withColumn("hit", hit)
    first = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) != x - 1))
    last = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) != x + 1))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    out = held.select(F.col("doc").alias(id_col), "n_words", F.size("hit").cast("long").alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def oracle(docs: str = "documents", items: str = "benchmark", window: int = WINDOW) -> str:
    """DuckDB SQL of the query over contamination(): windows as strings of words, looked up at each place of each document."""
    found = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {found} AS ws FROM {items}),
win AS (
  SELECT DISTINCT item_id, array_to_string(ws[k:k + least(len(ws), {window}) - 1], ' ') AS s, least(len(ws), {window}) AS n
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), {window}) + 2)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ws FROM {docs}),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
occ AS (
  SELECT p.r, p.k, win.n, win.item_id
  FROM (SELECT r, k, z.n, array_to_string(ws[k:k + z.n - 1], ' ') AS s FROM p, (SELECT DISTINCT n FROM win) z WHERE k + z.n - 1 <= len(ws)) p JOIN win ON p.s = win.s AND p.n = win.n),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM (SELECT DISTINCT r, k, n FROM occ)) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
