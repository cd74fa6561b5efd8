"""Record linkage: similarity, scores, merging candidates, acceptance, catalogue links."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import _plain, normalize_language, normalize_text, plain_forms
from shelfspark.operators.duplicates import PART_ROWS, ordered_pairs, union_pairs
from shelfspark.shared import small_side, stored

EDITION_WEIGHTS = {"title": 40, "authors": 35, "language": 10, "year": 10, "publisher": 5}
WORK_WEIGHTS = {"title": 50, "authors": 40, "language": 10}


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normal texts; null counts as empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def token_similarity(a: Column, b: Column) -> Column:
    """0 if either normal text is empty, 1 if equal, else shared words over the larger number of words."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).otherwise(shared)


def similarity(a: Column, b: Column) -> Column:
    words = token_similarity(a, b)
    return F.when(words.isin(0.0, 1.0) & ((a == b) | (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")), words).otherwise(F.greatest(words, sequence_ratio(a, b)))


def weighted_score(parts: dict[str, Column], weights: dict[str, int]) -> Column:
    """100 times the weighted mean of the parts (null parts do not count), one decimal, half to even; 0 without any."""
    points = sum((F.coalesce(parts[n], F.lit(0.0)) * w for n, w in weights.items()), F.lit(0.0))
    held = sum((F.when(parts[n].isNotNull(), F.lit(w)).otherwise(0) for n, w in weights.items()), F.lit(0))
    return F.when(held > 0, F.bround(100 * points / held, 1)).otherwise(F.lit(0.0))


def year_part(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.6).otherwise(0.0))


def match_type(score: Column, year_a: Column, year_b: Column, publisher: Column) -> Column:
    """edition iff the score is 95 or more, both years are known and at most one apart, and publishers agree by 0.8."""
    ok = (score >= 95) & year_a.isNotNull() & year_b.isNotNull() & (F.abs(year_a - year_b) <= 1) & (F.coalesce(publisher, F.lit(0.0)) >= 0.8)
    return F.when(F.coalesce(ok, F.lit(False)), "edition").otherwise("reference")


def merge_candidates(cands: DataFrame, key: str, score: str, arrival: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row of each key: scalars of the best-scoring candidate (first on ties), arrays united in order of arrival."""
    best = F.max_by(F.struct(*scalars), F.struct(F.col(score), -F.col(arrival))).alias("__best")
    united = [F.array_sort(F.collect_list(F.struct(arrival, F.col(n).alias("v")))).alias(f"__{n}") for n in lists]
    made = cands.groupBy(key).agg(best, *united, F.max(score).alias(score))
    return made.select(key, score, *[F.col(f"__best.{s}").alias(s) for s in scalars], *[F.array_distinct(F.flatten(F.transform(f"__{n}", lambda s: s["v"]))).alias(n) for n in lists])


@lru_cache(1 << 14)
def _similar_short(a: str, b: str) -> float:
    return _similarity(a, b)


def _similar(a: str | None, b: str | None) -> float:
    """The similarity of two names; pairs of short ones recur, as names and publishers do, and are compared once."""
    if not a or not b:
        return 0.0
    return _similar_short(a, b) if len(a) + len(b) <= 200 else _similarity(a, b)


def _similarity(a: str, b: str) -> float:
    x, y = _plain(a), _plain(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    u, v = set(x.split()), set(y.split())
    return max(SequenceMatcher(None, x, y).ratio(), len(u & v) / max(len(u), len(v), 1))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names or titles in plain form: 1 if equal, 0 if one is empty, else the larger of matching blocks and shared words."""
    return pd.Series([_similar(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def likeness(a: Column, b: Column) -> Column:
    """name_similarity; equal names with a letter or digit of ASCII, which their plain form keeps, do not go to Python."""
    same = F.coalesce((a == b) & a.rlike("[A-Za-z0-9]"), F.lit(False))
    return F.when(same, 1.0).otherwise(name_similarity(F.when(~same, a), F.when(~same, b)))


@F.pandas_udf(T.DoubleType())
def best_similarity(a: pd.Series, names: pd.Series) -> pd.Series:
    """The largest similarity of a name to any of an array of names; 0 without any."""
    return pd.Series([max((_similar(x, y) for y in (ys if ys is not None else ())), default=0.0) for x, ys in zip(a, names, strict=True)], dtype=float)


def scored(cands: DataFrame) -> DataFrame:
    """cands with score, work_score and match_type.

    What is asked for: q_title, q_author, q_language, q_year, q_publisher; the candidate: title,
    authors, language, year, publisher. A part that one side lacks does not count, but the author counts if asked for.
    """
    code = lambda c: normalize_language(F.col(c))
    sides = cands.withColumns({"__t": likeness(F.col("q_title"), F.col("title")), "__a": best_similarity("q_author", "authors"), "__p": likeness(F.col("q_publisher"), F.col("publisher")), "__ql": code("q_language"), "__l": code("language")})
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    parts = {
        "title": F.col("__t"), "authors": F.when(has("q_author"), F.col("__a")),
        "language": F.when(F.col("__ql").isNotNull() & F.col("__l").isNotNull(), (F.col("__ql") == F.col("__l")).cast("double")),
        "year": year_part(F.col("q_year"), F.col("year")), "publisher": F.when(has("q_publisher") & has("publisher"), F.col("__p")),
    }
    made = sides.withColumns({"score": weighted_score(parts, EDITION_WEIGHTS), "work_score": weighted_score(parts, WORK_WEIGHTS)})
    publisher = F.when(has("q_publisher") & has("publisher"), F.col("__p"))
    return made.withColumn("match_type", match_type(F.col("score"), F.col("q_year"), F.col("year"), publisher)).drop("__t", "__a", "__p", "__ql", "__l")


ASKED = ("q_title", "q_author", "q_language", "q_year", "q_publisher")
SCALARS = ("title", "publisher", "year", "language")
LISTS = ("authors", "subjects", "series", "sources", "source_ids")


def search_candidates(cands: DataFrame, book: str = "book_id") -> DataFrame:
    """One row of each book and ISBN of scored providers' rows (arrival tells their order), merged and scored again, with accepted."""
    once = scored(cands)
    rows = once.withColumn("__k", F.struct(book, "isbn13"))
    merged = merge_candidates(rows, "__k", "score", "arrival", [*ASKED, *SCALARS], list(LISTS))
    flat = merged.select(F.col(f"__k.{book}").alias(book), F.col("__k.isbn13").alias("isbn13"), *ASKED, *SCALARS, *LISTS)
    return accepted(scored(flat), book)


def accepted(cands: DataFrame, book: str = "book_id") -> DataFrame:
    """cands (scored, with sources) with accepted: edition, reference or null.

    edition: the one edition of a book, if it has two sources or is the book's only candidate.
    Without one, reference: the best work by score of 90 or more and 5 above the next other work;
    rows of equal work score, title and set of authors are one work.
    """
    plain = cands.withColumns({"__names": plain_forms("authors"), "__title": normalize_text("title")})
    rows = plain.withColumn("__work", F.struct("work_score", "__title", F.array_sort(F.array_distinct("__names")).alias("n"))).drop("__names", "__title")
    rows = stored(rows, "scored")  # read three times
    edition = (F.col("match_type") == "edition") & (F.col("score") >= 95)
    per = rows.groupBy(book).agg(
        F.count_if(edition).alias("__e"), F.count("*").alias("__all"), F.max(F.when(edition, F.size("sources"))).alias("__s"),
        F.min_by(F.struct("isbn13", "work_score", "__work"), F.when(F.col("match_type") == "reference", F.struct(-F.col("work_score"), -F.col("score"), F.col("isbn13")))).alias("__top"),
    )
    both = rows.join(per, book)
    next_ = both.where((F.col("match_type") == "reference") & (F.col("__work") != F.col("__top.__work"))).groupBy(book).agg(F.max("work_score").alias("__next"))
    both = both.join(next_, book, "left")
    auto = (F.col("__e") == 1) & ((F.col("__s") >= 2) | (F.col("__all") == 1))
    far = F.coalesce((F.col("__top.work_score") >= 90) & (F.col("__next").isNull() | (F.col("__top.work_score") - F.col("__next") >= 5)), F.lit(False))
    told = F.when(auto & edition, "edition").when(~auto & far & (F.col("match_type") == "reference") & (F.col("isbn13") == F.col("__top.isbn13")), "reference")
    return both.withColumn("accepted", told).drop("__work", "__e", "__all", "__s", "__top", "__next")


def order_candidates(cands: DataFrame) -> DataFrame:
    return cands.orderBy(F.desc("score"), "isbn13")


def plausible_match(title: Column, wanted_title: Column, author: Column | None = None, wanted_author: Column | None = None) -> Column:
    """Titles contain one another or hold seven tenths of the wanted words; authors, if both are known, contain one another."""
    words = F.array_distinct(F.split(wanted_title, " "))
    part = F.size(F.array_intersect(words, F.split(title, " "))) / F.size(words)
    near = F.contains(title, wanted_title) | F.contains(wanted_title, title) | (part >= 0.7)
    if author is None or wanted_author is None:
        return F.coalesce(near, F.lit(False))
    same = author.isNull() | wanted_author.isNull() | F.contains(author, wanted_author) | F.contains(wanted_author, author)
    return F.coalesce(near & same, F.lit(False))


def merge_field(target: Column, source: Column, title: bool = False, kind: str = "string") -> Column:
    """struct(value, source): manual values stay; a missing source (null, '' or an empty list, by the values' kind) changes nothing; a title only replaces a missing or filename one."""
    void = (lambda v: F.size(v) == 0) if kind.startswith("array") else (lambda v: v == "") if kind == "string" else (lambda v: F.lit(False))
    empty = lambda f: f["value"].isNull() | void(f["value"])
    keep = (F.coalesce(target["source"], F.lit("")) == "manual") | empty(source)
    if title:
        keep = keep | ~(empty(target) | (target["source"] == "filename"))
    return F.when(F.coalesce(keep, F.lit(False)), target).otherwise(source)


def merge_fields(target: Column, source: Column, fields: dict[str, str]) -> Column:
    """A struct of fields (value, source) after merging another source's: see merge_field; ISBNs are never taken over. fields: names and types of the values."""
    made = [target[f].alias(f) if f == "isbn" else merge_field(target[f], source[f], f == "title", kind).alias(f) for f, kind in fields.items()]
    return F.struct(*made)


def related_editions(cands: DataFrame) -> DataFrame:
    """(a, b), a < b: ISBNs of one book by equal title and author set, or by a shared source id; two equi-joins, no theta join."""
    by_work = cands.where(F.col("title_key") != "").select(F.col("isbn13").alias("id"), F.concat_ws("|", "title_key", F.array_join(F.array_sort("authors"), ";")).alias("k"))
    by_id = cands.select(F.col("isbn13").alias("id"), F.explode("source_ids").alias("k"))
    return union_pairs(*[ordered_pairs(x.distinct(), "k") for x in (by_work, by_id)]).select(F.col("left").alias("a"), F.col("right").alias("b"))


def reference_record(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """(isbn13, reference_isbns, subjects, series): what a candidate's related editions (a, b) bring together, its own first, each once in order."""
    both = pairs.select(F.col("a").alias("isbn13"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("isbn13"), F.col("a").alias("other")))
    every = both.unionByName(cands.select("isbn13", F.col("isbn13").alias("other")))
    told = cands.select(F.col("isbn13").alias("other"), "subjects", "series")
    rows = every.join(told, "other").withColumn("own", F.col("other") != F.col("isbn13"))
    lists = rows.groupBy("isbn13").agg(F.array_sort(F.collect_list(F.struct("own", "other", "subjects", "series"))).alias("r"))
    flat = lambda f: F.array_distinct(F.flatten(F.transform("r", lambda x: x[f])))
    return lists.select("isbn13", F.transform("r", lambda x: x["other"]).alias("reference_isbns"), flat("subjects").alias("subjects"), flat("series").alias("series"))


def link_catalogue(books: DataFrame, catalogue: DataFrame, priority: DataFrame, hits: int = 5) -> DataFrame:
    """(id, source, entry, by): the entry of each book (id, isbn, title, author) in the first source, by priority (source, place), that has one.

    catalogue: (source, entry, isbn, title, author, rank). A book with an ISBN takes a source's
    first entry of it; without one, the first plausible one of the first `hits` entries, by rank, whose title is near
    (see plausible_match). Such an entry holds one of the wanted words that may not all be missing, the rarest ones of
    the title; or all of its own words are wanted, its rarest one too. Only these are joined, and hot words are
    split. Titles that are parts of one another within a word are not found.
    """
    side = small_side(stored(priority.select("source", "place"), "priority"))
    entries = catalogue.join(side, "source")
    isbn = books.where(F.col("isbn").isNotNull()).select("id", "isbn").join(entries.select("source", "place", "entry", "isbn", "rank"), "isbn").select("id", "source", "place", "entry", "rank", F.lit("isbn").alias("by"))
    words = stored(entries.select("source", "place", "entry", "rank", normalize_text("title").alias("title"), F.when(F.col("author").isNotNull(), normalize_text("author")).alias("author")), "entries")
    split = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    posted = words.select("source", "entry", F.explode(split("title")).alias("w"))
    often = stored(posted.groupBy("w").agg(F.count("*").alias("c")), "words")
    asked = books.where(F.col("isbn").isNull()).select("id", normalize_text("title").alias("q"), F.when(F.col("author").isNotNull(), normalize_text("author")).alias("qa"))
    wanted = asked.select("id", F.explode(split("q")).alias("w")).join(often, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ranked = wanted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("ws"))
    need = F.size("ws") - F.ceil(F.size("ws") * F.lit(0.7) - F.lit(1e-9)).cast("int") + 1
    first = ranked.select("id", F.explode(F.slice("ws", 1, need)).alias("x")).select("id", "x.w", F.lit(0).alias("side"))
    least = posted.join(often, "w").groupBy("source", "entry").agg(F.min_by("w", F.struct("c", "w")).alias("w"))
    left = first.unionByName(wanted.select("id", "w", F.lit(1).alias("side")))
    right = posted.withColumn("side", F.lit(0)).unionByName(least.select("source", "entry", "w", F.lit(1).alias("side")))
    parts = right.groupBy("side", "w").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("k"))
    asks = left.join(parts, ["side", "w"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    gives = right.join(parts, ["side", "w"]).withColumn("part", F.pmod(F.xxhash64("source", "entry"), F.col("k")).cast("int")).drop("k")
    found = asks.join(gives, ["side", "w", "part"]).select("id", "source", "entry").distinct().join(words, ["source", "entry"]).join(asked, "id")
    n = F.row_number().over(Window.partitionBy("id", "source").orderBy("rank", "entry"))
    hit = found.where((F.col("q") != "") & (F.col("title") != "") & plausible_match(F.col("title"), F.col("q"))).withColumn("n", n)
    near = hit.where((F.col("n") <= hits) & plausible_match(F.col("title"), F.col("q"), F.col("author"), F.col("qa")))
    every = isbn.unionByName(near.select("id", "source", "place", "entry", "rank", F.lit("title").alias("by")))
    return every.groupBy("id").agg(F.min_by(F.struct("source", "entry", "by"), F.struct("place", "source", "rank", "entry")).alias("x")).select("id", "x.source", "x.entry", "x.by")


POSITIVE_DAYS, NEGATIVE_DAYS = 30, 7
CACHE_KEY = ("title", "author", "language", "year", "publisher")


def lookup_key(queries: DataFrame) -> DataFrame:
    """queries (title, author, language, year, publisher) with the key under which their answers are kept: equal for equal normal forms."""
    forms = {"title": normalize_text("title"), "author": normalize_text("author"), "language": normalize_language(F.col("language")), "year": F.col("year").cast("string"), "publisher": normalize_text("publisher")}
    return queries.withColumn("key", F.sha2(F.to_json(F.struct(*[F.coalesce(forms[c], F.lit("")).alias(c) for c in CACHE_KEY])), 256))


def store_lookups(cache: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """cache (key, candidates, expires_at) after answers of providers (key, provider, failed, candidates, at): the new rows, without those expired at now.

    A lookup is a key's answers of one time; its candidates are those of all providers, in their order. It is kept for POSITIVE_DAYS if there are
    any, for NEGATIVE_DAYS if there are none, and not at all if there are none and a provider failed. The latest lookup of a key replaces what was kept.
    """
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("provider", "candidates"))), lambda x: x["candidates"]))
    told = answers.withColumn("candidates", F.when(F.col("failed"), F.array().cast(answers.schema["candidates"].dataType)).otherwise(F.col("candidates")))
    asked = told.groupBy("key", "at").agg(listed.alias("candidates"), F.bool_or("failed").alias("outage")).where((F.size("candidates") > 0) | ~F.col("outage"))
    days = F.when(F.size("candidates") > 0, F.lit(POSITIVE_DAYS)).otherwise(F.lit(NEGATIVE_DAYS))
    fresh = asked.withColumn("expires_at", F.col("at") + F.make_interval(days=days)).select("key", "candidates", "expires_at", "at")
    every = cache.withColumn("at", F.lit(None).cast(answers.schema["at"].dataType)).unionByName(fresh)
    last = every.groupBy("key").agg(F.max_by(F.struct("candidates", "expires_at"), F.coalesce("at", F.to_timestamp(F.lit("0001-01-01")))).alias("x"))
    return last.select("key", "x.candidates", "x.expires_at").where(F.col("expires_at") > now)


def cached(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """queries (with a key) with candidates: those kept and not expired, null where providers are to be asked."""
    return queries.join(cache.where(F.col("expires_at") > now).select("key", "candidates"), "key", "left")
