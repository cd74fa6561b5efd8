"""Books as records: the read model, edits, provenance of fields, identity, tags and authors' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import isbn as i
from shelfspark.functions import text as t
from shelfspark.operators import catalogue as c

PROTECTED = ("manual", "user")
#: Titles and names that stand for none, in plain form.
PLACEHOLDERS = ("unbekannter titel", "unbekannt", "unknown title", "unknown")


def _none() -> Column:
    return F.array().cast("array<string>")


def document_value(document: Column, field: str) -> Column:
    """A field's value in a metadata document."""
    return F.get_json_object(document, f"$.metadata.{field}.value")


def book_view(books: DataFrame, authors: DataFrame, tags: DataFrame, detail: bool = False) -> DataFrame:
    """The read model of books (id, title, language, has_cover, cover_path, document, ...).

    authors, tags: (id, name). language comes as its code with a label; has_cover only with a path.
    detail adds description and work_match, of the column or else the document.
    """
    named = lambda names, out: names.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias(out))
    made = books.join(named(authors, "authors"), "id", "left").join(named(tags, "tags"), "id", "left")
    code = t.normalize_language(F.col("language"))
    made = made.withColumns({"authors": F.coalesce("authors", _none()), "tags": F.coalesce("tags", _none()), "language": code})
    made = made.withColumns({"language_label": t.language_label(F.col("language")), "has_cover": F.coalesce(F.col("has_cover") & F.col("cover_path").isNotNull(), F.lit(False))})
    if detail:
        for name in ("description", "work_match"):
            made = made.withColumn(name, F.coalesce(F.col(name), document_value(F.col("document"), name)))
    return made.drop("document") if detail else made.drop("document", "description", "work_match")


def get_book(books: DataFrame, authors: DataFrame, tags: DataFrame, key: int | str) -> DataFrame:
    """The read model of one book, in detail."""
    one = lambda df: df.where(F.col("id") == key)
    return book_view(one(books), one(authors), one(tags), detail=True)


def find_books(
    books: DataFrame, authors: DataFrame | None = None, tags: DataFrame | None = None, author: str | None = None, tag: str | None = None, year_from: int | None = None, year_to: int | None = None,
    language: str | None = None, publisher: str | None = None, format: str | None = None, series: str | None = None,
) -> DataFrame:
    """Books that hold all given conditions; years are inclusive, tags compare by normal name, languages by code, formats in lower case."""
    found = c.filter_books(books, (year_from, year_to), publisher=publisher, series=series)
    if author is not None:
        found = found.join(authors.where(F.col("name") == author).select("id"), "id", "left_semi")
    if tag is not None:
        found = found.join(tags.where(t.normalize_tag_name(F.col("name")) == t.normalize_tag_name(F.lit(tag))).select("id"), "id", "left_semi")
    if language is not None:
        found = found.where(t.normalize_language(F.col("language")) == t.normalize_language(F.lit(language)))
    return found if format is None else found.where(F.lower("format") == format.lower())


def count_books(books: DataFrame, **filters) -> DataFrame:
    """One row: the number of books that find_books finds."""
    return find_books(books, **filters).agg(F.count("*").alias("books"))


def validate_edits(edits: DataFrame, year_low: int = 0, year_high: int = 9999) -> DataFrame:
    """edits (title, authors, year, language, isbn, ...) with error: the first rule that fails, null if none does; and authors cleaned.

    An absent (null) field is not edited. Authors: single blanks, the first spelling of each in any case.
    """
    trimmed = F.transform("authors", lambda a: t.squeeze(a))
    staged = edits.withColumns({"__all": trimmed, "__code": t.normalize_language(F.col("language"))})
    code = F.col("__code")
    error = (
        F.when(F.trim("title") == "", "title_blank")
        .when(F.length(F.trim("title")) > 500, "title_long")
        .when(F.exists("__all", lambda a: a == ""), "author_blank")
        .when(F.exists("__all", lambda a: F.length(a) > 300), "author_long")
        .when(F.size("__all") > 30, "authors_many")
        .when(~F.col("year").between(year_low, year_high), "year")
        .when(F.col("language").isNotNull() & (F.trim("language") != "") & ~F.coalesce(code.rlike("^[a-z]{2,3}$"), F.lit(False)), "language")
        .when(F.col("isbn").isNotNull() & (F.col("isbn") != "") & i.canonical_isbn13(F.col("isbn")).isNull(), "isbn")
    )
    return staged.withColumns({"error": error, "authors": t.first_spelling(F.col("__all"), F.lower)}).drop("__all", "__code")


def split_valid(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without error, the rest with theirs)."""
    return edits.where("error is null").drop("error"), edits.where("error is not null")


def changed_fields(old: DataFrame, new: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(id, field, old, new, source) for the fields (as text) in which rows of equal id differ, null-safely; the source of a change is manual."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields])
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), F.explode(pairs).alias("x"))
    return both.where(~F.col("x.old").eqNullSafe(F.col("x.new"))).select(key, "x.field", "x.old", "x.new", F.lit("manual").alias("source"))


def may_rewrite(source: Column, confirmed: Column | None = None) -> Column:
    """Whether a job may rewrite a field's value: not one a person gave or confirmed."""
    free = ~F.coalesce(source.isin(*PROTECTED), F.lit(False))
    return free if confirmed is None else free & ~F.coalesce(confirmed, F.lit(False))


def has_identity(df: DataFrame, texts: list[str], lists: list[str], authors: str = "authors", out: str = "has_identity") -> DataFrame:
    """df with whether a row tells enough to look it up: a text that is no placeholder, an element of a list, or any author."""
    staged = df.withColumn("__plain", F.array(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in texts])).withColumn("__plain", t.plain_forms("__plain"))
    told = F.exists("__plain", lambda x: (x != "") & ~x.isin(*PLACEHOLDERS))
    some = [F.coalesce(F.size(x) > 0, F.lit(False)) for x in (*lists, authors)]
    for x in some:
        told = told | x
    return staged.withColumn(out, told).drop("__plain")


def safe_path(path: Column) -> Column:
    """Whether a path is relative, in POSIX spelling and stays below its folder."""
    parts = F.split(path, "/")
    plain = F.forall(parts, lambda x: (x != "") & (x != ".") & (x != ".."))
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.contains(F.get(parts, F.lit(0)), F.lit(":")) & plain, F.lit(False))


def integrity_audit(checks: dict[str, tuple]) -> DataFrame:
    """(check, key): for each check (rows, column, parents, column, and a column to tell rows by if it is another) the rows whose value no parent has; null refers to nothing."""
    out = None
    for name, (rows, col, parents, other, *key) in checks.items():
        keys = parents.select(F.col(other).alias("__p"))
        told = F.col(key[0] if key else col).cast("string").alias("key")
        lost = rows.where(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("__p"), "left_anti").select(F.lit(name).alias("check"), told)
        out = lost if out is None else out.unionByName(lost)
    return out


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """(path, state): added, missing or changed between manifests (path, bytes, sha256)."""
    e = expected.select(key, F.struct("bytes", "sha256").alias("e"))
    a = actual.select(key, F.struct("bytes", "sha256").alias("a"))
    state = F.when(F.col("e").isNull(), "added").when(F.col("a").isNull(), "missing").otherwise("changed")
    return e.join(a, key, "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select(key, state.alias("state"))


def genres_to_tags(genres: DataFrame, tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, links) after folding genres (book, name) into tags (id, name) and links (book, tag): by normal name, each tag and link once.

    A new tag has the least spelling of its genres, and a hash of its normal name as id.
    """
    known = tags.withColumn("__key", t.normalize_tag_name(F.col("name")))
    asked = genres.select("book", t.clean_tag_name(F.col("name")).alias("name")).withColumn("__key", t.fold("name")).where("__key <> ''")
    fresh = asked.join(known, "__key", "left_anti").groupBy("__key").agg(F.min("name").alias("name")).select(F.xxhash64("__key").alias("id"), "name", "__key")
    every = known.unionByName(fresh)
    made = asked.join(every.select("__key", F.col("id").alias("tag")), "__key").select("book", "tag")
    return every.drop("__key"), links.select("book", "tag").unionByName(made).distinct()


def canonical_authors(books: DataFrame, authors: DataFrame, least: float = 60.0) -> DataFrame:
    """(id, names): authors of books (id, title, authors, source, confirmed, match) in Latin letters, where the work match gives them.

    match: struct(title, authors, confidence). Only books with a name in other letters, an exact
    title, enough confidence and as many Latin names as authors; protected fields stay. A name takes
    the spelling of the archive's authors (name) with the same family name and initials: the one of
    fewest dots, then the longest, then the least.
    """
    rows = books.withColumns({"__title": t.normalize_text("title"), "__match": t.normalize_text("match.title")})
    latin = F.filter("match.authors", lambda a: t.is_latin(a) & (F.trim(a) != ""))
    foreign = F.exists("authors", lambda a: ~t.is_latin(a))
    use = may_rewrite(F.col("source"), F.col("confirmed")) & foreign & (F.col("__title") == F.col("__match")) & (F.col("match.confidence") >= least) & (F.size(latin) == F.size("authors"))
    names = rows.where(use).select("id", "authors", F.posexplode(F.transform(latin, lambda a: F.trim(a))).alias("place", "name"))
    named = names.withColumn("__key", t.person_key(F.col("name"), t.family_first("name")))
    known = authors.select(F.col("name").alias("spelling")).distinct().withColumn("__key", t.person_key(F.col("spelling"), t.family_first("spelling"))).where("__key is not null")
    order = F.struct(F.length(F.regexp_replace("spelling", "[^.]", "")), -F.length("spelling"), F.col("spelling"))
    best = known.groupBy("__key").agg(F.min_by("spelling", order).alias("spelling"))
    chosen = named.join(best, "__key", "left").withColumn("name", F.coalesce("spelling", "name"))
    back = chosen.groupBy("id").agg(F.first("authors").alias("authors"), F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"), F.count_if(F.col("__key").isNull()).alias("bad"))
    out = back.where("bad = 0").select("id", "authors", F.transform("n", lambda x: x["name"]).alias("names"))
    return out.where(F.col("names") != F.col("authors")).select("id", "names")


def clean_title_history(df: DataFrame, title: str = "title", source: str = "title_source", history: str = "history", version: str = "1") -> DataFrame:
    """df with cleaned titles; a changed one appends (old_title, new_title, source, version, rules) to the history. Titles that people gave, or that cleaning finds at fault, stay."""
    staged = df.withColumn("__nfc", t.compose(title))
    staged = staged.withColumn("__clean", t.clean_title(F.col(title), F.col("__nfc")))
    changed = F.coalesce(may_rewrite(F.col(source)) & F.col("__clean.error").isNull() & (F.col("__clean.title") != F.col(title)), F.lit(False))
    entry = F.struct(F.col(title).alias("old_title"), F.col("__clean.title").alias("new_title"), F.col(source).alias("source"), F.lit(version).alias("version"), F.col("__clean.rules").alias("rules"))
    log = F.coalesce(F.col(history), F.array().cast(df.schema[history].dataType))
    return staged.withColumn(history, F.when(changed, F.array_append(log, entry)).otherwise(log)).withColumn(title, F.when(changed, F.col("__clean.title")).otherwise(F.col(title))).drop("__nfc", "__clean")


HISTORY = "array<struct<old_title:string,new_title:string,source:string,version:string,rules:array<string>>>"


def context_fingerprint(fields: dict[str, Column], version: str) -> Column:
    """SHA-256 of the fields, by name, as JSON with the version: rows of another context or version differ."""
    named = [fields[n].alias(n) for n in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*named, F.lit(version).alias("version")), {"ignoreNullFields": "false"}), 256)


def labels(value: Column, most: int = 30) -> Column:
    """Distinct labels of a JSON value: a scalar, an object with label, name or id, or a list of those; at most `most`."""
    kind = T.ArrayType(T.StringType())
    items = F.when(value.isNull(), _none()).when(F.ltrim(value).startswith("["), F.from_json(value, kind)).otherwise(F.array(value))
    own = lambda x: F.when(F.ltrim(x).startswith("{"), F.coalesce(*[F.when(F.get_json_object(x, f"$.{n}") != "", F.get_json_object(x, f"$.{n}")) for n in ("label", "name", "id")])).otherwise(F.regexp_replace(x, r'^"|"$', ""))
    found = F.filter(F.transform(F.coalesce(items, _none()), lambda x: F.trim(own(x))), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.slice(F.array_distinct(found), 1, most)


def first_label(value: Column) -> Column:
    return F.get(labels(value), F.lit(0))


def record_sources(snapshots: DataFrame, book: str = "book", seq: str = "seq") -> DataFrame:
    """Rows (book, seq, field, value, source) whose value or source differs from the one before of the same book and field."""
    w = Window.partitionBy(book, "field").orderBy(seq)
    now = F.struct("value", "source")
    return snapshots.withColumn("__new", F.row_number().over(w).eqNullSafe(1) | ~now.eqNullSafe(F.lag(now).over(w))).where("__new").drop("__new")
