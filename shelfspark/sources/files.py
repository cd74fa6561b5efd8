"""Books as files: folder scans, manifests, XML books and packed ones."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import squeeze, year_from
from shelfspark.shared import stored

SUFFIXES = ("epub", "pdf", "fb2", "mobi", "azw3")
MAX_ENTRIES, MAX_MEMBER, MAX_TOTAL = 3000, 32 << 20, 100 << 20
#: Parts of a packed book that are no text of it, by name.
EXTRAS = r"(?i)(?:^|[/_.-])(cover|titlepage|copyright|imprint|toc|contents)(?:[/_.-]|$)"
#: Bodies of an XML book that are no text of it.
NOTES = ("notes", "footnotes", "comments")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, length, modificationTime, content) of the files below root with one of the suffixes in any case; others are passed over. content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def file_manifest(files: DataFrame, root: str = "") -> DataFrame:
    """(path, bytes, sha256) of files (path, content); paths relative to root."""
    end = F.locate(root, F.col("path")) + len(root) if root else F.lit(1)
    path = F.regexp_replace(F.substring(F.col("path"), end, F.length("path")), "^/+", "")
    return files.select(path.alias("path"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


XML = """
description struct<`title-info`: struct<`book-title`: string, genre: array<string>, lang: string, date: struct<_text: string, _value: string>,
    author: array<struct<`first-name`: string, `middle-name`: string, `last-name`: string, nickname: string>>, sequence: array<struct<_name: string>>>,
  `publish-info`: struct<publisher: string, year: string, isbn: string>>"""
PARTS = "path string, kind string, body int, section int, place int, text string, reason string"
#: Bytes of an XML book, and of it that are given to the parser at once.
MAX_BOOK, FED = 100_000_000, 1 << 16


class _Book:
    """Parts of an XML book as its parser meets them: the annotation, and each body's sections of the first level and what lies between them.

    Elements nest as deep as they like; a part's text is all texts below it, with a blank where a tag was.
    """

    def __init__(self) -> None:
        self.path: list[str] = []
        self.parts: list[tuple[str, int, int | None, list[str]]] = []  # kind, body, section, texts
        self.body, self.section, self.notes = 0, 0, False
        self.parser = p = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = self.start, self.end, self.text, self.refuse

    def refuse(self, *_: object) -> None:
        raise ValueError("document type declaration")

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.path.append(tag.rpartition(":")[2])
        if len(self.path) == 1 and self.path[0] != "FictionBook":
            raise ValueError("no book")
        if self.path[1:] == ["body"]:
            self.body, self.section, self.notes = self.body + 1, 0, attrs.get("name", "").lower() in NOTES
        self.section += self.path[1:] == ["body", "section"]

    def end(self, tag: str) -> None:
        self.path.pop()

    def text(self, data: str) -> None:
        way = self.path[1:]
        if way[:1] == ["body"] and not self.notes:
            key = ("body", self.body, self.section if way[1:2] == ["section"] else None)
        elif way[:3] == ["description", "title-info", "annotation"]:
            key = ("annotation", 0, None)
        else:
            return
        if not self.parts or self.parts[-1][:3] != key:
            self.parts.append((*key, []))
        self.parts[-1][3].append(data)


def _parsed(path: str, content: bytes) -> list[tuple]:
    if len(content) > MAX_BOOK:
        return [(path, None, None, None, None, None, "too large")]
    book = _Book()
    try:
        for at in range(0, len(content), FED):
            book.parser.Parse(content[at : at + FED])
        book.parser.Parse(b"", True)
    except expat.ExpatError:
        return [(path, None, None, None, None, None, "not well formed")]
    except ValueError as e:
        return [(path, None, None, None, None, None, str(e))]
    return [(path, kind, body, section, i, text, None) for i, (kind, body, section, texts) in enumerate(book.parts) if (text := " ".join(" ".join(texts).split()))]


def fb2_parts(files: DataFrame) -> DataFrame:
    """(path, kind, body, section, place, text, reason): parts of XML books (path, content) in order, or why a book is broken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in zip(batch["path"], batch["content"], strict=True) for r in _parsed(path, content or b"")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")]).astype({"body": "Int32", "section": "Int32", "place": "Int32"})

    return files.select("path", "content").mapInPandas(run, PARTS)


def fb2_units(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, quarantine) of XML books (path, content): (path, unit, label, text) for each first-level section, or whole body without sections, that
    is no note, numbered from 1 in order; and (path, reason) of broken books. Nested sections, titles, poems and marked words are in the text.
    """
    made = fb2_parts(files)
    texts = made.where("kind = 'body'").select("path", "body", "section", "place", "text")
    listed = texts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "body", "section", "text"))).alias("parts"))
    with_sections = F.array_distinct(F.transform(F.filter("parts", lambda p: p["section"].isNotNull()), lambda p: p["body"]))
    kept = F.filter("parts", lambda p: p["section"].isNotNull() | ~F.array_contains(F.col("split"), p["body"]))
    units = listed.withColumn("split", with_sections).select("path", F.posexplode(kept).alias("unit", "p"))
    number = F.col("unit") + 1
    return units.select("path", number.alias("unit"), F.concat(F.lit("section "), number.cast("string")).alias("label"), "p.text"), made.where("reason is not null").select("path", "reason")


def read_fb2(files: DataFrame) -> DataFrame:
    """XML books (path, content) as rows: path, title, authors, year, language, series, genres, publisher, isbn, description, text, reason.

    An author's name is first, middle and last name, or the nickname; the year that of publishing, else of the date's value,
    else of its text; text is all text of all bodies but notes. Broken books are rows of nulls but for the path and the reason.
    """
    rows = files.select("path", F.from_xml(F.col("content").cast("string"), XML, {"valueTag": "_text"}).alias("x")).select("path", "x.*")
    info, publish = F.col("description.title-info"), F.col("description.publish-info")
    full = lambda a: squeeze(F.concat_ws(" ", a["first-name"], a["middle-name"], a["last-name"]))
    name = lambda a: F.when(full(a) != "", full(a)).otherwise(a["nickname"])
    names = F.filter(F.transform(F.coalesce(info["author"], F.array().cast("array<struct<`first-name`:string,`middle-name`:string,`last-name`:string,nickname:string>>")), name), lambda x: F.coalesce(x, F.lit("")) != "")
    year = F.coalesce(year_from(publish["year"]), year_from(info["date"]["_value"]), year_from(info["date"]["_text"]))
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "text")))), lambda p: p["text"]), " ")
    texts = fb2_parts(files).groupBy("path").agg(joined("body").alias("text"), joined("annotation").alias("description"), F.max("reason").alias("reason"))
    told = rows.select(
        "path", info["book-title"].alias("title"), names.alias("authors"), year.alias("year"), info["lang"].alias("language"), F.get(info["sequence"], F.lit(0))["_name"].alias("series"),
        F.coalesce(info["genre"], F.array().cast("array<string>")).alias("genres"), publish["publisher"].alias("publisher"), publish["isbn"].alias("isbn"),
    )
    both = told.join(texts, "path", "left")
    sound = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return both.select("path", *[sound(c) for c in told.columns[1:]], F.when(F.col("reason").isNull(), F.nullif("description", F.lit(""))).alias("description"), F.when(F.col("reason").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "reason")


DIRECTORY = "path string, entries array<struct<name: string, size: long, encrypted: boolean>>, container string, packages map<string, string>, reason string"
CONTAINER = "rootfiles struct<rootfile: array<struct<`_full-path`: string>>>"
PACKAGE = "manifest struct<item: array<struct<_id: string, _href: string, _properties: string>>>, spine struct<itemref: array<struct<_idref: string, _linear: string>>>"


def _bounded(archive: zipfile.ZipFile, name: str) -> str:
    with archive.open(name) as member:
        return member.read(MAX_MEMBER + 1)[:MAX_MEMBER].decode("utf-8", "replace")


def directories(files: DataFrame) -> DataFrame:
    """Of packed books (path, content) the directory, the container and the packages; nothing else is unpacked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        listed = [{"name": i.filename, "size": i.file_size, "encrypted": bool(i.flag_bits & 1)} for i in z.infolist()]
                        small = [i.filename for i in z.infolist() if i.file_size <= MAX_MEMBER and not i.flag_bits & 1]
                        container = _bounded(z, "META-INF/container.xml") if "META-INF/container.xml" in small else None
                        rows.append((path, listed, container, {n: _bounded(z, n) for n in small[:MAX_ENTRIES] if n.lower().endswith(".opf")}, None))
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError, EOFError):
                    rows.append((path, None, None, None, "not an archive"))
            yield pd.DataFrame(rows, columns=["path", "entries", "container", "packages", "reason"])

    return files.select("path", "content").mapInPandas(run, DIRECTORY)


def unsafe(entries: Column) -> Column:
    """Why an archive with these entries is not unpacked: all reasons, in a fixed order."""
    names = F.transform(entries, lambda e: F.replace(e["name"], F.lit("\\"), F.lit("/")))
    parts = lambda n: F.split(n, "/")
    stray = F.exists(names, lambda n: n.startswith("/") | F.array_contains(parts(n), "..") | F.get(parts(n), F.lit(0)).contains(":"))
    rules = {
        "too many entries": F.size(entries) > MAX_ENTRIES,
        "nameless entry": F.exists(names, lambda n: n == ""),
        "straying entry": stray,
        "repeated entry": F.size(F.array_distinct(names)) < F.size(names),
        "encrypted entry": F.exists(entries, lambda e: e["encrypted"]),
        "entry too large": F.exists(entries, lambda e: e["size"] > MAX_MEMBER),
        "too large unpacked": F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["size"]) > MAX_TOTAL,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def member_of(base: Column, href: Column) -> Column:
    """The member that a reference in the member base means: unquoted, without query and fragment, from base's folder; null for one that leaves the archive."""
    plain = F.trim(F.try_url_decode(F.replace(F.regexp_replace(href, r"[?#].*$", ""), F.lit("+"), F.lit("%2B"))))
    steps = F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), plain), "/")
    walk = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda way, s: F.when(way.isNull() | ((s == "..") & (F.size(way) == 0)), F.lit(None)).when(s == "..", F.slice(way, 1, F.greatest(F.size(way) - 1, F.lit(0)))).when(s.isin("", "."), way).otherwise(F.array_append(way, s)),
    )
    return F.when((plain != "") & ~plain.rlike(r"^[/\\]|://"), F.array_join(walk, "/"))


def reading_order(listed: DataFrame) -> DataFrame:
    """(path, ordinal, member) of directories: the linear members of the spine that are neither navigation nor extras by name, each once."""
    package = F.get(F.from_xml("container", CONTAINER, {"ignoreNamespace": "true"})["rootfiles"]["rootfile"], F.lit(0))["_full-path"]
    opened = listed.select("path", package.alias("base"), F.try_element_at("packages", package).alias("opf"))
    read = opened.select("path", "base", F.from_xml("opf", PACKAGE, {"ignoreNamespace": "true"}).alias("p"))
    items = read.select("path", "base", F.explode("p.manifest.item").alias("i")).select("path", "base", F.col("i._id").alias("idref"), F.col("i._href").alias("href"), F.col("i._properties").alias("properties"))
    refs = read.select("path", F.posexplode("p.spine.itemref").alias("place", "r")).where("r._linear is null or r._linear <> 'no'").select("path", "place", F.col("r._idref").alias("idref"))
    text = ~F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "nav") & ~F.col("href").rlike(EXTRAS)
    members = refs.join(items, ["path", "idref"]).where(text).select("path", "place", member_of(F.col("base"), F.col("href")).alias("member"))
    once = members.where("member is not null").groupBy("path", "member").agg(F.min("place").alias("place"))
    ordered = once.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "member"))).alias("m"))  # a book's members: MAX_ENTRIES at most
    return ordered.select("path", F.posexplode("m").alias("ordinal", "m")).select("path", "ordinal", "m.member")


def explode_epub(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of packed books (path, content): (path, member, ordinal, html) in reading order, and (path, reason) of files that are
    broken, unsafe, or lack a member or a readable package. Files are read twice: their directories first, then the members in order.
    """
    listed = stored(directories(files), "directories")
    judged = listed.withColumn("reasons", F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(unsafe(F.col("entries"))))
    safe = judged.where("size(reasons) = 0")
    order = stored(reading_order(safe), "reading-order")
    wanted = order.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "member"))).alias("m"))
    there = safe.select("path", F.transform("entries", lambda e: e["name"]).alias("names")).join(wanted, "path", "left")
    lacking = F.when(F.col("m").isNull(), "no reading order").when(~F.forall("m", lambda x: F.array_contains(F.col("names"), x["member"])), "missing member")
    checked = stored(there.select("path", "m", lacking.alias("reason")), "members")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, members in zip(batch["path"], batch["content"], batch["m"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, x["member"], x["ordinal"], _bounded(z, x["member"])) for x in members]
            yield pd.DataFrame(rows, columns=["path", "member", "ordinal", "html"])

    good = files.select("path", "content").join(checked.where("reason is null").select("path", "m"), "path").mapInPandas(run, "path string, member string, ordinal int, html string")
    refused = judged.where("size(reasons) > 0").select("path", F.array_join("reasons", ", ").alias("reason"))
    return good, refused.unionByName(checked.where("reason is not null").select("path", "reason"))


def is_supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SUFFIXES)
