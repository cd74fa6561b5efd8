"""Pages: text of markup, metadata of markup, segments with markers and their way back into the page."""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree as Tree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import squeeze

#: Elements whose content is no text, by mode.
HIDDEN = {"content": ("script", "style"), "language": ("script", "style", "head", "nav")}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "figcaption", "title"}
#: Elements beside BLOCKS before which an open paragraph ends.
BOXES = {"div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "dl", "table", "tr", "figure", "form", "pre", "hr", "body"}
SKIPPED = {"script", "style", "code", "pre", "svg", "math"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MARKER = r"\[\[/?[0-9]+\]\]"
#: The inside of a tag: quoted values may hold its end.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


@F.pandas_udf(T.StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references decoded."""
    return texts.map(lambda x: None if x is None else references.unescape(x))


def ended(markup: str) -> str:
    """Each & that begins no known reference with its semicolon written as &amp;, so that it stays as text when references are decoded."""
    known = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}"
    return re.sub("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", known, markup)


@F.pandas_udf(T.StringType())
def ended_references(markup: pd.Series) -> pd.Series:
    """Markup in which only references that end in a semicolon are any; browsers also decode some without it (&amp, &copy)."""
    return markup.map(lambda x: None if x is None else ended(x))


def html_to_text(html: Column, mode: str = "content") -> Column:
    """Text of a page with character references decoded and single blanks, a blank at each tag.

    content: all but scripts and styles; language: also without head and navigation. An element of these that is not
    closed hides the rest. Null stays. Comments part words in content only. Built-in expressions; only pages with a reference go through Python.
    """
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " " if mode == "content" else "")
    for tag in HIDDEN[mode]:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}(?![\w-]){_INSIDE}>.*?(?:</{tag}\s*>|\z)", " ")
    bare = F.regexp_replace(bare, rf"<[A-Za-z/!?]{_INSIDE}(?:>|\z)", " ")
    return squeeze(F.when(bare.contains("&"), decoded(F.when(bare.contains("&"), bare))).otherwise(bare))


def _first(values: Column) -> Column:
    """The first value that is not blank."""
    return F.get(F.filter(F.transform(values, lambda x: squeeze(x)), lambda x: x != ""), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag; '' without it."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.regexp_replace(found, "^[\"']|[\"']$", "")


def html_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, language, author, identifier, date (each the first that is not blank, as value and source) and subjects of their markup.

    Attributes of a tag come in any order, quoted or not; character references are decoded.
    """
    h = F.col(html)
    tags = F.regexp_extract_all(h, F.lit(rf"(?is)<meta(?![\w-]){_INSIDE}>"), F.lit(0))
    named = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_replace(F.concat(_attribute(t, "name"), _attribute(t, "property")), r"^(?i)(dc|dcterms|og|article)[.:]", "")).alias("n"), _attribute(t, "content").alias("v")))
    staged = pages.select(*[F.col(f"`{c}`") for c in pages.columns], named.alias("__m"), F.regexp_extract_all(h, F.lit(r"(?is)<title[^>]*>(.*?)</title"), F.lit(1)).alias("__t"), F.regexp_extract_all(h, F.lit(rf"(?is)<html(?![\w-]){_INSIDE}>"), F.lit(0)).alias("__h"))
    meta = lambda *names: F.transform(F.filter("__m", lambda x: x["n"].isin(*names)), lambda x: x["v"])
    found = {
        "title": F.coalesce(_first(F.col("__t")), _first(meta("title"))), "language": F.coalesce(_first(F.transform("__h", lambda t: _attribute(t, "lang"))), _first(meta("language"))),
        "author": F.coalesce(_first(meta("author")), _first(meta("creator"))), "identifier": _first(meta("identifier")), "date": F.coalesce(_first(meta("date")), _first(meta("published_time"))),
    }
    said = {n: F.when(v.contains("&"), squeeze(decoded(v))).otherwise(v) for n, v in found.items()}
    told = {n: F.struct(v.alias("value"), F.when(v.isNotNull(), "embedded").alias("source")).alias(n) for n, v in said.items()}
    listed = decoded(F.array_join(meta("keywords", "subject"), ","))
    subjects = F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: squeeze(x)), lambda x: x != ""))
    return staged.select(*[F.col(f"`{c}`") for c in pages.columns], *told.values(), F.struct(subjects.alias("value"), F.when(F.size(subjects) > 0, "embedded").alias("source")).alias("subjects"))


class _Page(HTMLParser):
    """A tree of a page that may not be well formed. Entities of its own are never expanded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Tree.Element("page")
        self.open = [self.root]

    def _end_at(self, depth: int) -> None:
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names = [e.tag for e in self.open]
        boxes = [i for i, n in enumerate(names) if n in BLOCKS | BOXES or i == 0]
        if tag in BLOCKS | BOXES and names[boxes[-1]] == "p":
            self._end_at(boxes[-1])
        elif tag in BLOCKS - {"blockquote"} and names[boxes[-1]] == tag:
            self._end_at(boxes[-1])
        node = Tree.SubElement(self.open[-1], tag, {n: v or "" for n, v in attrs})
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        self._end_at(min(depth, len(self.open)))

    def handle_endtag(self, tag: str) -> None:
        at = [i for i, e in enumerate(self.open) if e.tag == tag and i]
        if at:
            self._end_at(at[-1])

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        if len(node):
            node[-1].tail = (node[-1].tail or "") + data
        else:
            node.text = (node.text or "") + data


def tree_of(markup: str) -> tuple[Tree.Element, bool]:
    """(root, well formed): XML without a document type's entities as it is, all else as a page."""
    if "<!ENTITY" not in markup:
        try:
            return Tree.fromstring(markup.encode()), True
        except (Tree.ParseError, ValueError):
            pass
    page = _Page()
    page.feed(markup)
    page.close()
    roots = list(page.root)
    return (roots[0] if len(roots) == 1 else page.root), False


def _name(node: Tree.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else "script"


def marked(node: Tree.Element) -> str:
    """An element's text; the i-th child's stands between [[i]] and [[/i]], and those of protected children stay empty."""
    out, todo = [], [node.text or "", *_children(node)][::-1]
    while todo:
        step = todo.pop()
        if isinstance(step, str):
            out.append(step)
        else:
            todo += [step.text or "", *_children(step)][::-1] if _name(step) not in SKIPPED else []
    return "".join(out)


def _children(node: Tree.Element) -> list:
    return [x for i, c in enumerate(node) for x in (f"[[{i}]]", c, f"[[/{i}]]", c.tail or "")]


class Misplaced(ValueError):
    """Markers that do not fit the element."""


def unmarked(text: str) -> list:
    """A marked text as a list: texts with (place, list) between them. Misplaced if a bracket is not closed in order."""
    held: list[tuple[int, list]] = [(-1, [""])]
    for token in re.split(f"({MARKER})", text):
        if not re.fullmatch(MARKER, token):
            held[-1][1][-1] += token
        elif token[2] != "/":
            held.append((int(token[2:-2]), [""]))
        else:
            place, inside = held.pop()
            if place != int(token[3:-2]) or not held:
                raise Misplaced("not closed in order")
            held[-1][1].extend([(place, inside), ""])
    if len(held) > 1:
        raise Misplaced("not closed")
    return held[0][1]


def put_back(node: Tree.Element, text: str) -> None:
    """Writes a marked text into the element that it came from; its tags and attributes stay."""
    todo = [(node, unmarked(text))]
    while todo:
        at, content = todo.pop()
        places = [p for p, _ in content[1::2]]
        if places != list(range(len(at))):
            raise Misplaced("other markers than children")
        at.text = content[0]
        for child, (_, inside), tail in zip(at, content[1::2], content[2::2], strict=True):
            child.tail = tail
            if _name(child) not in SKIPPED:
                todo.append((child, inside))
            elif inside != [""]:
                raise Misplaced("protected content")


def segments_of(markup: str, extra: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(location, kind, text) of one page in its order: blocks without blocks inside, and alt and title attributes.

    A location is the places of the children on the way from the root. extra: further elements that are blocks whatever they hold.
    """
    return [(loc, kind, text) for _, loc, kind, text in _segments(tree_of(markup)[0], extra)]


def _segments(root: Tree.Element, extra: tuple[str, ...]) -> Iterator[tuple[Tree.Element, str, str, str]]:
    holds = {e: False for e in root.iter()}  # a block below
    for parent in reversed(list(root.iter())):
        holds[parent] = any(holds[c] or _name(c) in BLOCKS for c in parent)
    todo = [(root, (), False)]
    while todo:
        node, places, inside = todo.pop()
        name, location = _name(node), json.dumps(places)
        if name in SKIPPED:
            continue
        own = (not inside and name in BLOCKS and not holds[node]) or name in extra
        if own and re.sub(MARKER, "", text := marked(node)).strip():
            yield node, location, "content", text
        for kind in ("alt", "title"):
            if node.get(kind, "").strip():
                yield node, location, kind, node.get(kind)
        todo += [(c, (*places, i), inside or own) for i, c in enumerate(node)][::-1]


SEGMENT = "file string, location string, kind string, text string, segment string, sha256 string, element string"


def _extra(file: str) -> tuple[str, ...]:
    return ("text",) if file.lower().endswith(".ncx") else ()


def segment_rows(file: str, markup: str | None) -> list[tuple]:
    rows = []
    for node, location, kind, text in _segments(tree_of(markup or "")[0], _extra(file)):
        key = hashlib.sha256(f"{file}:{location}:{kind}".encode()).hexdigest()[:20]
        rows.append((file, location, kind, text, key, hashlib.sha256(text.encode()).hexdigest(), _name(node)))
    return rows


def segment_html(pages: DataFrame) -> DataFrame:
    """Segments (file, location, kind, text, segment, sha256, element) of pages (file, html): see segments_of and marked. Blank ones go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for file, html in zip(batch["file"], batch["html"], strict=True) for r in segment_rows(file, html)]
            yield pd.DataFrame(rows, columns=["file", "location", "kind", "text", "segment", "sha256", "element"])

    return pages.select("file", "html").mapInPandas(run, SEGMENT)


def translated_page(file: str, markup: str, texts: dict[tuple[str, str], str]) -> tuple[str | None, str | None]:
    """(page, error): the page with its segments (location, kind) replaced; error names the first segment that does not fit."""
    root, sound = tree_of(markup)
    known = {(loc, kind): node for node, loc, kind, _ in _segments(root, _extra(file))}
    for (loc, kind), text in texts.items():
        node = known.get((loc, kind))
        try:
            if node is None:
                raise Misplaced("no such segment")
            if kind == "content":
                put_back(node, text)
            elif re.search(MARKER, text):
                raise Misplaced("markers in an attribute")
            else:
                node.set(kind, text)
        except Misplaced as e:
            return None, f"{loc} {kind}: {e}"
    try:
        return _written(root, sound, markup), None
    except RecursionError:
        return None, "nested too deeply to be written"


def _written(root: Tree.Element, sound: bool, markup: str) -> str:
    if sound:
        for prefix, uri in re.findall(r"""\sxmlns(?::([\w.-]+))?=["']([^"']+)["']""", markup):
            Tree.register_namespace(prefix, uri)
        prolog = re.match(r"(?s).*?(?=<[A-Za-z])", markup)[0]
        return prolog + Tree.tostring(root, encoding="unicode")
    prolog = re.match(r"(?is)\s*<!doctype[^>]*>", markup)
    body = Tree.tostring(root, encoding="unicode", method="html")
    return (prolog[0] if prolog else "") + (body if root.tag != "page" else body.removeprefix("<page>").removesuffix("</page>"))


def apply_translations(pages: DataFrame, translations: DataFrame) -> DataFrame:
    """(file, html, error): pages (file, html) with the texts of translations (file, location, kind, text) in place of their segments.

    Tags, attributes and protected content stay. A page of which a text does not fit is null with the reason. A page's texts are one task's.
    """
    texts = translations.groupBy("file").agg(F.collect_list(F.struct("location", "kind", "text")).alias("texts"))
    both = pages.select("file", "html").join(texts, "file", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, html, new in zip(batch["file"], batch["html"], batch["texts"], strict=True):
                asked = {} if new is None else {(x["location"], x["kind"]): x["text"] for x in new}
                rows.append((file, *(translated_page(file, html or "", asked) if asked else (html, None))))
            yield pd.DataFrame(rows, columns=["file", "html", "error"])

    return both.mapInPandas(run, "file string, html string, error string")
