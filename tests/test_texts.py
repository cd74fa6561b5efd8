"""Markup, packed books, languages and translation work by cases."""

from __future__ import annotations

import io
import random
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.text import simple_upper
from shelfspark.operators import language as g
from shelfspark.operators import markup as m
from shelfspark.operators import scanner
from shelfspark.sources import files as f


def test_segments_with_markers():
    html = """<html><head><title>T &amp; U</title></head><body><div title="tip"><p>One <i>two</i> <b>th<i>r</i>ee</b></p><blockquote><p>in</p> out</blockquote>
    <p> </p><p><img alt="pic" src="x"></p><pre>no</pre><ul><li>a<li>b</ul><p>Run <code>rm -rf /</code> now</div></body></html>"""
    got = [(loc, kind, text) for loc, kind, text in m.segments_of(html)]
    assert got == [
        ("[0, 0]", "content", "T & U"), ("[1, 0]", "title", "tip"), ("[1, 0, 0]", "content", "One [[0]]two[[/0]] [[1]]th[[0]]r[[/0]]ee[[/1]]"), ("[1, 0, 1, 0]", "content", "in"),
        ("[1, 0, 3, 0]", "alt", "pic"), ("[1, 0, 5, 0]", "content", "a"), ("[1, 0, 5, 1]", "content", "b"), ("[1, 0, 6]", "content", "Run [[0]][[/0]] now"),
    ]
    rows = m.segment_rows("toc.ncx", "<navPoint><text>Chapter</text></navPoint>")
    assert [(r[2], r[3], r[6]) for r in rows] == [("content", "Chapter", "text")]
    assert m.segment_rows("a.html", None) == []
    assert m.segments_of('<!DOCTYPE x [<!ENTITY a "boom">]><p>&a;</p>') == [("[]", "content", "&a;")]


def test_marked_texts_go_back_into_their_elements():
    html = '<p>Hello <em>old <strong>friend</strong></em> and <a href="x">note</a>. <code>rm -rf /</code></p>'
    put = lambda text, kind="content": m.translated_page("a.html", html, {("[]", kind): text})
    assert put("Hallo [[0]]alter [[0]]Freund[[/0]][[/0]] und [[1]]Anmerkung[[/1]]. [[2]][[/2]]") == ('<p>Hallo <em>alter <strong>Freund</strong></em> und <a href="x">Anmerkung</a>. <code>rm -rf /</code></p>', None)
    for wrong in ("no markers", "[[1]]x[[/1]] [[0]][[0]][[/0]][[/0]] [[2]][[/2]]", "[[0]][[0]]x[[/0]] [[1]][[/0]][[/1]] [[2]][[/2]]", "[[0]][[0]][[/0]][[/0]][[1]][[/1]][[2]]new[[/2]]", "[[0]]", "[[/0]]"):
        page, error = put(wrong)
        assert page is None and error.startswith("[] content")
    assert put("x", "title")[1] == "[] title: no such segment"
    for depth, fits in ((200, True), (3000, False)):
        deep = "<p>" + "<b>" * depth + "x" + "</b>" * depth + "</p>"
        (_, _, text), = m.segments_of(deep)
        page, error = m.translated_page("a", deep, {("[]", "content"): text.replace("x", "y")})
        assert (page == deep.replace("x", "y")) == fits and (error is None) == fits
    book = '<?xml version="1.0"?>\n<ncx xmlns="urn:n"><navPoint id="1"><text>One</text></navPoint></ncx>'
    assert m.translated_page("toc.ncx", book, {("[0, 0]", "content"): "Eins"}) == (book.replace("One", "Eins"), None)


PAGE = "<head><title>T</title><style>s</style></head>{}<nav>nav</nav><p>a<br>b &amp; c<!-- > --></p><script>if (a<b) '</p>'</script>d<x y='>'>e</x>"


@pytest.mark.parametrize(("mode", "want"), [("content", "T x nav a b & c d e"), ("language", "a b & c d e")])
def test_html_text_modes(spark, mode, want):
    pages = [PAGE.format("<p>x</p>" if mode == "content" else ""), None, "", "a <script>never closed", "1 < 2 &lt; 3 <b", "<p " + "a='b' " * 20_000 + ">long</p>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = [r["t"] for r in df.select("i", m.html_to_text(F.col("html"), mode).alias("t")).orderBy("i").collect()]
    assert got == [want, None, "", "a", "1 < 2 < 3", "long"]


def test_references_without_a_semicolon_stay_text(spark):
    html = "<html lang='en'><title>a&amp; b&amp</title><h1>&copy x &quot;y&quot; &ampfoo; &#65; &#65 &nosuch; &</h1></html>"
    assert m.ended("&amp;&lt;&ampfoo;&x") == "&amp;&lt;&amp;ampfoo;&amp;x"
    page = spark.createDataFrame([("p", html), ("none", None)], "file string, html string").withColumn("html", m.ended_references("html"))
    want = "&copy x \"y\" &ampfoo; A &#65 &nosuch; &"
    assert [r["t"] for r in page.orderBy(F.desc("file")).select(m.html_to_text(F.col("html")).alias("t")).collect()] == [f"a& b&amp {want}", None]
    assert [r["title"]["value"] for r in m.html_metadata(page).orderBy(F.desc("file")).collect()] == ["a& b&amp", None]
    assert [r["text"] for r in m.segment_html(page).orderBy("location").collect()] == ["a& b&amp", want]


def test_upper_case_keeps_the_number_of_characters(spark):
    texts = ["straße ŉ ᾳ ﬁn ǆ é", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["u"] for r in df.orderBy("i").select(simple_upper(F.col("t")).alias("u")).collect()] == ["STRAẞE ŉ ᾼ ﬁN Ǆ É", "", None]


def test_metadata_in_any_order_of_attributes(spark):
    html = """<html class=x lang='de'><head><title> </title><title>A &amp; B</title><meta content="Ann &lt;3" name="DC.creator"><meta name=keywords content="a, b"><META CONTENT='b,c' NAME='dc.subject'><meta property="og:date" content="1999"></head></html>"""
    r = m.html_metadata(spark.createDataFrame([(1, html, "clash"), (2, None, None)], "id int, html string, title2 string")).orderBy("id").collect()
    assert [r[0][c]["value"] for c in ("title", "language", "author", "date", "subjects")] == ["A & B", "de", "Ann <3", "1999", ["a", "b", "c"]]
    assert r[1]["title"]["value"] is None and r[1]["title"]["source"] is None


def test_unsafe_archives_are_refused(spark):
    def box(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(zipfile.ZipInfo(n), "x")
        return out.getvalue()

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cases = {"fine": ["a/b", "c"], "straying entry": ["/a"], "straying entry, repeated entry": ["a/../b", "c:/x", "c:/x"], "repeated entry": ["a/b", "a/b"], "too many entries": [f"f{i}" for i in range(3001)]}
        rows = [(name, box(names)) for name, names in cases.items()] + [("not an archive", b"PK no"), ("not an archive ", None)]
    good, bad = f.explode_epub(spark.createDataFrame(rows, "path string, content binary"))
    assert {r["path"].strip(): r["reason"] for r in bad.collect()} == {k: k for k in [*cases, "not an archive"] if k != "fine"} | {"fine": "no reading order"}
    assert good.count() == 0


def test_members_are_resolved(spark):
    cases = [("OPS/b.opf", "ch%201.xhtml", "OPS/ch 1.xhtml"), ("OPS/b.opf", "../text/two.xhtml#x", "text/two.xhtml"), ("b.opf", "./a+b.xhtml?q", "a+b.xhtml"), ("b.opf", "../x", None), ("a/b.opf", "../../x/../y", None), ("b.opf", "http://x/y", None), ("b.opf", "/x", None), ("b.opf", "#x", None), ("b.opf", None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, base string, href string, want string")
    assert [(r["got"], r["want"]) for r in df.select("i", "want", f.member_of(F.col("base"), F.col("href")).alias("got")).orderBy("i").collect()] == [(c[2], c[2]) for c in cases]


BOOK = """<?xml version="1.0"?><FictionBook xmlns="http://x" xmlns:l="http://y"><description><title-info><genre>g</genre><author><first-name>Ann</first-name><last-name>Bee</last-name></author><book-title>T</book-title>
<annotation><p>Short <emphasis>words</emphasis>.</p></annotation><lang>de</lang><date value="2020-01-01">2020</date></title-info></description>
<body><title><p>Book</p></title><section><title><p>One</p></title><section><p>in<strong>ner</strong> text</p><section><poem><stanza><v>verse</v></stanza></poem></section></section></section><section><p>two &amp; 2</p></section><section> </section></body>
<body name="Notes"><section><p>note</p></section></body><body><p>no sections</p></body></FictionBook>"""


def test_xml_books_with_nested_sections(spark):
    bad = {"cut": BOOK[:400], "dtd": BOOK.replace("<Fic", "<!DOCTYPE x><Fic", 1), "other": "<html/>", "none": None}
    files = spark.createDataFrame([("good", BOOK.encode()), *[(k, v and v.encode()) for k, v in bad.items()]], "path string, content binary")
    units, broken = f.fb2_units(files)
    assert [tuple(r)[1:] for r in units.orderBy("unit").collect()] == [(1, "section 1", "One in ner text verse"), (2, "section 2", "two & 2"), (3, "section 3", "no sections")]
    assert {r["path"]: r["reason"] for r in broken.collect()} == {"cut": "not well formed", "dtd": "document type declaration", "other": "no book", "none": "not well formed"}
    got = {r["path"]: r for r in f.read_fb2(files).collect()}
    assert got["good"]["text"] == "Book One in ner text verse two & 2 no sections" and got["good"]["description"] == "Short words ." and got["good"]["authors"] == ["Ann Bee"]
    assert got["cut"]["title"] is None and got["cut"]["text"] is None and got["cut"]["reason"] == "not well formed"


def test_vote_of_three(spark):
    rng = random.Random(1)
    words = {"en": "the house is near a green tree and birds sing there every morning".split(), "de": "das haus steht neben einem grünen baum und vögel singen dort jeden morgen".split()}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    known = g.profiles(spark.createDataFrame([(lang, text(lang, 3000)) for lang in words], "lang string, text string"))
    docs = [(1, text("en", 3000)), (2, text("de", 3000)), (3, text("en", 1200) + " " + text("de", 1200)), (4, "too short"), (5, None), (6, "same " * 3000)]
    taken = g.samples(spark.createDataFrame([(i, 0, t) for i, t in docs], "id long, place int, text string"))
    assert {r["id"]: r["n"] for r in taken.groupBy("id").agg({"*": "count"}).toDF("id", "n").collect()} == {1: 3, 2: 3, 3: 3, 6: 1}
    got = {r["id"]: (r["language"], r["reason"]) for r in g.vote(taken, known, ("de", "en"), gap=0.1, chunk_gap=0.3).collect()}
    assert got[1] == ("en", None) and got[2] == ("de", None) and got[3][0] is None and got[6] == (None, "too_few")


def test_decisions_keep_history(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "left int, right int")
    asked = spark.createDataFrame([(2, 1, "confirmed", 1), (1, 2, None, 2), (4, 3, "keep_both", 3), (5, 6, "confirmed", 4), (1, 2, "perhaps", 5)], "left int, right int, decision string, decided_at int")
    made = scanner.decide(pairs, asked)
    assert {(r["decided_at"], r["error"]) for r in made.checked.collect()} == {(1, None), (2, None), (3, None), (4, "unknown_pair"), (5, "decision")}
    assert {tuple(r) for r in made.state.collect()} == {(1, 2, None, 2), (3, 4, "keep_both", 1)}


def test_triples_are_counted_and_scored_where_they_lie(spark):
    texts = [("a", "Abcabc"), ("b", "äöü𝄞x"), ("a", None), ("b", "ab"), (None, "abcd")]
    rows = spark.createDataFrame(texts, "lang string, text string")
    assert {(r["lang"], r["gram"]): r["n"] for r in g.triple_counts(rows).collect()} == {("a", "abc"): 2, ("a", "bca"): 1, ("a", "cab"): 1, ("b", "äöü"): 1, ("b", "öü𝄞"): 1, ("b", "ü𝄞x"): 1, (None, "abc"): 1, (None, "bcd"): 1}
    asked = spark.createDataFrame([(1, "ABC"), (2, "zzz"), (3, None), (4, "äöü abc abc")], "id int, text string")
    found = g.detect(asked, g.profiles(rows))
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Explode" not in plan  # nothing is moved
    got = {r["id"]: (r["lang"], round(r["score"], 6), round(r["second"], 6)) for r in found.collect()}
    assert got == {1: ("a", 0.5, 0.5), 4: ("a", 0.428571, 0.428571)}
