"""Text columns: normal forms, keys, tags, languages, names, titles and subjects.

Unicode normal forms and case folding have no Spark function; those are Arrow UDFs over
distinct-free columns. All else is built-in expressions. Null inputs give the result stated for each.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"
NOT_WORD = r"[^\p{L}\p{N}_\p{M}\s]"


#: Letters whose full upper case has several characters, by the one of their simple upper case.
SEVERAL = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x20000)) if len(c.upper()) > 1}
_SEVERAL = re.compile(f"([{''.join(SEVERAL)}])")


@F.pandas_udf(T.StringType())
def simple_upper(c: pd.Series) -> pd.Series:
    """Upper case of as many characters as the text has: ß gives ẞ, not SS."""
    return c.map(lambda x: None if x is None else "".join(SEVERAL.get(p) or p.upper() for p in _SEVERAL.split(x)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def _plain(x: str) -> str:
    folded = unicodedata.normalize("NFKD", x).casefold()
    kept = "".join(ch for ch in folded if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^\w\s]", " ", kept).split())


@F.pandas_udf(T.StringType())
def normalize_text(c: pd.Series) -> pd.Series:
    """Compatibility decomposition, case folded, without marks and punctuation, single blanks; null gives ''."""
    return c.map(lambda x: _plain(x) if x else "")


@F.pandas_udf(T.StringType())
def key(c: pd.Series) -> pd.Series:
    """Compatibility composition, case folded, single blanks; punctuation and accents stay; null stays."""
    return c.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(T.StringType())
def compose(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def compose_compatible(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def fold(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def normalized_text(c: pd.Series) -> pd.Series:
    """The form that text fingerprints are taken of: composed, without soft hyphens, single blanks, case folded."""
    return c.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).replace("­", "").split()).casefold())


def text_form(c: Column) -> Column:
    """normalized_text; only texts that are not plain ASCII go to Python."""
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(normalized_text(F.when(wide, c)), native_text(c))


def native_text(c: Column) -> Column:
    """The same for texts whose letters need neither composition nor special folding; built-in functions only."""
    return squeeze(F.lower(F.replace(c, F.lit("­"), F.lit(""))))


def strip_punctuation(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, NOT_WORD, " "))


def search_key(c: Column) -> Column:
    return strip_punctuation(key(c))


def turn_name(c: Column) -> Column:
    """'Surname, Given' as 'Given Surname' if there is one comma and the surname has no blank."""
    parts = F.split(c, ",")
    last, first = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & ~F.contains(last, F.lit(" ")) & (last != "") & (first != ""), F.concat_ws(" ", first, last)).otherwise(c)


def author_key(c: Column) -> Column:
    return strip_punctuation(turn_name(key(c)))


def alias_key(field: Column, c: Column) -> Column:
    return F.when(field == "author", author_key(c)).otherwise(key(c))


def clean_tag_name(c: Column) -> Column:
    return F.substring(squeeze(compose_compatible(c)), 1, 200)


def normalize_tag_name(c: Column) -> Column:
    return fold(clean_tag_name(c))


# Names of languages and the codes they stand for.
LANGUAGE_ALIASES = {
    "de": "de", "de-de": "de", "de de": "de", "deu": "de", "ger": "de", "deutsch": "de", "german": "de",
    "en": "en", "eng": "en", "englisch": "en", "english": "en",
    "es": "es", "spa": "es", "spanisch": "es", "spanish": "es", "espanol": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "franzosisch": "fr", "french": "fr",
    "it": "it", "ita": "it", "italienisch": "it", "italian": "it",
    "pt": "pt", "por": "pt", "portugiesisch": "pt", "portuguese": "pt",
    "nl": "nl", "nld": "nl", "dut": "nl", "niederlandisch": "nl", "dutch": "nl",
    "pl": "pl", "pol": "pl", "polnisch": "pl", "polish": "pl",
    "ru": "ru", "rus": "ru", "russisch": "ru", "russian": "ru",
    "sv": "sv", "swe": "sv", "schwedisch": "sv", "swedish": "sv",
    "da": "da", "dan": "da", "danisch": "da", "danish": "da",
    "no": "no", "nor": "no", "norwegisch": "no", "norwegian": "no",
    "fi": "fi", "fin": "fi", "finnisch": "fi", "finnish": "fi",
    "cs": "cs", "ces": "cs", "cze": "cs", "tschechisch": "cs", "czech": "cs",
    "la": "la", "lat": "la", "latein": "la", "latin": "la",
}
LANGUAGE_LABELS = {
    "de": "Deutsch", "en": "Englisch", "es": "Spanisch", "fr": "Französisch", "it": "Italienisch", "pt": "Portugiesisch", "nl": "Niederländisch", "pl": "Polnisch",
    "ru": "Russisch", "sv": "Schwedisch", "da": "Dänisch", "no": "Norwegisch", "fi": "Finnisch", "cs": "Tschechisch", "la": "Latein",
}


def lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


@F.pandas_udf(T.StringType())
def unmarked(c: pd.Series) -> pd.Series:
    """Compatibility decomposition, case folded, without combining marks; null stays."""

    def form(x: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(ch))

    return c.map(lambda x: None if x is None else form(x))


def language_of(folded: Column) -> Column:
    """The code that a folded name or tag stands for, by itself or by its part before a hyphen; parts of two or three letters stay; blank gives null."""
    name = F.replace(squeeze(folded), F.lit("_"), F.lit("-"))
    base = F.substring_index(name, "-", 1)
    code = F.coalesce(lookup(LANGUAGE_ALIASES, name), lookup(LANGUAGE_ALIASES, base), F.when(F.length(base).between(2, 3), base), name)
    return F.when(F.length(name) > 0, code)


def normalize_language_plain(c: Column) -> Column:
    """normalize_language for names of plain letters; built-in functions only."""
    return language_of(F.lower(c))


def normalize_language(c: Column) -> Column:
    """The code of a language's name or tag in any case, with or without accents; unknown names stay, folded."""
    return language_of(unmarked(c))


def language_label(code: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_LABELS, code), F.when(F.length(code) <= 3, F.upper(code)), code)


#: Names that a file of some systems must not have.
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
_EDGES = "^[ .]+|[ .]+$"


def sanitize_component(c: Column, fallback: str = "Unbekannt", most: int = 120, composed: Column | None = None) -> Column:
    """A file name part that every file system takes; reserved names get a leading _; nothing left gives the fallback.

    composed: the column in composed form, compose(c) if not given.
    """
    spaced = F.regexp_replace(F.coalesce(compose(c) if composed is None else composed, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', " ")
    clean = F.regexp_replace(squeeze(spaced), _EDGES, "")
    named = F.when(F.length(clean) > 0, clean).otherwise(F.lit(fallback))
    safe = F.when(named.rlike(RESERVED), F.concat(F.lit("_"), named)).otherwise(named)
    cut = F.regexp_replace(F.substring(safe, 1, most), r"[ .]+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(fallback))


def fallback_title(filename: Column, composed: Column | None = None) -> Column:
    """The last part of a path without its suffix, as a file name part."""
    stem = lambda x: F.regexp_replace(F.regexp_extract(x, r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]*$", "")
    return sanitize_component(stem(filename), "Unbekannter Titel", composed=None if composed is None else stem(composed))


def year_from(c: Column) -> Column:
    return F.regexp_extract(c, r"((?:18|19|20)[0-9]{2})", 1).try_cast("int")


def printable_text(c: Column, most: int) -> Column:
    """Control characters as blanks, single blanks, cut; null if fewer than max(3, half) printable characters remain."""
    shown = F.regexp_replace(c, r"[\p{Cntrl}\p{Cf}\p{Co}\p{Cn}]", " ")
    left = F.length(F.regexp_replace(c, r"[\p{Cntrl}\p{Cf}\p{Co}\p{Cn}]", ""))
    return F.when(left >= F.greatest(F.lit(3), F.length(c) / 2), F.substring(squeeze(shown), 1, most))


#: White space other than the blank that titles must not hold (code points).
TITLE_SPACES = "\u0009\u000a\u000b\u000c\u000d \u0085                 　"


def clean_title(c: Column, composed: Column | None = None) -> Column:
    """struct(title, rules, error): rules nfc, leading_bom, whitespace as applied; error control_character, empty or too_long, title null then.

    composed: the column in composed form, compose(c) if not given.
    """
    nfc = compose(c) if composed is None else composed
    unmarked = F.regexp_replace(nfc, "^﻿+", "")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(unmarked, f"[{TITLE_SPACES}]", " "), " +", " "))
    rules = F.array_compact(F.array(F.when(nfc != c, F.lit("nfc")), F.when(unmarked != nfc, F.lit("leading_bom")), F.when(spaced != unmarked, F.lit("whitespace"))))
    error = F.when(c.isNull() | (spaced == ""), F.lit("empty")).when(spaced.rlike(r"[\x00-\x1F\x7F-\x9F]"), F.lit("control_character")).when(F.length(spaced) > 500, F.lit("too_long"))
    return F.struct(F.when(error.isNull(), spaced).alias("title"), F.when(error.isNull(), rules).otherwise(F.array().cast("array<string>")).alias("rules"), error.alias("error"))


# Parts of subjects that advertise, shelf paths, and groups of broad subjects of which one is enough (all in plain form).
NOISE = (
    "geschenk", "bestseller", "adventskalender", "weihnachtsgeschenk", "new york times", "spiegel bestseller", "carlsen", "bloomsbury", "vorlesebuch",
    "vorlesen", "zum vorlesen", "zaubern", "phantastische tierwesen", "fur fans", "fur leser", "top seller", "must read",
)
SHELVES = ("abenteuer entdecken", "abenteuer und entdecken", "moderne klassiker", "england", "schottland", "vereinigtes konigreich", "united kingdom")
BROAD = (("fantasy", "fantasy bucher", "fantasy roman", "zeitgenossische fantasyromane"), ("magie", "zauber"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_forms(values: pd.Series) -> pd.Series:
    """normalize_text of each element."""
    return values.map(lambda xs: None if xs is None else [_plain(x) if x else "" for x in xs])


def subject_parts(values: Column) -> Column:
    """The parts between bars of all values, single blanks, without marks at the ends."""
    parts = F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.split(v, r"\|")))
    return F.transform(parts, lambda v: F.regexp_replace(squeeze(v), r"^[ \-|,;:]+|[ \-|,;:]+$", ""))


def kept_subjects(parts: Column, keys: Column, known: Column, most: int = 20) -> Column:
    """Of parts with their plain forms in keys those that tell something, in order: three letters or more, not known, not noise or a shelf, each once, one of a broad group."""
    noise = "|".join(map(re.escape, NOISE))

    def take(acc: Column, x: Column) -> Column:
        key, seen = x["keys"], acc["seen"]
        broad = [key.isin(*g) & F.arrays_overlap(seen, F.array(*map(F.lit, g))) for g in BROAD]
        bad = (F.length(x["parts"]) < 3) | F.array_contains(known, key) | F.array_contains(seen, key) | key.rlike(noise) | key.isin(*SHELVES) | broad[0] | broad[1]
        good = ~bad & (F.size(acc["out"]) < most)
        return F.struct(F.when(good, F.array_append(seen, key)).otherwise(seen).alias("seen"), F.when(good, F.array_append(acc["out"], F.substring(x["parts"], 1, 160))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<string>")
    both = F.arrays_zip(parts.alias("parts"), keys.alias("keys"))
    return F.coalesce(F.aggregate(both, F.struct(none.alias("seen"), none.alias("out")), take, lambda acc: acc["out"]), none)


def clean_subjects(df: DataFrame, values: str, known: str | None = None, out: str = "subjects", most: int = 20) -> DataFrame:
    """df with the subjects of the array values that kept_subjects keeps; known: an array of names that are no subjects."""
    names = F.array().cast("array<string>") if known is None else F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    staged = df.withColumns({"__parts": subject_parts(F.col(values)), "__names": names})
    staged = staged.withColumns({"__keys": plain_forms("__parts"), "__known": plain_forms("__names")})
    return staged.withColumn(out, kept_subjects(F.col("__parts"), F.col("__keys"), F.col("__known"), most)).drop("__parts", "__names", "__keys", "__known")


def first_spelling(values: Column, form) -> Column:
    """Distinct values by form(value), the first spelling of each kept, in order."""
    return F.transform(
        F.filter(
            F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
            lambda s: F.array_position(F.transform(values, form), form(s["v"])) == s["i"] + 1,
        ),
        lambda s: s["v"],
    )


def dedupe_tags(tags: Column, most: int = 10) -> Column:
    """Tags without control characters and blanks at the ends, first spelling of each name (any case), at most `most`."""
    clean = F.filter(F.transform(tags, lambda t: F.substring(squeeze(F.regexp_replace(t, r"\p{Cntrl}", " ")), 1, 200)), lambda t: t != "")
    return F.slice(first_spelling(clean, F.lower), 1, most)


def is_latin(c: Column) -> Column:
    """Whether four fifths of the letters are Latin; false without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(c, r"[^\p{IsLatin}]", ""))
    return F.coalesce((letters > 0) & (latin >= 0.8 * letters), F.lit(False))


def person_key(c: Column, plain: Column | None = None) -> Column:
    """struct(family, initials) of 'Family, Given' or 'Given Family': last token of the family name, first letters of the given ones; null without both.

    plain: normalize_text of family_first(c), made of it if not given.
    """
    halves = F.split(plain if plain is not None else family_first(c), r"\|")
    tokens = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), " "), lambda w: w != "")
    family, given = tokens(F.get(halves, F.lit(0))), tokens(F.get(halves, F.lit(1)))
    initials = F.array_join(F.transform(given, lambda w: F.substring(w, 1, 1)), "")
    return F.when((F.size(family) > 0) & (F.size(given) > 0), F.struct(F.element_at(family, -1).alias("family"), initials.alias("initials")))


@F.pandas_udf(T.StringType())
def family_first(c: pd.Series) -> pd.Series:
    """'family|given' in plain form; without a comma the last word is the family name."""

    def form(x: str) -> str:
        family, comma, given = x.partition(",")
        if not comma:
            given, _, family = " ".join(x.split()).rpartition(" ")
        return f"{_plain(family)}|{_plain(given)}"

    return c.map(lambda x: None if x is None else form(x))
