"""Names in SQL: text and ISBN functions, the MinHash aggregate, shingles and segments as table functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import text as t
from shelfspark.operators import linkage
from shelfspark.operators.fingerprint import WORD, minhash_aggregate
from shelfspark.operators.markup import segments_of


def _isbn13(x: str) -> bool:
    return bool(re.fullmatch("[0-9]{13}", x)) and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(x)) % 10 == 0


def _isbn10(x: str) -> bool:
    return bool(re.fullmatch("[0-9]{9}[0-9X]", x)) and sum((10 if d == "X" else int(d)) * (10 - i) for i, d in enumerate(x)) % 11 == 0


@F.pandas_udf(T.BooleanType())
def valid_isbn13(c: pd.Series) -> pd.Series:
    return c.map(lambda x: x is not None and _isbn13(x))


@F.pandas_udf(T.BooleanType())
def valid_isbn10(c: pd.Series) -> pd.Series:
    return c.map(lambda x: x is not None and _isbn10(x))


@F.pandas_udf(T.StringType())
def canonical_isbn13(c: pd.Series) -> pd.Series:
    def form(x: str | None) -> str | None:
        plain = re.sub("[^0-9X]", "", (x or "").upper())
        if _isbn13(plain):
            return plain
        if not _isbn10(plain):
            return None
        stem = "978" + plain[:9]
        return stem + str(-sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(stem)) % 10)

    return c.map(form)


@F.udtf(returnType="shingle string, hash bigint, first boolean", useArrow=True)
class Shingle:
    """A row for each five-word window of a text in normal form, with its 64-bit hash, and whether it is the first of its kind in the text."""

    def eval(self, text: str) -> Iterator[tuple]:
        words, seen = WORD.findall(" ".join(t.unicodedata.normalize("NFKC", text or "").replace("\u00ad", "").split()).casefold()), set()
        for i in range(len(words) - 4):
            gram = " ".join(words[i : i + 5])
            yield gram, int.from_bytes(hashlib.sha256(gram.encode()).digest()[:8], "big", signed=True), gram not in seen
            seen.add(gram)


@F.udtf(returnType=T.StructType([T.StructField(n, T.StringType()) for n in ("location", "kind", "text")]))
class SegmentHtml:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from segments_of(html or "")


#: Functions of one text as they are in functions/text.py: their names in SQL stand for the same expressions.
COLUMNS = {
    "search_key": t.search_key, "author_key": t.author_key, "turn_name": t.turn_name, "strip_punctuation": t.strip_punctuation, "clean_tag_name": t.clean_tag_name, "clean_title": t.clean_title,
    "sanitize_component": t.sanitize_component, "normalize_language": t.normalize_language, "year_from": t.year_from, "squeeze": t.squeeze,
}
_SUM10 = " + ".join(f"{10 - i} * CAST(substring(x, {4 + i}, 1) AS INT)" for i in range(9))
#: Functions made of others. Arguments in order.
COMPOSED = {
    "normalize_tag_name": ("x STRING", "fold(clean_tag_name(x))"),
    "alias_key": ("field STRING, x STRING", "CASE WHEN field = 'author' THEN author_key(x) ELSE key(x) END"),
    "isbn10_to_isbn13": ("x STRING", "CASE WHEN valid_isbn10(x) THEN canonical_isbn13(x) END"),
    "isbn13_to_isbn10": ("x STRING", f"CASE WHEN valid_isbn13(x) AND x LIKE '978%' THEN substring(x, 4, 9) || substring('0123456789X', (11 - ({_SUM10}) % 11) % 11 + 1, 1) END"),
}


def _expression(spark: SparkSession, f) -> str:
    """A function of a column as SQL over x; its Python functions go by their own names."""
    made = spark.createDataFrame([], "x string").select(f(F.col("x")).alias("r"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    """Makes the names known to the session's SQL."""
    named = {
        "normalize_text": t.normalize_text, "key": t.key, "text_key": t.key, "unmarked": t.unmarked, "normalized_text": t.normalized_text, "fold": t.fold, "fold_case": t.fold, "compose": t.compose,
        "compose_compatible": t.compose_compatible, "valid_isbn10": valid_isbn10, "valid_isbn13": valid_isbn13, "canonical_isbn13": canonical_isbn13, "similarity": linkage.name_similarity, "minhash_signature": minhash_aggregate,
    }
    for name, f in named.items():
        spark.udf.register(name, f)
    bodies = {name: ("x STRING", _expression(spark, f)) for name, f in COLUMNS.items()} | COMPOSED
    for name, (arguments, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")
    spark.udtf.register("shingle", Shingle)
    spark.udtf.register("segment_html", SegmentHtml)
