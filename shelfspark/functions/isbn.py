"""ISBN columns: spelling, checksums and conversion. Null or malformed inputs give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_isbn(c: Column) -> Column:
    """Digits and X of a number of 10 or 13 characters; the checksum is not looked at."""
    kept = F.regexp_replace(F.upper(c), "[^0-9X]", "")
    return F.when(F.length(kept).isin(10, 13), kept)


def _sum(c: Column, weights: list[int]) -> Column:
    """Weighted sum of the leading digits; null if one is none. c occurs once: columns of columns stay short."""
    digits = F.slice(F.split(c, ""), 1, len(weights))
    return F.aggregate(F.zip_with(digits, F.array(*map(F.lit, weights)), lambda d, w: d.try_cast("int") * w), F.lit(0), lambda a, x: a + x)


def check13(c: Column) -> Column:
    """Check digit of the first twelve digits."""
    return ((10 - _sum(c, [1, 3] * 6) % 10) % 10).cast("string")


def check10(c: Column) -> Column:
    """Check character of the first nine digits."""
    rest = (11 - _sum(c, list(range(10, 1, -1))) % 11) % 11
    return F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string"))


def valid_isbn13(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{13}$") & (F.substring(c, 13, 1) == check13(c)), F.lit(False))


def valid_isbn10(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{9}[0-9X]$") & (F.substring(c, 10, 1) == check10(c)), F.lit(False))


def isbn10_to_isbn13(c: Column) -> Column:
    stem = F.concat(F.lit("978"), F.substring(c, 1, 9))
    return F.when(valid_isbn10(c), F.concat(stem, check13(stem)))


def isbn13_to_isbn10(c: Column) -> Column:
    stem = F.substring(c, 4, 9)
    return F.when(valid_isbn13(c) & c.startswith("978"), F.concat(stem, check10(stem)))


def canonical_isbn13(c: Column) -> Column:
    plain = normalize_isbn(c)
    return F.when(valid_isbn13(plain), plain).when(valid_isbn10(plain), isbn10_to_isbn13(plain))
