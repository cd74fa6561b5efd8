"""Quality rules (operator 6): a threshold table compiled into one Spark projection.

No user functions: every count is a built-in expression over the text, and a document is
judged in the row where it stands, so there is no shuffle. Words are runs of characters that
are not white space (blank, tab to carriage return).

Defined results: a null text counts as empty, has no words and fails; ratios over nothing are
null and a rule over a null ratio does not fire. Rows are independent: repeated rows, other
columns and empty tables pass through. An input column with the name of a result is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import WS, drop_names, words_column

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages; lower case.
STOP_WORDS = tuple(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
        "der die und das von zu den mit ist im dem nicht ein eine auf für sich des als auch es an er aus bei "
        "le la les de et des en un une du que qui dans pour est pas sur au par il elle ne se plus "
        "el los las y que en un una por con para no se su al lo como más del es"
    ).split()
)
#: (name, value, comparison, threshold): a document is dropped if any row holds.
BASE_RULES = (
    ("too_few_words", "n_words", "<", 50),
    ("repeated_windows", "repeat_percent", ">", 50),
)
METHOD_RULES = (
    ("too_many_words", "n_words", ">", 1_000_000),
    ("word_too_short", "mean_word", "<", 2.0),
    ("word_too_long", "mean_word", ">", 14.0),
    ("symbols", "symbols_per_word", ">", 0.2),
    ("no_stop_words", "stop_percent", "<", 1.0),
    ("duplicate_lines", "dup_line_percent", ">", 40),
    ("shouting", "upper_percent", ">", 60),
)


def _windows(words: Column) -> Column:
    """Hashes (64 bits) of the 3-word windows, in place."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(some)


def _repeated(windows: Column) -> Column:
    """The distinct hashes that occur twice or more: equal neighbours of the sorted ones; a text without any is not sorted."""
    ordered = F.array_sort(windows)
    twice = F.array_distinct(F.filter(F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.array().cast("array<bigint>")).otherwise(twice)


def _repeat_words(windows: Column, repeated: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    The places of repeated windows, in order, cover three words each less what the one before
    covers already. With few repeated hashes the places are looked up among them; with many,
    (hash, place) pairs are sorted and equal neighbours taken.
    """
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    looked_up = F.transform(F.filter(placed, lambda p: F.array_contains(repeated, p["h"])), lambda p: p["i"])
    ordered = F.array_sort(placed)
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    sorted_out = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    places = F.when(F.size(repeated) <= 24, looked_up).otherwise(sorted_out)
    return F.when(F.size(repeated) == 0, F.lit(0)).otherwise(
        F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
    )


def _verdict(rules: tuple, values: dict[str, Column]) -> Column:
    test = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    return reduce(lambda a, b: a | b, (F.coalesce(test[op](values[value], F.lit(limit)), F.lit(False)) for _, value, op, limit in rules))


def measure(df: DataFrame, text: str = "text", base_rules: tuple = BASE_RULES, method_rules: tuple = METHOD_RULES) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed, kept and failed (names of the rules that fired)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_upper", "base_failed", "kept", "failed"]
    kept = drop_names(df, [*names, "__w", "__l", "__h", "__r"])
    whole = F.coalesce(F.col(text), F.lit(""))
    staged = kept.withColumn("__w", words_column(F.col(text))).withColumn("__l", F.filter(F.split(whole, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
    staged = staged.withColumn("__h", _windows(F.col("__w"))).withColumn("__r", _repeated(F.col("__h")))
    t, w, lines = F.coalesce(F.col(text), F.lit("")), F.col("__w"), F.col("__l")
    counted = staged.select(
        *kept.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__h"), F.col("__r")).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long").alias("n_upper"),
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    over = lambda a, b: F.when(b > 0, a / b)
    values = {
        "n_words": n,
        "repeat_percent": over(100 * F.col("n_repeat_words"), n),
        "mean_word": over(chars, n),
        "symbols_per_word": over(F.col("n_symbols"), n),
        "stop_percent": over(100 * F.col("n_stop_words"), n),
        "dup_line_percent": over(100 * F.col("n_dup_lines"), F.col("n_lines")),
        "upper_percent": over(100 * F.col("n_upper"), chars),
    }
    fired = F.array_compact(F.array(*[F.when(_verdict((r,), values), F.lit(r[0])) for r in (*base_rules, *method_rules)]))
    # The always true test on a row number keeps filters on these columns above the projection: pushed below,
    # they would put the array expressions inside other expressions' lambdas and run them for each element.
    return counted.withColumns({"base_failed": _verdict(base_rules, values), "failed": fired}).withColumn("kept", (F.size("failed") == 0) & (F.monotonically_increasing_id() >= 0))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of df that no rule drops, with df's own columns."""
    marked = measure(df.withColumn("__row", F.struct(*df.columns)).select("__row", F.col(text)), text)
    return marked.where("kept").select("__row.*")


def oracle(table: str = "documents", stop_words: tuple = STOP_WORDS) -> str:
    """DuckDB SQL of the query over measure()."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(stop_words))
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM {table}),
w AS (
  SELECT *, list_filter(string_split_regex(t, '{ws}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{ws}', '', 'g') <> '') AS ls FROM d),
g AS (
  SELECT *, CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1), lambda i: {{'w': ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2], 'i': i}}) END AS gs FROM w),
o AS (SELECT *, list_sort(gs) AS os FROM g),
r AS (
  SELECT *, list_sort(list_distinct(flatten(list_filter(list_transform(range(1, len(os)), lambda k: CASE WHEN os[k].w = os[k+1].w THEN [os[k].i, os[k+1].i] END), lambda x: x IS NOT NULL)))) AS rs FROM o),
c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{ws}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(CASE WHEN len(rs) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(range(1, len(rs)), lambda k: least(3, rs[k+1] - rs[k]))), 0) + 3 END AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_words > 1000000
    OR (n_words > 0 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0 OR n_symbols / n_words > 0.2 OR 100 * n_stop_words / n_words < 1.0))
    OR (n_lines > 0 AND 100 * n_dup_lines / n_lines > 40) OR (word_chars > 0 AND 100 * n_upper / word_chars > 60)) AS kept
FROM c"""
