"""Full-text index and ranked prefix search."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}_]+"


@F.pandas_udf(T.StringType())
def bare(c: pd.Series) -> pd.Series:
    """Lower case without combining marks; null stays."""

    def form(x: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch)).lower()

    return c.map(lambda x: None if x is None else form(x))


def tokens(text: Column) -> Column:
    """Words in lower case without diacritics; only texts that are not plain ASCII go to Python."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.regexp_extract_all(F.coalesce(bare(F.when(wide, text)), F.lower(text)), F.lit(TOKEN), F.lit(0))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])))
def counted(words: pa.Array) -> pa.Array:
    """The distinct words of texts of words with a blank between them, with their numbers; Python's objects are those of 256 texts at a time."""

    def some(texts: pa.Array) -> pa.Array:
        found = [Counter(w.split(" ")) if w else {} for w in texts.to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        token, tf = pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([token, tf], ["token", "tf"]))

    return pa.concat_arrays([some(words.slice(i, 256)) for i in range(0, max(1, len(words)), 256)])


def build_index(books: DataFrame, columns: list[str]) -> DataFrame:
    """Postings (token, id, col, tf) over the named columns of books, a row an id; arrays count as their elements.

    Tokens are counted in their row, so that no posting is moved for it.
    """
    kinds = dict(books.dtypes)
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") if kinds[c].startswith("array") else F.coalesce(F.col(c), F.lit(""))
    staged = books.select("id", *[counted(F.array_join(tokens(text(c)), " ")).alias(c) for c in columns])
    # The outer form, as a filter on what Python makes would have it made twice.
    made = staged.select("id", F.explode_outer(F.concat(*map(_tagged, columns))).alias("t")).where("t is not null")
    return made.select(F.col("t.token").alias("token"), "id", F.col("t.col").alias("col"), F.col("t.tf").alias("tf"))


def _tagged(c: str) -> Column:
    return F.transform(c, lambda t: F.struct(t["token"].alias("token"), t["tf"].alias("tf"), F.lit(c).alias("col")))


@dataclass
class Index:
    """Postings sorted by token, the length of each row, and one row of totals, as they lie in a folder."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame


def save_index(index: DataFrame, path: str) -> Index:
    """Writes an index once for many searches: postings dealt by tokens and sorted, so that a prefix reads few row groups of a file, lengths and totals.

    Ranges of tokens would need samples, for which the texts were read and counted once more.
    """
    spark = index.sparkSession
    index.repartition("token").sortWithinPartitions("token").write.parquet(f"{path}/postings")
    postings = spark.read.schema(index.schema).parquet(f"{path}/postings")
    postings.groupBy("id").agg(F.sum("tf").alias("len")).write.parquet(f"{path}/lengths")
    spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("rows"), F.avg("len").alias("avg")).write.parquet(f"{path}/totals")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "totals")])


def search(index: Index, query: str, limit: int | None = 100, columns: list[str] | None = None) -> DataFrame:
    """(id, score): rows that hold every term of the query (at most twelve, each a prefix) in any column, by BM25.

    The lowest score is best; without a limit the rows come in no order. No terms, no rows.
    """
    plain = "".join(ch for ch in unicodedata.normalize("NFD", query) if not unicodedata.combining(ch)).lower()
    terms = list(dict.fromkeys(re.findall(r"\w+", plain)[:12]))
    postings = index.postings.where(F.col("col").isin(columns)) if columns else index.postings
    if not terms:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    # a range of the sorted token column for each term; one pass for all
    starts = [F.col("token").startswith(t) for t in terms]
    hit = postings.where(reduce(lambda a, b: a | b, starts))
    term = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in zip(starts, terms, strict=True)])))
    f = hit.select("id", "tf", term.alias("term")).groupBy("id", "term").agg(F.sum("tf").alias("f"))
    n = f.groupBy("term").agg(F.count("*").alias("n"))  # at most twelve rows
    rows = f.join(F.broadcast(n), "term").join(index.lengths, "id").crossJoin(F.broadcast(index.totals))  # one row of totals
    idf = F.greatest(F.lit(1e-6), F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    found = rows.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("c")).where(F.col("c") == len(terms)).select("id", "score")
    return found if limit is None else found.orderBy("score", "id").limit(limit)


def search_title(index: Index, token: str) -> DataFrame:
    """(id, tf) of the rows whose title holds the token."""
    return index.postings.where((F.col("col") == "title") & (F.col("token") == token)).select("id", "tf")
