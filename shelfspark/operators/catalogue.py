"""Catalogue queries over books, bridges and dimensions: filters, children, counts, facets, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nocase(c: Column) -> Column:
    """Order key that folds ASCII letters only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def having(books: DataFrame, bridge: DataFrame, dim: DataFrame, book: str, item: str, value: Column) -> DataFrame:
    """Books that have an item of the dimension for which value holds; bridge(book, item), dim(item, ...)."""
    return books.join(bridge.join(dim.where(value), item).select(book), book, "left_semi")


def filter_books(books: DataFrame, year: tuple[int | None, int | None] = (None, None), **equal: str | None) -> DataFrame:
    """Books within the inclusive year bounds and equal in all given columns."""
    low, high = year
    if low is not None:
        books = books.where(F.col("year") >= low)
    if high is not None:
        books = books.where(F.col("year") <= high)
    for name, wanted in equal.items():
        if wanted is not None:
            books = books.where(F.col(name) == wanted)
    return books


def with_children(books: DataFrame, bridge: DataFrame, dim: DataFrame, book: str, item: str, name: str, out: str) -> DataFrame:
    """books with the sorted array out of the names of their items (empty without any)."""
    named = bridge.join(dim.select(item, F.col(name).alias("__n")), item).groupBy(book).agg(F.array_sort(F.collect_set("__n")).alias(out))
    return books.join(named, book, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def count_children(dim: DataFrame, bridge: DataFrame, item: str) -> DataFrame:
    """dim with book_count, 0 without rows in the bridge. The bridge is counted before it is joined."""
    counts = bridge.groupBy(item).agg(F.count("*").alias("book_count"))
    return dim.join(counts, item, "left").withColumn("book_count", F.coalesce("book_count", F.lit(0)).cast("long"))


def value_counts(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    value = F.col(col).cast("string")
    return df.where(value.isNotNull() & (F.trim(value) != "")).groupBy(value.alias(name)).agg(F.count("*").alias("book_count"))


def facets(books: DataFrame, columns: dict[str, str], bridges: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(facet, value, book_count) of columns, in one pass of grouping sets, and of bridge dimensions."""
    names = list(columns)
    picked = books.select(*[F.col(columns[n]).cast("string").alias(n) for n in names])
    sets = picked.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.count("*").alias("book_count"), *[F.grouping(n).alias(f"g_{n}") for n in names])
    facet = F.coalesce(*[F.when(F.col(f"g_{n}") == 0, F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col(f"g_{n}") == 0, F.col(n)) for n in names])
    out = sets.select(facet.alias("facet"), value.alias("value"), "book_count").where(value.isNotNull() & (F.trim(value) != ""))
    for name, (counted, col) in bridges.items():
        out = out.unionByName(counted.select(F.lit(name).alias("facet"), F.col(col).alias("value"), F.col("book_count").cast("long").alias("book_count")))
    return out


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page in the given order; offsets below 0 are 0."""
    ordered = df.orderBy(*order).offset(max(0, offset))
    return ordered if limit is None else ordered.limit(limit)


def keyset_page(df: DataFrame, col: str, after: int, limit: int) -> DataFrame:
    return df.where(F.col(col) > after).orderBy(col).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def get_or_create(dim: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """dim with the unseen keys of incoming, once each; ids are hashes of the key, so that all writers agree."""
    new = incoming.select(key).where(F.col(key).isNotNull()).distinct().join(dim, key, "left_anti")
    return dim.select("id", key).unionByName(new.select(F.xxhash64(key).alias("id"), key))


def orphans(dim: DataFrame, bridge: DataFrame, item: str) -> DataFrame:
    return dim.join(bridge, item, "left_anti")


def spread_sample(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """n evenly spaced rows of each key's m rows: places round(i (m-1) / (n-1)), half to even; all rows if m <= n."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__m": F.count("*").over(w), "__i": F.row_number().over(w.orderBy(*order)) - 1})
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__m") - 1) / F.lit(max(1, n - 1)), 0).cast("int"))
    return ranked.where((F.col("__m") <= n) | F.array_contains(places, F.col("__i"))).drop("__m", "__i")
