"""Catalogues as a source, and search over an index that takes inserts and deletes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.sources import catalogue as c

BOOKS = "id string, title string, authors array<string>, year int, imported_at string, file struct<name: string, size: long, sha256: string, path: string, format: string>, title_history array<struct<title: string, rules: array<string>, at: string>>, cover struct<path: string, source: string>"
FIELDS = "title string, authors array<string>, year int"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('catalogue')}/books"
    rows = [(f"bk_{i % 5:02x}{i:06x}", f"T {i} é \"q\"", ["A", "B"] if i % 3 else [], 1900 + i, "2024-01-01", (f"f{i}.epub", i, "ab", "p", "epub"), [("old", ["nfc"], "2024")] if i % 2 else None, None if i % 4 else ("c.png", "embedded")) for i in range(200)]
    rows.append(("bk_00zz", None, None, None, None, None, None, None))
    books = spark.createDataFrame(rows, BOOKS)
    c.write_documents(c.to_documents(books, ["title", "authors", "year"]), path, 2)
    c.register(spark)
    return path, books


def test_documents_rebuild_the_table(spark, written):
    path, books = written
    got = spark.read.format("shelf_catalogue").option("fields", FIELDS).option("digits", 2).load(path)
    assert sorted(map(repr, got.select(*books.columns).collect())) == sorted(map(repr, books.collect()))
    assert got.select("id", "year").where("year < 1910").count() == 10


def test_a_lookup_opens_one_shard(spark, written):
    path, books = written
    reader = c.CatalogueReader(books.schema, path, 2)
    assert len(reader.partitions()) == 5
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    kept = list(reader.pushFilters([EqualTo(("id",), "bk_01000001"), GreaterThan(("year",), 3)]))
    assert len(kept) == 2 and len(reader.partitions()) == 1
    assert [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()][0]["year"] == 1901
    list(reader.pushFilters([In(("id",), ("bk_03000003", "bk_01000001"))]))
    assert reader.ids == {"bk_01000001"}
    got = spark.read.format("shelf_catalogue").option("fields", FIELDS).option("digits", 2).load(path).where(F.col("id").isin("bk_01000001", "bk_0200000c", "none"))
    assert sorted(r["year"] for r in got.collect()) == [1901, 1912] and got.rdd.getNumPartitions() == 2


def test_broken_documents_are_rows_of_nulls(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    c.write_documents(spark.createDataFrame([("bk_1", "{broken"), ("bk_2", None), ("bk_3", "[1]"), ("bk_4", '{"metadata": {"title": {"value": "T"}}}')], "id string, json string"), path)
    c.register(spark)
    got = {r["id"]: r["title"] for r in spark.read.format("shelf_catalogue").load(path).collect()}
    assert got == {"bk_1": None, "bk_2": None, "bk_3": None, "bk_4": "T"}
    assert os.path.isdir(f"{tmp_path}/x")


def test_search_over_increments_is_search_over_a_rebuild(spark, tmp_path):
    from shelfspark.operators import growing_index as g
    from shelfspark.operators import search as s

    words = "sun moon star river stone tree bird wolf rain wind".split()
    book = lambda i, k: (i, " ".join(words[(i * 7 + k + j * j) % 10] for j in range(3 + i % 5)), [f"tag{i % 3}"])
    index = g.GrowingIndex(spark, f"file://{tmp_path}/index", most_segments=3)
    schema, held = "id long, title string, tags array<string>", {}
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert s.search(index.open(), "sun").count() == 0

    def check():
        index_now, rebuilt = index.open(), s.save_index(s.build_index(frame(list(held.values())), ["title", "tags"]), f"file://{tmp_path}/r{check.n}")
        check.n += 1
        for q in ("s*", "moon tag1", "wolf wind"):
            got, want = (sorted((r["id"], round(r["score"], 9)) for r in s.search(x, q, None).collect()) for x in (index_now, rebuilt))
            assert got == want, q

    check.n = 0
    for step, (new, gone) in enumerate([(range(20), []), (range(15, 30), [3, 4, 99]), (range(4, 6), [16]), (range(40, 43), []), ([], list(range(0, 40, 2)))]):
        if new:
            rows = [book(i, step) for i in new]
            index.insert(frame(rows), ["title", "tags"])
            held |= {r[0]: r for r in rows}
        if gone:
            index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
            held = {k: v for k, v in held.items() if k not in gone}
        if step != 2:
            check()
    assert len(index.state().segments) <= 3
    index.merge(list(index.state().segments))
    check()
