"""Duplicate queries on tables of their own."""

from __future__ import annotations

import random

from compare import oracle, rows
from pyspark.sql import functions as F

from shelfspark.catalog_queries import ORACLES, QUERIES
from shelfspark.operators import duplicates as d
from shelfspark.operators import fingerprint as fp
from shelfspark.operators import scanner
from shelfspark.shared import stored
from shelfspark.streaming import importer


def test_near_duplicates_exact_in_large_groups(spark, tmp_path):
    """Groups of more near copies than 199, each with a word of its own, and of fewer, against all pairs of sets."""
    rng = random.Random(5)
    texts = []
    for g, copies in enumerate((230, 70, 5)):
        text = [f"g{g}w{k}" for k in range(104)]
        for i in range(copies):
            at = rng.sample(range(104), rng.choice((1, 1, 6, 9)))
            texts.append(" ".join(f"own{g}x{i}" if k in at else w for k, w in enumerate(text)))
    rng.shuffle(texts)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and len(x & y) / len(x | y) >= 0.5}
    got = QUERIES["near_duplicates_exact"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 10_000
    assert {(r["left"], r["right"]): r["jaccard"] for r in got} == want


def test_texts_of_more_than_150_000_words(spark, tmp_path):
    """Whole texts are read: a passage at the end of a long one is found, and it has a hash, shingles and a near copy."""
    long = [f"w{k}" for k in range(150_100)]
    texts = [" ".join(long), " ".join(["other", *long])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(long[-40:]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("benchmark_containment", "text_fingerprint", "shingle_counts"):
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert len(got) == 2
        assert rows(got) == rows(oracle(ORACLES[name], str(tmp_path))), name
    assert QUERIES["near_duplicates_exact"](spark, str(tmp_path)).count() == 1


def test_near_duplicates_recall(spark):
    """Bands find 0.99 of the pairs at the threshold by formula; measured against all pairs."""
    sf = "/root/testdata/sf0.01"
    found = {(r["left"], r["right"]) for r in QUERIES["near_duplicates"](spark, sf).collect()}
    every = {(r["left"], r["right"]) for r in QUERIES["near_duplicates_exact"](spark, sf).collect()}
    assert found <= every and len(found) >= 0.98 * len(every) > 10


def test_matches_without_all_candidates_are_those_of_all_candidates(spark):
    rng = random.Random(5)
    words = [f"{c}word{i}" for i, c in enumerate("abcdefghijkl")] + ["of", "in"]
    vocabulary = [f"t{i}" for i in range(4000)]
    docs, body = [], []
    for i in range(160):
        if i % 4 == 0:
            body = rng.choices(vocabulary, k=rng.choice((120, 300)))
        elif i % 4 == 1:
            body = [w if rng.random() > 0.04 else "x" for w in body]
        elif i % 4 == 2:
            body = body[: rng.choice((110, len(body)))]
        title = rng.sample(words, rng.choice((1, 3, 4, 5, 6, 9, 11)))[: rng.choice((3, 99))] if i % 3 else ["aword0", "bword1", "cword2", "dword3", *rng.sample(["eword4", "of"], 1)]
        docs.append((i, " ".join(body), " ".join(title) if i % 41 else None, rng.choice((["A"], ["A", None], [None, "B"], [], ["B", "A"])), rng.choice(("en", "en", "de", None)), f"isbn{i % 70}" if i % 5 == 0 else None))
    rows = stored(spark.createDataFrame(docs, "id long, text string, title string, authors array<string>, language string, isbn string"), "rows")
    keys = rows.selectExpr("id", "title", "authors", "isbn", "language", "cast(null as int) as year", "cast(null as string) as publisher", "cast(null as string) as series")
    prints = stored(fp.fingerprint(rows.select("id", "text"), 100), "prints")
    signed = stored(fp.representatives(prints).withColumn("signature", fp.minhash("shingles")).where("size(signature) = 32").select("id", "signature"), "signed")
    firsts = stored(keys.join(fp.representatives(prints).select("id"), "id", "left_semi"), "firsts")
    textual = stored(d.union_pairs(d.pairs_by_lsh(signed), d.pairs_by_value(firsts, "title"), d.pairs_by_value(firsts, "isbn")), "textual")
    every = d.union_pairs(textual, d.pairs_by_rare_tokens(firsts, "title"), d.pairs_by_text_hash(prints))
    plain = lambda df: sorted((r["left"], r["right"], r["kind"], r["reasons"], r["conflicts"]) for r in df.collect())
    got = plain(scanner.find_matches(prints, signed, keys, 0.5, 100))
    assert got == plain(scanner.match_pairs(every, textual, prints, keys, 0.5, 100))
    # every pair's texts compared, with no use of titles
    compared = d.text_relation(d.compare_texts(textual, prints), near_words=100, near=0.5).where("relation is not null and relation <> 'same'").select("left", "right", "relation").collect()
    assert {(r["left"], r["right"]) for r in compared} == {(a, b) for a, b, _, reasons, _ in got if {"near_text", "partial_text"} & set(reasons)}
    assert {x for r in got for x in r[3]} >= {"near_text", "partial_text", "same_isbn", "title_author", "similar_title_author"}


def test_index_keys_meet_for_similar_titles_only(spark):
    titles = ["common alpha beta gamma delta", "common alpha beta gamma", "common other words here", "alpha common gamma beta"]
    rows = spark.createDataFrame([(i, t, ["A"] if i < 9 else ["B"]) for i, t in [*enumerate(titles), (9, titles[1])]], "id int, title string, authors array<string>")
    made = rows.select("id", importer.index_keys(F.col("title"), F.col("authors"), F.lit(None).cast("string"), F.array().cast("array<bigint>")).alias("k")).collect()
    keys = {r["id"]: {(k["key"], k["asks"]) for k in r["k"]} for r in made}
    meet = lambda a, b: any(x == y and (p or q) for x, p in keys[a] for y, q in keys[b])
    assert {(a, b) for a in keys for b in keys if a < b and meet(a, b)} == {(0, 1), (0, 3), (1, 3), (1, 9)}


def test_title_pairs_are_made_once(spark):
    """Titles that meet by several tokens, from both sides, as equals or in arrays of several ids, with none of their pairs moved."""
    rng = random.Random(3)
    words = [f"{c}word{i}" for i, c in enumerate("abcdefghijkl")] + ["of", "in", "the"]
    titles = [None, "", "of", "of in", "of in", *["aword0 bword1 cword2 of"] * 600, *["aword0 bword1 cword2"] * 3, *[" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)]]
    rows = stored(spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(titles)], "id long, title_key string"), "titles")
    made = d.pairs_by_titles(rows)
    want = {(r["left"], r["right"]) for r in d.union_pairs(d.pairs_by_value(rows, "title_key"), d.pairs_by_rare_tokens(rows)).collect()}
    got = [(r["left"], r["right"]) for r in made.collect()]
    assert len(got) == len(set(got)) > 180_000 and set(got) == want
    others = stored(spark.createDataFrame(sorted(want)[:50] + [(0, 7)], "left long, right long"), "others")
    assert [tuple(r) for r in d.not_by_titles(others, rows).collect()] == [(0, 7)]
    plan = QUERIES["candidate_union"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
