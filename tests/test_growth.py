"""What grows with the input: accesses of state, rows moved, batches sent to Python."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfspark import sqlnames
from shelfspark.catalog_queries import QUERIES
from shelfspark.operators import duplicates as d
from shelfspark.operators import fingerprint as fp
from shelfspark.operators import linkage, search, selection
from shelfspark.plans import dedup
from shelfspark.plans.linkage import provider_rows
from shelfspark.shared import stored
from shelfspark.streaming import importer, reviews

SF = "/root/testdata/sf0.001"


class Calls:
    """A state and timers that count what is asked of them."""

    def __init__(self):
        self.n, self.held, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.n += 1
        return self.held is not None

    def get(self):
        self.n += 1
        return self.held

    def update(self, value):
        self.n, self.held = self.n + 1, value

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def test_a_batch_of_an_item_is_one_access_of_its_state():
    calls, day = Calls(), 24 * reviews.HOUR * 1000
    events = [Row(item=1, at=k * day // 2 if k < 50 else k * day, seq=k, status="ready", archived=False) for k in range(100)]
    for run, part in ((0, events[:60]), (1, events[60:])):
        calls.n = 0
        p = reviews.Reviews(run, 24 * reviews.HOUR)
        p.init(calls)
        out = [tuple(r) for r in p.handleInputRows((1,), iter(part[::-1]), None)]
        assert calls.n <= 4
        assert out == [(1, "ready", e.at + day) for e in events[max(0, 60 * run - 1) : 59 + 40 * run] if e.seq >= 49]
    assert calls.timers == {calls.held[3]}


def test_signatures_move_without_shingles(spark):
    """Shingles stay where they are made, and bands are joined by their slots."""
    signed = dedup.signatures(spark, SF)
    assert signed.columns == ["id", "signature"]
    plan = d.pairs_by_lsh(signed)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, "a b"), (4, "ä b c d e")], "id long, text string")
    made = fp.fingerprint(texts, 0, max_words=None, slots=8).select("id", "signature", fp.minhash_of(8)("shingles").alias("want")).collect()
    assert all(r["signature"] == r["want"] for r in made) and sorted(len(r["want"]) for r in made) == [0, 0, 8, 8]
    none = spark.createDataFrame([(1, None), (2, [5]), (3, [])], "id long, s array<long>").select("id", fp.minhash("s").alias("m")).collect()
    assert {r["id"]: len(r["m"]) for r in none} == {1: 0, 2: 32, 3: 0}


def test_table_function_tells_first_windows(spark):
    """Distinct windows of a text are counted without moving them."""
    sqlnames.register(spark)
    spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "a b"), (3, None)], "id long, text string").createOrReplaceTempView("growth_texts")
    rows = spark.sql("SELECT id, s.shingle, s.first FROM growth_texts, LATERAL shingle(text) AS s")
    assert sorted(map(tuple, rows.collect())) == [(1, "a b c d e", False), (1, "a b c d e", True), (1, "b c d e a", True), (1, "c d e a b", True), (1, "d e a b c", True), (1, "e a b c d", True)]
    plan = QUERIES["table_functions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()


def test_a_large_group_is_read_without_rounds(spark):
    """Equal values are one row, and the number of jobs does not grow with a group."""
    rows = spark.range(60_000).select(F.lit("k").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(7)) * 1.5).alias("v"))
    marks = []
    for df in (rows.limit(600), rows):
        spark.sparkContext.setJobGroup(f"growth-{len(marks)}", "")
        got = selection.percentiles(df, ["k"], "v", (0.0, 0.31, 0.5, 1.0), "p", most=10).collect()
        marks.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"growth-{len(marks)}")))
        assert [tuple(r["p"]) for r in got] == [tuple(df.agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.31, 0.5, 1.0)))).alias("p")).first()["p"])]
    assert not hasattr(selection, "RANGES") and max(marks) < 40


def test_candidates_are_scored_once(spark):
    """Names are compared before acceptance reads the rows thrice; equal names are not sent."""
    plan = linkage.search_candidates(provider_rows(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan
    pairs = [("Ann Bee", "Ann Bee"), ("--", "--"), ("é", "é"), ("", ""), (None, None), (None, "a"), ("ab cd", "ab ce"), ("x" * 300, "x" * 299), ("A b", "a B")]
    got = spark.createDataFrame(pairs, "a string, b string").select(linkage.likeness(F.col("a"), F.col("b")).alias("x"), linkage.name_similarity("a", "b").alias("y")).collect()
    assert [r["x"] for r in got] == [r["y"] for r in got] and [r["x"] for r in got][:6] == [1.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def test_shingles_are_moved_once_to_be_counted(spark):
    """Representatives are told before shingles are made, and sets are compared by the shingles that two of them have."""
    made = dedup.first_sets(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert made.index("ArrowEvalPython") < made.index("Join LeftSemi")
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [2, 3, 4, 5]), (3, [4, 9, 10, 11]), (4, []), (5, None)], "id long, shingles array<long>")
    ranked = d.shared_shingles(sets, 0.5)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = {r["id"]: (r["n"], r["room"], [tuple(x) for x in r["shared"]]) for r in ranked.collect()}
    assert got == {1: (4, 2, [(2, 2), (2, 3), (3, 4)]), 2: (4, 2, [(2, 2), (2, 3), (3, 4)])}
    assert [tuple(r) for r in d.near_pairs(sets, 0.5).collect()] == [(1, 2, 0.6)]


def test_tokens_are_counted_in_their_row(spark, tmp_path):
    """No posting is moved before the index is written, and texts are read once for it."""
    books = spark.createDataFrame([(1, "Nuñez a_b a_b, A", ["x y", "x"]), (2, None, None), (3, "--", []), (4, "b " * 999, ["É"])], "id long, text string, tags array<string>")
    made = search.build_index(books, ["text", "tags"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("counted") == 2
    want = {("nunez", 1, "text", 1), ("a_b", 1, "text", 2), ("a", 1, "text", 1), ("x", 1, "tags", 2), ("y", 1, "tags", 1), ("b", 4, "text", 999), ("e", 4, "tags", 1)}
    assert sorted(map(tuple, made.collect())) == sorted(want)
    calls = spark.sparkContext.accumulator(0)
    seen = books.rdd.map(lambda r: (calls.add(1), r)[1]).toDF(books.schema)
    index = search.save_index(search.build_index(seen, ["text", "tags"]), f"file://{tmp_path}/index")
    assert calls.value == 4 and sorted(map(tuple, index.postings.collect())) == sorted(want)
    assert {r["id"]: r["len"] for r in index.lengths.collect()} == {1: 7, 4: 1000}


def test_title_pairs_with_evidence_are_told_by_arrays(spark):
    """Equal titles of an author in common: evidence is told for arrays of ids, no pair is moved, and known pairs are left out."""
    kinds = [(["A"], "en", None), (["A", "B"], "en", "x"), (["B", None], "de", "x"), ([None], "en", None), ([], "en", None)]
    docs = [(i * 7 % 1009, "one two" if i < 640 else ["", None, "other"][i % 3], *kinds[i % 5], i % 4 == 0) for i in range(700)]
    rows = stored(spark.createDataFrame(docs, "id long, title string, authors array<string>, language string, series string, fresh boolean").selectExpr("*", "cast(null as string) as isbn", "cast(null as int) as year", "series as publisher"), "rows")
    told = stored(spark.createDataFrame([(0, 7), (0, 14), (0, 35), (7, 1000)], "left long, right long"), "told")
    gone, by = set(map(tuple, told.collect())), {r["id"]: r for r in rows.collect()}

    def pairs(later):
        for a, x in by.items():
            for b, y in by.items():
                if x["title"] and x["title"] == y["title"] and {*x["authors"]} & {*y["authors"]} - {None} and x["language"] == y["language"] and later(x, y) and (a, b) not in gone:
                    yield a, b

    whole = d.title_author_runs(rows.drop("fresh"), told)
    got = [(r["left"], r["right"]) for r in d.run_pairs(whole).collect()]
    assert len(got) == len(set(got)) > 40_000 and set(got) == set(pairs(lambda x, y: x["id"] < y["id"]))
    assert whole.count() < len(got) / 20
    plan = d.run_pairs(whole)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan.split("explode(left#")[0] for x in ("Join", "Aggregate", "Repartition"))
    new = [(r["left"], r["right"]) for r in d.run_pairs(d.title_author_runs(rows, told)).collect()]
    assert len(new) == len(set(new)) and set(new) == set(pairs(lambda x, y: y["fresh"] and (not x["fresh"] or x["id"] < y["id"])))


def test_snapshots_are_reconciled_as_arrays(spark):
    """Runs give what their pairs give, against a join of pairs, and are moved as arrays."""
    rng = random.Random(2)
    found = [("metadata", ["a"], []), ("metadata", ["a", "b"], []), ("content", ["a"], None), ("metadata", ["a"], ["c"])]
    made = [{(left, right): rng.randrange(4) for left in range(9) for right in range(100, 160) if rng.random() < p} for p in (0.8, 0.6)]
    rows = [[(*k, *found[f]) for k, f in m.items()] for m in made]
    kind = "left long, right long, kind string, reasons array<string>, conflicts array<string>"
    now = stored(spark.createDataFrame(rows[0], kind), "now")
    then = stored(spark.createDataFrame([(*r, "keep_both" if r[1] % 2 else None) for r in rows[1]], kind + ", decision string"), "then")
    want = set()
    for k in made[0].keys() | made[1].keys():
        state = "inserted" if k not in made[1] else "deleted" if k not in made[0] else "kept" if made[0][k] == made[1][k] else "changed"
        decided = "keep_both" if k in made[1] and k[1] % 2 else None
        want.add((*k, state, decided if state == "kept" else None, "reset" if decided and state in ("deleted", "changed") else None))
    runs = lambda df, *by: df.groupBy("left", "kind", "reasons", "conflicts", *by).agg(F.collect_list("right").alias("rights"))
    for a, b in ((now, then), (runs(now), runs(then, "decision")), (runs(now), then)):
        got = list(map(tuple, d.reconcile(a, b).collect()))
        assert len(got) == len(want) and set(got) == want
    plan = d.reconcile(stored(runs(now), "now"), stored(runs(then, "decision"), "then"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan.split("RepartitionByExpression")[1]


class Lists(Calls):
    """A list state that counts its accesses."""

    def getListState(self, name, schema):
        self.held = []
        return self

    def exists(self):
        self.n += 1
        return bool(self.held)

    def get(self):
        self.n += 1
        return iter(self.held)

    def appendValue(self, value):
        self.n += 1
        self.held.append(value)


def test_a_batch_of_a_shard_is_one_access_of_its_state():
    """Many keys of one shard are read and written at once; a whole title gives out its ids, not their pairs."""
    rng = random.Random(4)
    rows = [(k // 100, rng.randrange(1000), rng.randrange(40), rng.random() < 0.5) for k in range(400)]
    rows = pd.DataFrame(sorted(set(rows)), columns=["batch", "id", "key", "asks"]).drop_duplicates(["batch", "id"]).assign(textual=lambda x: x["key"] % 2 == 0, whole=lambda x: x["key"] % 5 == 0)
    runs = [rows[rows["batch"] < 2].sample(frac=1, random_state=1), rows[rows["batch"] >= 2].sample(frac=1, random_state=1)]
    calls, index, got = Lists(), importer.Index(), []
    index.init(calls)
    for part in runs:
        calls.n = 0
        made = pd.concat([pd.DataFrame(columns=["left", "left_batch", "right", "batch", "textual", "fresh"]), *index.handleInputRows((0,), iter([part[:90], part[90:]]), None)])
        got.append(made)
        assert calls.n <= 3
    every, arrived = list(rows.itertuples()), lambda r: (r.batch, r.id)
    for made, fresh in zip(got, (lambda r: r.batch < 2, lambda r: r.batch >= 2), strict=True):
        there = [r for r in every if r.batch < 2 or fresh(r)]
        pairs = {(a.id, a.batch, b.id, b.batch, b.textual) for a in there for b in there if a.key == b.key and not a.whole and arrived(a) < arrived(b) and fresh(b) and (a.asks or b.asks) and a.id != b.id}
        alone = made["right"].isna()
        assert sorted(pairs) == sorted((r.left, r.left_batch, r.right, r.batch, r.textual) for r in made[~alone].itertuples())
        titles = {r.key for r in there if r.whole and fresh(r) and sum(x.key == r.key for x in there) > 1}
        assert sorted((r.id, r.batch, fresh(r)) for r in there if r.key in titles) == sorted((r.left, r.left_batch, r.fresh) for r in made[alone].itertuples())

    calls, first, seen = Lists(), importer.FirstSeen(), {}
    first.init(calls)
    files = pd.DataFrame([(k // 100, k * 7 % 401, f"f{rng.randrange(90)}") for k in range(400)], columns=["batch", "id", "sha256"])
    files["text_hash"] = "t" + (files["sha256"].str[1:].astype(int) % 30).astype(str)
    for part in (files[:200], files[200:]):
        calls.n = 0
        (out,) = first.handleInputRows((0,), iter([part.sample(frac=1, random_state=2)]), None)
        assert calls.n <= 3
        want = []
        for r in part.sort_values(["batch", "id"]).itertuples():
            want.append((r.id, r.batch, seen.get((r.text_hash, r.sha256)), seen.get(r.text_hash)))
            seen.setdefault(r.text_hash, r.id)
            seen.setdefault((r.text_hash, r.sha256), r.id)
        assert [tuple(None if pd.isna(x) else x for x in r) for r in out.itertuples(index=False)] == want
