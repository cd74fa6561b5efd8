"""Centroids, benchmark windows and ranked search against brute force and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from shelfspark.llm import clusters, decontaminate, search

# 11 centroids


def plain_clusters(rows, k=8, rounds=10):
    """rows: (id, 64 integers); Lloyd's rounds with Python's integers."""
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))[:k]
    cents = [list(rows[i][1]) for i in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in rows:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return cents, [near(v) for _, v in rows]


def test_transform_is_in_order_of_sign_changes_and_exact():
    h = clusters.hadamard(np.eye(64, dtype=np.int64))
    assert (np.abs(h) == 1).all() and (h @ h.T == 64 * np.eye(64)).all()
    assert [(np.diff(h[:, i]) != 0).sum() for i in range(64)] == list(range(64))
    rng = np.random.default_rng(1)
    v, c = rng.integers(-9000, 9000, (200, 64)), rng.integers(-9000, 9000, (7, 64))
    c[5] = c[2]  # ties go to the smaller number
    which, far, compared = clusters.nearest(clusters.hadamard(v), clusters.hadamard(c))
    want = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (which == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def test_far_centroids_are_dropped_before_all_coefficients():
    rng = np.random.default_rng(2)
    c = rng.integers(-500, 500, (8, 1)) * 40 + rng.integers(-9, 9, (8, 64))
    v = c[rng.integers(0, 8, 300)] + rng.integers(-5, 5, (300, 64))
    assert clusters.nearest(clusters.hadamard(v), clusters.hadamard(c))[2] < 300 * 8 * 64 / 3


def test_clusters_against_plain_rounds_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(90)]
    rows += [(90, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (91, [0.0] * 64), (92, [131071.9] * 64), (93, [-131071.5] * 63 + [1e-30])]
    bad = [(100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]), (105, [1.0] * 63 + [float("-inf")]), (106, []), (107, [131072.0] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string")
    got = clusters.cluster_vectors(df.repartition(5)).toPandas()
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    cents, near = plain_clusters(whole)
    assert collections.Counter(zip(got.vec_id, got.cluster, got.distance, strict=True)) == collections.Counter((i, j, d) for (i, _), (d, j) in zip(whole, near, strict=True))
    assert {r.cluster: list(r.centroid) for r in got.itertuples()} == {j: cents[j] for _, j in near}
    assert set(got.inertia) == {sum(d for d, _ in near)}
    assert all(set(g.cluster_inertia) == {sum(d for d, j in near if j == c)} for c, g in got.groupby("cluster"))


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (None, [0.25] * 64), (1, [0.5] * 64)], "vec_id long, embedding array<float>")
    got = clusters.cluster_vectors(df).toPandas()
    assert sorted(got.distance) == [0, 0, 0] and got.cluster.nunique() == 2
    assert clusters.cluster_vectors(df.limit(0)).count() == 0


# 12 benchmark windows


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_hits(docs, items, window=10):
    wins = collections.defaultdict(set)
    for item, text in items:
        ws = plain_words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            wins[tuple(ws[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in wins[w] if x is not None}
        spans = [(i, next(j for j in range(i, len(ws) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc, len(ws), len(hit), tuple(spans), tuple(sorted(found))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r["n_words"], r["n_hit"], tuple(map(tuple, r["spans"])), tuple(r["items"])) for r in df.collect()), key=repr)


DOCS = "doc_id long, text string, n_hit string"
ITEMS = "item_id long, text string, window string"


@pytest.fixture(scope="module")
def windows():
    rng = random.Random(7)
    vocab = ["the", "of", "a", "Ünder", "naïve", "日本", "x1", *(f"w{i}" for i in range(40))]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]) if i % 6 else 12)) for i in range(4, 30)]
    items += [(1, None), (2, ""), (3, "?! --"), (30, items[0][1]), (4, "zz yy"), (None, "only here by itself"), (31, "again again again again"), (100, "x"), (100, "x")]
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(60)]
    docs += [(100 + j, f"{text(9)} {t.upper() if j % 2 else t}, {text(3)}... {t}") for j, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "zz. YY"), (202, "zz. YY"), (202, "other"), (None, "zz yy"), (203, "again " * 3000 + "end"), (204, "\x00a\x00zz\nyy"), (205, f"{items[2][1]} " * 40)]
    return docs, items


@pytest.mark.parametrize("sent", [decontaminate.SENT_BYTES, 0])
def test_windows_against_brute_force(spark, windows, sent):
    docs, items = windows
    d, i = spark.createDataFrame([(*r, "clash") for r in docs], DOCS).repartition(3), spark.createDataFrame([(*r, "clash") for r in items], ITEMS)
    got = found(decontaminate.contamination(d, i, sent_bytes=sent))
    assert got == plain_hits(docs, items)
    assert sum(r[2] > 0 for r in got) > 40


def test_windows_of_empty_tables(spark, windows):
    d, i = spark.createDataFrame([(*r, "c") for r in windows[0]], DOCS), spark.createDataFrame([(*r, "c") for r in windows[1]], ITEMS)
    assert decontaminate.contamination(d.limit(0), i).count() == 0
    none = decontaminate.contamination(d, i.limit(0)).collect()
    assert len(none) == len(windows[0]) and not any(r["n_hit"] or r["items"] for r in none)
    assert decontaminate.contamination(d, i.where("item_id = 1")).count() == len(windows[0])


# 13 ranked search


def plain_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, c) for d, t in docs if (c := collections.Counter(terms(t)))]
    n, length = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scores = collections.Counter(terms(text)), []
        for d, c in held:
            m = 25 + 75 * c.total() * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = [f"{w}{i}" for i in range(60) for w in ("t", "Ü")]
    text = lambda n: " ".join(vocab[min(119, int(rng.expovariate(0.05)))] for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 20, 20, 80]))) for i in range(300)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(40)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1]), (2000, None), (2001, ""), (2002, "!!"), (2003, "T1 " * 20000)]
    items = [(i, text(rng.choice([1, 2, 8, 40]))) for i in range(30)]
    items += [(1, items[0][1]), (1, items[1][1]), (None, docs[5][1]), (50, None), (51, " "), (52, "nowhere"), (53, "t1 T1 t1"), (53, "t1 T1 t1")]
    return docs, items


@pytest.mark.parametrize(("postings", "block"), [(search.SEGMENT_POSTINGS, search.BLOCK_TERMS), (400, 50)])
def test_search_against_brute_force(spark, texts, postings, block):
    docs, items = texts
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, score string").repartition(4)
    i = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, rank string")
    index = search.build_index(d, segment_postings=postings)
    got = sorted((tuple(r) for r in search.search(index, i, block_terms=block).collect()), key=repr)
    assert got == plain_search(docs, items)
    assert index.count() == 1 if postings > 400 else index.count() > 5


def test_strata_below_the_bound_are_not_visited():
    """Long documents that hold a term once cannot reach short ones."""
    import pyarrow as pa

    m = np.repeat(np.arange(25, 1025, 10), 4)
    rows = pa.table({"segment": pa.array([0] * 400), "m": pa.array(m), "doc": pa.array(range(400)), "terms": pa.array([["a"]] * 400), "tfs": pa.array([[1]] * 400, pa.list_(pa.int32()))})
    seg = search._Segment(search._segment(rows), pa.array(["a"]))
    places, scores, seen = seg.search(np.array([0]), np.array([100]), 10)
    assert seg.doc[places].tolist() == list(range(10)) and seen == search.FIRST_WAVE
    assert scores.tolist() == [100 * (10**9 // (1000 + 8 * int(x))) for x in m[:10]]


def test_search_of_empty_tables(spark, texts):
    d, i = spark.createDataFrame(texts[0], "doc_id long, text string"), spark.createDataFrame(texts[1], "item_id long, text string")
    assert search.search(search.build_index(d.limit(0)), i).count() == 0
    assert search.search(search.build_index(d), i.limit(0)).count() == 0
