"""Percentiles of large groups and bootstrap medians against plain ones."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import fingerprint as fp
from shelfspark.operators import selection
from shelfspark.operators import usage as u


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(3)
    rows = [("ties", float(rng.choice([1, 1, 1, 1, 2, 9]))) for _ in range(900)] + [("same", 5.0)] * 700 + [("small", 3.5), ("small", 1.5), (None, None), ("none", None), ("nan", float("nan"))]
    rows += [(None, 10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1])) for _ in range(1001)] + [("even", rng.gauss(0, 1)) for _ in range(2000)]
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


def test_percentiles_of_large_groups(spark, groups):
    points = (0.0, 0.025, 0.5, 0.731, 0.95, 1.0)
    want = {r["k"]: r["p"] for r in groups.where("not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("p")).where("k is null or k <> 'none'").collect()}
    for most in (10, 500, selection.MOST):
        got = {r["k"]: r["p"] for r in selection.percentiles(groups, ["k"], "v", points, "p", most).collect()}
        assert got == want, most
    assert selection.percentiles(groups.limit(0), ["k"], "v", points, "p").count() == 0


def test_operators_with_large_groups_as_with_small_ones(spark, groups):
    runs = groups.where("not isnan(v)").select("k", "v", (F.col("v") * 2).alias("w"), (F.col("v") != 9).alias("ok"))
    plain = sorted(map(repr, u.run_metrics(runs, ["k"], "v", "ok", ("w",)).drop("mean", "stddev", "cv").collect()))
    assert sorted(map(repr, u.run_metrics(runs, ["k"], "v", "ok", ("w",), most=50).drop("mean", "stddev", "cv").collect())) == plain
    asks = groups.where("not isnan(v)").select(F.col("k").alias("endpoint"), F.lit("success").alias("outcome"), F.col("v").alias("actual"), (-F.col("v")).alias("scheduled"))
    assert sorted(map(repr, u.latency_percentiles(asks, most=50).collect())) == sorted(map(repr, u.latency_percentiles(asks).collect()))


@pytest.mark.parametrize("n", [1, 2, 37, 300])
def test_bootstrap_medians_are_those_of_the_draws(spark, n):
    xs = sorted(random.Random(n).gauss(0, 1) for _ in range(n))
    placed = spark.createDataFrame([(i + 1, x) for i, x in enumerate(xs)], "place long, x double")
    got = {r["r"]: r["m"] for r in selection.bootstrap_medians(placed, "x", "place", n, 20, ranges=4).collect()}
    for r in range(20):
        drawn = [xs[int(hashlib.md5(f"{r}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(1, n + 1)]
        assert got[r] == pytest.approx(statistics.median(drawn), abs=1e-12)


def test_signatures_by_parts(spark):
    """Slot minima of parts give the signature of the whole; a group without values has none."""
    rng = random.Random(1)
    sets = {1: [rng.getrandbits(64) - (1 << 63) for _ in range(5000)], 2: [7], None: [1, 2]}
    rows = [(k, v) for k, vs in sets.items() for v in vs] + [(3, None), (2, 7)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(8)
    got = {r["k"]: r["signature"] for r in fp.signatures_by(df, "k", "v").collect()}
    import numpy as np

    assert got == {k: fp.signature_of(np.array(vs, np.int64).view(np.uint64)).view(np.int64).tolist() for k, vs in sets.items()}
