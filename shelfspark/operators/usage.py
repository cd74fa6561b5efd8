"""Usage ledger, job progress, run statistics and ordered folds."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import selection
from shelfspark.shared import numbered, stored

FAILED = ("failed", "interrupted", "unknown")


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost by rates per million tokens; null unless both rates are above 0."""
    return F.when((rate_in > 0) & (rate_out > 0), (tokens_in * rate_in + tokens_out * rate_out) / 1e6)


def per_million(price: Column, currency: Column) -> Column:
    """A price per token (text, 0 to 1, dollars) as price per million tokens, six decimals; else null."""
    value = price.try_cast("double")
    return F.when((currency == "USD") & value.between(0, 1), F.bround(value * 1_000_000, 6))


def usage_by_feature(usage: DataFrame) -> DataFrame:
    unpriced = (F.col("input_rate").isNull() & (F.col("cost") == 0)) | F.col("status").isin(*FAILED)
    return usage.groupBy("feature").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost"), 6).alias("cost"), F.count_if(unpriced).alias("unpriced"),
    )


def period_cost(usage: DataFrame, period: str, now: str, include_reserved: bool = False, feature: str | None = None, book: str | None = None) -> DataFrame:
    """One row: cost since the start of now's day or month (UTC), or of 3650 days; with reservations if asked for; 0 without rows."""
    at = F.to_timestamp(F.lit(now))
    since = F.date_trunc(period, at) if period in ("day", "month") else at - F.expr("interval 3650 days")
    rows = usage.where((F.col("created_at") >= since) & (F.col("created_at") <= at))
    rows = rows if feature is None else rows.where(F.col("feature") == feature)
    rows = rows if book is None else rows.where(F.col("book_id") == book)
    value = F.col("cost") + F.coalesce("reserved", F.lit(0.0)) if include_reserved else F.col("cost")
    return rows.agg(F.round(F.coalesce(F.sum(value), F.lit(0.0)), 6).alias("cost"))


def budget_status(usage: DataFrame, now: str, day_limit: float, month_limit: float, percent: float = 80) -> DataFrame:
    """One row: day_cost, month_cost, reserved in the month, and whether a limit (0: none) is reached to so many per cent."""
    at = F.to_timestamp(F.lit(now))
    since = lambda unit, c: F.coalesce(F.sum(F.when((F.col("created_at") >= F.date_trunc(unit, at)) & (F.col("created_at") <= at), F.col(c))), F.lit(0.0))
    made = usage.agg(since("day", "cost").alias("day_cost"), since("month", "cost").alias("month_cost"), since("month", "reserved").alias("reserved"))
    warn = lambda c, limit: F.lit(bool(limit)) & (F.col(c) >= limit * percent / 100)
    return made.select(*[F.round(c, 6).alias(c) for c in ("day_cost", "month_cost", "reserved")], warn("day_cost", day_limit).alias("day_warning"), warn("month_cost", month_limit).alias("month_warning"))


def recent_usage(usage: DataFrame, n: int = 100, feature: str | None = None, book: str | None = None) -> DataFrame:
    """The newest n rows; a cost only of completed or invalid requests that had a rate or a cost."""
    rows = usage if feature is None else usage.where(F.col("feature") == feature)
    rows = rows if book is None else rows.where(F.col("book_id") == book)
    known = F.col("status").isin("completed", "invalid") & (F.col("input_rate").isNotNull() | (F.col("cost") > 0))
    return rows.withColumn("cost", F.when(known, F.col("cost"))).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """fold over the rows of each key in order: fold(state, part) -> (state, out), state None where a key begins.

    Rows of a key come to one task in order, a batch at a time; between batches only the state is kept. Null is a key like any other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            for found, part in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(x) else x for x in found)  # a null's stand-in is not equal to itself
                state, out = fold(state if key == last else None, part)
                last = key
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def admit_by_budget(requests: DataFrame, day_limit: float, month_limit: float, cost: str = "estimate", scope: str | None = None) -> DataFrame:
    """(id, admitted): in time order a request is admitted iff what its day and month hold plus itself keeps both limits; a rejected one holds nothing. scope: a column whose values have budgets of their own."""

    def fold(state: tuple | None, part: pd.DataFrame) -> tuple:
        month, day, spent = state or (0.0, None, 0.0)
        out = []
        for d, x in zip(part["day"], part[cost], strict=True):
            day, spent = (day, spent) if d == day else (d, 0.0)  # days come in order
            ok = spent + x <= day_limit and month + x <= month_limit
            if ok:
                spent, month = spent + x, month + x
            out.append(ok)
        return (month, day, spent), pd.DataFrame({"id": part["id"].to_numpy(), "admitted": out})

    own = F.lit("") if scope is None else F.col(scope)
    keyed = requests.select("id", "created_at", F.col(cost).alias(cost), own.alias("scope"), F.to_date("created_at").cast("string").alias("day"), F.date_format("created_at", "yyyy-MM").alias("month"))
    return ordered_fold(keyed, ["scope", "month"], ["created_at", "id"], fold, f"id {_type(requests, 'id')}, admitted boolean")


def spend(rows: DataFrame, key: str, order: list[str], cost: str, limit: str, stop: bool = False) -> DataFrame:
    """(key, order, admitted): in order a row is admitted iff the costs admitted before it plus its own keep the limit; stop: after a rejected one no other is."""

    def fold(state: tuple | None, part: pd.DataFrame) -> tuple:
        spent, paused = state or (0.0, False)
        out = []
        for x, most in zip(part[cost], part[limit], strict=True):
            ok = not paused and spent + x <= most
            spent, paused = spent + (x if ok else 0.0), stop and not ok
            out.append(ok)
        return (spent, paused), part[[key, *order]].assign(admitted=out)

    schema = ", ".join(f"{n} {_type(rows, n)}" for n in (key, *order)) + ", admitted boolean"
    return ordered_fold(rows.select(key, *order, cost, limit), [key], order, fold, schema)


def pack_batches(df: DataFrame, key: str, order: list[str], size: str, most_items: int, most_size: float, keep: list[str] | None = None) -> DataFrame:
    """df with batch: rows of a key in order fill a batch until it has most_items or the next would overflow most_size. A null size counts as 0."""
    names = [*dict.fromkeys([key, *order, size, *(keep or [])])]

    def fold(state: tuple | None, part: pd.DataFrame) -> tuple:
        batch, items, total = state or (0, 0, 0.0)
        out = []
        for x in part[size].fillna(0):
            if items and (items >= most_items or total + x > most_size):
                batch, items, total = batch + 1, 0, 0.0
            items, total = items + 1, total + x
            out.append(batch)
        return (batch, items, total), part[names].assign(batch=out)

    schema = ", ".join(f"{n} {_type(df, n)}" for n in names) + ", batch long"
    return ordered_fold(df.select(*names), [key], order, fold, schema)


def job_progress(items: DataFrame, job: str = "job") -> DataFrame:
    """For each job totals by state and its status: running, needs_review, failed (all failed) or finished."""
    s = F.col("status")
    done = s.isin("finished", "duplicate", "failed", "discarded")
    made = items.groupBy(job).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(s == "queued").alias("queued"), F.count_if(s == "active").alias("active"),
        F.count_if(s == "needs_review").alias("needs_review"), F.count_if(s == "failed").alias("__failed"),
    )
    status = F.when(F.col("queued") + F.col("active") > 0, "running").when(F.col("needs_review") > 0, "needs_review").when(F.col("__failed") == F.col("total"), "failed").otherwise("finished")
    return made.withColumn("status", status).drop("__failed")


def _by_group(base: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """base with found's columns; null keys meet."""
    other = found.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return base.join(other, on, "left").drop(*[f"__{k}" for k in keys])


def run_metrics(runs: DataFrame, keys: list[str], value: str, valid: str | None = None, also: tuple[str, ...] = (), most: int = selection.MOST) -> DataFrame:
    """For each group valid and invalid runs, and of the valid ones median, least, most, mean, sample deviation and its percentage of the mean; median and most of each further measure.

    Groups of more than `most` runs have their medians by selection.
    """
    ok = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    v, names = F.when(ok, F.col(value)), {value: "median"} | {n: f"{n}_median" for n in also}
    big = selection.large(runs, keys, most)
    medians = {} if big else {out: F.percentile(F.when(ok, F.col(n)), F.lit(0.5)).alias(out) for n, out in names.items()}
    made = runs.groupBy(*keys).agg(
        F.count(v).alias("runs"), F.count_if(~ok | F.col(value).isNull()).alias("invalid"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("stddev"), F.try_divide(100 * F.stddev_samp(v), F.avg(v)).alias("cv"), *[F.max(F.when(ok, F.col(n))).alias(f"{n}_most") for n in also], *medians.values(),
    )
    for n, out in names.items() if big else ():
        made = _by_group(made, selection.percentiles(runs.where(ok), keys, n, (0.5,), out, most).withColumn(out, F.get(out, F.lit(0))), keys)
    more = [x for n in also for x in (f"{n}_median", f"{n}_most")]
    return made.select(*keys, "runs", "invalid", "median", "least", "most", "mean", "stddev", "cv", *more)


def latency_percentiles(requests: DataFrame, enough: int = 200, most: int = selection.MOST) -> DataFrame:
    """For each endpoint of requests (endpoint, outcome, actual, scheduled): planned, success, errors, skipped, p50 and p95 of both times of successes, and whether those are few.

    Endpoints of more than `most` requests have their percentiles by selection.
    """
    good, points = F.col("outcome") == "success", (0.5, 0.95)
    big = selection.large(requests, ["endpoint"], most)
    direct = [] if big else [F.percentile(F.when(good, F.col(c)), F.array(*map(F.lit, points))).alias(c) for c in ("actual", "scheduled")]
    made = requests.groupBy("endpoint").agg(
        F.count("*").alias("planned"), F.count_if(good).alias("success"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), *direct
    )
    for c in ("actual", "scheduled") if big else ():
        made = _by_group(made, selection.percentiles(requests.where(good), ["endpoint"], c, points, c, most), ["endpoint"])
    return made.select("endpoint", "planned", "success", "errors", "skipped", *[F.get(c, F.lit(i)).alias(f"p{q}_{c}") for c in ("actual", "scheduled") for i, q in enumerate((50, 95))], (F.col("success") < enough).alias("weak"))


def phase_totals(spans: DataFrame, most: int = selection.MOST) -> DataFrame:
    """For each phase of spans (phase, ms, counters): calls, median and total milliseconds. Phases of more than `most` calls have their median by selection."""
    big = selection.large(spans, ["phase"], most)
    made = spans.groupBy("phase").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), *([] if big else [F.percentile("ms", F.lit(0.5)).alias("median_ms")]))
    if big:
        made = _by_group(made, selection.percentiles(spans, ["phase"], "ms", (0.5,), "median_ms", most).withColumn("median_ms", F.get("median_ms", F.lit(0))), ["phase"])
    return made.select("phase", "calls", "median_ms", "total_ms")


def counter_totals(spans: DataFrame) -> DataFrame:
    """(counter, total) over the maps of all spans."""
    return spans.select(F.explode("counters").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("total"))


def outcome_counts(results: DataFrame, col: str, known: tuple[str, ...]) -> DataFrame:
    """(value, count) of each known category, 0 for those that do not occur, and of any other."""
    all_ = results.sparkSession.createDataFrame([(k,) for k in known], "value string")
    counts = results.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return all_.join(counts, "value", "full_outer").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def paired_savings(pairs: DataFrame, replicates: int = 1000, cv: tuple[float, float] | None = None) -> DataFrame:
    """One row of pairs (a, b): median saving 100 (1 - b / a), its 95 % bootstrap interval, and whether b is reliably faster.

    A replicate draws as many pairs as there are, by hash of its number and the draw's; draws are counted where they are made. Reliable: both
    variation coefficients at most 5, a median of 5 or more and a lower end above 0.
    """
    saving = pairs.where("a > 0 and b is not null").select((100 * (1 - F.col("b") / F.col("a"))).alias("x"))
    placed = stored(numbered(saving, ["x"], "place"), "placed")
    n = placed.count()
    medians = selection.bootstrap_medians(placed, "x", "place", n, replicates) if n else placed.select(F.col("place").alias("r"), F.col("x").alias("m"))
    ends = medians.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))  # a row a replicate
    middle = placed.where(F.col("place").isin((n - 1) // 2 + 1, n // 2 + 1)).agg(F.avg("x").alias("median_saving"))
    made = middle.crossJoin(ends).select(F.lit(n).cast("long").alias("pairs"), "median_saving", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))  # one row each
    steady = True if cv is None else max(cv) <= 5
    return made.withColumn("reliable", F.lit(steady) & (F.col("median_saving") >= 5) & (F.col("low") > 0))


def usage_lifecycle(events: DataFrame) -> DataFrame:
    """The last state of each request: reservations end with any exit, unknown usage costs 0, open ones are interrupted."""
    last = events.groupBy("request").agg(F.max_by(F.struct("status", "cost", "reserved"), F.struct("ts", "seq")).alias("l"))
    status = F.when(F.col("l.status") == "reserved", "interrupted").otherwise(F.col("l.status"))
    return last.select("request", status.alias("status"), F.when(status.isin("completed", "invalid"), F.col("l.cost")).otherwise(0.0).alias("cost"), F.lit(0.0).alias("reserved"))


def provenance_log(snapshots: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same keys (null-safe); the first always counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return snapshots.withColumn("__changed", changed).where("__changed").drop("__changed")


#: Keys whose values no log may show; token counts (tokens, input_tokens) may.
SECRET = re.compile(r"(?i)^(authorization|cookie|set_cookie|.*secret.*|.*password.*|.*api_?key.*|.*credential.*|token|.*_token|auth|x_auth)$")
HIDDEN = "[REDACTED]"


def redact_url(url: str) -> str:
    """A URL with the values of secret parameters hidden."""
    return re.sub(r"([?&])([^=&#]+)=([^&#]*)", lambda m: f"{m[1]}{m[2]}={HIDDEN if SECRET.match(m[2].replace('-', '_')) else m[3]}", url)


def redact_json(text: str | None) -> str | None:
    """A JSON document with the values of secret keys hidden at any depth, and in URLs; other texts are read as URLs."""

    def walk(x: object) -> object:
        if isinstance(x, dict):
            return {k: HIDDEN if SECRET.match(k.replace("-", "_")) else walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return redact_url(x) if isinstance(x, str) else x

    if text is None:
        return None
    try:
        return json.dumps(walk(json.loads(text)), ensure_ascii=False)
    except ValueError:
        return redact_url(text)


@F.pandas_udf(T.StringType())
def redacted(c: pd.Series) -> pd.Series:
    return c.map(redact_json)
