"""Usage, jobs, statistics, conversations as segments, pages as markup. Events stand for the usage ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.operators import language
from shelfspark.operators import linkage as k
from shelfspark.operators import selection
from shelfspark.operators import usage as u
from shelfspark.plans.registry import query
from shelfspark.shared import spread, stored
from shelfspark.sources.tables import read_table

NOW = "2024-01-20 12:00:00"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature: event type; tokens: the number in props; cost: value / 1000; status by id."""
    events = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_id") % 10 == 0, "failed").when(F.col("event_id") % 10 == 1, "interrupted").otherwise("completed")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("feature"), F.col("user_id").alias("book_id"), k.alias("input_tokens"), (k * 2).alias("output_tokens"),
        F.coalesce(F.col("value") / 1000, F.lit(0.0)).alias("cost"), F.when(F.col("event_id") % 10 == 1, 0.5).otherwise(0.0).alias("reserved"), F.lit(1.0).alias("input_rate"), status.alias("status"),
    )


K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"""SELECT event_type AS feature, count(*) AS requests, sum({K}) AS input_tokens, sum(2 * {K}) AS output_tokens, round(sum(coalesce(value / 1000, 0)), 6) AS cost,
  count(*) FILTER (event_id % 10 IN (0, 1)) AS unpriced FROM events GROUP BY event_type""")
def usage_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.usage_by_feature(ledger(spark, sf_dir))


@query(f"""WITH e AS (SELECT ts, coalesce(value / 1000, 0) AS cost, CASE WHEN event_id % 10 = 1 THEN 0.5 ELSE 0 END AS reserved FROM events WHERE ts <= TIMESTAMP '{NOW}')
SELECT round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-20'), 0), 6) AS day_cost, round(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-01'), 6) AS month_cost, round(sum(reserved) FILTER (ts >= TIMESTAMP '2024-01-01'), 6) AS reserved,
  FALSE AS day_warning, round(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-01'), 6) >= 10 * 0.8 AS month_warning FROM e""")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.budget_status(ledger(spark, sf_dir), NOW, 0, 10)


@query(f"""WITH e AS (SELECT ts, event_type, user_id, coalesce(value / 1000, 0) AS cost, CASE WHEN event_id % 10 = 1 THEN 0.5 ELSE 0 END AS reserved FROM events WHERE ts <= TIMESTAMP '{NOW}')
SELECT 'day' AS period, round(coalesce(sum(cost + reserved) FILTER (ts >= TIMESTAMP '2024-01-20'), 0), 6) AS cost FROM e UNION ALL SELECT 'month', round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-01' AND event_type = 'click'), 0), 6) FROM e UNION ALL SELECT 'all', round(sum(cost), 6) FROM e""")
def period_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day with reservations, the month of one feature, and all."""
    rows = ledger(spark, sf_dir)
    day, month, all_ = u.period_cost(rows, "day", NOW, include_reserved=True), u.period_cost(rows, "month", NOW, feature="click"), u.period_cost(rows, "all", NOW)
    return day.select(F.lit("day").alias("period"), "cost").union(month.select(F.lit("month"), "cost")).union(all_.select(F.lit("all"), "cost"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS u, CAST(ts AS DATE) AS d, strftime(ts, '%Y-%m') AS m, coalesce(value / 1000, 0) AS x, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT id, u, d, m, n, x <= 0.05 AND x <= 0.2 AS ok, CASE WHEN x <= 0.05 THEN x ELSE 0.0 END AS day, CASE WHEN x <= 0.05 THEN x ELSE 0.0 END AS month FROM e WHERE n = 1
 UNION ALL SELECT e.id, e.u, e.d, e.m, e.n, (CASE WHEN e.d = f.d THEN f.day ELSE 0.0 END) + e.x <= 0.05 AND f.month + e.x <= 0.2,
  (CASE WHEN e.d = f.d THEN f.day ELSE 0.0 END) + CASE WHEN (CASE WHEN e.d = f.d THEN f.day ELSE 0.0 END) + e.x <= 0.05 AND f.month + e.x <= 0.2 THEN e.x ELSE 0.0 END,
  f.month + CASE WHEN (CASE WHEN e.d = f.d THEN f.day ELSE 0.0 END) + e.x <= 0.05 AND f.month + e.x <= 0.2 THEN e.x ELSE 0.0 END FROM f JOIN e ON e.u = f.u AND e.m = f.m AND e.n = f.n + 1)
SELECT id, ok AS admitted FROM f""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's requests under budgets of its own for a day and a month."""
    rows = ledger(spark, sf_dir).withColumn("estimate", F.col("cost"))
    return u.admit_by_budget(rows, 0.05, 0.2, scope="book_id")


@query(f"""SELECT event_id AS id, event_type AS feature, ts AS created_at, CASE WHEN event_id % 10 NOT IN (0, 1) THEN coalesce(value / 1000, 0) END AS cost FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.recent_usage(ledger(spark, sf_dir), 100, feature="click").select("id", "feature", "created_at", "cost")


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN (k * (event_id % 3) + 2 * k * 4) / 1e6 END AS cost FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by rates; a third of the models has no price for input."""
    rows = ledger(spark, sf_dir)
    return rows.select("id", u.token_cost(F.col("input_tokens"), F.col("output_tokens"), (F.col("id") % 3).cast("double"), F.lit(4.0)).alias("cost"))


LIFE = "CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'reserved' ELSE 'completed' END"


@query(f"""
WITH e AS (SELECT user_id AS request, ts, event_id, {LIFE} AS status, coalesce(value / 1000, 0) AS cost FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY request ORDER BY ts DESC, event_id DESC) = 1)
SELECT request, CASE WHEN status = 'reserved' THEN 'interrupted' ELSE status END AS status, CASE WHEN status = 'completed' THEN cost ELSE 0 END AS cost, 0.0 AS reserved FROM l""")
def usage_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as requests, their events as ledger changes; the first event type reserves, others complete."""
    events = read_table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("first"))
    rows = events.crossJoin(F.broadcast(first))  # one row
    changes = rows.select(F.col("user_id").alias("request"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == F.col("first"), "reserved").otherwise("completed").alias("status"), F.coalesce(F.col("value") / 1000, F.lit(0.0)).alias("cost"), F.lit(0.0).alias("reserved"))
    return u.usage_lifecycle(changes)


@query("""
WITH i AS (SELECT user_id AS job, CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'active' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'failed' ELSE 'finished' END AS s FROM events),
c AS (SELECT job, count(*) AS total, count(*) FILTER (s IN ('finished', 'failed')) AS completed, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'needs_review') AS needs_review, count(*) FILTER (s = 'failed') AS f FROM i GROUP BY job)
SELECT job, total, completed, queued, active, needs_review, CASE WHEN queued + active > 0 THEN 'running' WHEN needs_review > 0 THEN 'needs_review' WHEN f = total THEN 'failed' ELSE 'finished' END AS status FROM c""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, ("queued", "active", "needs_review", "failed", "finished", "finished")))
    items = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.get(states, (F.col("event_id") % 6).cast("int")).alias("status"))
    return u.job_progress(items)


@query("""WITH l AS (SELECT l_returnflag AS variant, l_extendedprice AS v, l_quantity AS q, l_linenumber <> 7 AS ok FROM lineitem)
SELECT variant, count(*) FILTER (ok) AS runs, count(*) FILTER (NOT ok) AS invalid, round(median(v) FILTER (ok), 4) AS median, min(v) FILTER (ok) AS least, max(v) FILTER (ok) AS most, round(avg(v) FILTER (ok), 4) AS mean,
  round(stddev_samp(v) FILTER (ok), 4) AS stddev, round(100 * stddev_samp(v) FILTER (ok) / avg(v) FILTER (ok), 4) AS cv, median(q) FILTER (ok) AS memory_median, max(q) FILTER (ok) AS memory_most FROM l GROUP BY variant""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), "l_extendedprice", F.col("l_quantity").alias("memory"), (F.col("l_linenumber") != 7).alias("ok"))
    made = u.run_metrics(runs, ["variant"], "l_extendedprice", "ok", ("memory",))
    return made.select("variant", "runs", "invalid", "least", "most", *[F.round(c, 4).alias(c) for c in ("median", "mean", "stddev", "cv")], "memory_median", "memory_most")


@query("""WITH r AS (SELECT event_type AS endpoint, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'skipped' ELSE 'success' END AS o, coalesce(value, 0) AS a, coalesce(value, 0) + event_id % 5 AS s FROM events)
SELECT endpoint, count(*) AS planned, count(*) FILTER (o = 'success') AS success, count(*) FILTER (o = 'error') AS errors, count(*) FILTER (o = 'skipped') AS skipped,
  round(quantile_cont(a, 0.5) FILTER (o = 'success'), 6) AS p50_actual, round(quantile_cont(a, 0.95) FILTER (o = 'success'), 6) AS p95_actual, round(quantile_cont(s, 0.5) FILTER (o = 'success'), 6) AS p50_scheduled, round(quantile_cont(s, 0.95) FILTER (o = 'success'), 6) AS p95_scheduled,
  count(*) FILTER (o = 'success') < 200 AS weak FROM r GROUP BY endpoint""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    outcome = F.when(e % 11 == 0, "error").when(e % 13 == 0, "skipped").otherwise("success")
    made = u.latency_percentiles(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), outcome.alias("outcome"), value.alias("actual"), (value + e % 5).alias("scheduled")))
    return made.select(*[F.round(c, 6).alias(c) if c.startswith("p5") or c.startswith("p9") else F.col(c) for c in made.columns])


@query("""WITH RECURSIVE p AS (SELECT user_id, sum(value) FILTER (event_id % 2 = 0) AS a, sum(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id),
x AS (SELECT 100 * (1 - b / a) AS x, row_number() OVER (ORDER BY 100 * (1 - b / a)) AS place, count(*) OVER () AS n FROM p WHERE a > 0 AND b IS NOT NULL),
m AS (SELECT r, median(x.x) AS m FROM (SELECT r, CAST('0x' || substr(md5(r || ':' || i), 1, 8) AS BIGINT) % (SELECT max(n) FROM x) + 1 AS place FROM range(200) a(r), range(1, (SELECT max(n) FROM x) + 1) b(i)) d JOIN x USING (place) GROUP BY r)
SELECT (SELECT max(n) FROM x) AS pairs, round((SELECT median(x) FROM x), 6) AS median_saving, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT median(x) FROM x) >= 5 AND quantile_cont(m, 0.025) > 0 AS reliable FROM m""")
def paired_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sums of even and odd events as pairs of runs; 200 replicates."""
    odd = F.col("event_id") % 2 == 1
    pairs = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(~odd, F.col("value"))).alias("a"), F.sum(F.when(odd, F.col("value"))).alias("b"))
    made = u.paired_savings(pairs, 200)
    return made.select("pairs", *[F.round(c, 6).alias(c) for c in ("median_saving", "low", "high")], "reliable")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.coalesce("value", F.lit(0.0)).alias("ms"), F.create_map(F.lit("rows"), k, F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")), F.lit(1).cast("long")).alias("counters"))


@query("""SELECT event_type AS phase, count(*) AS calls, round(median(coalesce(value, 0)), 6) AS median_ms, round(sum(coalesce(value, 0)), 4) AS total_ms FROM events GROUP BY event_type""")
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.phase_totals(spans(spark, sf_dir)).select("phase", "calls", F.round("median_ms", 6).alias("median_ms"), F.round("total_ms", 4).alias("total_ms"))


@query("""SELECT 'rows' AS counter, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events UNION ALL SELECT 'user' || user_id % 3, count(*) FROM events GROUP BY 1""")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.counter_totals(spans(spark, sf_dir))


@query("""SELECT k AS value, (SELECT count(*) FROM orders WHERE o_orderstatus = k) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS k)""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.outcome_counts(read_table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P", "X"))


@query(f"""WITH a AS (SELECT user_id AS k, event_id % 3 AS provider, date_trunc('day', ts) AS d, coalesce(value, 0) < 20 AS failed, CASE WHEN coalesce(value, 0) > 60 THEN [event_id] ELSE [] END AS c FROM events),
l AS (SELECT k, d, flatten(list(CASE WHEN failed THEN [] ELSE c END ORDER BY provider, c)) AS c, bool_or(failed) AS outage FROM a GROUP BY k, d),
s AS (SELECT * FROM l WHERE len(c) > 0 OR NOT outage QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) = 1),
q AS (SELECT DISTINCT user_id AS k FROM events)
SELECT q.k AS user_id, c IS NOT NULL AS hit, array_to_string(c, ',') AS candidates FROM q LEFT JOIN (SELECT * FROM s WHERE d + CASE WHEN len(c) > 0 THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END > TIMESTAMP '{NOW}') s ON s.k = q.k""")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of three providers to users' lookups, some of them failures: what a cache holds at a fixed time, kept in two steps."""
    events, none = read_table(spark, sf_dir, "events"), F.lit(None).cast("string")
    value, key = F.coalesce("value", F.lit(0.0)), F.concat(F.lit("Üser  "), F.col("user_id").cast("string"))
    asked = lambda df: k.lookup_key(df.select("*", key.alias("title"), none.alias("author"), F.lit("de-DE").alias("language"), F.lit(1999).alias("year"), none.alias("publisher")))
    found = F.when(value > 60, F.array("event_id")).otherwise(F.array().cast("array<bigint>"))
    answers = asked(events).select("key", (F.col("event_id") % 3).alias("provider"), (value < 20).alias("failed"), found.alias("candidates"), F.date_trunc("day", "ts").cast("timestamp").alias("at"))
    cache, now = spark.createDataFrame([], "key string, candidates array<bigint>, expires_at timestamp"), F.to_timestamp(F.lit(NOW))
    half = F.to_timestamp(F.lit("2024-01-15"))
    cache = stored(k.store_lookups(cache, answers.where(F.col("at") < half), half), "cache")
    cache = stored(k.store_lookups(cache, answers.where(F.col("at") >= half), now), "cache")
    users = events.select("user_id").distinct().withColumn("title", F.upper(key))
    queries = k.lookup_key(users.select("user_id", "title", none.alias("author"), F.lit("de").alias("language"), F.lit(1999).alias("year"), none.alias("publisher")))
    return k.cached(queries, cache, now).select("user_id", F.col("candidates").isNotNull().alias("hit"), F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query(r"""SELECT event_id, '{"call": {"api_key": "[REDACTED]", "tokens": ' || json_extract(props, '$.k') || ', "headers": [{"X-Auth": "[REDACTED]"}]}, "url": "https://h/p?token=[REDACTED]&q=' || user_id || '"}' AS log FROM events""")
def redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request logs made of events, with secrets at several depths and in an address."""
    k = F.get_json_object("props", "$.k")
    log = F.concat(F.lit('{"call": {"api_key": "k'), k, F.lit('", "tokens": '), k, F.lit(', "headers": [{"X-Auth": "y"}]}, "url": "https://h/p?token=abc&q='), F.col("user_id").cast("string"), F.lit('"}'))
    return read_table(spark, sf_dir, "events").select("event_id", u.redacted(log).alias("log"))


@query("""
WITH g AS (SELECT lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM (SELECT lang, lower(text) AS t FROM documents) WHERE length(t) >= 3),
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY lang, gram)
SELECT lang, gram, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 100""")
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent character triples of each language's texts."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counts = language.triple_counts(spread(read_table(spark, sf_dir, "documents").select("lang", "text")))
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 100").drop("r")


@query("""SELECT l_returnflag AS variant, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.975), 6) AS high,
  quantile_cont(l_quantity, 0.95) AS quantity FROM lineitem GROUP BY l_returnflag""")
def large_group_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of line prices by return flag, groups of more than 500 rows by selection."""
    lines = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "variant")
    prices = selection.percentiles(lines, ["variant"], "l_extendedprice", (0.025, 0.5, 0.975), "p", most=500)
    amounts = selection.percentiles(lines, ["variant"], "l_quantity", (0.95,), "q", most=500)
    return prices.join(amounts, "variant").select("variant", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("low", "median", "high"))], F.get("q", F.lit(0)).alias("quantity"))
