"""Streaming queries: a table is read as a stream of files, run to its end, and the sink is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.plans import dedup
from shelfspark.plans.registry import query
from shelfspark.shared import new_folder
from shelfspark.sources.tables import read_table
from shelfspark.streaming import importer, reviews
from shelfspark.streaming import streams as s


def work_dir(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    return new_folder(spark, "stream")


@query("""
WITH h AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha256, CASE WHEN text IS NULL OR trim(text) = '' THEN 'failed' WHEN length(text) < 40 THEN 'needs_review' ELSE 'archived' END AS status FROM documents)
SELECT id AS doc_id, CASE WHEN id <> min(id) OVER (PARTITION BY sha256) THEN 'duplicate' ELSE status END AS status FROM h""")
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    stream = s.read_stream(spark, sf_dir, "documents", docs.schema).select(F.col("doc_id").alias("id"), "text")
    folder = work_dir(spark)
    imported = s.run_available(s.import_status(stream), f"{folder}/items", f"{folder}/state")
    return s.mark_duplicates(imported).select(F.col("id").alias("doc_id"), "status")


@query("""SELECT date_trunc('day', ts) AS day, event_type AS feature, count(*) AS requests, round(sum(coalesce(value, 0)), 4) AS cost FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of the days that the watermark has passed."""
    events = read_table(spark, sf_dir, "events")
    stream = s.read_stream(spark, sf_dir, "events", events.schema).select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("feature"), F.coalesce("value", F.lit(0.0)).alias("cost"))
    folder = work_dir(spark)
    made = s.run_available(s.usage_windows(stream), f"{folder}/days", f"{folder}/state")
    return made.select(F.col("day").cast("timestamp_ntz").alias("day"), "feature", "requests", F.round("cost", 4).alias("cost"))


@query("""
WITH e AS (SELECT user_id AS item, ts, CASE event_id % 4 WHEN 0 THEN 'analyzing' WHEN 1 THEN 'ready' WHEN 2 THEN 'archiving' ELSE 'archived' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
b AS (SELECT item, ts, CASE status WHEN 'analyzing' THEN 'queued' WHEN 'archiving' THEN 'ready' ELSE status END AS status FROM e)
SELECT item, status, ts + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31 00:00:00' AND status IN ('ready', 'skipped') AS expired FROM b""")
def stream_review_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    states = F.array(*map(F.lit, ("analyzing", "ready", "archiving", "archived")))
    stream = s.read_stream(spark, sf_dir, "events", events.schema).select(F.col("user_id").alias("item"), "ts", F.col("event_id").alias("seq"), F.get(states, (F.col("event_id") % 4).cast("int")).alias("status"))
    folder = work_dir(spark)
    return s.live_reviews(s.run_available(stream, f"{folder}/events", f"{folder}/state"), "2024-01-31 00:00:00")


@query("""SELECT event_id AS item, unnest(CASE WHEN event_id % 6 = 0 THEN ['isbn', 'tags'] WHEN event_id % 6 = 1 THEN ['authors'] ELSE CAST([] AS VARCHAR[]) END) AS step FROM events""")
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    failed = F.when(F.col("event_id") % 6 == 0, F.array(F.lit("tags"), F.lit("isbn"))).when(F.col("event_id") % 6 == 1, F.array(F.lit("authors"))).otherwise(F.array().cast("array<string>"))
    stream = s.read_stream(spark, sf_dir, "events", events.schema).select(F.col("event_id").alias("item"), failed.alias("failed_steps"))
    folder = work_dir(spark)
    return s.run_available(s.retry_failed_steps(stream), f"{folder}/steps", f"{folder}/state")


@query("""WITH h AS (SELECT min(doc_id) AS id, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY 2) SELECT count(*) AS texts, count(DISTINCT sha256) AS distinct_texts FROM h""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of one day keep one record, in state; which one is open."""
    docs = read_table(spark, sf_dir, "documents")
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600)
    stream = s.read_stream(spark, sf_dir, "documents", docs.schema).select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), arrived.alias("arrived"))
    folder = work_dir(spark)
    kept = s.run_available(s.dedupe_stream(stream), f"{folder}/kept", f"{folder}/state")
    return kept.agg(F.count("*").alias("texts"), F.count_distinct("sha256").alias("distinct_texts"))


@query("""WITH h AS (SELECT min(doc_id) AS id, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY 2) SELECT id AS doc_id, sha256 FROM h""")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive filled by two runs with one checkpoint: the second starts where the first ended, and adds nothing twice."""
    docs = read_table(spark, sf_dir, "documents")
    folder = work_dir(spark)
    own = s.import_status(s.read_stream(spark, sf_dir, "documents", docs.schema).select(F.col("doc_id").alias("id"), "text"))
    for _ in range(2):
        s.resumable_scan(own, s.import_batch(f"{folder}/archive"), f"{folder}/state")
    return spark.read.parquet(f"{folder}/archive").select(F.col("id").alias("doc_id"), "sha256")


STATES = "['queued', 'active', 'needs_review', 'failed', 'finished', 'finished']"


@query(f"""WITH e AS (SELECT user_id AS item, user_id % 7 AS job, {STATES}[event_id % 6 + 1] AS s FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT job, count(*) AS total, count(*) FILTER (s IN ('finished', 'failed')) AS completed, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'needs_review') AS needs_review, count(*) FILTER (s = 'failed') AS f FROM e GROUP BY job)
SELECT job, total, completed, queued, active, needs_review, CASE WHEN queued + active > 0 THEN 'running' WHEN needs_review > 0 THEN 'needs_review' WHEN f = total THEN 'failed' ELSE 'finished' END AS status FROM c""")
def stream_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leave one state and enter another, in state, and the progress of the jobs from the sums of such changes."""
    events = read_table(spark, sf_dir, "events")
    states = F.array(*map(F.lit, ("queued", "active", "needs_review", "failed", "finished", "finished")))
    stream = s.read_stream(spark, sf_dir, "events", events.schema).select(F.col("user_id").alias("item"), (F.col("user_id") % 7).alias("job"), F.get(states, (F.col("event_id") % 6).cast("int")).alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    folder = work_dir(spark)
    return reviews.progress_of_counts(reviews.job_counts(stream, folder))


@query("""SELECT user_id AS item, arg_max(event_type, event_id) AS event_type, max(event_id) AS revision FROM events GROUP BY user_id""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "event_type", F.col("event_id").alias("revision"))
    return s.latest_revision(rows).select("item", "event_type", "revision")


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type AS feature, count(*) AS requests, sum(coalesce(value, 0)) AS cost FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2)
SELECT date_trunc('month', day) AS month, feature, CAST(sum(requests) AS BIGINT) AS requests, round(sum(cost), 3) AS cost FROM d GROUP BY 1, 2""")
def stream_usage_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals of the days that the stream has given out."""
    days = stream_usage(spark, sf_dir).withColumn("day", F.col("day").cast("timestamp"))
    return s.month_windows(days).select(F.col("month").cast("timestamp_ntz").alias("month"), "feature", "requests", F.round("cost", 3).alias("cost"))


@query(f"""{dedup.ALL_EVIDENCE},
fi AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS file FROM documents),
m AS (SELECT "right" AS id, count(*) AS matches FROM ev JOIN reps ON reps.id = ev."right" GROUP BY 1)
SELECT p.id AS doc_id, CASE WHEN p.text_hash IS NULL THEN 'failed' WHEN fi.file < p.id THEN 'duplicate' WHEN reps.id IS NULL OR matches IS NOT NULL THEN 'needs_review' ELSE 'archived' END AS status,
  CASE WHEN p.text_hash IS NOT NULL AND fi.file < p.id THEN fi.file END AS duplicate_of, coalesce(matches, 0) AS matches
FROM p JOIN fi USING (id) LEFT JOIN reps USING (id) LEFT JOIN m USING (id)""")
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in three batches by id, each imported on its own against all before it; the SQL is one scan of all."""
    docs = read_table(spark, sf_dir, "documents")
    folder = work_dir(spark)
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    third = docs.crossJoin(F.broadcast(ends)).withColumn("third", F.expr("(doc_id - lo) * 3 div (hi - lo + 1)")).drop("lo", "hi")  # one row
    none = lambda t: F.lit(None).cast(t)
    for k in range(3):
        third.where(F.col("third") == k).drop("third").write.mode("append").parquet(f"{folder}/arrivals")
        new = spark.readStream.schema(docs.schema).parquet(f"{folder}/arrivals")
        titled = new.select(F.col("doc_id").alias("id"), "text", dedup.title_of(F.col("text")).alias("title"), F.array("source").alias("authors"), none("string").alias("isbn"), F.col("lang").alias("language"), none("int").alias("year"), F.col("source").alias("publisher"), none("string").alias("series"))
        done = importer.import_stream(titled, f"{folder}/archive", dedup.MIN_WORDS, dedup.NEAR, dedup.MIN_WORDS, max_words=None, title_form=lambda t: t)
    return done.withColumnRenamed("id", "doc_id")


REVIEWS = "['analyzing', 'ready', 'archiving', 'cover_search', 'skipped', 'archived']"


@query(f"""
WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
e AS (SELECT user_id AS item, ts, event_id AS seq, {REVIEWS}[event_id % 6 + 1] AS status, event_id % 5 = 0 AS archived,
    CASE WHEN ts > lo + (hi - lo) / 3 * 2 THEN 2 WHEN ts > lo + (hi - lo) / 3 THEN 1 ELSE 0 END AS run FROM events, b),
n AS (SELECT *, lead(ts) OVER w AS next_ts, coalesce(lead(run) OVER w, 2) AS next_run FROM e WINDOW w AS (PARTITION BY item ORDER BY ts, seq)),
f AS (SELECT *, CASE WHEN run = next_run OR status NOT IN ('analyzing', 'cover_search', 'archiving') THEN status WHEN status = 'analyzing' THEN 'queued' WHEN status = 'archiving' AND archived THEN 'archived' ELSE 'ready' END AS now_status FROM n)
SELECT item, now_status AS status, ts + INTERVAL 24 HOUR AS expires_at FROM f, b WHERE now_status IN ('ready', 'skipped') AND (next_ts >= ts + INTERVAL 24 HOUR OR next_ts IS NULL AND ts + INTERVAL 24 HOUR <= hi)""")
def stream_review_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed by their own clock in three runs of one checkpoint; what was worked on when a run ended has been interrupted."""
    events = read_table(spark, sf_dir, "events")
    folder, states = work_dir(spark), F.array(*map(F.lit, ("analyzing", "ready", "archiving", "cover_search", "skipped", "archived")))
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select("lo", ((F.col("hi") - F.col("lo")) / 3).alias("step"))
    dealt = events.crossJoin(F.broadcast(ends)).withColumn("run", F.when(F.col("ts") > F.col("lo") + F.col("step") * 2, 2).when(F.col("ts") > F.col("lo") + F.col("step"), 1).otherwise(0))  # one row
    for run in range(3):
        dealt.where(F.col("run") == run).drop("lo", "step", "run").write.mode("append").parquet(f"{folder}/events")
        new = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        stream = new.select(F.col("user_id").cast("long").alias("item"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.get(states, (F.col("event_id") % 6).cast("int")).alias("status"), (F.col("event_id") % 5 == 0).alias("archived"))
        done = reviews.expire_reviews(stream, f"{folder}/reviews", run)
    return done.select("item", "status", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
