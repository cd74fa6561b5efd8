"""Streams: import with duplicates, usage windows, review expiry, retried steps, job states, resumed scans.

All run with Trigger.AvailableNow over files and a checkpoint in the caller's folder, so a
restart goes on after the last committed file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything available now, appended to Parquet at sink; returns the sink's rows."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def run_batches(stream: DataFrame, each, checkpoint: str) -> None:
    """each(batch, id) for everything available now; each must be idempotent by id."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of one table's Parquet files: `folder/name` is a file or a folder of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def usage_windows(usage: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, feature, requests, cost) per day; a day is given out once the watermark has passed it."""
    rows = usage.withWatermark("created_at", delay)
    made = rows.groupBy(F.window("created_at", "1 day").alias("w"), "feature").agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"))
    return made.select(F.col("w.start").alias("day"), "feature", "requests", "cost")


def import_status(files: DataFrame, min_chars: int = 40) -> DataFrame:
    """files (id, text) with sha256 and status: failed without text, needs_review when short, else archived."""
    status = F.when(F.col("text").isNull() | (F.trim("text") == ""), "failed").when(F.length("text") < min_chars, "needs_review").otherwise("archived")
    return files.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), status.alias("status"))


def mark_duplicates(imported: DataFrame) -> DataFrame:
    """imported with status duplicate for all but the smallest id of a hash; a count before a join, no window over a hot hash."""
    least = imported.groupBy("sha256").agg(F.min("id").alias("first"))
    return imported.join(least, "sha256").select("id", "sha256", F.when(F.col("id") != F.col("first"), "duplicate").otherwise(F.col("status")).alias("status"))


def live_reviews(events: DataFrame, now: str, ttl: str = "24 hours") -> DataFrame:
    """(item, status, expired): the last event of each item; open reviews older than ttl are expired, interrupted work falls back."""
    last = events.groupBy("item").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("l")).select("item", "l.*")
    back = F.when(F.col("status") == "analyzing", "queued").when(F.col("status") == "cover_search", "ready").when(F.col("status") == "archiving", "ready").otherwise(F.col("status"))
    old = (F.col("ts") + F.expr(f"interval {ttl}")) <= F.to_timestamp(F.lit(now))
    return last.select("item", back.alias("status"), (old & back.isin("ready", "skipped")).alias("expired"))


def retry_failed_steps(items: DataFrame, steps: tuple[str, ...] = ("isbn", "authors", "language", "tags")) -> DataFrame:
    """(item, step): the failed post-processing steps, in their fixed order."""
    order = F.array(*map(F.lit, steps))
    return items.select("item", F.explode(F.filter(order, lambda s: F.array_contains(F.col("failed_steps"), s))).alias("step"))


def dedupe_stream(files: DataFrame, at: str = "arrived", delay: str = "1 day") -> DataFrame:
    """The first of equal texts (by sha256) that arrive within the watermark's delay of each other; state is kept that long."""
    return files.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"])


def not_archived(arrivals: DataFrame, archive: DataFrame) -> DataFrame:
    """Arrivals whose sha256 no archived row has: what a second run into the same archive adds."""
    return arrivals.join(archive.select("sha256").distinct(), "sha256", "left_anti")


def import_batch(archive: str):
    """A batch function for run_batches that appends to the archive's folder what it does not hold yet, one row a text.

    The folder is partitioned by batch and a batch overwrites its own part, so a repeated batch changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("sha256").agg(F.min(F.struct("id", "status")).alias("f")).select("f.id", "sha256", "f.status")
        try:
            held = spark.read.schema("id long, sha256 string, status string, batch long").parquet(archive).where(F.col("batch") != number)
            first = not_archived(first, held)
        except AnalysisException:
            pass  # no archive yet
        first.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(archive)

    return each


def latest_revision(writes: DataFrame, key: str = "item", revision: str = "revision") -> DataFrame:
    """The row of the highest revision of each key: stale writes go. Works on streams too."""
    rest = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("x")).select(key, "x.*")


def month_windows(usage: DataFrame) -> DataFrame:
    """(month, feature, requests, cost) of the daily totals that usage_windows gives."""
    return usage.groupBy(F.date_trunc("month", "day").alias("month"), "feature").agg(F.sum("requests").alias("requests"), F.sum("cost").alias("cost"))


def resumable_scan(rows: DataFrame, each, checkpoint: str) -> None:
    """each(batch, id) over what no run with this checkpoint has seen: a restart goes on after the last finished batch."""
    run_batches(rows, each, checkpoint)
