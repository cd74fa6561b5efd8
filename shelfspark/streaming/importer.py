"""Imports into an archive whose index grows with each micro-batch; no earlier text is read again unless it is a candidate.

Three steps, each with its own checkpoint under `folder`, so that a restart goes on where it ended:

1. `prints`: arrivals are hashed, their titles cleaned, their texts fingerprinted and signed; a table in parts by batch and id.
2. `firsts`: state by text hash tells copies of files and of texts from first ones.
3. `matches`: state by index key (LSH bucket, title, ISBN, words of similar titles) holds the ids of earlier first texts. New
   ones meet them there and join the state; of a title that has new ones, all are given out once, not their pairs. Only
   candidates' parts of `prints` are read, for the evidence of the pairs.

State is kept in RocksDB, by shards of keys: an access of state costs milliseconds, whatever it holds, so that a batch costs
reads of its keys' shards, at most SHARDS, and writes of its own keys. Arrivals count in the order of
(batch, id); a micro-batch's rows of one key are held by one task. A row without text fails and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfspark.functions.isbn import canonical_isbn13
from shelfspark.functions.text import clean_title, search_key
from shelfspark.operators import duplicates as d
from shelfspark.operators import fingerprint as fp
from shelfspark.operators import scanner
from shelfspark.shared import stored
from shelfspark.streaming.streams import run_batches

#: Parts of a batch's prints: a candidate's part is read, not its batch.
PARTS = 16
#: Shards of the keys of a state; kept with the archive's checkpoints, so not to be changed for one that is there.
SHARDS = 1024
#: Pairs of a key that are made at a time.
PAIRS_AT_ONCE = 1 << 18
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYED = "shard int, key long, whole boolean, batch long, id long, asks boolean, textual boolean"
PRINTS = (
    "id long, sha256 string, status string, title string, title_rules array<string>, title_key string, authors array<string>, isbn string, language string, year int, publisher string, series string, "
    "word_count int, text_hash string, shingles array<bigint>, keys array<struct<key: string, asks: boolean, textual: boolean>>, batch long, part int"
)
PAIRS = "left long, left_batch long, right long, batch long, textual boolean, fresh boolean"
FIRSTS = "id long, batch long, same_file long, same_text long"
MATCHES = "left long, rights array<long>, kind string, reasons array<string>, conflicts array<string>"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["batch", "id"], kind="stable")


def _shard(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


class FirstSeen(StatefulProcessor):
    """By shard of text hashes: the first arrival of each text and of each file with it; a batch adds one row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "texts array<string>, files array<string>, ids array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = _in_order(rows)
        texts, files, out, new = {}, {}, [], []
        for held in list(self.seen.get()) if self.seen.exists() else []:
            for text, file, i in zip(*held, strict=True):
                texts.setdefault(text, i)
                files[text, file] = i
        for i, batch, file, text in zip(now["id"].tolist(), now["batch"].tolist(), now["sha256"], now["text_hash"], strict=True):
            out.append((i, batch, files.get((text, file)), texts.get(text)))
            texts.setdefault(text, i)
            if files.setdefault((text, file), i) == i:
                new.append((text, file, i))
        if new:
            self.seen.appendValue(tuple(map(list, zip(*new, strict=True))))
        yield pd.DataFrame(out, columns=["id", "batch", "same_file", "same_text"]).astype("Int64")

    def close(self) -> None:
        pass


class Index(StatefulProcessor):
    """By shard of index keys: earlier ids of each key; new ones meet them, and each other, and are added, one row a batch.

    Of a pair one side at least must ask. A key that is whole gives out all its ids (fresh: new ones) without a right one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "keys array<long>, batches array<long>, ids array<long>, asks array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, names, types = _in_order(rows), ("key", "batch", "id", "asks"), (np.int64, np.int64, np.int64, bool)
        new = [now[c].to_numpy(t) for c, t in zip(names, types, strict=True)]
        old = [[np.array(c, t) for c, t in zip(held, types, strict=True)] for held in (list(self.entries.get()) if self.entries.exists() else [])]
        columns = [np.concatenate([*parts, last]) for parts, last in zip(zip(*old, strict=True) if old else [()] * 4, new, strict=True)]
        n_old = len(columns[0]) - len(now)
        flags = [np.concatenate([np.zeros(n_old, bool), x]) for x in (now["textual"].to_numpy(bool), now["whole"].to_numpy(bool), np.ones(len(now), bool))]
        met = np.flatnonzero(np.isin(columns[0], new[0]))
        met = met[np.argsort(columns[0][met], kind="stable")]
        keys, batch, ids, asks, textual, whole, fresh = (x[met] for x in columns + flags)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        out, size = [], 0
        for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            # A key's last row is a new one and tells its kind.
            for part in [(np.arange(lo, hi), None)] if whole[hi - 1] else _ordered(asks, ids, lo, lo + int((~fresh[lo:hi]).sum()), hi):
                out.append(part if part[1] is not None else (part[0], np.full(hi - lo, -1)))
                size += len(part[0])
                if size >= PAIRS_AT_ONCE:
                    yield _pair_rows(out, batch, ids, textual, fresh)
                    out, size = [], 0
        if size:
            yield _pair_rows(out, batch, ids, textual, fresh)
        self.entries.appendValue(tuple(c.tolist() for c in new))

    def close(self) -> None:
        pass


def _ordered(asks: np.ndarray, ids: np.ndarray, lo: int, first: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of the pairs of a key's rows lo to hi of which j is `first` or later and one side asks."""
    i, step = np.arange(lo, hi), max(1, PAIRS_AT_ONCE // (hi - lo))
    for at in range(first, hi, step):
        j = np.arange(at, min(at + step, hi))
        a, b = np.nonzero((i[:, None] < j) & (asks[i][:, None] | asks[j]) & (ids[i][:, None] != ids[j]))
        yield i[a], j[b]


def _pair_rows(places: list[tuple[np.ndarray, np.ndarray]], batch: np.ndarray, ids: np.ndarray, textual: np.ndarray, fresh: np.ndarray) -> pd.DataFrame:
    """PAIRS of places (i, j); j is -1 for a row without a right side."""
    i, j = (np.concatenate(x) for x in zip(*places, strict=True))
    alone = j < 0
    right = pd.Series(ids[j]).astype("Int64").mask(alone)
    return pd.DataFrame({"left": ids[i], "left_batch": batch[i], "right": right, "batch": np.where(alone, batch[i], batch[j]), "textual": textual[np.where(alone, i, j)], "fresh": fresh[i]})


def index_keys(title_key: Column, authors: Column, isbn: Column, signature: Column) -> Column:
    """The keys under which a text is found, as the pairs of a scan that can have evidence are: by bands, whole titles, ISBNs, and similar titles of an author in common."""
    entry = lambda key, asks, textual: F.struct(key.alias("key"), asks.alias("asks"), F.lit(textual).alias("textual"))
    yes = F.lit(True)
    bands = F.transform(fp.lsh_buckets(signature), lambda b: entry(F.concat(F.lit("l:"), b), yes, True))
    whole = F.array_compact(
        F.array(F.when(title_key != "", entry(F.concat(F.lit("t:"), title_key), yes, True)), F.when(isbn != "", entry(F.concat(F.lit("i:"), isbn), yes, True)))
    )
    named = F.array_compact(F.array_distinct(F.coalesce(authors, F.array().cast("array<string>"))))
    by_title = F.coalesce(d.title_keys(title_key), F.array().cast("array<struct<key:string,asks:boolean>>"))
    similar = F.flatten(F.transform(named, lambda a: F.transform(by_title, lambda k: entry(F.concat_ws("\t", k["key"], a), k["asks"], False))))
    return F.concat(bands, whole, similar)


def arrival_prints(arrivals: DataFrame, min_words: int, max_words: int | None, title_form: Callable[[Column], Column] = search_key) -> DataFrame:
    """PRINTS without batch and part, of arrivals (id, text, title, authors, isbn, language, year, publisher, series)."""
    cleaned = arrivals.withColumn("clean", clean_title(F.col("title")))
    known = cleaned.withColumn("title", F.coalesce("clean.title", "title")).withColumn("title_rules", F.col("clean.rules")).drop("clean").withColumn("title_key", title_form(F.col("title")))
    hashed = known.withColumn("isbn", canonical_isbn13(F.col("isbn"))).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    made = fp.fingerprint(arrivals.select("id", "text"), min_words, max_words=max_words).select("id", "status", "word_count", "text_hash", "shingles")
    both = hashed.drop("text").join(made, "id").withColumn("signature", fp.minhash("shingles"))
    state = F.when(F.col("text_hash").isNull(), "failed").otherwise("read")
    return both.select(
        "id", "sha256", state.alias("status"), "title", "title_rules", "title_key", "authors", "isbn", "language", "year", "publisher", "series",
        "word_count", "text_hash", "shingles", index_keys(F.col("title_key"), F.col("authors"), F.col("isbn"), F.col("signature")).alias("keys"),
    )


def _part(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(PARTS)).cast("int")


def prints_of(spark: SparkSession, prints: str, ids: DataFrame) -> DataFrame:
    """Rows of the table prints for ids (id, batch): parts without any of them are not read."""
    asked = ids.withColumn("part", _part(F.col("id")))
    return spark.read.schema(PRINTS).parquet(prints).join(F.broadcast(asked.select("batch", "part").distinct()), ["batch", "part"], "left_semi").join(ids, ["id", "batch"], "left_semi")


def _keys_of(spark: SparkSession, prints: str, ids: DataFrame) -> DataFrame:
    rows = prints_of(spark, prints, ids).select("batch", "id", F.explode("keys").alias("k"))
    return rows.select(_shard(F.col("k.key")).alias("shard"), F.xxhash64("k.key").alias("key"), F.col("k.key").startswith("t:").alias("whole"), "batch", "id", "k.asks", "k.textual")


def _matched(spark: SparkSession, prints: str, met: DataFrame, near: float, near_words: int) -> DataFrame:
    """MATCHES of a batch: evidence of its candidate pairs and of the titles that have new texts."""
    met = stored(met, "met")
    held = stored(met.where("right is not null").groupBy("left", "left_batch", "right", "batch").agg(F.max("textual").alias("textual")), "pairs")
    titled = met.where("right is null").select(F.col("left").alias("id"), F.col("left_batch").alias("batch"), "fresh")
    sides = held.select(F.col("left").alias("id"), F.col("left_batch").alias("batch")).unionByName(held.select(F.col("right").alias("id"), "batch")).unionByName(titled.drop("fresh")).distinct()
    own = stored(prints_of(spark, prints, stored(sides, "sides")), "sides-prints")
    keys = own.select("id", F.col("title_key").alias("title"), "authors", "isbn", "language", "year", "publisher", "series")
    slim = own.select("id", "word_count", "text_hash", "shingles")
    textual = held.where("textual").select("left", "right")
    # Similar titles count as in a scan: if one holds any of the longest words of the other.
    side = lambda s: own.select(F.col("id").alias(s), F.col("title_key").alias(f"{s}_title"))
    similar = held.where("not textual").join(side("left"), "left").join(side("right"), "right").where(d.meets_by_tokens(F.col("left_title"), F.col("right_title"))).select("left", "right")
    at = lambda s: titled.select(F.col("id").alias(s), F.struct("batch", "id").alias(f"{s}_at"), F.col("fresh").alias(f"{s}_fresh"))
    alike = scanner.alike_by_title(slim, keys.join(titled, "id").select("id", "title"), near).join(at("left"), "left").join(at("right"), "right").where("left_fresh or right_fresh")
    alike = alike.select(F.least("left_at", "right_at").getField("id").alias("left"), F.greatest("left_at", "right_at").getField("id").alias("right"))
    told, related = scanner.tell_pairs(textual, alike, textual.unionByName(similar), slim, near, near_words)
    # Titles' rows are told by (batch, id), their order of arrival.
    order = lambda s: titled.select(F.col("id").alias(s), F.struct("batch", "id").alias(f"{s}_at"))
    known = told.join(order("left"), "left").join(order("right"), "right").select(F.col("left_at").alias("left"), F.col("right_at").alias("right"))
    entitled = d.title_author_runs(keys.join(titled, "id").withColumn("id", F.struct("batch", "id")).drop("batch"), known)
    found = d.as_runs(scanner.evidence_of(told, related, slim, keys)).unionByName(entitled.withColumns({"left": F.col("left.id"), "rights": F.col("rights.id")}))
    return found.select("left", "rights", "kind", "reasons", "conflicts")


def import_stream(
    arrivals: DataFrame, folder: str, min_words: int = 1000, near: float = 0.95, near_words: int = 1000, max_words: int | None = fp.MAX_WORDS, title_form: Callable[[Column], Column] = search_key
) -> DataFrame:
    """Everything available now in the stream arrivals (id, text, title, authors, isbn, language, year, publisher, series), imported
    into the archive at folder: see `archive` for what it then holds. Ids are unique.
    """
    spark = arrivals.sparkSession
    prints, firsts, keys, matches = (f"{folder}/{n}" for n in ("prints", "firsts", "keys", "matches"))

    def into(path: str, make: Callable[[DataFrame], DataFrame], parts: tuple[str, ...] = ("run",)) -> Callable[[DataFrame, int], None]:
        """A batch function: the batch's rows, in parts of the table that a repeated batch overwrites."""

        def each(batch: DataFrame, number: int) -> None:
            made = make(batch).withColumn("run" if "run" in parts else "batch", F.lit(number).cast("long"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

        return each

    def stream(path: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).parquet(path)

    printed = into(prints, lambda b: arrival_prints(b, min_words, max_words, title_form).withColumn("part", _part(F.col("id"))), ("batch", "part"))
    run_batches(arrivals, printed, f"{folder}/state-prints")
    with rocksdb(spark):
        read = stream(prints, PRINTS).where("text_hash is not null").select(_shard(F.col("text_hash")).alias("shard"), "id", "batch", "sha256", "text_hash")
        seen = read.groupBy("shard").transformWithStateInPandas(statefulProcessor=FirstSeen(), outputStructType=FIRSTS, outputMode="Append", timeMode="None")
        run_batches(seen, into(firsts, lambda b: b), f"{folder}/state-firsts")
        news = stream(firsts, FIRSTS + ", run long").where("same_text is null").select("id", "batch")
        run_batches(news, into(keys, lambda b: _keys_of(spark, prints, b)), f"{folder}/state-keys")
        keyed = stream(keys, KEYED + ", run long").drop("run")
        pairs = keyed.groupBy("shard").transformWithStateInPandas(statefulProcessor=Index(), outputStructType=PAIRS, outputMode="Append", timeMode="None")
        run_batches(pairs, into(matches, lambda b: _matched(spark, prints, b, near, near_words)), f"{folder}/state-matches")
    return archive(spark, folder)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """(id, status, duplicate_of, matches): failed without text; duplicate of the first arrival of the same file; needs_review with an earlier
    text of the same hash or with evidence for an earlier one; else archived.
    """
    prints = _read(spark, f"{folder}/prints", PRINTS).select("id", "status", "batch")
    firsts = _read(spark, f"{folder}/firsts", FIRSTS)
    found = _read(spark, f"{folder}/matches", MATCHES).select(F.explode("rights").alias("id")).groupBy("id").agg(F.count("*").alias("matches"))
    both = prints.join(firsts.drop("batch"), "id", "left").join(found, "id", "left")
    review = F.col("same_text").isNotNull() | F.col("matches").isNotNull()
    status = F.when(F.col("status") == "failed", "failed").when(F.col("same_file").isNotNull(), "duplicate").when(review, "needs_review").otherwise("archived")
    return both.select("id", status.alias("status"), F.col("same_file").alias("duplicate_of"), F.coalesce("matches", F.lit(0)).alias("matches"))


