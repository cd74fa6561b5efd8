"""Text fingerprints: words, five-word shingles, MinHash signatures, LSH buckets.

Shingle hashes are the first 8 bytes of SHA-256 of the window (64 bits that any SQL engine can
compute), kept as signed 64-bit numbers; signature slots are unsigned ones, kept likewise, and
shown by `hexed`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import text_form
from shelfspark.shared import spread

VERSION = 3
SLOTS, BANDS, ROWS = 32, 8, 4
GOLDEN = 0x9E3779B97F4A7C15
MAX_WORDS = 150_000
WORD = re.compile(r"\w+")
LONGS = T.ArrayType(T.LongType())


def hexed(c: Column) -> Column:
    """A 64-bit number as 16 hexadecimal digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def shingle_set(text: str, n: int = 5, most: int | None = None) -> np.ndarray:
    """Distinct hashes (big-endian, unsigned) of the n-word windows; none for fewer than n or, if it is given, more than `most` words."""
    tokens = WORD.findall(text)
    if len(tokens) < n or (most is not None and len(tokens) > most):
        return np.empty(0, np.uint64)
    sha = hashlib.sha256
    data = b"".join([sha(" ".join(tokens[i : i + n]).encode()).digest()[:8] for i in range(len(tokens) - n + 1)])
    return np.unique(np.frombuffer(data, ">u8").astype(np.uint64))


def _lists(arrays: Iterable[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as an Arrow column of lists: one buffer, no Python object a number."""
    parts = [a.view(np.int64) for a in arrays]
    ends = np.cumsum([0, *map(len, parts)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), np.concatenate([np.empty(0, np.int64), *parts])).cast(pa.list_(pa.int64()))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of an Arrow column as views of its buffer; null is empty."""
    values, ends, null = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[0 if null[i] else ends[i] : 0 if null[i] else ends[i + 1]].view(np.uint64)


def shingles(text: Column, n: int = 5, most: int | None = None) -> Column:
    """Sets of window hashes of normal texts, as arrays; a null text has an empty one."""

    @F.arrow_udf(LONGS)
    def run(texts: pa.Array) -> pa.Array:
        return _lists(shingle_set(x.as_py() or "", n, most) for x in texts)

    return run(text)


def text_signature(text: Column, slots: int, n: int = 5, most: int | None = None) -> Column:
    """minhash of a normal text's shingles, which stay where they are made."""

    @F.arrow_udf(LONGS)
    def run(texts: pa.Array) -> pa.Array:
        return _lists(signature_of(shingle_set(x.as_py() or "", n, most), slots) for x in texts)

    return run(text)


def signature_of(values: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Slot s: the least of v * (2s + 1) + s * GOLDEN modulo 2**64; no values, no slots."""
    if not len(values):
        return np.empty(0, np.uint64)
    s = np.arange(slots, dtype=np.uint64)
    least = np.full(slots, np.uint64(2**64 - 1))
    for i in range(0, len(values), 4096):
        part = np.multiply.outer(values[i : i + 4096], 2 * s + np.uint64(1)) + s * np.uint64(GOLDEN)
        least = np.minimum(least, part.min(axis=0))
    return least


def minhash_of(slots: int):
    """minhash with another number of slots."""

    @F.arrow_udf(LONGS)
    def run(sets: pa.Array) -> pa.Array:
        return _lists(signature_of(x, slots) for x in _sets(sets))

    return run


minhash = minhash_of(SLOTS)


@F.pandas_udf(LONGS)
def minhash_aggregate(values: pd.Series) -> np.ndarray:
    """MinHash signature of a group's distinct hashes (one row each): an aggregate, for SQL too."""
    return signature_of(values.dropna().to_numpy(np.int64).view(np.uint64)).view(np.int64)


def lsh_keys(signature: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """The number and slots of each band of a full signature: what lsh_buckets hashes, for joins."""
    made = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), *[F.get(signature, b * rows + k).alias(f"s{k}") for k in range(rows)]))
    return F.when(F.size(signature) == bands * rows, made)


def lsh_buckets(signature: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One bucket (band and hash of its slots) for each band of a full signature."""
    slots = F.transform(signature, hexed)
    made = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.concat_ws(":", b.cast("string"), F.sha2(F.array_join(F.slice(slots, b * rows + 1, rows), ","), 256)))
    return F.when(F.size(signature) == bands * rows, made).otherwise(F.array().cast("array<string>"))


def fingerprint(docs: DataFrame, min_words: int = 1000, max_words: int | None = MAX_WORDS, error: str | None = None, slots: int | None = None, dealt: bool = False) -> DataFrame:
    """(id, status, reason, word_count, text_hash, shingles, version) of docs (id, text); with slots signature, too, made without the column shingles.

    status: failed where the column error names what went wrong with the text, unavailable without
    text, partial beyond max_words (no hash then; None: no limit), else complete; shingles only
    from min_words on. dealt: the texts are over all tasks already, or cost little.
    """
    base = docs.select("id", text_form(F.col("text")).alias("normal"), (F.lit(None).cast("string") if error is None else F.col(error)).alias("error"))
    base = base if dealt else spread(base)
    counted = base.withColumn("word_count", F.when(F.coalesce(F.length("normal"), F.lit(0)) > 0, F.size(F.split("normal", " "))).otherwise(0))
    over = F.lit(False) if max_words is None else F.col("word_count") > max_words
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("word_count") == 0, "unavailable").when(over, "partial").otherwise("complete")
    done = counted.withColumn("status", status).withColumn("long", F.when((F.col("status") == "complete") & (F.col("word_count") >= min_words), F.col("normal")))
    reason = F.coalesce("error", F.when(F.col("status") == "unavailable", "no text").when(F.col("status") == "partial", "too long to compare"))
    return done.select(
        "id", "status", reason.alias("reason"), "word_count", F.when(F.col("status") == "complete", F.sha2("normal", 256)).alias("text_hash"),
        shingles(F.col("long"), most=max_words).alias("shingles"), F.lit(VERSION).alias("version"),
        *([] if slots is None else [text_signature(F.col("long"), slots, most=max_words).alias("signature")]),
    )


def lsh_index(signed: DataFrame) -> DataFrame:
    """(id, band, bucket): a row for each band of signed (id, signature)."""
    return signed.select("id", F.posexplode(lsh_buckets(F.col("signature"))).alias("band", "bucket"))


def coverage(prints: DataFrame) -> DataFrame:
    """(status, documents) for each of the four states, 0 for those that do not occur."""
    states = prints.sparkSession.createDataFrame([(s,) for s in ("complete", "partial", "unavailable", "failed")], "status string")
    counts = prints.groupBy("status").agg(F.count("*").alias("documents"))
    return states.join(counts, "status", "left").select("status", F.coalesce("documents", F.lit(0)).alias("documents"))


def stale(source: DataFrame, derived: DataFrame, version: int = VERSION, key: str = "id") -> DataFrame:
    """Rows of source without a derived row of the current version."""
    return source.join(current(derived, version).select(key), key, "left_anti")


def current(derived: DataFrame, version: int = VERSION) -> DataFrame:
    """Derived rows of the current version; others count as missing."""
    return derived.where(F.col("version") == version)


def representatives(prints: DataFrame) -> DataFrame:
    """One row of each text hash, the smallest id: equal texts share all buckets and need no comparison."""
    return prints.join(prints.where(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.min("id").alias("id")), ["id", "text_hash"], "left_semi")


def signatures_by(values: DataFrame, key: str, value: str, slots: int = SLOTS) -> DataFrame:
    """(key, signature): MinHash of each group's hashes (64 bits), merged from parts: an Arrow batch gives a key's least number
    in each slot, and only those are moved. So a hot key is all tasks' work, where minhash_aggregate holds a group in one. Nulls are no values.
    """
    kind = values.schema[key].dataType.simpleString()

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for found, part in batch.groupby("k", dropna=False, sort=False)["v"]:
                # In signed order, so that Spark's min is the least of unsigned numbers.
                signed = (signature_of(part.to_numpy(np.int64).view(np.uint64), slots) ^ np.uint64(1 << 63)).view(np.int64)
                yield pd.DataFrame({"k": pd.Series([None if pd.isna(found) else found] * slots, dtype=batch["k"].dtype if not pd.isna(found) else object), "slot": np.arange(slots, dtype=np.int32), "least": signed})

    rows = values.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).where("v is not null")
    parts = rows.mapInPandas(least, f"k {kind}, slot int, least long").groupBy("k", "slot").agg(F.min("least").alias("least"))
    whole = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("slot", "least"))).alias("s"))
    flip = F.lit(-(1 << 63))
    return whole.select(F.col("k").alias(key), F.transform("s", lambda x: x["least"].bitwiseXOR(flip)).alias("signature"))
