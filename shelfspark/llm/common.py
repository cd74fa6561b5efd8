"""What the operators share: table access, tables kept in the shared folder, Arrow helpers, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every word rule here: blank, and tab to carriage return.
WS = r"\x20\x09-\x0D"
#: A task splits its Arrow batches so that a piece holds about so many bytes of text (one row at least).
PIECE_BYTES = 2 << 20

_made: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); where it is unset, a temporary one for local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    key = id(spark.sparkContext)
    if key not in _made:
        _made[key] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _made[key]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage, and survives lost executors.

    The folder is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfspark-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, move: bool = False) -> DataFrame:
    """df, written once to a table in the shared folder that is bucketed by key: joins on key do not move its rows.

    Rows stay in their tasks' files, unless they are to move to the task of their bucket first.
    The table is dropped and its folder deleted when the driver's Python ends.
    """
    spark, n, own = df.sparkSession, n_parts(df), f"shelfspark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}/{name}"
    ready = df.repartition(n, key) if move else df
    ready.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(own)
    atexit.register(_drop, spark, own, path.rpartition("/")[0])
    return spark.table(own)


def _drop(spark: SparkSession, name: str, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _remove(spark, path)


@contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send one row at a time to Python: for rows of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def n_parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def drop_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without its columns that clash (in any case) with names about to be added."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batch: pa.RecordBatch, column: str | None, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch that hold about limit bytes of the column each, one row at least."""
    if not batch.num_rows:
        return
    if column is None:
        yield batch
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def append_arrow(df: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], sized_by: str | None = None, limit: int = PIECE_BYTES) -> DataFrame:
    """df with columns added by Python over Arrow batches.

    make() runs once a task and returns f(batch) -> arrays for fields; f.done(), if there is one, ends the task. A column of df
    with the name of a new one is replaced.
    """
    kept = drop_names(df, [f.name for f in fields])
    names = kept.columns
    types = [f for f in T.StructType(fields)]
    schema = T.StructType([*kept.schema.fields, *types])
    arrow_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for whole in batches:
                for batch in pieces(whole, sized_by, limit):
                    old = [batch.column(batch.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays([*old, *f(batch)], names=arrow_names)
        finally:
            getattr(f, "done", lambda: None)()

    return df.mapInArrow(run, schema)


def words_column(text: Column) -> Column:
    """Words of a text ([^\\x20\\x09-\\x0D]+) as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def word_hashes(data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of documents that lie one after the other in data (uint8), and each word's document."""
    return placed_words(data, doc_ends)[:2]


def placed_words(data: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of the words of documents that lie one after the other in data (uint8).

    doc_ends: where each document ends; a document must end with a white-space byte.
    """
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts, ends
    value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    # A sum over the word of byte hash times an odd power of the byte's place in the word.
    place = np.arange(len(data), dtype=np.uint64)
    lead = np.repeat(place[starts], ends - starts)
    inside = np.flatnonzero(~white)
    within = place[inside] - lead
    terms = value[inside] * mix(within + np.uint64(0x1234567))
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
    return mix(np.add.reduceat(terms, cuts) + (ends - starts).astype(np.uint64)), np.searchsorted(doc_ends, starts, side="right"), starts, ends


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the first k bytes of words; 0 for words of k bytes or fewer."""
    h = np.full(len(start), k, np.uint64)
    for i in range(k):
        byte = data[np.minimum(start + i, len(data) - 1)].astype(np.uint64)
        h = (h + byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.where(end - start > k, mix(h) | np.uint64(1), np.uint64(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xorshift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts (null: empty) as one byte array with a newline after each, and where each ends."""
    whole = b"".join(b"%b\n" % (t or b"") for t in texts.cast(pa.binary()).to_pylist())
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(whole, np.uint8), np.cumsum(size + 1)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): every node of an undirected edge list with the smallest id that it reaches.

    Rounds of minimum labels over neighbours followed by a jump to the label's label, so
    that the number of rounds grows with the logarithm of the longest chain. Each round
    is a table in the shared folder; only one number a round, the count of changed
    labels, reaches the driver. Edges with a null end and loops are ignored; no edges, no rows.
    """
    pairs = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a <> b")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("c1"))
        known = labels.select(F.col("id").alias("k"), F.col("component").alias("c2"))
        labels = stored(step.join(known, step.c1 == known.k).select("id", "old", F.least("c1", "c2").alias("component")), "labels")
        if not labels.where("component <> old").limit(1).count():
            return labels.select("id", "component")


def few_rows(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; df should be a stored table."""
    return df.limit(most + 1).count() <= most


#: Bytes of a table, by its rows and types, up to which it is sent to all tasks.
SMALL_BYTES = 8 << 20
_WIDTH = {"tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8, "boolean": 8, "date": 8, "timestamp": 8, "string": 64}


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """df marked for broadcast if its rows, counted, take at most SMALL_BYTES; else as it is (then the join shuffles).

    Columns of numbers count 8 bytes, strings (keys of bounded length) 64; other types are never sent. most: a lower bound of rows.
    """
    kinds = [t for _, t in df.dtypes]
    if any(t not in _WIDTH for t in kinds):
        return df
    rows = SMALL_BYTES // (16 + sum(_WIDTH[t] for t in kinds))
    return F.broadcast(df) if few_rows(df, rows if most is None else min(rows, most)) else df


def over_groups(df: DataFrame, key: str, f: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType | str, also: tuple[str, ...] = ()) -> DataFrame:
    """f over the rows of each value of key (a bounded group), as one stream a partition rather than one call of Spark's a group."""
    ready = df.repartition(n_parts(df), key).sortWithinPartitions(key, *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pc.run_end_encode(batch.column(batch.schema.get_field_index(key)))
            start = 0
            for end, value in zip(keys.run_ends.to_pylist(), keys.values.to_pylist(), strict=True):
                if held and value != held_key:
                    if (out := f(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held_key = value
                held.append(batch.slice(start, end - start))
                start = end
        if held and (out := f(pa.Table.from_batches(held))) is not None:
            yield out

    return ready.mapInArrow(run, schema)


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and undirected edges (i, j): the smallest node that each reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
