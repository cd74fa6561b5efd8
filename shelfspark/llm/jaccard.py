"""N-gram Jaccard join (operator 8): MinHash banding, shuffled on band hashes, verified on full sets.

A document's set holds the hashes of its NGRAM-word windows (lower-case A-Z, words between
white space); a document of one to NGRAM-1 words has one window. Documents with equal sets
form a class and are represented by their smallest id. Bands and rows are chosen for
TARGET_RECALL at the threshold. Classes that share a band hash are candidates. Each class has
its home at the least class it shares one with, or that one's home; the classes of a home fill tiles of bounded size,
and only tiles with a bucket in common are compared, on the full sets, so that chains of chance
candidates do not grow together and no group meets in one task. A pair of tiles returns, for each
of its members, the number of links and one edge towards another that it reaches, never the pairs.

Result, one row per input row: class_id (smallest id reachable by links), n_links (other rows
linked directly, rows of the same set included). A null or blank text has no set and links with
nothing. Rows that repeat an id with other texts are nodes of their own. An empty table gives no
rows. Sets are told apart by two 64-bit sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import append_arrow, connected_components, free_name, joined_bytes, min_labels, mix, over_groups, small_side, stored, word_hashes

NGRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 192
#: Times that a home moves on to its own home.
HOME_STEPS = 2
#: Members and set elements of a tile.
TILE_ROWS = 1024
TILE_ITEMS = 1 << 20
SEED = 71


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose bands reach the recall."""
    for rows in range(most, 0, -1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands within so many hashes reach that recall")


def shingle_sets(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct window hashes of each text."""
    data, ends = joined_bytes(texts)
    upper = (data >= 65) & (data <= 90)
    words, doc = word_hashes(np.where(upper, data + 32, data).astype(np.uint8), ends)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = words[a:b]
        m = len(own) - n + 1
        if m < 1:
            width, m = len(own), min(1, len(own))
        else:
            width = n
        value = np.zeros(m, np.uint64)
        for k in range(width if m else 0):
            value = (value + own[k : k + m]) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        out.append(np.unique(mix(value)))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, as signed 64-bit numbers: equal for equal sets."""
    a, b = np.add.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for i in range(0, len(s), 512):
        least = np.minimum(least, (np.multiply.outer(s[i : i + 512], a) + b).min(axis=0))
    odd = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mix((least.reshape(bands, rows) * odd).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).astype(np.int64)


def signatures(df: DataFrame, text: str, bands: int, rows: int) -> DataFrame:
    """df with n_shingles, fp1, fp2 (of the set) and bands (hashes, empty for an empty set)."""

    def make() -> Callable:
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = shingle_sets(batch.column(batch.schema.get_field_index(text)))
            prints = [fingerprint(s) for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.array([band_hashes(s, bands, rows) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]

        return run

    longs = [T.StructField(n, T.LongType()) for n in ("n_shingles", "fp1", "fp2")]
    return append_arrow(df, make, [*longs, T.StructField("bands", T.ArrayType(T.LongType()))], sized_by=text)


def with_sets(df: DataFrame, text: str) -> DataFrame:
    """df with its sets as binary (sorted 64-bit numbers), fp1 and fp2; the text goes."""

    def make() -> Callable:
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = shingle_sets(batch.column(batch.schema.get_field_index(text)))
            prints = [fingerprint(s) for s in sets]
            return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]

        return run

    made = append_arrow(df, make, [T.StructField("set", T.BinaryType()), T.StructField("got1", T.LongType()), T.StructField("got2", T.LongType())], sized_by=text)
    return made.drop(text)


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (right None: of left with itself).

    Products of 0/1 matrices over blocks of the elements that two sets or more hold.
    """
    both = left if right is None else left + right
    value, inverse, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(both)), [len(s) for s in both])
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[inverse]
    who, item = who[use], number[inverse[use]]
    order = np.argsort(item, kind="stable")
    who, item = who[order], item[order]
    total = np.zeros((len(left), len(both) if right is None else len(right)), np.float32)
    width = max(1, (1 << 22) // max(1, len(both)))
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(item, [a, a + width])
        m = np.zeros((len(both), width), np.float32)
        m[who[lo:hi], item[lo:hi] - a] = 1
        total += m[: len(left)] @ (m if right is None else m[len(left) :]).T
    return total


def links(rows: pa.Table, threshold: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ids, links, root) of the members of one tile pair: links within a tile for one (side 0), between the sides for two."""
    ids, first = np.unique(np.array(rows["id"].to_pylist(), np.int64), return_index=True)
    tile = np.array(rows["side"].to_pylist())[first]
    n = np.array(rows["n"].to_pylist(), np.int64)[first]
    data = rows["set"].to_pylist()
    sets = [np.frombuffer(data[i], np.uint64) for i in first]
    size = np.array([len(s) for s in sets], np.float64)
    sides = np.unique(tile)
    alone = len(sides) == 1
    a = np.flatnonzero(tile == sides[0])
    b = a if alone else np.flatnonzero(tile == sides[1])
    shared = intersections([sets[i] for i in a], None if alone else [sets[i] for i in b])
    match = shared * (1 + threshold) >= threshold * (size[a][:, None] + size[b]) - 1e-6
    i, j = np.nonzero(np.triu(match, 1) if alone else match)
    i, j = a[i], b[j]
    count = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
    return ids, count.astype(np.int64), ids[min_labels(len(ids), i, j)]


def candidate_tiles(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, tile, n, size, fp1, fp2) of the classes that share a band hash with another, and the pairs of tiles to compare (a, b, unit).

    A class has its home at the least class that it shares a bucket with (itself included), or at that
    one's home, so HOME_STEPS times: near copies, which share buckets with one another, have one or two
    homes between them. The classes of a home fill tiles of bounded size. Tiles that have a bucket in common are compared; buckets of one class
    meet nothing, and no pairs of classes are made.
    """
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = stored(banded.join(buckets, "band"), "shared-bands")
    homes = shared.groupBy("node").agg(F.min("least").alias("home")).join(classes.drop("bands"), "node")
    homes = stored(homes.select("node", "n", "rep", "size", "fp1", "fp2", "home"), "homes")
    for step in range(HOME_STEPS):
        next_ = homes.select(F.col("node").alias("home"), F.col("home").alias("__next"))
        homes = stored(homes.join(next_, "home").drop("home").withColumnRenamed("__next", "home"), f"homes{step}")
    wide = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / F.lit(TILE_ROWS), F.sum("size") / F.lit(TILE_ITEMS))).cast("int").alias("k"))
    placed = homes.join(wide, "home").withColumn("tile", F.concat_ws(".", F.col("home").cast("string"), F.pmod(F.col("node"), F.col("k")).cast("string"))).drop("home", "k")
    placed = stored(placed, "placed")
    held = stored(shared.select("node", "band").join(placed.select("node", "tile"), "node").select("band", "tile").distinct(), "tile-bands")
    several = held.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    across = held.join(several, "band")
    pairs = across.select("band", F.col("tile").alias("a")).join(across.select("band", F.col("tile").alias("b")), "band").where("a < b").select("a", "b").distinct()
    alone = placed.groupBy("tile").agg(F.count("*").alias("c")).where("c > 1").select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    return placed, pairs.unionByName(alone).withColumn("unit", F.concat_ws("|", "a", "b"))


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """(id, n_links, class_id), one row per row of df."""
    bands, rows = choose_bands(threshold, recall)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("__text"))
    sig = stored(signatures(docs, "__text", bands, rows).drop("__text"), "signatures")
    classes = sig.where("n_shingles > 0 and id is not null").groupBy("fp1", "fp2")
    classes = classes.agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.xxhash64("fp1", "fp2")), "classes")
    placed, pairs = candidate_tiles(classes)
    pairs = stored(pairs, "tile-pairs")
    # one row of each class carries its text
    texts = docs.join(small_side(placed.drop("size")), F.col("id") == F.col("rep"))
    sets = with_sets(texts, "__text").where("got1 = fp1 and got2 = fp2").dropDuplicates(["node"])
    sides = pairs.select("unit", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("unit", F.col("b").alias("tile"), F.lit(1).alias("side")))
    units = sets.join(sides, "tile").select("unit", "side", F.col("node").alias("id"), "n", "set")

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        ids, count, root = links(group, threshold)
        some = count > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (ids, count, root)], names=["id", "links", "root"]) if some.any() else None

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "links", "root")])
    found = stored(over_groups(units, "unit", verify, schema), "links")
    total = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "node")
    named = roots.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    judged = classes.select("fp1", "fp2", "n", "rep", "node").join(total, "node", "left").join(roots.join(named, "component").select("node", "least"), "node", "left")
    judged = judged.select("fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("class_id"))
    out = sig.select("id", "fp1", "fp2", F.when(F.col("n_shingles") > 0, True).alias("has")).join(judged.withColumn("has", F.lit(True)), ["fp1", "fp2", "has"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the first in the order of the table as it is stored; rows count apart whatever their ids."""
    own = free_name(df, "row")
    rows = stored(df.withColumn(own, F.monotonically_increasing_id()), "rows")
    classes = jaccard_classes(rows, own, text, threshold)
    keep = stored(classes.where(F.col("class_id") == F.col(own)).select(own), "kept")
    return rows.join(small_side(keep), own, "left_semi").drop(own)
