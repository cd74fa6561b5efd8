"""Centroid clustering (operator 11): k centroids by a progressive search over Walsh-Hadamard coefficients.

Components x become integers floor(1024 * x). Vectors and centroids go through the exact integer
Walsh-Hadamard transform in order of sequency, in which 64 times a squared distance is the sum of
squared differences of the 64 coefficients. Differences are added coarse to fine (1, 1, 2, 4, ... 32
coefficients). The sum so far is a lower bound of a centroid's distance; an upper one is the sum with twice
both sides' remaining energy, and, once LEAD coefficients are in, the whole distance of the centroid that leads
then. Centroids whose lower bound exceeds the least upper bound are strictly worse and go. Those left at
the end have all 64 coefficients, so their distances are exact.

Vectors are transformed once and stored. In a round each task returns the number and the sums of
coefficients of each centroid; sums of sums (k * 64 numbers) reach the driver, which transforms them back
(the transform is linear and exact) and takes floors.

Defined results: vectors that are null, have other than 64 components, or hold null or non-finite ones are
left out, and so are those with a component of LARGEST or more in magnitude, whose squared distance may not
fit a long. Repeated rows are vectors of their own. Null ids come last among the starting centroids; equal
hashes start in the order of their components. Fewer than k vectors start fewer centroids; no vectors, no
rows. Sums of distances beyond a long are held at its largest value. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

DIMS = 64
SCALE = 1024
#: Magnitude of an integer component from which a vector is left out.
LARGEST = 1 << 27
#: Coefficients below it have sums of squares and bounds within 63 bits; larger ones are computed with Python's integers.
MACHINE = 1 << 26
#: Ends of the steps, coarse to fine.
STEPS = (1, 2, 4, 8, 16, 32, 64)
#: After so many coefficients a row's leading centroid gets the rest at once.
LEAD = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of 64 integers through the Walsh-Hadamard transform, coefficients by rising sequency (sign changes)."""
    out = x.reshape(len(x), -1)
    width = 1
    while width < DIMS:
        pairs = out.reshape(len(x), -1, 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), DIMS)
        width *= 2
    return out[:, SEQUENCY]


def _sequency_order() -> np.ndarray:
    """Natural index of the rows of the matrix in order of their sign changes: the bits of the Gray code, reversed."""
    gray = np.arange(DIMS) ^ (np.arange(DIMS) >> 1)
    return np.array([int(f"{g:06b}"[::-1], 2) for g in gray])


SEQUENCY = _sequency_order()


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance, coefficients compared) for rows of coefficients v among rows c; of equal ones the smaller number."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) >= MACHINE:
        v, c = v.astype(object), c.astype(object)
    n, k = len(v), len(c)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    row, cent = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, v.dtype)
    rest_v, rest_c = (v * v).sum(axis=1), (c * c).sum(axis=1)
    least, done, compared = None, 0, 0
    for end in STEPS:
        diff = v[row, done:end] - c[cent, done:end]
        total = total + (diff * diff).sum(axis=1)
        compared += diff.size
        rest_v = rest_v - (v[:, done:end] ** 2).sum(axis=1)
        rest_c = rest_c - (c[:, done:end] ** 2).sum(axis=1)
        done = end
        # (a - b)^2 <= 2 a^2 + 2 b^2 over what is left
        upper = np.minimum.reduceat(total + 2 * (rest_v[row] + rest_c[cent]), _firsts(row))
        least = upper if least is None else np.minimum(least, upper)
        if end == LEAD:
            leads = np.flatnonzero(total == np.minimum.reduceat(total, _firsts(row))[row])
            leads = leads[_firsts(row[leads])]
            diff = v[:, end:] - c[cent[leads], end:]
            least = np.minimum(least, total[leads] + (diff * diff).sum(axis=1))
            compared += diff.size
        keep = total <= least[row]  # the least of a row stays, so every row does
        row, cent, total = row[keep], cent[keep], total[keep]
    # Those left of a row are equally near, in order of their numbers.
    first = _firsts(row)
    return cent[first], total[first] // DIMS, compared


def _firsts(row: np.ndarray) -> np.ndarray:
    """Places where a new row begins."""
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))


def integers(vector: Column) -> Column:
    """Components as integers; null if the vector is not one of 64 finite components below LARGEST."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST // SCALE))
    return F.when((F.size(vector) == DIMS) & fine, whole)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMS)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = hadamard(_rows(b.column("x")))
        ends = pa.array(np.arange(len(out) + 1) * DIMS, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=["vec_id", "v"])


def _assigned(centroids: np.ndarray):
    c = hadamard(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, distance, _ = nearest(_rows(b.column("v")), c)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(which, pa.int32()), pa.array([int(d) for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _sums(centroids: np.ndarray):
    """Of a task's vectors: a row for each centroid and coefficient with the number of vectors and the sum, in two halves of 32 bits."""
    c = hadamard(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(len(c), np.int64), np.zeros((len(c), DIMS), np.int64), np.zeros((len(c), DIMS), np.int64)
        for b in batches:
            v = _rows(b.column("v"))
            which, _, _ = nearest(v, c)
            for j in np.unique(which):
                own = v[which == j]
                n[j] += len(own)
                low[j] += (own & 0xFFFFFFFF).sum(axis=0)
                high[j] += (own >> 32).sum(axis=0)
        at = np.repeat(np.arange(len(c)), DIMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.tile(np.arange(DIMS), len(c)), pa.int32()), pa.array(n[at]), pa.array(low.reshape(-1)), pa.array(high.reshape(-1))], names=["cluster", "place", "n", "low", "high"]
        )

    return run


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid (64 integers) of each vector kept.

    Centroids start as the k vectors with the smallest sha256 of salt and id.
    """
    name = F.concat(F.lit(salt), F.col("vec_id").cast("string"))
    kept = vectors.select(F.col(id_col).alias("vec_id"), integers(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, "
    first = kept.select("x").orderBy(F.sha2(name, 256).asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), DIMS)
    coded = stored(kept.mapInArrow(_transformed, schema + "v array<bigint>"), "coefficients")
    for _ in range(rounds if len(centroids) else 0):
        sums = coded.mapInArrow(_sums(centroids), "cluster int, place int, n long, low long, high long")
        held = sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).collect()  # k * 64 rows
        counts = np.zeros(len(centroids), object)
        total = np.zeros((len(centroids), DIMS), object)
        for r in held:
            counts[r["cluster"]], total[r["cluster"], r["place"]] = r["n"], (r["high"] << 32) + r["low"]
        natural = np.zeros_like(total)
        natural[:, SEQUENCY] = total
        back = hadamard(natural)
        plain = np.zeros_like(back)
        plain[:, SEQUENCY] = back
        moved = [[int(s) // DIMS // int(n) for s in row] if n else [int(x) for x in old] for row, n, old in zip(plain, counts, centroids, strict=True)]
        centroids = np.array(moved, np.int64)
    if not len(centroids):
        out = schema + "cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>"
        return coded.sparkSession.createDataFrame([], out)
    near = stored(coded.mapInArrow(_assigned(centroids), schema + "cluster int, distance long"), "assigned")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), most)
    per = near.groupBy("cluster").agg(total("distance").cast("long").alias("cluster_inertia"))
    whole = near.agg(total("distance").cast("long").alias("inertia"))
    ends = coded.sparkSession.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    few = F.broadcast(per.join(F.broadcast(ends), "cluster").crossJoin(F.broadcast(whole)))  # k rows
    return near.join(few, "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def oracle(table: str = "embeddings", k: int = 8, rounds: int = 10, salt: str = "3:") -> str:
    """DuckDB SQL of the query over cluster_vectors(): plain distances, a chain of rounds."""
    parts = [
        f"""e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM {table}
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
v AS MATERIALIZED (SELECT r, generate_subscripts(x, 1) AS p, unnest(x) AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{salt}' || vec_id), x) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT s.c, v.p, v.x FROM s JOIN v USING (r) WHERE s.c < {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""d{i} AS MATERIALIZED (
  SELECT r, arg_min(c, dist * 1000 + c) AS c, min(dist) AS dist FROM (
    SELECT v.r, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS HUGEINT) AS dist FROM v JOIN c{i} k USING (p) GROUP BY v.r, k.c) GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""n{i} AS (
  SELECT d.c, v.p, CAST(sum(v.x) AS HUGEINT) AS t, CAST(count(*) AS HUGEINT) AS n FROM d{i} d JOIN v USING (r) GROUP BY d.c, v.p),
c{i + 1} AS MATERIALIZED (
  SELECT k.c, k.p, coalesce(CAST((n.t - ((n.t % n.n) + n.n) % n.n) // n.n AS BIGINT), k.x) AS x FROM c{i} k LEFT JOIN n{i} n ON n.c = k.c AND n.p = k.p)"""
            )
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS sha FROM c{rounds} GROUP BY c)
SELECT e.vec_id, CAST(d.c AS INTEGER) AS cluster, CAST(d.dist AS BIGINT) AS distance, CAST(sum(d.dist) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d.dist) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM e JOIN d{rounds} d USING (r) JOIN h ON h.c = d.c"""
