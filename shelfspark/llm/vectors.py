"""Embedding near-duplicates (operator 2): tiles compared along principal axes, leading dimensions first.

Equal vectors form a class. Class vectors are scaled to length one and turned onto the
principal axes of all of them (a rotation keeps products). Tiles follow that order: a tree of
medians along the leading axes, grown on a bounded sample (SAMPLE_ROWS) to leaves of about
TILE_ROWS vectors; every vector goes to its leaf, and a leaf that is fuller than that is dealt
to several tiles. Two unit vectors with a cosine of at least t lie within sqrt(2-2t) of each
other, so a pair of tiles whose boxes on the first BOX_AXES axes lie farther apart is skipped;
boxes meet by an equi-join on slabs of that width along the first axis. A vector is sent to
the tiles near its own, in the type it came in; there are LEAST_TILES tiles at least, so that
small tables are spread too. In a pair of tiles, blocks of BLOCK_ROWS are compared: blocks
with boxes apart are skipped, then products of the leading dimensions come first; a pair of
vectors is dropped as soon as its partial product plus the product of its suffix norms, which
bounds the rest, is below t. What is left is summed in double precision, near t from the
vectors as given. A tile pair returns for each vector its number of links and one edge, never
the pairs.

Result, one row per input row: n_links, component_id, kept. Vectors that are null, zero or
hold null or non-finite parts, and rows without an id, link with nothing; vectors of
different lengths are not compared. Rows that repeat an id with another vector are nodes of their
own. Empty tables give no rows. Vectors are told apart by two 64-bit hashes. Vectors of more than PCA_DIMS parts have
WIDE_AXES principal axes, fitted on WIDE_SAMPLE of them, before their rest in their own parts: products stay the same,
and the matrix for the turn small. Tiles hold at most TILE_BYTES of numbers a side, so wide vectors have smaller ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import connected_components, min_labels, over_groups, small_side, stored

THRESHOLD = 0.95
BOX_AXES = 8
TILE_ROWS, TILE_BYTES = 65_536, 32 << 20
LEAST_TILES = 3
BLOCK_ROWS = 1024
SAMPLE_ROWS = 65_536
PCA_DIMS = 512
#: Axes of longer vectors, and the vectors that they are fitted on.
WIDE_AXES, WIDE_SAMPLE = 128, 2048
FIRST_STEP = 8
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest part, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def tile_rows(dim: int) -> int:
    """Vectors of a tile."""
    return max(1, min(TILE_ROWS, max(BLOCK_ROWS, TILE_BYTES // (8 * dim))))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the axes (columns) by falling variance about the origin: all of them, from all vectors; beyond PCA_DIMS the leading ones, from a sample by hash.

    Tasks send sums of products, so what is collected has at most PCA_DIMS squared rows for a length, or WIDE_SAMPLE vectors.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                u = unit_rows(_matrix(batch.column(1).filter(pa.array(dims == d)), d))
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], names=["dim", "i", "j", "x"])

    narrow = classes.where(F.col("dim") <= PCA_DIMS)
    rows = narrow.select("dim", "vec").mapInArrow(sums, "dim int, i int, j int, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    axes = {}
    for d, part in rows.groupby("dim"):
        m = np.zeros((int(d), int(d)))
        m[part["i"], part["j"]] = part["x"]
        axes[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    for r in classes.where(F.col("dim") > PCA_DIMS).select("dim").distinct().collect():  # a row a vector length
        d = r["dim"]
        some = classes.where(F.col("dim") == d).orderBy(F.xxhash64("rep"), "rep").limit(WIDE_SAMPLE).select("vec").collect()
        u = unit_rows(np.array([x["vec"] for x in some], np.float64))
        found = np.linalg.svd(u, full_matrices=False)[2]
        axes[d] = found[: min(WIDE_AXES, len(found))].T.copy()
    return axes


def turn(raw: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows on the axes; where these are not all, what they leave of a row follows in its own parts."""
    u = unit_rows(raw)
    on = u @ axes
    return on if axes.shape[0] == axes.shape[1] else np.concatenate([on, u - on @ axes.T], axis=1)


def leading(u: np.ndarray) -> np.ndarray:
    lead = np.zeros((len(u), BOX_AXES))
    lead[:, : min(u.shape[1], BOX_AXES)] = u[:, :BOX_AXES]
    return lead


def grow(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, threshold, child below, child from it on; a leaf has axis -1) of a tree of medians, each along the widest axis."""
    nodes: list[tuple[int, float, int, int]] = []

    def add(rows: np.ndarray, want: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if want > 1 and len(rows) > 1:
            axis = int(np.argmax(np.ptp(rows, axis=0)))
            half = want // 2
            cut = float(np.sort(rows[:, axis])[len(rows) * half // want])
            low = rows[:, axis] < cut
            if low.any() and not low.all():
                nodes[me] = (axis, cut, add(rows[low], half), add(rows[~low], want - half))
        return me

    add(sample, leaves)
    return nodes


def leaf_of(lead: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(lead), np.int64)
    axis, cut, low, high = (np.array(x) for x in zip(*nodes, strict=True))
    row = np.arange(len(lead))
    while True:
        inner = axis[at] >= 0
        if not inner.any():
            return at
        below = lead[row, np.maximum(axis[at], 0)] < cut[at]
        at = np.where(inner, np.where(below, low[at], high[at]), at)


def linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least threshold; a, b: unit rows on the principal axes."""
    d, step = a.shape[1], min(FIRST_STEP, a.shape[1])
    # suffix norms: length of what is left after the first k dimensions
    rest = [np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])) for m in (a, b)]
    tail = lambda side, k: rest[side][:, k] if k < d else np.zeros(len(rest[side]))
    first = a[:, :step] @ b[:, :step].T
    hope = first + np.multiply.outer(tail(0, step), tail(1, step)) >= threshold - SLACK
    i, j = np.nonzero(np.triu(hope, 1) if same else hope)
    keep_i, keep_j = [], []
    for lo in range(0, len(i), 1 << 17):
        p, q = i[lo : lo + (1 << 17)], j[lo : lo + (1 << 17)]
        value, k = first[p, q], step
        while k < d and len(p):
            to = min(d, 2 * k)
            value = value + np.einsum("ij,ij->i", a[p, k:to], b[q, k:to])
            k = to
            ok = value + tail(0, k)[p] * tail(1, k)[q] >= threshold - SLACK
            p, q, value = p[ok], q[ok], value[ok]
        near = np.abs(value - threshold) <= SLACK
        ok = value >= threshold
        if near.any():
            x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (raw_a[p[near]], raw_b[q[near]]))
            ok[near] = np.array([math.fsum(s * t) / math.sqrt(math.fsum(s * s) * math.fsum(t * t)) for s, t in zip(x, y, strict=True)]) >= threshold
        keep_i.append(p[ok])
        keep_j.append(q[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *keep_i]), np.concatenate([none, *keep_j])


def tile_links(raw: np.ndarray, side: np.ndarray, weight: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the vectors of one tile (side all 0), or of two (0 and 1) between them. 
    weight: rows of each class. Blocks hold vectors that are neighbours along the first axis; of the
    links of two blocks only sums and a spanning forest are kept.
    """
    n, width = len(raw), math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    u = turn(raw, axes)
    blocks: list[list[np.ndarray]] = []
    for s in (0, 1):
        own = np.flatnonzero(side == s)
        own = own[np.argsort(u[own, 0], kind="stable")]
        blocks.append([own[k : k + BLOCK_ROWS] for k in range(0, len(own), BLOCK_ROWS)])
    alone = not blocks[1]
    box = [[(leading(u[b]).min(axis=0), leading(u[b]).max(axis=0)) for b in part] for part in blocks]
    count, label, edges = np.zeros(n, np.int64), np.arange(n), []
    held = 0
    for x, a in enumerate(blocks[0]):
        for y, b in enumerate(blocks[0] if alone else blocks[1]):
            if alone and y < x:
                continue
            (lo, hi), (lo2, hi2) = box[0][x], box[0 if alone else 1][y]
            if (np.maximum(0, np.maximum(lo - hi2, lo2 - hi)) ** 2).sum() > width * width:
                continue
            i, j = linked(u[a], u[b], raw[a], raw[b], threshold, alone and x == y)
            if not len(i):
                continue
            i, j = a[i], b[j]
            count += (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
            members, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            edges.append((members, members[min_labels(len(members), at[: len(i)], at[len(i) :])]))
            held += len(members)
            if held > 1 << 20:
                label = min_labels(n, np.concatenate([label, *(e[0] for e in edges)]), np.concatenate([np.arange(n), *(e[1] for e in edges)]))
                edges, held = [], 0
    label = min_labels(n, np.concatenate([label, *(e[0] for e in edges)]), np.concatenate([np.arange(n), *(e[1] for e in edges)]))
    return count, label


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of df."""
    vec = F.col(vector) if dict(df.dtypes)[vector] in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    sound = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # -0.0 and 0.0 are one number and must hash alike
    plain = F.transform("vec", lambda x: x + F.lit(0.0).cast(rows.schema["vec"].dataType.elementType))
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({"h1": F.when(F.col("sound"), F.xxhash64(plain)), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), plain))})
    ids = stored(keyed.select("id", "h1", "h2"), "hashes")
    classes = keyed.where("sound").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = classes.withColumns({"dim": F.size("vec"), "rep": F.xxhash64("h1", "h2")})
    classes = stored(classes, "classes")
    axes = principal_axes(classes)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(leading(turn(_matrix(part.column(1), d), axes[d]))), pa.list_(pa.float64()))], names=["dim", "rep", "lead"])

    leads = classes.select("dim", "vec", "rep").mapInArrow(lead, "dim int, rep long, lead array<double>")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row for each vector length
    trees = {}
    for d, size in sizes.items():
        tiles = max(LEAST_TILES, -(-size // tile_rows(d))) if size > 2 * BLOCK_ROWS else 1
        sample = leads.where(F.col("dim") == d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).toPandas() if tiles > 1 else None
        trees[d] = grow(np.array(sample["lead"].tolist()) if tiles > 1 else np.zeros((1, BOX_AXES)), tiles)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                first = leading(turn(_matrix(part.column(1), d), axes[d]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(leaf_of(first, trees[d])), pa.array(list(first), pa.list_(pa.float64()))], names=["dim", "rep", "leaf", "lead"])

    leaves = stored(classes.select("dim", "vec", "rep").mapInArrow(place, "dim int, rep long, leaf long, lead array<double>"), "leaves")
    parts = leaves.groupBy("dim", "leaf").agg(F.count("*").alias("n"))
    most = F.lit(2) * F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.greatest(F.lit(BLOCK_ROWS), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim"))))))  # as tile_rows
    parts = parts.select("dim", "leaf", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    tile = F.concat_ws("/", F.col("dim").cast("string"), F.col("leaf").cast("string"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string"))
    tiled = stored(leaves.join(parts, ["dim", "leaf"]).select("dim", "rep", "lead", tile.alias("tile")), "tiled")
    box = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(BOX_AXES) for name, f in (("lo", F.min), ("hi", F.max))]
    tiles = stored(tiled.groupBy("dim", "tile").agg(*box), "tiles")
    slab = lambda c: F.floor(c / F.lit(width)).cast("int")
    left = tiles.select("dim", F.explode(F.sequence(slab(F.col("lo0")) - 1, slab(F.col("hi0")) + 1)).alias("slab"), F.col("tile").alias("a"), *[F.col(f"{s}{k}").alias(f"{s}{k}_a") for k in range(BOX_AXES) for s in ("lo", "hi")])
    right = tiles.withColumn("slab", F.explode(F.sequence(slab(F.col("lo0")), slab(F.col("hi0")))))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"hi{k}_a"), F.col(f"lo{k}_a") - F.col(f"hi{k}")), 2) for k in range(BOX_AXES)), F.lit(0.0))
    pairs = left.join(right, ["dim", "slab"]).where(F.col("a") <= F.col("tile")).where(gap <= width * width).select("a", F.col("tile").alias("b")).distinct()
    pairs = stored(pairs.withColumn("unit", F.concat_ws("|", "a", "b")), "pairs")
    sides = pairs.select("unit", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("unit", F.col("b").alias("tile"), F.lit(1).alias("side")))
    units = classes.select("dim", "rep", "n", "vec").join(tiled.select("rep", "tile"), "rep").join(small_side(sides), "tile").select("unit", "side", "dim", "rep", "n", "vec")

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        d = group["dim"][0].as_py()
        rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
        count, label = tile_links(_matrix(group["vec"], d), group["side"].to_numpy(), n, axes[d], threshold)
        some = count > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (rep, count, rep[label])], names=["id", "links", "root"]) if some.any() else None

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "links", "root")])
    found = stored(over_groups(units, "unit", verify, schema, also=("rep",)), "links")
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = roots.join(classes.select(F.col("rep").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    judged = classes.select("h1", "h2", "n", "least", F.col("rep").alias("id")).join(total, "id", "left").join(roots.join(named, "component").select("id", "component_id"), "id", "left")
    judged = judged.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = ids.join(judged, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
