"""Suffix-array dedup (operator 4): repeated passages by column-wise multi-document construction.

Every byte that lies in a LENGTH-byte string which also starts anywhere else is removed.

Inserting one symbol per document each round needs as many rounds, each over the whole
collection, as the longest document has bytes. So the collection is first cut into short
strings that make the rounds few and the work proportional to the corpus. Each
LENGTH-byte window has an anchor, the leftmost ANCHOR-byte string in it of the least hash;
the windows of a document that share an anchor make one segment of fewer than 2 * LENGTH bytes.
Equal windows have equal anchors at equal places, so they meet among segments of one anchor
(anchors seen once go), and they lie in the same column counted from the anchor. In periodic text,
where the anchor would move with every window, a window that equals the one a period before it
is repeated by itself and makes no segment, so that a run gives a segment or two. Segments of
equal bytes are one with a count. In a group of an anchor's distinct segments, rounds go over
the columns from the last to the first: each inserts one symbol of every segment, and updates
the order of the suffixes (the collection's transform restricted to that column) and the
common prefixes of neighbours; a window is repeated if a neighbour shares LENGTH symbols. The
rounds run in memory over blocks of groups; the segments are read in order from tables in the
shared folder. A group of more than GROUP_ROWS distinct segments is not brought together: its
windows are counted by digest.

Anchors of more than HOT_ROWS segments are looked up in a table sent to all tasks (if it is small,
else they too are joined by shuffle), so that a passage of very many documents stays spread.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing. Rows count
apart: a row that repeats an id and text is a copy; all copies share one list of segments. Other columns play no part; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import append_arrow, drop_names, few_rows, mix, n_parts, pieces, stored

LENGTH = 200
ANCHOR = 32
#: Distinct segments of an anchor up to which its group is one task's work.
GROUP_ROWS = 20_000
#: Segments that a block of groups holds.
BLOCK_ROWS = 40_000
PAD = 256
SCAN_BYTES = 2 << 20
#: Segments of an anchor from which on it is hot.
HOT_ROWS = 2048
#: Hot anchors (16 bytes each) up to which they are sent to all tasks.
HOT_ANCHORS = 400_000


def echoes(data: np.ndarray, at: np.ndarray, low: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask of the windows that equal the one a period before, byte ranges that those and their models cover). at, low: place and hash of each window's anchor."""
    mask, ranges = np.zeros(len(at), bool), []
    edge = np.flatnonzero(np.diff(at)) + 1
    step = at[edge] - at[edge - 1]
    back = (low[edge] == low[edge - 1]) & (step > 0) & (step <= length - anchor)
    if not back.any():
        return mask, ranges
    # stretches of anchors that follow one another by the same step
    k = np.flatnonzero(back)
    cut = np.flatnonzero((np.diff(k) != 1) | (np.diff(step[k]) != 0)) + 1
    for part in np.split(k, cut):
        period, first = int(step[part[0]]), int(edge[part[0]])
        end = int(edge[part[-1] + 1]) if part[-1] + 1 < len(edge) else len(at)
        first = max(first, period)
        if first >= end:
            continue
        same = data[first : end + length - 1] == data[first - period : end + length - 1 - period]
        upto = np.concatenate([[0], np.cumsum(same)])
        whole = upto[length:] - upto[:-length] == length
        mask[first:end] |= whole
        run = np.flatnonzero(np.diff(np.concatenate([[False], whole, [False]]).astype(np.int8)))
        ranges += [(first + a - period, first + b - 1 + length) for a, b in zip(run[0::2].tolist(), run[1::2].tolist(), strict=True)]
    return mask, ranges


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(place of the anchor, first window, last window, anchor hash) of the runs of windows of one text, and its byte ranges that are periodic."""
    n = len(data) - length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none, []
    h = mix(data.astype(np.uint64) + np.uint64(1))
    span = 1
    while span < anchor:  # hashes of strings of double length
        h = mix(h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:])
        span *= 2
    width = length - anchor + 1
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:  # leftmost minima of windows of growing width
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        right = b < a
        low, at, span = np.where(right, b, a), np.where(right, at[step:], at[:-step]), span + step
    low, at = low[:n], at[:n]
    echo, periodic = echoes(data, at, low, length, anchor)
    window = np.flatnonzero(~echo) if periodic else np.arange(n)
    if not len(window):
        window = np.arange(1)
    edge = np.flatnonzero((np.diff(at[window]) != 0) | (np.diff(window) != 1)) + 1
    first = window[np.concatenate([[0], edge])]
    last = window[np.concatenate([edge, [len(window)]]) - 1]
    return at[first].astype(np.int64), first, last, low[first].astype(np.int64), periodic


def _scan(docs: DataFrame) -> DataFrame:
    """(key, th, place, first, last, anchor): the segments of docs (key, th, text); without an anchor: byte ranges (first, last) that repeat by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SCAN_BYTES):
                out = [anchors(np.frombuffer(text or b"", np.uint8)) for text in batch.column(2).cast(pa.binary()).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(out)), [len(p[0]) for p in out]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[pa.array(np.concatenate([p[k] for p in out]), pa.int64() if k == 3 else pa.int32()) for k in range(4)]], names=names)
                own = [(i, a, b) for i, p in enumerate(out) for a, b in p[4]]
                if own:
                    row = pa.array([i for i, _, _ in own])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[pa.array([o[k] for o in own], pa.int32()) for k in (1, 1, 2)], pa.nulls(len(own), pa.int64())], names=names)

    names = ["key", "th", "place", "first", "last", "anchor"]
    return docs.mapInArrow(run, "key long, th long, place int, first int, last int, anchor long")


def repeated_windows(group: np.ndarray, lead: np.ndarray, texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window start in it) of windows that another segment of the same group holds in the same column.

    group: numbers, in order; lead: bytes before the anchor. One symbol of each segment a round,
    from the last column to the first.
    """
    m, zero = len(texts), length - anchor
    columns = 2 * length - anchor
    size = np.fromiter(map(len, texts), np.int64, m)
    cells = np.full((m, columns), PAD, np.int16)
    start = zero - lead
    at = np.arange(columns)
    inside = (at >= start[:, None]) & (at < (start + size)[:, None])
    cells[inside] = np.frombuffer(b"".join(texts), np.uint8)
    cells = np.ascontiguousarray(cells.T)
    order = np.arange(m)
    common = np.where(np.concatenate([[True], group[1:] != group[:-1]]), 0, columns).astype(np.int32)
    depth = 0
    who, where = [], []
    last_window = start + size - length
    for x in range(columns - 1, -1, -1):
        symbol = cells[x][order].astype(np.int64)
        g = group[order]
        key = g * 257 + symbol
        put = np.argsort(key, kind="stable")
        # neighbours now: common prefix is one more than the least between their old places
        old = np.append(np.minimum(common, depth), 0)
        a, b = put[:-1], put[1:]
        same = key[a] == key[b]
        fresh = np.zeros(m, np.int32)
        if same.any():
            lo, hi = a[same] + 1, b[same] + 1
            bounds = np.empty(2 * len(lo), np.int64)
            bounds[0::2], bounds[1::2] = lo, hi
            least = np.minimum.reduceat(old, bounds)[0::2]
            fresh[1:][same] = least + 1
        order, common, depth = order[put], fresh, depth + 1
        if x <= zero:
            long = common >= length
            hit = long.copy()
            hit[:-1] |= long[1:]
            found = order[hit]
            found = found[(start[found] <= x) & (x <= last_window[found])]
            who.append(found)
            where.append(x - start[found])
    return np.concatenate(who), np.concatenate(where)


def _runs(who: np.ndarray, where: np.ndarray, m: int, length: int) -> list[list[tuple[int, int]]]:
    """For each segment the byte ranges that its repeated windows cover, joined."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    order = np.lexsort((where, who))
    for s, w in zip(who[order].tolist(), where[order].tolist(), strict=True):
        own = out[s]
        if own and w <= own[-1][1]:
            own[-1] = (own[-1][0], w + length)
        else:
            own.append((w, w + length))
    return out


def _groups(distinct: DataFrame) -> DataFrame:
    """(anchor, digest, ranges): repeated ranges in the distinct segments (anchor, digest, lead, bytes) of anchors with several."""
    ready = distinct.select("anchor", "digest", "lead", "bytes").repartition(n_parts(distinct), "anchor").sortWithinPartitions("anchor")

    def out(table: pa.Table) -> pa.RecordBatch | None:
        anchor = table["anchor"].to_numpy()
        group = np.cumsum(np.concatenate([[0], (np.diff(anchor) != 0)]))
        texts = table["bytes"].to_pylist()
        who, where = repeated_windows(group, table["lead"].to_numpy().astype(np.int64), texts)
        ranges = _runs(who, where, len(texts), LENGTH)
        some = [i for i, r in enumerate(ranges) if r]
        if not some:
            return None
        flat = pa.array([[{"a": a, "b": b} for a, b in ranges[i]] for i in some], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(anchor[some]), table["digest"].combine_chunks().take(pa.array(some)), flat], names=["anchor", "digest", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
                if cut:
                    if (made := out(table.slice(0, cut))) is not None:
                        yield made
                    held, n = table.slice(cut).to_batches(), len(anchor) - cut
        if held and (made := out(pa.Table.from_batches(held))) is not None:
            yield made

    return ready.mapInArrow(run, "anchor long, digest binary, ranges array<struct<a: int, b: int>>")


def _by_digest(distinct: DataFrame) -> DataFrame:
    """The same for groups too large for one task: windows are exploded to digests and counted."""

    def windows(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
        return [pa.array([[hashlib.blake2b(t[i : i + LENGTH], digest_size=16).digest() for i in range(len(t) - LENGTH + 1)] for t in texts], pa.list_(pa.binary()))]

    made = append_arrow(distinct.select("anchor", "digest", "lead", "bytes"), lambda: windows, [T.StructField("w", T.ArrayType(T.BinaryType()))]).drop("bytes")
    rows = stored(made.select("anchor", "digest", "lead", F.posexplode("w").alias("i", "w")), "windows")
    # the column is the window's place against the anchor; equal windows share it
    twice = rows.groupBy("anchor", "w").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    hit = rows.join(twice, ["anchor", "w"])
    own = hit.groupBy("anchor", "digest").agg(F.array_sort(F.collect_list("i")).alias("is"))
    return own.select("anchor", "digest", F.transform("is", lambda i: F.struct(i.alias("a"), (i + LENGTH).alias("b"))).alias("ranges"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(key, th, ranges): for documents (key, th, text) with repeated passages, the byte ranges that repeat, sorted by start."""
    found = stored(_scan(docs), "segments")
    often = stored(found.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    hot = often.where(F.col("c") > HOT_ROWS).select("anchor")
    if few_rows(hot, HOT_ANCHORS):
        rest = found.join(F.broadcast(hot), "anchor", "left_anti").join(often.where(F.col("c") <= HOT_ROWS).select("anchor"), "anchor", "left_semi")
        again = found.join(F.broadcast(hot), "anchor", "left_semi").unionByName(rest)
    else:
        again = found.join(often, "anchor", "left_semi")
    # copies of a row have the same segments: a set, so that they do not multiply
    lists = again.groupBy("key", "th").agg(F.collect_set(F.struct("place", "first", "last", "anchor")).alias("segments"))
    lists = stored(lists, "repeated-anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SCAN_BYTES):
                rows: list[tuple] = []
                columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()]
                for key, th, text, segments in zip(*columns, strict=True):
                    for s in segments:
                        body = text[s["first"] : s["last"] + LENGTH]
                        rows.append((key, th, s["first"], s["place"] - s["first"], s["anchor"], hashlib.blake2b(body, digest_size=16).digest(), body))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "th", "first", "lead", "anchor", "digest", "bytes"])

    joined = docs.join(lists, ["key", "th"]).select("key", "th", "text", "segments")
    pieces_ = stored(joined.mapInArrow(cut, "key long, th long, first int, lead int, anchor long, digest binary, bytes binary"), "pieces")
    distinct = stored(pieces_.groupBy("anchor", "digest", "lead", "bytes").agg(F.count("*").alias("n")), "distinct")
    kinds = stored(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    several = distinct.join(kinds, "anchor")
    ranges = _groups(several.where(F.col("kinds") <= GROUP_ROWS))
    large = kinds.where(F.col("kinds") > GROUP_ROWS)
    if not few_rows(large, 0):
        ranges = ranges.unionByName(_by_digest(several.where(F.col("kinds") > GROUP_ROWS)))
    # a segment seen twice is repeated from end to end
    whole = distinct.where("n > 1").select("anchor", "digest", F.array(F.struct(F.lit(0).alias("a"), F.length("bytes").alias("b"))).alias("ranges"))
    ranges = stored(whole.unionByName(ranges.join(whole.select("anchor", "digest"), ["anchor", "digest"], "left_anti")), "ranges")
    hits = pieces_.select("key", "th", "first", "anchor", "digest").join(ranges, ["anchor", "digest"])
    spans = hits.select("key", "th", F.explode("ranges").alias("r"), "first").select("key", "th", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b")).alias("r"))
    periodic = found.where("anchor is null").select("key", "th", F.struct(F.col("first").alias("a"), F.col("last").alias("b")).alias("r"))
    return spans.unionByName(periodic).groupBy("key", "th").agg(F.array_sort(F.collect_set("r")).alias("ranges"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with kept (binary: the bytes that stay), n_bytes, n_removed and n_spans (maximal removed runs)."""
    base = drop_names(df, ["kept", "n_bytes", "n_removed", "n_spans", "key", "th", "__ranges"])
    # Rows of equal id and text are equal in all results, so both make the key.
    keyed = base.withColumns({"key": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "th": F.xxhash64(text)})
    ranges = repeated_ranges(keyed.select("key", "th", F.col(text).alias("text")))
    joined = keyed.join(ranges.withColumnRenamed("ranges", "__ranges"), ["key", "th"], "left").drop("key", "th")

    def make() -> Callable:
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            kept, n, gone, spans = [], [], [], []
            for body, ranges in zip(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist(), batch.column(batch.schema.get_field_index("__ranges")).to_pylist(), strict=True):
                body = body or b""
                out, done, runs = [], 0, 0
                for r in ranges or ():
                    if r["a"] > done or not runs:
                        out.append(body[done : r["a"]])
                        runs += 1
                    done = max(done, r["b"])
                out.append(body[done:])
                kept.append(b"".join(out))
                n.append(len(body))
                gone.append(len(body) - len(kept[-1]))
                spans.append(runs)
            return [pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (n, gone, spans)]]

        return run

    fields = [T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    return append_arrow(joined, make, fields, sized_by=text).drop("__ranges")
