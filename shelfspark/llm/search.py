"""Ranked lexical search (operator 13): an index of all documents in strata of equal normaliser.

Terms are runs of ASCII digits and letters and of all characters beyond ASCII, A-Z lower-cased. The
normaliser of a document with n terms is m = 100 - 75 + ((75 * n * N) div L), with N documents that have
terms and L terms in all. Documents of equal m are a stratum; strata are dealt to segments, large ones in
pieces, so that a segment holds about SEGMENT_POSTINGS postings. A segment is a row: its documents by
stratum, its terms, and for each term its postings in runs by stratum and rising term frequency.

A search meets every segment with blocks of items. The impact (1000000000 * tf) div (1000 * tf + 8 * m) is
computed once a run, not a posting. The bound of a stratum is the sum over the item's terms of the impact of
the highest frequency there; strata are visited in order of their bounds, in waves of doubling number, and
those whose bound is below the k-th best score so far are left out, which loses none: scores only add
what the bound has counted. Best rows of segments are ranked once more over all.

Defined results: null and blank texts have no terms; such documents are not counted and never found. Repeated
rows of documents are documents of their own. Repeated rows of items are one item; different texts under one
id are ranked apart; an item of a null id is ranked, one without terms gives no rows. Equal scores are in order of doc_id,
nulls last. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import over_groups, pieces, single_rows, small_side, stored

#: Postings of a segment, about: a row of some 10 MB, searched by one task at a time.
SEGMENT_POSTINGS = 500_000
#: Different terms of the items that are sent to all tasks at once, about.
BLOCK_TERMS = 200_000
#: Strata of the first wave of a visit.
FIRST_WAVE = 8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_INDEX = "segment long, doc array<bigint>, m array<bigint>, m_docs array<int>, term array<string>, df array<int>, n_runs array<int>, run_m array<int>, run_tf array<int>, run_n array<int>, place array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: n, its different terms and how often each occurs; turn numbers a task's rows."""
    turn = 0
    for whole in batches:
        for b in pieces(whole, "text"):
            n, ends, terms, tfs = [], [0], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").translate(_FOLD).split()
                count = Counter(words)
                n.append(len(words))
                terms.extend(count)
                tfs.extend(count.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())), pa.array(range(turn, turn + len(n)), pa.int64())],
                names=["doc", "n", "terms", "tfs", "turn"],
            )
            turn += b.num_rows


def _lists(values: list[np.ndarray | pa.Array]) -> list[pa.Array]:
    """Arrays of one row each."""
    out = []
    for v in values:
        v = v if isinstance(v, pa.Array) else pa.array(v)
        out.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
    return out


def _segment(rows: pa.Table) -> pa.RecordBatch:
    """One segment from its documents' terms."""
    rows = rows.sort_by("m")
    m = rows["m"].to_numpy()
    strata, m_docs = np.unique(m, return_counts=True)
    terms = rows["terms"].combine_chunks()
    size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    words = terms.flatten().dictionary_encode()
    place = np.repeat(np.arange(len(m), dtype=np.int32), size)
    tf = rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int32)
    term = words.indices.to_numpy()
    stratum = np.repeat(np.arange(len(strata), dtype=np.int32), m_docs)[place]
    order = np.lexsort((place, tf, stratum, term))
    place, tf, term, stratum = place[order], tf[order], term[order], stratum[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
    run = np.flatnonzero(new)
    run_n = np.diff(np.append(run, len(term))).astype(np.int32)
    n_terms = len(words.dictionary)
    columns = _lists(
        [rows["doc"].combine_chunks(), strata, m_docs.astype(np.int32), words.dictionary, np.bincount(term, minlength=n_terms).astype(np.int32), np.bincount(term[run], minlength=n_terms).astype(np.int32), stratum[run], tf[run], run_n, place]
    )
    return pa.RecordBatch.from_arrays([pa.array([rows["segment"][0].as_py()], pa.int64()), *columns], names=[c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """The index of docs: a stored table of segments, over all terms of all documents."""
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    counted = stored(read.mapInArrow(_counted, "doc long, n long, terms array<string>, tfs array<int>, turn long").where("n > 0"), "terms")
    whole = counted.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("P")).first()
    n, length, postings = whole
    normed = counted.withColumn("m", (F.expr(f"25 + ((75 * n * {n}L) div {max(length, 1)}L)")).cast("long"))
    # Strata of more than a quarter of a segment are dealt in pieces.
    parts = normed.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) * 4 / segment_postings).alias("parts"))
    dealt = normed.join(small_side(stored(parts, "strata")), "m").withColumn("segment", F.pmod(F.xxhash64("m", F.col("turn") % F.col("parts")), F.lit(-(-postings // segment_postings) or 1)))
    built = over_groups(dealt.select("segment", "m", "doc", "terms", "tfs"), "segment", _segment, _INDEX)
    return stored(built, "index")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, ..., start + size - 1 of each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _best(doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, then doc_id, nulls last."""
    if len(score) > 4 * k:
        edge = -np.partition(-score, k - 1)[k - 1]
        some = np.flatnonzero(score >= edge)
        return some[np.lexsort((doc[some], null[some], -score[some]))[:k]]
    return np.lexsort((doc, null, -score))[:k]


class _Segment:
    """A segment's arrays, ready for items."""

    def __init__(self, row: pa.RecordBatch, wanted: pa.Array):
        get = lambda name: row.column(name)[0].values
        number = lambda name: get(name).to_numpy(zero_copy_only=False)
        ids = get("doc")
        self.null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        self.doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.m, self.place = number("m"), number("place")
        self.run_m, self.run_n = number("run_m"), number("run_n").astype(np.int64)
        n_runs = number("n_runs").astype(np.int64)
        self.run_start = np.cumsum(self.run_n) - self.run_n
        self.term_start, self.term_runs = np.cumsum(n_runs) - n_runs, n_runs
        tf = number("run_tf").astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * self.m[self.run_m])
        # The last run of a term in a stratum has its highest frequency.
        last = np.ones(len(tf), bool)
        last[:-1] = self.run_m[1:] != self.run_m[:-1]
        last[self.term_start[1:] - 1] = True
        self.last = last
        at = pc.index_in(wanted, get("term"))
        self.at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places of documents, scores, strata visited) of the k best for an item: places of its terms among those wanted, and their weights."""
        own = self.at[terms]
        own, weights = own[(own >= 0) & (weights > 0)], weights[(own >= 0) & (weights > 0)]
        size = self.term_runs[own]
        runs = _ranges(self.term_start[own], size)
        gain = np.repeat(weights, size) * self.impact[runs]
        stratum = self.run_m[runs]
        bound = np.zeros(len(self.m), np.int64)
        top = self.last[runs]
        np.add.at(bound, stratum[top], gain[top])
        visits = np.argsort(-bound, kind="stable")
        visits = visits[bound[visits] > 0]
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        done, wave, seen = 0, FIRST_WAVE, 0
        while done < len(visits):
            now = visits[done : done + wave]
            if len(scores) >= k:
                now = now[bound[now] >= scores[-1]]
                if not len(now):
                    break
            done, wave, seen = done + wave, wave * 2, seen + len(now)
            visited = np.zeros(len(self.m), bool)
            visited[now] = True
            mine = np.flatnonzero(visited[stratum])
            length = self.run_n[runs[mine]]
            docs = self.place[_ranges(self.run_start[runs[mine]], length)]
            score = np.zeros(len(self.doc), np.int64)
            np.add.at(score, docs, np.repeat(gain[mine], length))
            new = np.flatnonzero(score)
            found, scores = np.concatenate([found, new]), np.concatenate([scores, score[new]])
            best = _best(self.doc[found], self.null[found], scores, k)
            found, scores = found[best], scores[best]
        return found, scores, seen


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1)
                keys, words, weights = row.column("asked")[0].values.flatten()
                ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
                weights = weights.flatten().to_numpy(zero_copy_only=False)
                coded = words.flatten().dictionary_encode()
                terms, segment = coded.indices.to_numpy(), _Segment(row, coded.dictionary)
                item, doc, null, score = [], [], [], []
                for j, (key, end) in enumerate(zip(keys.to_pylist(), ends.tolist(), strict=True)):
                    start = 0 if j == 0 else int(ends[j - 1])
                    places, scores, _ = segment.search(terms[start:end], weights[start:end], k)
                    item.append(np.full(len(places), key, np.int64))
                    doc.append(segment.doc[places])
                    null.append(segment.null[places])
                    score.append(scores)
                if item:
                    ids = pa.array(np.concatenate(doc), pa.int64(), mask=np.concatenate(null))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item)), ids, pa.array(np.concatenate(score))], names=["key", "doc", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id and score."""
    spark = index.sparkSession
    asked = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct().withColumn("key", F.xxhash64("item", "text"))
    asked = stored(asked, "items")
    counted = asked.select(F.col("key").alias("doc"), "text").mapInArrow(_counted, "doc long, n long, terms array<string>, tfs array<int>, turn long")
    terms = stored(counted.select(F.col("doc").alias("key"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("key", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")), "item-terms")
    n = index.select(F.coalesce(F.sum(F.size("doc")), F.lit(0))).first()[0]
    wanted = small_side(stored(terms.select("term").distinct(), "wanted"))
    held = index.select(F.explode(F.arrays_zip("term", "df")).alias("t")).select(F.col("t.term").alias("term"), F.col("t.df").alias("df"))
    df = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    n_blocks = -(-terms.count() // block_terms) or 1
    weighed = terms.join(df, "term").select("key", "term", (F.col("times") * weight).alias("weight"))
    per_item = weighed.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select(F.pmod(F.col("key"), F.lit(n_blocks)).alias("block"), F.struct("key", F.col("t.term").alias("words"), F.col("t.weight").alias("weights")).alias("one"))
    blocks = stored(per_item.groupBy("block").agg(F.collect_list("one").alias("asked")), "blocks")
    found = []
    with single_rows(spark):
        for b in range(n_blocks):
            met = index.join(F.broadcast(blocks.where(F.col("block") == b).select("asked")))  # one row of bounded size
            found.append(stored(met.mapInArrow(_searched(k), "key long, doc long, score long"), f"found-{b}"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item"), "key").select(F.col("item").alias(item_id), F.col("rank").cast("int"), F.col("doc").alias("doc_id"), "score")


def oracle(docs: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """DuckDB SQL of the query over search(): every document scored."""
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ts FROM {docs} WHERE text IS NOT NULL),
k AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
a AS (SELECT count(*) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM k),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM k) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * cn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, a GROUP BY t, cn),
m AS (SELECT r, doc_id, 25 + (75 * n * cn) // cl AS m FROM k, a),
i AS (SELECT row_number() OVER () AS i, item_id, ts FROM (SELECT DISTINCT item_id, {found} AS ts FROM {items} WHERE text IS NOT NULL)),
q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(ts) AS t FROM i) GROUP BY i, item_id, t),
s AS (
  SELECT q.i, q.item_id, m.r, m.doc_id, CAST(sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN m ON m.r = p.r GROUP BY q.i, q.item_id, m.r, m.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {k}"""
