"""LM scoring (operator 7): a hierarchical Pitman-Yor model of words after words, over a spelling model.

Restaurants. Every word (and the end of a text, which is also the context of a text's first
word) is the context of a restaurant whose dishes are the words that follow it. All context
restaurants share one parent, the root restaurant of words: each of their tables is a customer
of it. The root's base distribution spells a word byte by byte: restaurants of one byte of
context under one of bytes, under the uniform distribution over 256 bytes and the end of a
word; every known word is spelt once there.

Seating is sampled by blocked Gibbs: a sweep seats all customers of each dish anew at once, given the
parent's probabilities and the restaurant's tables of the sweep before. What the Chinese-restaurant process
says of c customers and a weight w of a new table (strength + discount * tables of the restaurant, times the parent's
probability of the dish) is the law of their number of tables t, in proportion to w^t S(c, t) with generalised Stirling
numbers S, at which single customers that leave and sit down again would arrive after many steps; only this number
enters any probability, so it alone is drawn, exactly up to STIRLING customers. Beyond them the law hardly changes with c:
that of the next smaller of a scale of numbers of customers is taken (steps of 5 %, to LAST). Laws that reach beyond
WIDEST tables are drawn from the normal law with the saddle point's mean and variance. The first sweep (every dish at
one table) is burnt in; predictive probabilities are averaged over the SAMPLES that follow it.

score is the model's log10 probability of the text, unknown words spelt; base_score takes them
as one symbol, as the contract says.

Distribution. Texts are tokenised into blocks of about BLOCK_BYTES, stored bucketed by block
so that they never move again. A block sends its words and its pairs of neighbours, sorted by
hash, as packed slices to hash ranges; a range holds about RANGE_ITEMS of them whatever the
corpus, a frequent word or pair is one item of each block, and nothing is grouped by word or
context alone. A range counts, and answers each block in the order of its slice, so that
answers need no keys. Pairs are told apart by 56 bits of hash, words by 64. The seating of a pair
is drawn from random numbers that are a hash of the pair, so all blocks that hold it draw the
same one and only one of them, its owner, reports its tables. Of the model only the spelling
counts reach the driver: at most 257 * 257, by the alphabet.

Defined results: a null text is empty and has one token, its end. A null id hashes as ''.
Rows are independent (repeated rows score alike); an empty table gives no rows; without training
rows all words are spelt under the uniform root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import bucketed, mix, over_groups, placed_words, single_rows, stored

BLOCK_BYTES = 4 << 20
SAMPLES = 2
#: Customers up to which each number has its own law of tables; the largest number that has one; tables that a law reaches.
STIRLING, LAST, WIDEST = 512, 1 << 14, 256
STRENGTH = 1.0
SPELL_DISCOUNT, SPELL_STRENGTH, SPELL_SWEEPS = 0.5, 1.0, 20
#: Words or pairs, summed over blocks, of a hash range.
RANGE_ITEMS = 500_000
SEED = 4711
START = END = 256
WIDE = 257
_ODD = np.uint64(0x9E3779B97F4A7C15)


def crc_column(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


# seating


def uniform(key: np.ndarray, number: int) -> np.ndarray:
    """Numbers of [0, 1) by key; number: which of a key's."""
    return (mix(key + np.uint64((number + 1) * int(_ODD) & (2**64 - 1))) >> np.uint64(11)) * 2.0**-53


@lru_cache(maxsize=4)
def stirling(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(customers, log S): the numbers of customers that have a law, rising from 1, and log generalised Stirling numbers for 1 to WIDEST tables."""
    kept, rows = [1], [np.concatenate([[0.0], np.full(WIDEST - 1, -np.inf)])]
    now, t = rows[0], np.arange(1, WIDEST + 1)
    for n in range(1, LAST):
        with np.errstate(divide="ignore"):
            stay = now + np.log(np.maximum(n - t * discount, 0))
        now = np.logaddexp(stay, np.concatenate([[-np.inf], now[:-1]]))
        if n + 1 <= STIRLING or n + 1 >= kept[-1] * 1.05:
            kept.append(n + 1)
            rows.append(now)
    return np.array(kept), np.array(rows)


def many_tables(c: np.ndarray, weight: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables by the normal law, for weights that make many: sizes of tables are Poisson, given their sum c, at the saddle point y."""
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # log y; weight (1 - y) y^(discount - 1) falls with y
    for _ in range(60):
        middle = (low + high) / 2
        more = np.log(weight) + np.log1p(-np.exp(middle)) + (discount - 1) * middle > np.log(c)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    y = np.exp((low + high) / 2)
    mean = weight / discount * (1 - y**discount)
    squares = c + (1 - y) ** 2 * weight * (1 - discount) * y ** (discount - 2)
    spread = np.sqrt(np.maximum(mean - c / squares * c, 0))
    normal = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
    return np.clip(np.rint(mean + spread * normal), 1, c).astype(np.int64)


def seat(c: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish in a sweep. c: customers; weight: of a new table; key: the dish's, from which its random numbers come."""
    tables = np.minimum(c, 1).astype(np.int64)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return tables
    u, weight, n = uniform(key[many], 2 * sweep), np.maximum(weight[many], 1e-300), c[many]
    # Two customers: w (1 - d) for one table against w^2 for two.
    out = 1 + (u * (weight + 1 - discount) >= 1 - discount).astype(np.int64)
    more = np.flatnonzero(n > 2)
    likely = weight[more] / discount
    reach = np.minimum(np.minimum(n[more], (2 * likely + 10 * np.sqrt(likely) + 12)), WIDEST + 1).astype(np.uint16)
    wide = more[reach > WIDEST]
    if len(wide):
        out[wide] = many_tables(n[wide].astype(np.float64), weight[wide], discount, u[wide], uniform(key[many[wide]], 2 * sweep + 1))
    order = np.argsort(reach, kind="stable")[: len(more) - len(wide)]
    reach, order = reach[order].astype(np.int64), more[order]
    customers, logs = stirling(discount)
    row = np.where(n <= STIRLING, n - 1, 0)
    row[n > STIRLING] = np.searchsorted(customers, n[n > STIRLING], side="right") - 1
    log_weight, a = np.log(weight), 0
    while a < len(order):
        b = int(np.searchsorted(reach, reach[a] * 5 // 4, side="right"))
        b = min(b, a + max(1, (1 << 18) // int(reach[b - 1])))
        part = order[a:b]
        t = np.arange(1, int(reach[b - 1]) + 1)
        p = logs[row[part], : len(t)] + log_weight[part][:, None] * t
        p -= p.max(axis=1)[:, None]
        p = np.cumsum(np.exp(p, out=p), axis=1, out=p)
        out[part] = np.minimum((p <= (u[part] * p[:, -1])[:, None]).sum(axis=1), len(t) - 1) + 1
        a = b
    tables[many] = np.minimum(out, n)
    return tables


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


# spelling


def spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (byte before * 257 + symbol) of all symbols of the words, each with its end, and where each word's codes start."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(size)])[:-1]
    symbol = np.full(int(size.sum()), END, np.int64)
    inside = np.ones(len(symbol), bool)
    inside[starts + size - 1] = False
    symbol[inside] = np.frombuffer(b"".join(words), np.uint8)
    before = np.concatenate([[START], symbol[:-1]])[: len(symbol)]
    before[starts] = START
    return before * WIDE + symbol, starts


def spelling(counts: np.ndarray) -> np.ndarray:
    """log probability of each symbol after each byte, 257 by 257, averaged over Gibbs sweeps; counts: customers, 257 by 257."""
    tables = np.minimum(counts, 1)
    keys = mix(np.arange(WIDE * WIDE + WIDE, dtype=np.uint64) + np.uint64(SEED))
    total = np.zeros((WIDE, WIDE))
    top = np.zeros(WIDE, np.int64)
    for sweep in range(SPELL_SWEEPS):
        below = tables.sum(axis=0)
        top = seat(below, (SPELL_STRENGTH + SPELL_DISCOUNT * top.sum()) / WIDE * np.ones(WIDE), SPELL_DISCOUNT, keys[-WIDE:], sweep)
        root = (below - SPELL_DISCOUNT * top + (SPELL_STRENGTH + SPELL_DISCOUNT * top.sum()) / WIDE) / (SPELL_STRENGTH + below.sum())
        fresh = SPELL_STRENGTH + SPELL_DISCOUNT * tables.sum(axis=1)
        tables = seat(counts.ravel(), np.multiply.outer(fresh, root).ravel(), SPELL_DISCOUNT, keys[: WIDE * WIDE], sweep).reshape(WIDE, WIDE)
        if sweep >= SPELL_SWEEPS // 2:
            fresh = SPELL_STRENGTH + SPELL_DISCOUNT * tables.sum(axis=1)
            total += (counts - SPELL_DISCOUNT * tables + np.multiply.outer(fresh, root)) / (SPELL_STRENGTH + counts.sum(axis=1))[:, None]
    return np.log(total / (SPELL_SWEEPS - SPELL_SWEEPS // 2))


def spell(words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Probability of each word's spelling."""
    if not words:
        return np.empty(0)
    code, starts = spelt(words)
    return np.exp(np.add.reduceat(logp.ravel()[code], starts))


# packed slices


def planes(a: np.ndarray) -> bytes:
    """An array byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplane(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_small(a: np.ndarray) -> bytes:
    """Whole numbers: a byte each, those of 255 and more after it in four."""
    few = np.minimum(a, 255).astype(np.uint8)
    return np.uint32(len(a)).tobytes() + few.tobytes() + a[few == 255].astype(np.uint32).tobytes()


def unpack_small(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    a = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    a[a == 255] = np.frombuffer(data, np.uint32, -1, 4 + n)
    return a


def pack_sorted(a: np.ndarray) -> bytes:
    """Rising 64-bit numbers by their differences, in as many bytes as the largest needs."""
    if not len(a):
        return b""
    step = np.diff(a)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return bytes([width]) + a[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    low = np.frombuffer(data, np.uint8, -1, 9).reshape(width, -1).T
    step = np.zeros((len(low), 8), np.uint8)
    step[:, :width] = low
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), step.view(np.uint64).ravel()]), dtype=np.uint64)


def hash_words(joined: bytes) -> np.ndarray:
    """64-bit hashes of words joined by line ends; an empty word has one too."""
    data = np.frombuffer(joined + b"\n", np.uint8)
    end = np.flatnonzero(data == 10)
    size = np.diff(end, prepend=-1) - 1
    out = np.full(len(end), mix(np.array([SEED], np.uint64))[0])
    a = 0
    while a < len(end):
        b = max(a + 1, int(np.searchsorted(end, end[a] + (1 << 18))))
        part = data[end[a] - size[a] : end[b - 1] + 1]
        out[a:b][size[a:b] > 0] = placed_words(part, np.array([len(part)]))[0]
        a = b
    return out


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit hash; rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def slices(sorted_hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the ranges that occur."""
    if len(sorted_hashes):
        r = range_of(sorted_hashes, ranges)
        cut = np.flatnonzero(np.diff(r)) + 1
        yield from zip(r[np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(r)], strict=True)


# blocks


def blocks(docs: DataFrame) -> DataFrame:
    """Tokenised blocks of docs (id, held, text): block, n_words, words (in the order of their hashes, joined), ids, held, lengths, tokens (numbers of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        state: dict = {}

        def fresh() -> None:
            state.update(vocab={b"": 0}, ids=[], held=[], lengths=[], tokens=[], size=0)

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(state["tokens"])
            words = list(state["vocab"])
            order = np.argsort(hash_words(b"\n".join(words)))
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            joined = b"\n".join([words[i] for i in order.tolist()])
            arrays = [
                pa.array([part << 32 | number], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([joined], pa.binary()), pa.array([state["ids"]], pa.list_(pa.int64())),
                pa.array([state["held"]], pa.list_(pa.bool_())), pa.array([state["lengths"]], pa.list_(pa.int32())), pa.array([planes(rank[tokens])], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "n_words", "words", "ids", "held", "lengths", "tokens"])

        fresh()
        for batch in batches:
            for i, held, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                text = (text or "").encode().lower()
                vocab = state["vocab"]
                own = [vocab.setdefault(w, len(vocab)) for w in text.split()]
                own.append(0)
                state["tokens"].append(np.array(own, np.int32))
                state["ids"].append(i)
                state["held"].append(held)
                state["lengths"].append(len(own))
                state["size"] += len(text)
                if state["size"] >= BLOCK_BYTES:
                    yield out()
                    number += 1
                    fresh()
        if state["ids"]:
            yield out()

    return docs.mapInArrow(run, "block long, n_words long, words binary, ids array<long>, held array<boolean>, lengths array<int>, tokens binary")


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, and the place of each number among them; small ones are sorted with their places in the low bits."""
    bits = max(1, len(code)).bit_length()
    if not len(code) or int(code.max()).bit_length() + bits > 62:
        return np.unique(code, return_inverse=True)
    both = np.sort(code << bits | np.arange(len(code)))
    value = both >> bits
    new = np.concatenate([[True], value[1:] != value[:-1]])
    place = np.empty(len(code), np.int64)
    place[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return value[new], place


class Block:
    """A block's words in the order of their hashes, and its distinct pairs of neighbours in the order of theirs."""

    def __init__(self, row: dict, pairs: bool = True):
        self.joined = row["words"]
        self.hash = hash_words(self.joined)
        n = len(self.hash)
        self.tokens = unplane(row["tokens"], np.int32).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.counts = np.bincount(self.tokens[self.train], minlength=n)
        if pairs:
            # a text ends with the end, which is the context of the next one's first word
            code, at = distinct(np.concatenate([self.tokens[-1:], self.tokens[:-1]]) * n + self.tokens)
            u, v = np.divmod(code, n)
            h = mix(self.hash[u] * _ODD + (self.hash[v] ^ np.uint64(SEED))) & ~np.uint64(255)
            order = np.argsort(h)
            self.u, self.v, self.pair_hash = u[order], v[order], h[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.pair_of = rank[at]
            self.pair_counts = np.bincount(self.pair_of[self.train], minlength=len(order))


def told(answers: list[dict], kind: str, part: int) -> list[bytes]:
    """The parts of the answers of a kind, in the order of ranges."""
    return [a["parts"][part] for a in sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["range"])]


def _per_block(batches: Iterator[pa.RecordBatch], f) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from f(batch.slice(i, 1).to_pylist()[0])


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("parts", pa.list_(pa.binary()))])
SENT = "range int, block long, parts array<binary>"
ANSWERS = "kind string, range int, block long, parts array<binary>, stats array<double>"
_ANSWERS = pa.schema([("kind", pa.string()), ("range", pa.int32()), ("block", pa.int64()), ("parts", pa.list_(pa.binary())), ("stats", pa.list_(pa.float64()))])


def send_words(cut: DataFrame, ranges: int) -> DataFrame:
    """The words of each block and their training counts, by hash range."""

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        b = Block(row, pairs=False)
        words = b.joined.split(b"\n")
        yield _rows(_SENT, [{"range": r, "block": row["block"], "parts": [b"\n".join(words[i:j]), pack_small(b.counts[i:j])]} for r, i, j in slices(b.hash, ranges)])

    return cut.select("block", "words", "held", "lengths", "tokens").mapInArrow(lambda batches: _per_block(batches, one), SENT)


def count_words(sent: DataFrame) -> DataFrame:
    """Answers 'count' (training counts of each block's words) and a row 'dishes' a range: words, counts, hashes, blocks and, for each, places among the words."""

    def f(group: pa.Table) -> pa.RecordBatch:
        rows = group.to_pylist()
        words = [r["parts"][0].split(b"\n") for r in rows]
        ends = np.cumsum([len(w) for w in words])
        every = [w for own in words for w in own]
        h, first, place = np.unique(hash_words(b"\n".join(every)), return_index=True, return_inverse=True)
        c = np.bincount(place, np.concatenate([unpack_small(r["parts"][1]) for r in rows]), len(h)).astype(np.int64)
        place = np.split(place, ends[:-1])
        out = [{"kind": "count", "range": r["range"], "block": r["block"], "parts": [pack_small(c[p])], "stats": []} for r, p in zip(rows, place, strict=True)]
        dishes = [b"\n".join(every[i] for i in first.tolist()), pack_small(c), *[planes(p.astype(np.int32)) for p in place]]
        stats = [float(c.sum()), float((c > 0).sum()), float((c == 1).sum()), float((c == 2).sum()), float(len(c))]
        order = np.array([r["block"] for r in rows], np.int64).tobytes()
        return _rows(_ANSWERS, [*out, {"kind": "dishes", "range": rows[0]["range"], "block": None, "parts": [order, *dishes], "stats": stats}])

    return over_groups(sent, "range", f, ANSWERS, also=("block",))


def send_pairs(cut: DataFrame, ranges: int) -> DataFrame:
    def one(row: dict) -> Iterator[pa.RecordBatch]:
        b = Block(row)
        # 56 bits tell pairs apart
        yield _rows(_SENT, [{"range": r, "block": row["block"], "parts": [pack_sorted(b.pair_hash[i:j] >> np.uint64(8)), pack_small(b.pair_counts[i:j])]} for r, i, j in slices(b.pair_hash, ranges)])

    return cut.select("block", "words", "held", "lengths", "tokens").mapInArrow(lambda batches: _per_block(batches, one), SENT)


def count_pairs(sent: DataFrame) -> DataFrame:
    """Answers 'pair' (twice the training count of each block's pairs, and one for the block that owns it)."""

    def f(group: pa.Table) -> pa.RecordBatch:
        rows = group.to_pylist()
        keys = [unpack_sorted(r["parts"][0]) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        c = np.bincount(place, np.concatenate([unpack_small(r["parts"][1]) for r in rows]), len(distinct)).astype(np.int64)
        twice = 2 * c[place]
        twice[first] += 1
        out = [{"kind": "pair", "range": r["range"], "block": r["block"], "parts": [pack_small(x)], "stats": []} for r, x in zip(rows, np.split(twice, ends[:-1]), strict=True)]
        out[0]["stats"] = [float((c == 1).sum()), float((c == 2).sum()), float(len(c))]
        return _rows(_ANSWERS, out)

    return over_groups(sent, "range", f, ANSWERS, also=("block",))


class Root:
    """What a sweep needs of the root restaurant: discounts, its customers and tables."""

    def __init__(self, discount: float, pair_discount: float, customers: float, tables: float):
        self.discount, self.pair_discount, self.customers, self.tables = discount, pair_discount, customers, tables

    def p(self, own: np.ndarray, base: np.ndarray) -> np.ndarray:
        return (own + (STRENGTH + self.discount * self.tables) * base) / (STRENGTH + self.customers)


def _floats(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([unplane(x, np.float32) for x in parts]).astype(np.float64)


def pair_tables(c: np.ndarray, u: np.ndarray, v: np.ndarray, key: np.ndarray, root: Root, p: np.ndarray, context_tables: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of pairs (u, v) in a sweep. c: training counts; p: root probability of each word; context_tables: of each word's restaurant."""
    return seat(c, (STRENGTH + root.pair_discount * context_tables[u]) * p[v], root.pair_discount, key, sweep)


def first_tables(both: DataFrame, ranges: int) -> DataFrame:
    """One table for each pair that a block owns, summed by its word and by its context, by range; as range -1 what later sweeps need of the block: those pairs."""

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        b = Block(row)
        twice = np.concatenate([unpack_small(x) for x in told(row["answers"], "pair", 0)])
        c, own = twice >> 1, (twice & 1) > 0
        once, many = np.flatnonzero(own & (c == 1)), np.flatnonzero(own & (c > 1))
        fixed = [np.bincount(x[once], minlength=len(b.hash)) for x in (b.v, b.u)]
        n = [f + np.bincount(x[many], minlength=len(b.hash)) for f, x in zip(fixed, (b.v, b.u), strict=True)]
        rows = [{"range": r, "block": row["block"], "parts": [pack_small(x[i:j]) for x in n]} for r, i, j in slices(b.hash, ranges)]
        kept = [pack_sorted(b.pair_hash[many] >> np.uint64(8)), planes(b.u[many].astype(np.int32)), planes(b.v[many].astype(np.int32)), pack_small(c[many]), *map(pack_small, fixed)]
        yield _rows(_SENT, [*rows, {"range": -1, "block": row["block"], "parts": kept}])

    return both.mapInArrow(lambda batches: _per_block(batches, one), SENT)


def next_tables(both: DataFrame, sweep: int, root: Root) -> DataFrame:
    """The tables of a sweep of the pairs that a block owns, summed by word and by context, by range."""

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        answers, last = row["answers"], f"sweep{sweep - 1}"
        key, u, v, c, *fixed = row["parts"]
        key = unpack_sorted(key) << np.uint64(8)
        u, v, c = unplane(u, np.int32), unplane(v, np.int32), unpack_small(c)
        p = root.p(_floats(told(answers, last, 0)), _floats(told(answers, "sweep0", 2)))
        t = pair_tables(c, u, v, key, root, p, _floats(told(answers, last, 1)), sweep)
        n = [unpack_small(f) + np.bincount(x, t, len(p)).astype(np.int64) for f, x in zip(fixed, (v, u), strict=True)]
        ranges = sorted(a["range"] for a in answers if a["kind"] == last)
        ends = np.cumsum([len(x) // 4 for x in told(answers, last, 0)])
        yield _rows(_SENT, [{"range": r, "block": row["block"], "parts": [pack_small(x[i:j]) for x in n]} for r, i, j in zip(ranges, [0, *ends.tolist()], ends.tolist(), strict=False)])

    return both.mapInArrow(lambda batches: _per_block(batches, one), SENT)


def seat_root(dishes: DataFrame, sent: DataFrame, sweep: int, discount: float, tables: float, logp: np.ndarray) -> DataFrame:
    """Answers 'sweep<n>': customers less discounted tables of each word at the root, tables of its own restaurant and, in sweep 0, the probability of its spelling."""
    by_range = sent.groupBy("range").agg(F.collect_list(F.struct("block", "parts")).alias("told"))

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        order, words, c, *places = row["parts"]
        h, words = hash_words(words), words.split(b"\n")
        known = unpack_small(c) > 0
        place = dict(zip(np.frombuffer(order, np.int64).tolist(), [unplane(p, np.int32) for p in places], strict=True))
        n, own = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for x in row["told"]:
            for into, part in zip((n, own), x["parts"], strict=True):
                np.add.at(into, place[x["block"]], unpack_small(part))
        base = spell(words, logp)
        t = seat(n, (STRENGTH + discount * tables) * base, discount, h, sweep)
        answer = [np.asarray(x, np.float32) for x in (n - discount * t, own, *([base] if not sweep else []))]
        assert (n[~known] == 0).all()
        out = [{"kind": f"sweep{sweep}", "range": row["range"], "block": b, "parts": [planes(a[p]) for a in answer], "stats": []} for b, p in place.items()]
        out[0]["stats"] = [float(n.sum()), float(t.sum())]
        yield _rows(_ANSWERS, out)

    return dishes.join(by_range, "range").select("range", "parts", "told").mapInArrow(lambda batches: _per_block(batches, one), ANSWERS)


def totals(answers: DataFrame, n: int) -> list[float]:
    sums = answers.where(F.size("stats") > 0).agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0.0)) for k in range(n)]).first()
    return [float(x) for x in sums]


def spelling_counts(dishes: DataFrame) -> np.ndarray:
    """257 by 257 counts of symbols after bytes over the known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDE * WIDE, np.int64)
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                known = unpack_small(parts[2]) > 0
                words = [w for w, k in zip(parts[1].split(b"\n"), known.tolist(), strict=True) if k]
                if words:
                    total += np.bincount(spelt(words)[0], minlength=WIDE * WIDE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    rows = dishes.select("parts").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(WIDE * WIDE, np.int64)
    counts[rows["code"].to_numpy(np.int64)] = rows["n"]
    return counts.reshape(WIDE, WIDE)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 7, held_rest: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row per row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.pmod(crc_column(id_col), F.lit(modulus)) == held_rest).alias("held"), F.col(text).alias("text"))
    cut = bucketed(blocks(rows), "block", "blocks")
    with single_rows(docs.sparkSession):
        scored, n = _score_blocks(cut)
    return scored.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _score_blocks(cut: DataFrame) -> tuple[DataFrame, int]:
    """(id, held, n_tokens, n_known, base_score, score) of the texts of blocks; the training tokens."""
    entries = cut.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    word_ranges = max(1, -(-entries // RANGE_ITEMS))
    counted = stored(count_words(send_words(cut, word_ranges)), "word-counts")
    n, v, once, twice, _ = totals(counted.where("kind = 'dishes'"), 5)
    discount = discount_of(once, twice)
    dishes = bucketed(counted.where("kind = 'dishes'").select("range", "parts"), "range", "dishes", move=True)
    tokens = cut.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    # a block has at most as many distinct pairs as tokens, about half as many as a rule
    pair_ranges = max(1, -(-tokens // (2 * RANGE_ITEMS)))
    pairs = bucketed(count_pairs(send_pairs(cut, pair_ranges)), "block", "pair-counts", move=True)
    pair_discount = discount_of(*totals(pairs, 3)[:2])
    logp = spelling(spelling_counts(dishes))
    counts = bucketed(counted.where("kind = 'count'"), "block", "counts", move=True)

    def joined(left: DataFrame, *answers: DataFrame) -> DataFrame:
        made, names = left, left.columns
        for k, a in enumerate(answers):
            own = a.groupBy("block").agg(F.collect_list(F.struct("kind", "range", "parts")).alias(f"a{k}"))
            made = made.join(own, "block")
        return made.select(*names, F.concat(*[F.col(f"a{k}") for k in range(len(answers))]).alias("answers"))

    first = bucketed(first_tables(joined(cut.select("block", "words", "held", "lengths", "tokens"), pairs), word_ranges), "block", "tables")
    owned = first.where(F.col("range") < 0).select("block", "parts")
    sweeps: list[DataFrame] = []
    roots: list[Root] = []
    for k in range(1 + SAMPLES):
        sent = next_tables(joined(owned, *dict.fromkeys((sweeps[0], sweeps[-1]))), k, roots[-1]) if k else first.where(F.col("range") >= 0)
        made = bucketed(seat_root(dishes, sent, k, discount, roots[-1].tables if roots else v, logp), "block", f"sweep{k}", move=True)
        sweeps.append(made)
        roots.append(Root(discount, pair_discount, *totals(made, 2)))

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        b, answers = Block(row), row["answers"]
        c = np.concatenate([unpack_small(x) for x in told(answers, "count", 0)])
        pair_c = np.concatenate([unpack_small(x) for x in told(answers, "pair", 0)]) >> 1
        base = _floats(told(answers, "sweep0", 2))
        p = [r.p(_floats(told(answers, f"sweep{k}", 0)), base) for k, r in enumerate(roots)]
        tables = [_floats(told(answers, f"sweep{k}", 1)) for k in range(len(roots))]
        mean = np.zeros(len(b.u))
        for k in range(1, 1 + SAMPLES):
            t = pair_tables(pair_c, b.u, b.v, b.pair_hash, roots[k - 1], p[k - 1], tables[k - 1], k)
            mean += (pair_c - pair_discount * t + (STRENGTH + pair_discount * tables[k][b.u]) * p[k][b.v]) / (STRENGTH + c[b.u])
        logs = np.log10(np.maximum(mean / SAMPLES, 1e-300))
        starts = np.cumsum(b.lengths) - b.lengths
        of_words = [np.add.reduceat(x[b.tokens], starts) for x in ((c > 0).astype(np.int64), np.log10((c + 1.0) / (n + 1.0 * (v + 1))))]
        whole = np.add.reduceat(logs[b.pair_of], starts)
        arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths), *map(pa.array, (*of_words, whole))]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "held", "n_tokens", "n_known", "base_score", "score"])

    ready = joined(cut.select("block", "words", "ids", "held", "lengths", "tokens"), pairs, counts, *sweeps)
    scored = ready.mapInArrow(lambda batches: _per_block(batches, one), "id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return stored(scored, "scores"), int(n)
