"""Byte-level BPE encoding and decoding (operator 9).

A text is cut by the tokenizer's pattern; each distinct piece of a batch that is not itself a
token goes, with the pieces of about its length, into one padded numpy matrix. In each round
every row merges its leftmost pair of minimum rank (pairs are looked up in an open-addressing
hash table), the freed cells are compacted away, and rows without a pair left go out. A piece
beyond MATRIX_BYTES is a matrix of one row, in which a round merges the leftmost minimum-rank
pair and, going on to the right, all others of the same rank, up to the first that makes a pair
of lower rank: the same merges in the same order, in fewer rounds.

Defined results: a null text encodes to no ids, as the empty text does; null ids decode to
empty bytes. Rows are independent, so repeated rows, any other columns and empty tables
pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfspark.llm.common import append_arrow

#: Longer pieces are rows of their own.
MATRIX_BYTES = 256
#: Pieces a worker remembers between batches.
CACHE_PIECES = 120_000
#: Bytes of text and ids that are worked on at a time.
ENCODE_BYTES = 2 << 20
DECODE_IDS = 1 << 19
NONE = np.int64(1) << np.int64(40)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined token, in an open-addressing table of numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left_k, left_v = np.array(keys, np.int64), np.array(values, np.int64)
        probe = 0
        while len(left_k):
            slot = self._slot(left_k, probe)
            free = np.flatnonzero(self.keys[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = left_k[free[first]], left_v[free[first]]
            rest = np.ones(len(left_k), bool)
            rest[free[first]] = False
            left_k, left_v, probe = left_k[rest], left_v[rest], probe + 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none; negative ids are padding."""
        out = np.full(left.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo] << np.int64(32) | right.ravel()[todo]
        flat = out.ravel()
        for probe in range(self.probes):
            if not len(todo):
                break
            slot = self._slot(keys, probe)
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            todo, keys = todo[more], keys[more]
        return flat.reshape(left.shape)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        # The same pattern for texts of ASCII characters alone.
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(r"\p{N}", "0-9").replace(" ?0-9+", " ?[0-9]+"), re.ASCII) if pattern.count(r"\p{") == 4 else self.split
        self.pairs = PairTable(ranks)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # Two generations of remembered pieces: the older one goes when the newer is full.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge_matrix(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of pieces of similar length, merged round by round in one padded matrix."""
        width = max(map(len, rows))
        ids = np.full((len(rows), width), -1, np.int64)
        inside = np.arange(width) < np.fromiter(map(len, rows), np.int64, len(rows))[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[list[int]] = [[]] * len(rows)
        who = np.arange(len(rows))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(who):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(who), np.int64)
            best = rank[np.arange(len(who)), at] if rank.shape[1] else np.full(len(who), NONE)
            over = best == NONE
            if over.any():
                for i, row in zip(who[over].tolist(), ids[over].tolist(), strict=True):
                    out[i] = row
                who, ids, rank, at, best = (x[~over] for x in (who, ids, rank, at, best))
                if not len(who):
                    break
            n = np.arange(len(who))
            ids[n, at] = best
            take = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take + (take > at[:, None]), axis=1)
            take = take[:-1]
            rank = np.take_along_axis(rank, take + (take >= at[:, None]), axis=1)
            right = at < rank.shape[1]
            rank[n[right], at[right]] = self.pairs.find(ids[n[right], at[right]], ids[n[right], at[right] + 1])
            left = at > 0
            rank[n[left], at[left] - 1] = self.pairs.find(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        return [row[: row.index(-1)] if row and row[-1] == -1 else row for row in out]

    def merge_row(self, row: bytes) -> list[int]:
        """Ids of one long piece; a round merges all leftmost pairs of the least rank that would follow one another."""
        ids = self.single[np.frombuffer(row, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (best := int(rank.min())) != NONE:
            at = np.flatnonzero(rank == best)
            # of pairs that overlap, every other one from the left
            first = np.concatenate([[True], np.diff(at) != 1])
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]
            # pairs that each merge makes while those to its right still stand
            padded = np.concatenate([[-1], ids, [-1]])
            left = padded[at]
            left[1:] = np.where(at[1:] - at[:-1] == 2, best, left[1:])
            made = np.minimum(self.pairs.find(left, np.full(len(at), best)), self.pairs.find(np.full(len(at), best), padded[at + 3]))
            lower = np.flatnonzero(made < best)
            at = at[: lower[0] + 1] if len(lower) else at
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids[at] = best
            ids, rank = ids[stay], rank[stay[1:]]
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids.tolist()

    def learn(self, new: list[str]) -> None:
        """Put the ids of pieces into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            if (ids := self.older.get(piece)) is not None:
                self.known[piece] = ids
                continue
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = (rank,)
            elif len(raw) > MATRIX_BYTES:
                self.known[piece] = tuple(self.merge_row(raw))
            else:
                buckets.setdefault(len(raw) if len(raw) <= 16 else 1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, rows in buckets.items():
            most = max(1, (1 << 20) // width)
            for i in range(0, len(rows), most):
                part = rows[i : i + most]
                for (piece, _), ids in zip(part, self.merge_matrix([r for _, r in part]), strict=True):
                    self.known[piece] = tuple(ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        cut = [(self.split_ascii if t.isascii() else self.split).findall(t) if t else [] for t in texts]
        self.learn([p for p in set().union(*cut) if p not in self.known] if cut else [])
        find = self.known.__getitem__
        return [[*chain.from_iterable(map(find, c))] for c in cut]

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """The codec of a worker, built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the array<int> column ids of its texts. path: a .tiktoken rank file on every machine."""

    def make() -> Callable:
        own = codec(path, pattern)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(own.encode(batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.list_(pa.int32()))]

        run.done = own.forget  # workers outlive the task; what they remember would stay
        return run

    return append_arrow(df, make, [T.StructField(ids, T.ArrayType(T.IntegerType(), False), True)], sized_by=text, limit=ENCODE_BYTES)


class Decoder:
    """Bytes of ids by gathering from one array of all tokens' bytes."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        ends = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[ids] - upto[:-1], size)
        where += np.arange(len(where))
        cuts = upto[ends - ends[0]].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(self.bytes[where].tobytes())])


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the binary column decoded: the bytes of its ids."""

    def make() -> Callable:
        own = Decoder(path)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            n = np.diff(lists.offsets.to_numpy())
            out, a, full = [], 0, np.cumsum(n)
            while a < len(lists):  # about DECODE_IDS ids at a time
                b = max(a + 1, int(np.searchsorted(full, (full[a - 1] if a else 0) + DECODE_IDS, side="right")))
                out.append(own.decode(lists.slice(a, b - a)))
                a = b
            return [pa.concat_arrays(out) if out else pa.array([], pa.binary())]

        return run

    return append_arrow(df, make, [T.StructField(decoded, T.BinaryType(), True)])
