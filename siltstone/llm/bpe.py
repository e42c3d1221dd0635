"""Byte-level BPE in numpy: all distinct pieces of a slice of texts are merged side by side.

Texts are split by the vocabulary's pattern. The distinct pieces of a slice that are no tokens
themselves go into matrices by length (up to 4, 8, 16, ... bytes), one row a piece, padded. In every
round each row merges its leftmost pair of minimum rank; the pair's rank comes from a hash table
over all pairs that can merge. Merged rows are closed up, finished rows leave the matrix. Only
the two pairs beside a merge are looked up anew, so a round costs one move of the row. As that
is square in a piece's length, pieces above LONG bytes (runs without a space) merge by a heap of
pairs instead, in the same order: lowest rank first, of equal ones the leftmost.

Defined results: null text is the empty text, with no ids; texts are never cut; repeated rows
give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textnum import slices, spread

NONE = np.iinfo(np.int32).max
KNOWN = 400_000
LONG = 2048


class Vocabulary:
    """Tokens by id, and the hash table of pairs that merge."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.decimal = [str(i).encode() for i in range(size)]
        left, right, made = [], [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                if (a := self.rank.get(token[:cut])) is not None and (b := self.rank.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.made = {(a << 32) | b: r for a, b, r in zip(left, right, made, strict=True)}
        self._forget()
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        self.bits = max(4, int(len(made) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = (left << 32) | right
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[at[todo]] < 0
            chosen, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[chosen], self.values[chosen] = keys[put], made[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs; NONE where a pair does not merge or a side is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(keys.shape, NONE, np.int32)
        at = self._slot(keys)
        seen = self.keys[at]
        hit = seen == keys
        out[hit] = self.values[at[hit]]
        open_ = np.nonzero(~hit & (seen >= 0) & (keys >= 0))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            where = tuple(x[hit] for x in open_)
            out[where] = self.values[at[where]]
            rest = ~hit & (seen >= 0)
            open_ = tuple(x[rest] for x in open_)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one pool, with each piece's start and length there."""
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        pool, filled = [np.zeros(0, np.int32)], 0
        for i in np.flatnonzero(sizes > LONG):
            ids = self._merge_long(pieces[i])
            start[i], length[i] = filled, len(ids)
            pool.append(ids)
            filled += len(ids)
        for width in np.unique(widths[sizes <= LONG]):
            members = np.flatnonzero((widths == width) & (sizes <= LONG))
            rows = max(1, (1 << 21) // int(width))  # bounds a matrix to some two million cells
            for i in range(0, len(members), rows):
                for done, n, ids in self._merge_matrix(pieces, members[i : i + rows], sizes, int(width)):
                    length[done] = n
                    start[done] = filled + np.cumsum(n) - n
                    pool.append(ids)
                    filled += len(ids)
        return start, length, np.concatenate(pool)

    def _merge_matrix(self, pieces: list[bytes], members: np.ndarray, sizes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        joined = np.frombuffer(b"".join([pieces[i] for i in members]), np.uint8)
        n = sizes[members]
        ids = np.full((len(members), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.of_byte[joined]
        ranks = np.full((len(members), width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(members):
            j = ranks.argmin(1)
            row = np.arange(len(members))
            best = ranks[row, j]
            done = best == NONE
            if done.any():
                ended = ids[done]
                yield members[done], n[done], ended[ended >= 0]
                keep = ~done
                ids, ranks, members, n, j, best = ids[keep], ranks[keep], members[keep], n[keep], j[keep], best[keep]
                if not len(members):
                    break
                top = int(n.max())
                ids, ranks, columns = ids[:, :top], ranks[:, :top], columns[:top]
                row = np.arange(len(members))
            ids[row, j] = best
            source = np.minimum(columns + (columns > j[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, 1)
            source = np.minimum(columns + (columns >= j[:, None]), ids.shape[1] - 1)
            ranks = np.take_along_axis(ranks, source, 1)
            n = n - 1
            ids[row, n], ranks[row, n], ranks[row, n - 1] = -1, NONE, NONE
            inner = j < n - 1
            ranks[row[inner], j[inner]] = self.pair_ranks(ids[row[inner], j[inner]], ids[row[inner], j[inner] + 1])
            inner = j > 0
            ranks[row[inner], j[inner] - 1] = self.pair_ranks(ids[row[inner], j[inner] - 1], ids[row[inner], j[inner]])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece: a heap of (rank, place) over a linked list, n log n in its length."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(r), int(i)) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        of, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        current = ranks.tolist() + [NONE]  # the rank of the pair that begins at a place; NONE once the place is gone
        made = self.made

        def renew(i: int) -> None:
            rank = made.get((of[i] << 32) | of[after[i]], NONE) if after[i] < n else NONE
            current[i] = rank
            if rank != NONE:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if current[i] != rank:
                continue
            gone = after[i]
            of[i], after[i], current[gone] = rank, after[gone], NONE
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        out, i = [], 0
        while i < n:
            out.append(of[i])
            i = after[i]
        return np.array(out, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Add pieces to those whose ids are known."""
        raw = [p.encode() for p in new]
        whole = np.array([self.rank.get(p, -1) for p in raw], np.int64)
        start, length = np.zeros(len(raw), np.int64), np.ones(len(raw), np.int64)
        direct, rest = np.flatnonzero(whole >= 0), np.flatnonzero(whole < 0)
        start[direct] = len(self.pool) + np.arange(len(direct))
        at, n, pool = self.merge([raw[i] for i in rest])
        start[rest], length[rest] = len(self.pool) + len(direct) + at, n
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.at = np.concatenate((self.at, start))
        self.n = np.concatenate((self.n, length))
        self.pool = np.concatenate((self.pool, whole[direct].astype(np.int32), pool))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.n, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and len + 1 offsets."""
        pieces: list[str] = []
        upto = [0]
        for text in texts:
            pieces += self.split(text)
            upto.append(len(pieces))
        distinct = set(pieces)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN:  # start afresh, which bounds the memory
            self._forget()
            new = distinct
        if new:
            self._learn(list(new))
        code = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ends = np.concatenate(([0], np.cumsum(self.n[code])))
        return self.pool[spread(self.at[code], self.n[code])], ends[upto]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in a row, and where each id's bytes begin (len + 1)."""
        length = self.length[ids]
        return self.bytes[spread(self.start[ids], length)], np.concatenate(([0], np.cumsum(length)))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the bytes that the ids stand for) of every text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                ids, at = own.encode([t or "" for t in part.column("text").to_pylist()])
                raw, begin = own.decode(ids)
                arrays = [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                    pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(begin[at].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sha256_of_ids(ids: list[int]) -> str:
    """The digest that the query gives, for tests."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
