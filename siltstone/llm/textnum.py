"""Whole columns of text as flat numpy arrays: words, lines, windows and their hashes.

Used inside Arrow tasks. A batch is worked on in slices of a few MB, so memory stays bounded
whatever the batch size; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(MULTIPLIER), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U))
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


CODES = {False: _byte_codes(False), True: _byte_codes(True)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"]


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch whose texts have about ``limit`` bytes, at least one row each, with ``flat`` of them."""
    data, at = flat(batch.column(column))
    row, n = 0, len(at) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1))
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(CODES[lower][data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text index (len + 1) of the maximal runs of True bytes that lie in one text."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but ASCII white space."""
    return runs(~WHITE[data], offsets)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k items in a row within a text, in order, and their per-text index (len + 1)."""
    counts = np.diff(first)
    made = np.maximum(counts - k + 1, 0)
    index = np.concatenate(([0], np.cumsum(made)))
    if index[-1] == 0:
        return np.zeros(0, U), index
    n = len(hashes) - k + 1
    h = hashes[:n].copy()
    for j in range(1, k):
        h = mix(h * MULTIPLIER + hashes[j : j + n])
    at = np.repeat(first[:-1] - index[:-1], made) + np.arange(index[-1])
    return h[at], index


def per_text(index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each text's part."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[index[1:]] - total[index[:-1]]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then start[1] and so on."""
    end = np.cumsum(length)
    if not len(end):
        return np.zeros(0, np.int64)
    return np.repeat(start - (end - length), length) + np.arange(end[-1])
