"""Hashes of words and word shingles over Arrow batches, as numpy operations on their bytes.

Words are runs of anything but the six ASCII white-space characters, with A-Z lower-cased. A word's 64-bit hash takes
its bytes eight at a time, mixing after each, so that no pattern inside a word cancels out; long words are hashed by
BLAKE2. A shingle's hash combines its words' in order. All constants come from a fixed mixing function, so hashes agree
between runs and machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from banstream.llm.segments import resident

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_SPACES = b" \t\n\x0b\x0c\r"

#: Bytes of text that are hashed at once.
SLICE_BYTES = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that makes every bit depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _BASE)


def _inverse(odd: np.uint64) -> np.uint64:
    x = odd
    for _ in range(6):  # each step doubles the number of right bits
        x = x * (np.uint64(2) - odd * x)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 64
#: The low bytes of a 64-bit number, by how many.
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(_SPACES, np.uint8))
_PLACE = random64(2, 64) | np.uint64(1)
with np.errstate(over="ignore"):
    _UNBASE = _inverse(_BASE)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    size = SLICE_BYTES if n <= SLICE_BYTES else 1 << n.bit_length()

    def build() -> list[np.ndarray]:
        tables = []
        for base in (_BASE, _UNBASE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        return tables

    power, unpower = resident(("powers", size), build)
    return power[:n], unpower[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column without nulls: first row, bytes, and the rows' offsets in these (one more than rows)."""
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        first = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of every row (one more than rows), and the words' start and end bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    length = end - start
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[data]
    eight = np.ndarray((n,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    hashes = mix(length.astype(np.uint64) * _PLACE[63])
    left, at = np.arange(len(start)), 0
    while len(left := left[(length[left] > at) & (length[left] <= LONG_WORD)]):
        block = eight[start[left] + at] & _BYTES[np.minimum(length[left] - at, 8)]
        hashes[left] = mix(hashes[left] ^ block) + _PLACE[at // 8]
        at += 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]], digest_size=8).digest(), "little")
    return hashes, np.searchsorted(start, offsets), start, end


def shingle(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row, and each row's first run.

    A row with fewer words, but some, has its whole sequence as the only run.
    """
    counts = np.diff(first)
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], runs)
    stop = np.repeat(first[1:], runs)
    out = np.zeros(len(at), np.uint64)
    for j in range(min(size, int(counts.max(initial=0)))):
        there = at + j < stop
        out += np.where(there, (hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] + np.uint64(j + 1)) * _PLACE[j], np.uint64(0))
    return mix(out), begin


def row_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, with how often they occur, and each row's first."""
    values = values.copy()
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[begin[:-1][begin[:-1] < len(values)]] = True
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values))), np.searchsorted(at, begin)
