"""Cutting texts where no token can cross, so that repeated pieces are encoded once.

In the tokenizers used here no token and no pre-token reaches from a character that is not white space into a
space or line feed after it. A text's ids are therefore those of its segments, joined, where each segment starts
with the white space before a word. ``SegmentMemo`` keeps what each segment gave; it is emptied when full, so a
worker's memory is bounded whatever the texts are.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CLOSE = re.compile(r"[\s▁][ \n]")
_SAFE = re.compile(r"(?<=[^\s▁])(?=[ \n])")

#: Bytes of text that are taken together; segments longer than LONG are not kept for long.
BATCH_BYTES = 2_000_000
MEMO_SEGMENTS = 800_000
LONG = 64


_resident: dict[Hashable, Any] = {}


def resident(owner: Hashable, build: Callable[[], Any]) -> Any:
    """The large tables of an operator in this worker; those of the operator before are given up for them.

    Spark keeps Python workers between stages, so without this a pipeline's workers would hold all stages' tables.
    """
    if owner not in _resident:
        _resident.clear()
        gc.collect()
        _resident[owner] = build()
    return _resident[owner]


def release(tables: bool = False) -> None:
    """Give memory that is free inside this worker back to the machine, with ``tables`` also an operator's large tables.

    Spark keeps workers beside its executors between stages; what they hold on to is missing there.
    """
    if tables:
        _resident.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], tables: bool = False) -> Callable[[Iterator], Iterator]:
    """A function over batches that releases memory at its end."""

    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        release(tables)

    return outer


def segments(text: str) -> list[str]:
    """Pieces that give ``text`` when joined; the empty text has none."""
    if not text:
        return []
    if "\0" in text or _CLOSE.search(text):
        return _SAFE.split(text)
    # every space and line feed follows something else: a cut before each of them
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return cut if cut[0] else cut[1:]


def by_bytes(column: pa.Array | pa.ChunkedArray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Slices of a text column with about ``limit`` bytes each, as (first row, texts); null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, before = 0, 0
    while first < len(column):
        stop = min(int(np.searchsorted(ends, before + limit)) + 1, len(column))
        yield first, [t or "" for t in column.slice(first, stop - first).to_pylist()]
        first, before = stop, int(ends[stop - 1])


class SegmentMemo:
    """Looks segments up; those it has not met are encoded together by ``encode``.

    Two generations of at most ``limit`` / 2 segments: what is used moves to the younger one, and the older one goes
    when the younger is full.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence], limit: int = MEMO_SEGMENTS) -> None:
        self.encode, self.half, self.young, self.old = encode, limit // 2, {}, {}

    def look_up(self, cut: list[list[str]]) -> dict:
        young, old = self.young, self.old
        new = {s for own in cut for s in own if s not in young}
        seen = new & old.keys()
        missing = list(new - seen)
        got = dict(zip(missing, self.encode(missing), strict=True)) if missing else {}
        young.update((s, old[s]) for s in seen)
        young.update(got)
        out = young
        if len(young) > self.half:
            self.old, self.young = {s: v for s, v in young.items() if len(s) <= LONG}, {}
        return out


def in_chunks(parts: list[str], size: int = 4096) -> Iterator[list[str]]:
    for i in range(0, len(parts), size):
        yield parts[i : i + size]
