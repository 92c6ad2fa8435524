"""Removal of repeated substrings by suffix arrays.

A byte goes when it lies in a string of ``length`` bytes that is also found in a document with a smaller identifier.

*Where to look.* In every string of ``length`` bytes the piece of about half that length with the least hash is its
anchor, so equal strings have equal anchors wherever they are. About one byte in fourteen begins an anchor. What lies
around an anchor, as far as strings of ``length`` bytes with it reach, is its context. Hashes of anchors are dealt to
buckets (four bytes each, as planes of sorted bytes), which return a bit for each: whether another document has it. For
those that are shared, a hash of anchor and context (96 bits beside the bucket) goes to buckets. A context that is also in a smaller
document is covered as a whole. What is left to decide are the first documents of contexts whose anchor has several.

*Suffix arrays.* The different contexts of an anchor, each from its first document, make a string for linear grouping
(``suffix_groups``), many strings at once. Strings of ``length`` bytes that are equal stand side by side in its suffix
array; the least identifier of such a run decides for all of it. A context that has no partner in its anchor's string
which agrees with it on half of what surrounds the anchor, to the left or to the right, can't share such a string and
is left out before.

*Hot anchors* aren't gathered. One in more than ``HOT_PARTS`` parts of the texts may have any number of contexts: these
are dealt by context instead of by anchor. Contexts of such an anchor, and of one that has more than ``HOT`` different
ones (the edges of a common passage), are cut into strings of ``length`` bytes, a place of a text once, however many anchors
it has. A part sends a hash (96 bits) and its least identifier of each different string to buckets, which return a bit for
each: whether a smaller document has it.

Texts are shuffled once, to a table bucketed by part; the later passes over them bring bits and positions to the texts,
not texts to these. A pass ends in a table, which frees the disk that its shuffle took. Numbers go as planes of their bytes,
in the order of hashes where they can, which the shuffle's compression makes small. Parts have ``PART_BYTES``, and more of
very large tables, so that an anchor or context which is everywhere, and costs a bucket one entry for each part, stays
small there. All else is bounded: a bucket by ``BUCKET_ANCHORS`` on average and what ``HOT_PARTS`` parts hold at most, a
task's numpy work by slices of a part.

Defined cases: a null text is empty; rows without an identifier come after all others and take nothing from each
other; rows that repeat an identifier take nothing from each other; texts shorter than ``length`` stay as they are;
a long text is a part of its own and read in slices; what is left of a text need not be valid UTF-8; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banstream.llm.shared import fresh_path, materialize, shuffles_removed
from banstream.llm.shingles import mix, random64
from banstream.llm.suffix_groups import spread, suffix_arrays

LENGTH = 50
PART_BYTES = 4_000_000
LARGEST_PART = 64_000_000
#: Beyond so many parts these become larger.
MANY_PARTS = 20_000
#: Parts of a Spark partition of the texts.
PARTS = 4
BUCKET_ANCHORS = 1_000_000
HOT = 1024
HOT_PARTS = 512
#: Bytes hashed at once, and bytes of contexts sorted at once.
SLICE = 1 << 20
SORTED_BYTES = 4_000_000

NO_ID = np.iinfo(np.int64).max
_ODD = random64(13, 16) | np.uint64(1)


def anchor_bytes(length: int) -> int:
    return max(8, length // 2 // 8 * 8)


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` positions, as numbers; ``data`` goes on for seven more."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data[: n + 7], 8)).view("<u8").ravel()


def _over(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        values, done = best(values[:-done], values[done:]), 2 * done
    rest = width - done
    return best(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that lie in ``data`` from ``starts`` (one more than texts) on."""
    size, total = anchor_bytes(length), int(starts[-1])
    windows = length - size + 1
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, total, SLICE):
        # strings of the length that touch the slice begin and end in here
        low, high = max(0, a - length), min(total, a + SLICE + length)
        own = np.concatenate([data[low:high], np.zeros(size + 8, np.uint8)])
        n = high - low
        w = _words(own, n + size)
        x = w[:n] * _ODD[0]
        for k in range(8, size, 8):
            x += w[k : k + n] * _ODD[k // 8]
        x = mix(x)
        v = np.maximum((x >> np.uint64(32)).astype(np.uint32), 1)
        first, last = np.searchsorted(starts, [low, high - 1], side="right") - 1
        ends = np.minimum(starts[first + 1 : last + 2], high)
        room = np.repeat(ends - low, np.diff(np.concatenate([[low], ends]))) - np.arange(n)
        least = _over(np.concatenate([v, np.zeros(windows - 1, np.uint32)]), windows, np.minimum)
        least[room < length] = 0
        most = _over(np.concatenate([np.zeros(windows - 1, np.uint32), least]), windows, np.maximum)
        hit = np.flatnonzero(most == v)
        hit = hit[(hit + low >= a) & (hit + low < a + SLICE)]
        at.append(hit + low)
        hashes.append(x[hit])
    return np.concatenate(at), np.concatenate(hashes)


def _reach(at: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the contexts of anchors."""
    text = np.searchsorted(starts, at, side="right") - 1
    return text, np.maximum(at - (length - anchor_bytes(length)), starts[text]), np.minimum(at + length, starts[text + 1])


def context_hashes(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, by: int = 13) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(0, len(at), 1 << 15):
        a, z = low[i : i + (1 << 15)], high[i : i + (1 << 15)]
        width = -(-int((z - a).max()) // 8) * 8
        index = a[:, None] + np.arange(width)
        raw = data[np.minimum(index, len(data) - 1)]
        raw[index >= z[:, None]] = 0
        h = mix((at[i : i + (1 << 15)] - a).astype(np.uint64) * _ODD[14] + (z - a).astype(np.uint64) * _ODD[15])
        for word in np.ascontiguousarray(raw).view("<u8").T:
            h = mix(h * _ODD[by] ^ word)
        out[i : i + (1 << 15)] = h
    return out


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, starts) of a part's rows, in a fixed order: by identifier, then text."""
    table = table.select(["id", "text"]).combine_chunks()
    table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])).combine_chunks()
    ids = pc.fill_null(table["id"], NO_ID).to_numpy()
    sizes = pc.binary_length(table["text"]).to_numpy().astype(np.int64)
    data = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(_data(c), np.uint8) for c in table["text"].chunks if int(pc.sum(pc.binary_length(c)).as_py() or 0))])
    return ids, data, np.concatenate([[0], np.cumsum(sizes)])


def _data(column: pa.Array) -> bytes | pa.Buffer:
    """The bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    return data[int(ends[0]) : int(ends[-1])] if data is not None and len(column) else b""


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes by the plane of their bytes; of sorted or small ones the high planes shrink to nearly nothing when compressed."""
    return np.ascontiguousarray(values.astype(f">u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unplane(raw: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f">u{width}").ravel().astype(np.uint64)


def _unplaned(rows: pa.Table, name: str, width: int = 4) -> np.ndarray:
    """The numbers of all rows of a column of planes."""
    return np.concatenate([np.zeros(0, np.uint64), *(_unplane(x, width) for x in rows[name].to_pylist())])


def _unpacked(packed: list[bytes], counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n).view(bool) for b, n in zip(packed, counts, strict=True))])


def _rows(columns: dict[str, list], **types: pa.DataType) -> pa.Table:
    return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in columns.items()})


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(buckets)


def _post(length: int, buckets: int):
    """A part's distinct anchors, a row for each bucket."""

    def post(table: pa.Table) -> pa.Table:
        ids, data, starts = _texts(table)
        at, h = anchors(data, starts, length)
        owner = ids[np.searchsorted(starts, at, side="right") - 1]
        key = (_bucket(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")  # positions, and so identifiers, ascend for equal keys
        key, owner = key[order], owner[order]
        cuts = _cuts(key)
        key, several = key[cuts[:-1]], owner[cuts[:-1]] != owner[np.maximum(cuts[1:], 1) - 1]
        own = _cuts(key >> np.uint64(32))
        part = table["part"][0].as_py()
        out = [(int(key[a] >> np.uint64(32)), part, _planes(key[a:z] & np.uint64(0xFFFFFFFF)), np.packbits(several[a:z]).tobytes()) for a, z in zip(own[:-1], own[1:], strict=True)]
        return _rows(dict(zip(("bucket", "part", "anchors", "several"), map(list, zip(*out, strict=True)) if out else [[]] * 4, strict=True)), bucket=pa.int32(), part=pa.int32())

    return post


def _share(hot_parts: int):
    """For each anchor that a part has posted to a bucket, whether another document has it, and whether it is in very many parts."""

    return lambda table: _shared(table, hot_parts)


def _shared(table: pa.Table, hot_parts: int) -> pa.Table:
    posted = [_unplane(x) for x in table["anchors"].to_pylist()]
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for b, p in zip(table["several"].to_pylist(), posted, strict=True)])
    every = np.concatenate(posted)
    order = np.argsort(every, kind="stable")
    cuts = _cuts(every[order])
    shared = (np.diff(cuts) > 1) | (np.add.reduceat(several[order].astype(np.int64), cuts[:-1]) > 0)
    out = {"part": table["part"], "bucket": table["bucket"]}
    for name, own in (("shared", shared), ("everywhere", np.diff(cuts) > hot_parts)):
        flags = np.zeros(len(every), bool)
        flags[order] = np.repeat(own, np.diff(cuts))
        out[name] = pa.array([np.packbits(f).tobytes() for f in np.split(flags, np.cumsum([len(p) for p in posted])[:-1])], pa.binary())
    return pa.table(out)


def _contexts(length: int, buckets: int):
    """A part's distinct contexts of shared anchors: hashes, first identifier and all positions, a row for each bucket."""
    names = ("bucket", "part", "h", "c", "everywhere", "least", "n", "n_least", "at")

    def contexts(table: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and bits.num_rows:
            ids, data, starts = _texts(table)
            at, h = anchors(data, starts, length)
            bucket = _bucket(h, buckets)
            key = (bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            posted, inverse = np.unique(key, return_inverse=True)
            flags = np.zeros((2, len(posted)), bool)
            cuts = _cuts(posted >> np.uint64(32))
            told = dict(zip(bits["bucket"].to_pylist(), zip(bits["shared"].to_pylist(), bits["everywhere"].to_pylist(), strict=True), strict=True))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                for own, packed in zip(flags, told[int(posted[a] >> np.uint64(32))], strict=True):
                    own[a:z] = np.unpackbits(np.frombuffer(packed, np.uint8), count=z - a)
            own = flags[0, inverse]
            at, h, bucket, everywhere = at[own], h[own], bucket[own], flags[1, inverse][own]
            text, low, high = _reach(at, starts, length)
            c = context_hashes(data, at, low, high)
            bucket = np.where(everywhere, _bucket(mix(h ^ c), buckets), bucket)
            h = h & np.uint64(0xFFFFFFFF)  # with the bucket the anchor, with the context's hash 96 bits and more
            order = np.lexsort((at, c, h, bucket))
            at, h, c, bucket, everywhere, owner = at[order], h[order], c[order], bucket[order], everywhere[order], ids[text[order]]
            changed = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (bucket[1:] != bucket[:-1])
            cuts = np.append(np.flatnonzero(np.concatenate([[True], changed])), len(h)) if len(h) else np.zeros(1, np.int64)
            n = np.diff(cuts)
            least = owner[cuts[:-1]]
            first = np.add.reduceat((owner == np.repeat(least, n)).astype(np.int64), cuts[:-1]) if len(n) else n
            for a, z in zip((b := _cuts(bucket[cuts[:-1]]))[:-1], b[1:], strict=True):
                i, j = cuts[a], cuts[z]
                head = cuts[a:z]
                out.append((int(bucket[i]), table["part"][0].as_py(), _planes(h[head]), c[head].tobytes(), np.packbits(everywhere[head]).tobytes(), _planes(least[a:z], 8), _planes(n[a:z]), _planes(first[a:z]), _planes(at[i:j])))
        return _rows(dict(zip(names, map(list, zip(*out, strict=True)) if out else [[]] * 9, strict=True)), bucket=pa.int32(), part=pa.int32())

    return contexts


def _decide(hot: int):
    """For each part's contexts in a bucket: the positions that are covered, and what suffix arrays have to decide."""

    def decide(table: pa.Table) -> pa.Table:
        hs, ns, firsts, ats = ([_unplane(x) for x in table[name].to_pylist()] for name in ("h", "n", "n_least", "at"))
        h, c, least = np.concatenate(hs), np.frombuffer(b"".join(table["c"].to_pylist()), np.uint64), _unplaned(table, "least", 8).view(np.int64)
        everywhere = _unpacked(table["everywhere"].to_pylist(), [len(x) for x in hs])
        lane = h | np.uint64(table["bucket"][0].as_py() << 32)
        order = np.lexsort((c, h))
        sh, sc = h[order], c[order]
        changed = np.concatenate([[True], (sh[1:] != sh[:-1]) | (sc[1:] != sc[:-1])])
        group = np.cumsum(changed) - 1
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(changed))
        per = _cuts(sh)
        kinds = np.add.reduceat(changed.astype(np.int64), per[:-1])
        first, many, crowd = np.zeros(len(h), bool), np.zeros(len(h), bool), np.zeros(len(h), bool)
        first[order] = least[order] == smallest[group]
        many[order] = np.repeat(kinds > 1, np.diff(per))
        crowd[order] = np.repeat(np.diff(per) > hot, np.diff(per))
        many, crowd = many | everywhere, crowd | everywhere  # the other contexts of these are in other buckets
        out, a = [], 0
        for i in range(table.num_rows):
            z = a + len(hs[i])
            n, own, f, at = ns[i].view(np.int64), firsts[i].view(np.int64), first[a:z], ats[i]
            begin = np.cumsum(n) - n
            skip = np.where(f, own, 0)
            covered = at[spread(begin + skip, n - skip)]
            ask = np.flatnonzero(f & many[a:z])
            out.append((_planes(np.sort(covered)), _planes(lane[a:z][ask], 8), crowd[a:z][ask].astype(np.uint8).tobytes(), _planes(own[ask]), _planes(at[spread(begin[ask], own[ask])]), int(crowd[a:z][ask].sum())))
            a = z
        kinds = {"part": table["part"], "kind": pa.array([0] * len(out), pa.int32())}
        names = ("covered", "lane", "hot", "n", "at", "n_hot")
        return pa.table(kinds | {k: pa.array(v, pa.int32() if k == "n_hot" else pa.binary()) for k, v in zip(names, zip(*out, strict=True), strict=True)})

    return decide


_DECIDED = "part int, kind int, covered binary, lane binary, hot binary, n binary, at binary, n_hot int"


def _asked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's decided rows: lane, hot, and for each the positions as (n, at) with the first one apart."""
    n, at = (_unplaned(rows, name).view(np.int64) for name in ("n", "at"))
    return _unplaned(rows, "lane", 8), np.frombuffer(b"".join(rows["hot"].to_pylist()), np.uint8) > 0, n, at, at[np.cumsum(n) - n] if len(n) else at


def _cut(length: int):
    """The contexts that suffix arrays compare, t: the bytes before the anchor."""

    def cut(table: pa.Table, rows: pa.Table) -> pa.Table:
        part, at, t, owner, lane, low, sizes, data = 0, *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        if table.num_rows and rows.num_rows:
            ids, data, starts = _texts(table)
            lane, crowd, _, _, at = _asked(rows)
            lane, at, part = lane[~crowd], at[~crowd], table["part"][0].as_py()
            text, low, high = _reach(at, starts, length)
            sizes, owner, t = high - low, ids[text], at - low
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        context = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[spread(low, sizes)].tobytes())])
        return pa.table({"lane": pa.array(lane.view(np.int64)), "part": pa.array(np.full(len(at), part, np.int32)), "at": pa.array(at), "t": pa.array(t.astype(np.int32)), "id": pa.array(owner), "context": context})

    return cut


_CUT = "lane long, part int, at long, t int, id long, context binary"


def _hot_strings(ids: np.ndarray, data: np.ndarray, starts: np.ndarray, decided: pa.Table, length: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(begin, owner, bucket, two hashes) of the strings of the length in a part's contexts of hot anchors, and the cuts of equal ones; the first has the least owner."""
    _, crowd, n, at, _ = _asked(decided)
    _, low, high = _reach(at[np.repeat(crowd, n)], starts, length)
    begin = np.unique(spread(low, high - low - length + 1))
    h, c = (context_hashes(data, begin, begin, begin + length, by) for by in (12, 13))
    c, bucket = c & np.uint64(0xFFFFFFFF), _bucket(h, buckets)
    order = np.lexsort((begin, c, h, bucket))  # places, and so identifiers, ascend for equal strings
    begin, bucket, h, c = begin[order], bucket[order], h[order], c[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])), len(h)) if len(h) else np.zeros(1, np.int64)
    return begin, ids[np.searchsorted(starts, begin, side="right") - 1], bucket, h, c, cuts


def _post_hot(length: int, buckets: int):
    """A part's different strings of hot anchors with their least identifiers, a row for each bucket."""
    names = ("bucket", "part", "h", "c", "least")

    def post(table: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and rows.num_rows:
            _, owner, bucket, h, c, cuts = _hot_strings(*_texts(table), rows, length, buckets)
            head = cuts[:-1]
            owner, bucket, h, c = owner[head], bucket[head], h[head], c[head]
            own = _cuts(bucket)
            out = [(int(bucket[a]), table["part"][0].as_py(), _planes(h[a:z], 8), _planes(c[a:z]), _planes(owner[a:z], 8)) for a, z in zip(own[:-1], own[1:], strict=True)]
        return _rows(dict(zip(names, map(list, zip(*out, strict=True)) if out else [[]] * 5, strict=True)), bucket=pa.int32(), part=pa.int32())

    return post


def _later(table: pa.Table) -> pa.Table:
    """For each string that a part has posted to a bucket, whether another part has it with a smaller identifier."""
    h, c, least = _unplaned(table, "h", 8), _unplaned(table, "c"), _unplaned(table, "least", 8).view(np.int64)
    counts = pc.binary_length(table["c"]).to_numpy() // 4
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    changed = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(changed))
    later = np.zeros(len(least), bool)
    later[order] = least[order] > smallest[np.cumsum(changed) - 1]
    bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(counts)[:-1])]
    return pa.table({"part": table["part"], "kind": pa.array([2] * table.num_rows, pa.int32()), "bucket": table["bucket"], "later": pa.array(bits, pa.binary())})


def later_repeats(lane: np.ndarray, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For contexts sorted by lane: bits of the places at which a string of the length begins that a smaller id of its lane has."""
    sizes = np.diff(starts)
    cuts = _cuts(lane)
    per = np.diff(cuts)
    # a letter before each lane as guard, one after each context to part them, one more at a lane's end
    lens = sizes + 1
    lane_of = np.repeat(np.arange(len(per)), per)
    begin = np.cumsum(lens) - lens + 2 * lane_of + 1
    letters = np.zeros(int(lens.sum()) + 2 * len(per), np.int64)
    letters[spread(begin, sizes)] = data.astype(np.int64) + 2
    letters[begin + sizes] = 1
    sizes_of_lanes = np.add.reduceat(lens, cuts[:-1]) + 1
    firsts = np.cumsum(sizes_of_lanes + 1) - sizes_of_lanes
    order = suffix_arrays(letters, firsts, sizes_of_lanes)
    inside = spread(firsts, sizes_of_lanes)
    at = order[inside]
    owner = np.full(len(letters), -1)
    starts_here = spread(begin, sizes - length + 1)
    owner[starts_here] = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    at = at[owner[at] >= 0]  # places where a whole string of the length begins, by lane and in order
    text = np.concatenate([np.minimum(letters, 255).astype(np.uint8), np.zeros(length + 8, np.uint8)])
    text[spread(begin, sizes)] = data
    own = owner[at]
    same = lane[own[1:]] == lane[own[:-1]]
    for k in [*range(0, length - 8, 8), length - 8]:  # neighbours agree on the length?
        i = np.flatnonzero(same)
        one, other = (text[at[j][:, None] + np.arange(k, k + 8)].view("<u8").ravel() for j in (i, i + 1))
        same[i] = one == other
    runs = np.append(np.flatnonzero(np.concatenate([[True], ~same])), len(at))
    least = np.repeat(np.minimum.reduceat(ids[own], runs[:-1]), np.diff(runs))
    later = ids[own] > least
    bits = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(bits, own[later], np.int64(1) << (at[later] - begin[own[later]]))
    return bits


def _partnered(lane: np.ndarray, left: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether another context of the lane agrees on the near half of what surrounds the anchor, on one side at least."""
    size = anchor_bytes(length)
    half = (length - size) // 2
    rest = length - size - half
    out = np.zeros(len(lane), bool)
    at = starts[:-1] + left
    for begin, width, fits in ((at - half, half, left >= half), (at + size, rest, starts[1:] - at - size >= rest)):
        i = np.flatnonzero(fits)
        raw = np.zeros((len(i), width + -width % 8), np.uint8)
        raw[:, :width] = data[begin[i][:, None] + np.arange(width)]
        h = mix(lane[i] * _ODD[0])
        for word in raw.view("<u8").T:
            h = mix(h * _ODD[1] ^ word)
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        out[i] |= counts[inverse] > 1
    return out


def _sorted_lanes(length: int):
    """Contexts in the order of their lanes, as many whole lanes at once as SORTED_BYTES hold: (part, at, bits) where bits are set."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        column = rows["context"].combine_chunks()
        lane, ids, at, left = (rows[c].to_numpy() for c in ("lane", "id", "at", "t"))
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        data, starts = np.frombuffer(_data(column), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        keep = np.flatnonzero(_partnered(lane.view(np.uint64), left.astype(np.int64), data, starts, length))
        bits = np.zeros(len(lane), np.int64)
        # lanes of like sizes go together
        if len(keep):
            cuts = _cuts(lane[keep])
            size = np.add.reduceat(sizes[keep], cuts[:-1])
            by = np.argsort(size, kind="stable")
            for few in np.split(by, np.flatnonzero(np.diff(np.cumsum(size[by]) // (SORTED_BYTES // 2))) + 1):
                own = keep[spread(cuts[few], np.diff(cuts)[few])]
                bits[own] = later_repeats(np.repeat(np.arange(len(few)), np.diff(cuts)[few]), ids[own], data[spread(starts[own], sizes[own])], np.concatenate([[0], np.cumsum(sizes[own])]), length)
        hit = np.flatnonzero(bits)
        return pa.record_batch([pa.array(rows["part"].to_numpy()[hit]), pa.array(at[hit]), pa.array(bits[hit])], ["part", "at", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > 2 * SORTED_BYTES:
                table = pa.Table.from_batches(held)
                lanes = table["lane"].to_numpy()
                whole = int(np.searchsorted(lanes, lanes[-1]))  # the last lane may go on
                if whole:
                    yield solve(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = sum(x.nbytes for x in held)
        if sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    return run


def _spans(length: int, hot_buckets: int):
    """Each text of a part with its removed spans and what is left."""

    def spans(table: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["id", "n_bytes", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        ids, data, starts = _texts(table)
        edge = np.zeros(len(data) + 1, np.int32)

        def take(low: np.ndarray, high: np.ndarray) -> None:
            np.add.at(edge, low, 1)
            np.add.at(edge, high, -1)

        if rows.num_rows:
            decided, found = rows.filter(pc.equal(rows["kind"], 0)), rows.filter(pc.equal(rows["kind"], 1))
            take(*_reach(_unplaned(decided, "covered").view(np.int64), starts, length)[1:])
            told = rows.filter(pc.equal(rows["kind"], 2)).sort_by("bucket")
            if told.num_rows:
                begin, owner, bucket, _, _, cuts = _hot_strings(ids, data, starts, decided, length, hot_buckets)
                head, same = cuts[:-1], np.diff(cuts)
                later = _unpacked(told["later"].to_pylist(), np.diff(_cuts(bucket[head])))
                own = begin[np.repeat(later, same) | (owner > np.repeat(owner[head], same))]
                take(own, own + length)
            if found.num_rows:
                _, _, n, at, rep = _asked(decided)
                order = np.argsort(rep)
                place = order[np.searchsorted(rep[order], found["rep"].to_numpy())]
                bits, n_all, begin = found["bits"].to_numpy(), n, np.cumsum(n) - n
                every = at[spread(begin[place], n_all[place])]
                bits = np.repeat(bits, n_all[place])
                low = _reach(every, starts, length)[1]
                for t in range(length - anchor_bytes(length) + 1):
                    own = low[(bits >> t) & 1 > 0] + t
                    take(own, own + length)
        gone = np.cumsum(edge[:-1]) > 0
        turns, kept = [], []
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            flags = gone[a:z]
            turns.append(np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))))
            kept.append(data[a:z][~flags].tobytes() if len(turns[-1]) else data[a:z].tobytes())
        every = np.concatenate(turns)
        pairs = pa.StructArray.from_arrays([pa.array(every[0::2]), pa.array(every[1::2])], ["start", "end"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) // 2 for x in turns])]).astype(np.int32)), pairs)
        return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(starts)), listed, pa.array(kept, kinds[3])], names)

    return spans


def _stored(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The texts as a table (id, text, part) bucketed by part, and their bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with shuffles_removed(spark):
        total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // max(PART_BYTES, min(LARGEST_PART, total // MANY_PARTS))))
    tasks = max(1, -(-parts // PARTS))
    path = fresh_path(spark, "suffix-texts")
    name = "suffix_texts_" + path.rpartition("-")[2]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
    with shuffles_removed(spark):
        dealt.repartition(tasks, "part").write.option("path", path).option("compression", "zstd").bucketBy(tasks, "part").saveAsTable(name)
    return spark.table(name), total


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, hot_parts: int = HOT_PARTS) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: the removed spans (start, end in bytes) and the bytes that stay."""
    if not 16 <= length <= 112:
        raise ValueError("the length must be from 16 to 112 bytes")  # the places in a context are bits of a long
    texts, total = _stored(docs, id_col, text_col)
    size = anchor_bytes(length)
    buckets = max(1, round(2 * total / (length - size + 2) / BUCKET_ANCHORS))
    parts = lambda df: df.groupBy("part")
    posted = parts(texts).applyInArrow(_post(length, buckets), "bucket int, part int, anchors binary, several binary")
    with shuffles_removed(docs.sparkSession):
        shared = materialize(posted.groupBy("bucket").applyInArrow(_share(hot_parts), "part int, bucket int, shared binary, everywhere binary"), "shared")
        found = parts(texts).cogroup(parts(shared)).applyInArrow(_contexts(length, buckets), "bucket int, part int, h binary, c binary, everywhere binary, least binary, n binary, n_least binary, at binary")
        decided = materialize(found.groupBy("bucket").applyInArrow(_decide(hot), _DECIDED), "decided")
        asked = decided.select("part", "lane", "hot", "n", "at")
        cut = parts(texts).cogroup(parts(asked)).applyInArrow(_cut(length), _CUT)
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bits = cut.repartition(tasks, "lane").sortWithinPartitions("lane").mapInArrow(_sorted_lanes(length), "part int, rep long, bits long")
        both = decided.drop("n_hot").unionByName(materialize(bits, "bits").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        n_hot = decided.agg(F.sum("n_hot").alias("n")).first()["n"] or 0
        hot_buckets = max(1, round(n_hot * (length - size + 1) / BUCKET_ANCHORS))
        if n_hot:
            strings = parts(texts).cogroup(parts(asked)).applyInArrow(_post_hot(length, hot_buckets), "bucket int, part int, h binary, c binary, least binary")
            later = materialize(strings.groupBy("bucket").applyInArrow(_later, "part int, kind int, bucket int, later binary"), "later")
        else:
            later = docs.sparkSession.createDataFrame([], "part int, kind int, bucket int, later binary")
    both = both.unionByName(later, allowMissingColumns=True)
    out = parts(texts).cogroup(parts(both)).applyInArrow(_spans(length, hot_buckets), "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
