"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is what the merges give for its bytes exactly if every neighbouring pair of tokens
is (a pair is, if the merges give back just these two for their joined bytes), so of the tokens that end at a
position at most one can follow the encoding of what lies before it. Compiled from the vocabulary's prefix tree,
this is a transducer that reads bytes: an item is a node of the tree inside the token being read, and the token
before it. A state is the set of items that are open together, and a transition puts out the last token of the
encoding of all that was read. What lies before the open items' beginnings and on all their ways back is settled and
emitted; nothing is open for longer than the longest token. States and transitions are made when a text first needs
them, for all words of a slice that stand at the same place together, and kept up to ``MAX_TRANSITIONS``.

Each match of the splitting pattern is encoded separately. Decoding maps ids to bytes and gives out text as far as
it is complete: ``Utf8Stream`` carries the state of a character that has begun.

Defined cases: null text is the empty text, with no ids; bytes that are no UTF-8 decode to U+FFFD in text and
stay as they are in bytes; an unknown id is an error; a text of many megabytes, or one match of that length, is
taken in windows; repeated rows are encoded each, in no order, so there are no ties; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banstream.llm.segments import SegmentMemo, by_bytes, resident, segments, tidy

MAX_TRANSITIONS = 600_000
MAX_PAIRS = 600_000
MEMO_SEGMENTS = 200_000
#: Bytes of text that are encoded together.
SLICE_BYTES = 1_000_000
#: Matches up to this many bytes are read side by side, longer ones alone.
SHORT = 256
#: Bytes of a long match after which what is settled is emitted.
WINDOW = 4096

_NEVER = 1 << 60


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges by rank, done plainly; for pairs of tokens, which are short."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if best == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Numbers:
    """A map from non-negative 64-bit keys to 32-bit values whose look-ups are numpy operations on many keys."""

    _MUL = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int = 12) -> None:
        self.n, self.bits = 0, bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for those that are not here."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not here yet."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.bits = max(self.bits + 1, (4 * self.n - 1).bit_length())
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several that want one place the last gets it
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class Rows:
    """A numpy array that grows at its end."""

    def __init__(self) -> None:
        self.n, self.data = 0, np.zeros(1024, np.int64)

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(self.n, len(values)) + 1024, np.int64)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Transducer:
    """Encodes byte strings that stand alone (the matches of the splitting pattern)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.size = np.zeros(max(self.token, default=0) + 1, np.int64)
        self.size[list(self.token)] = [len(t) for t in self.token.values()]
        child: dict[int, int] = {}
        ends, depth, inner = [-1], [0], [False]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                inner[node] = True
                nxt = child.get(node << 8 | byte)
                if nxt is None:
                    nxt = child[node << 8 | byte] = len(ends)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                    inner.append(False)
                node = nxt
            ends[node] = rank
        self.ends, self.depth, self.inner = np.array(ends), np.array(depth), np.array(inner)
        self.child = Numbers()
        self.child.put(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))
        self.edges: dict[int, tuple[list[bytes], list[bytes], bool] | None] = {}
        self.follows = Numbers()
        self._forget()

    def _forget(self) -> None:
        # a state's items stand together in ``items``, as node << 32 | token before + 1
        self.items, self.first = Rows(), Rows()
        self.items.add(np.zeros(1, np.int64))
        self.first.add(np.array([0, 1]))
        self.number = {np.zeros(1, np.int64).tobytes(): 0}
        self.moves, self.target, self.last = Numbers(16), Rows(), Rows()

    def _edge(self, token: int) -> tuple[list[bytes], list[bytes], bool] | None:
        """The parts that stand first and last while the merges make this token, from bytes on, and whether the ranks
        of its merges ascend; None if the merges do not make it."""
        if token not in self.edges:
            text = self.token[token]
            parts, low, ascending = [text[i : i + 1] for i in range(len(text))], -1, True
            firsts, lasts = parts[:1], parts[-1:]
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if best == _NEVER:
                    break
                ascending, low = ascending and best >= low, best
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    firsts.append(parts[0])
                if at == len(parts) - 1:
                    lasts.append(parts[-1])
            self.edges[token] = (firsts, lasts, ascending) if len(parts) == 1 else None
        return self.edges[token]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merges leave these two tokens apart and whole; ``before`` is -1 at the start.

        Where ranks ascend inside both tokens, the merges run through both in order of rank, and only the parts at the
        border matter: do they join before one of them grows?
        """
        right = self._edge(token)
        left = self._edge(before) if before >= 0 else None
        if right is None or before < 0:
            return right is not None
        if left is None:
            return False
        if not (left[2] and right[2]):
            return merge(self.token[before] + self.token[token], self.ranks) == [before, token]
        lasts, firsts = left[1], right[0]
        i = j = 0
        while True:
            grows = self.ranks[lasts[i + 1]] if i + 1 < len(lasts) else _NEVER
            other = self.ranks[firsts[j + 1]] if j + 1 < len(firsts) else _NEVER
            joined = self.ranks.get(lasts[i] + firsts[j], _NEVER)
            if joined < grows and joined <= other and joined < _NEVER:
                return False
            if grows == other == _NEVER:
                return True
            if grows <= other:
                i += 1
            else:
                j += 1

    def _may(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs; ``before`` is counted from 1 here, 0 at the start."""
        keys = before << 32 | token
        known = self.follows.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.follows.n > MAX_PAIRS:
                self.follows = Numbers()
                return self._may(before, token)
            self.follows.put(new, np.array([self.may_follow((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()], np.int32))
            known = self.follows.get(keys)
        return known == 1

    def _determinise(self, keys: np.ndarray) -> None:
        """Make the transitions for these distinct pairs state << 8 | byte."""
        state = keys >> 8
        first = self.first.data[state]
        counts = self.first.data[state + 1] - first
        row = np.repeat(np.arange(len(keys)), counts)
        item = self.items.data[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(len(row))]
        node = self.child.get((item >> 32) << 8 | (keys & 255)[row]).astype(np.int64)
        on = node >= 0
        row, node, before = row[on], node[on], (item & 0xFFFFFFFF)[on]
        token = self.ends[node]
        whole = np.full(len(keys), -1, np.int64)
        done = np.flatnonzero(token >= 0)
        done = done[self._may(before[done], token[done])]
        whole[row[done]] = token[done]
        if (whole < 0).any():
            raise ValueError(f"no token ends with byte {int(keys[whole < 0][0]) & 255}")
        goes = self.inner[node]
        row, item = row[goes], node[goes] << 32 | before[goes]
        counts = np.bincount(row, minlength=len(keys)) + 1
        stops = np.cumsum(counts)
        items = np.zeros(stops[-1], np.int64)
        items[np.arange(len(row)) + row] = item  # one place in each row before is the root's
        items[stops - 1] = whole + 1
        target, new, size = np.zeros(len(keys), np.int64), [], []
        data, number = items.tobytes(), self.number
        for i, (a, z) in enumerate(zip((stops - counts).tolist(), stops.tolist(), strict=True)):
            name = data[8 * a : 8 * z]
            at = number.get(name)
            if at is None:
                at = number[name] = len(number)
                new.append(name)
                size.append(z - a)
            target[i] = at
        if new:
            self.first.add(self.items.n + np.cumsum(size))
            self.items.add(np.frombuffer(b"".join(new), np.int64))
        self.moves.put(keys, np.arange(self.target.n, self.target.n + len(keys), dtype=np.int32))
        self.target.add(target)
        self.last.add(whole)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the last tokens."""
        keys = state << 8 | byte
        move = self.moves.get(keys)
        if len(missing := keys[move < 0]):
            self._determinise(np.unique(missing))
            move = self.moves.get(keys)
        return self.target.data[move], self.last.data[move]

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        if self.moves.n > MAX_TRANSITIONS:
            self._forget()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -SHORT) :]  # the longest first, so that those still read are a prefix
        last, state = np.zeros(len(data), np.int64), np.zeros(len(order), np.int64)
        for at in range(int(size[order].max(initial=0))):
            n = int(np.searchsorted(-size[order], -at))
            where = begin[order[:n]] + at
            state[:n], last[where] = self._step(state[:n], data[where])
        # read back from each end
        ends, owners, places = [], [], []
        rows, place = order, (begin + size)[order]
        while len(rows := rows[keep := place > begin[rows]]):
            place = place[keep]
            token = last[place - 1]
            ends.append(token)
            owners.append(rows)
            places.append(place)
            place = place - self.size[token]
        for i in np.flatnonzero(size > SHORT).tolist():
            own = np.array([t for some in self.stream([pieces[i]]) for t in some], np.int64)
            ends.append(own)
            owners.append(np.full(len(own), i))
            places.append(begin[i] + np.cumsum(self.size[own]))
        if not ends:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        ids, owner = np.concatenate(ends), np.concatenate(owners)
        return ids[np.argsort(np.concatenate(places))], np.bincount(owner, minlength=len(pieces))

    def encode(self, data: bytes) -> list[int]:
        return self.encode_many([data])[0].tolist()

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one piece that comes in chunks, given out as they are settled."""
        state, base, last = 0, 0, []  # ``last``: of every byte from ``base`` on the last token of the encoding up to it
        moves: dict[int, tuple[int, int]] = {}

        def back(at: int) -> list[int]:
            """The borders of the encoding of what was read up to ``at``, last one first."""
            out = []
            while at > 0:
                out.append(at)
                at -= int(self.size[last[at - 1]])
            return out

        for chunk in chunks:
            for start in range(0, len(chunk), WINDOW):
                for byte in chunk[start : start + WINDOW]:
                    key = state << 8 | byte
                    if key not in moves:
                        if len(moves) > MAX_TRANSITIONS // 4:
                            moves.clear()
                        to, token = self._step(np.array([state]), np.array([byte]))
                        moves[key] = int(to[0]), int(token[0])
                    state, token = moves[key]
                    last.append(token)
                nodes = self.items.data[self.first.data[state] : self.first.data[state + 1]] >> 32
                ways = [set(back(len(last) - d)) for d in self.depth[nodes].tolist()]
                settled = max(set.intersection(*ways), default=0)
                yield [last[b - 1] for b in reversed(back(settled))]
                del last[:settled]
        yield [last[b - 1] for b in reversed(back(len(last)))]


class Utf8Stream:
    """Turns chunks of bytes into text by a state machine over UTF-8.

    The state is what a character that has begun still needs: its bytes so far, how many are to come, and the bounds of
    the next one. Whole characters inside a chunk are decoded together; the machine runs over its ends.
    """

    def __init__(self) -> None:
        self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def _take(self, byte: int) -> bool:
        """Move on by a byte; False if it can't stand here (then no character is open)."""
        if self.need:
            if not self.low <= byte <= self.high:
                self.held, self.need = b"", 0
                return False
            self.held, self.need, self.low, self.high = self.held + bytes([byte]), self.need - 1, 0x80, 0xBF
            return True
        self.need = 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        self.held = bytes([byte]) if self.need else b""
        return bool(self.need) or byte < 0x80

    def feed(self, chunk: bytes) -> str:
        out, at = "", 0
        while self.need and at < len(chunk):
            begun = self.held
            if not self._take(chunk[at]):
                out += "\ufffd"  # the bytes that had begun stand for one
                break
            at += 1
            if not self.need:
                out += (begun + chunk[at - 1 : at]).decode()
                self.held = b""
        rest = chunk[at:]
        # the last byte that begins a character, if it is among the last three, may be waiting for more
        lead = next((i for i in range(len(rest) - 1, max(len(rest) - 4, -1), -1) if rest[i] >= 0xC0), len(rest))
        for i in range(lead, len(rest)):
            if not self._take(rest[i]) or not self.need:
                lead = len(rest)
                self.held, self.need = b"", 0
                break
        return out + rest[:lead].decode(errors="replace")

    def close(self) -> str:
        rest = "\ufffd" if self.need else ""
        self.held, self.need = b"", 0
        return rest


class Spelling:
    """What each id is written as, side by side in one array of bytes."""

    def __init__(self, texts: dict[int, bytes]) -> None:
        n = max(texts, default=-1) + 1
        parts = [texts.get(i, b"") for i in range(n)]
        self.size = np.fromiter(map(len, parts), np.int64, n)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.data[np.repeat(self.begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()


class Coder:
    """A rank file's transducer, a memo of segments' ids (little-endian 32-bit strings), and the ids' spellings."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.machine = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})
        self.split = regex.compile(pattern)
        self.memo = SegmentMemo(self._encoded, MEMO_SEGMENTS)
        self.spelled = Spelling(self.machine.token)
        self.decimal = Spelling({i: b"%d," % i for i in self.machine.token})
        self.known = np.zeros(len(self.spelled.size), bool)
        self.known[list(self.machine.token)] = True

    def _encoded(self, parts: list[str]) -> list[bytes]:
        found = [self.split.findall(p) for p in parts]
        ids, counts = self.machine.encode_many([x.encode() for own in found for x in own])
        stops = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, found)])].tolist()
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * z] for a, z in zip(stops[:-1], stops[1:], strict=True)]


def load(path: str, pattern: str) -> Coder:
    return resident(("byte_bpe", path, pattern), lambda: Coder(path, pattern))


def encode_texts(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    memo = load(path, pattern).memo
    cut = [segments(t) for t in texts]
    known = memo.look_up(cut)
    return [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in cut]


def decode_stream(chunks: Iterable[np.ndarray | list[int]], path: str, pattern: str) -> Iterator[tuple[bytes, str]]:
    """For chunks of ids: their bytes, and the text that they complete; at the end what is left over."""
    coder, stream = load(path, pattern), Utf8Stream()
    for ids in chunks:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(coder.known) or not coder.known[ids].all()):
            raise KeyError("unknown id")
        data = coder.spelled.join(ids)
        yield data, stream.feed(data)
    if rest := stream.close():
        yield b"", rest


#: Ids that are decoded at once.
CHUNK = 1 << 16


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per document: id and what ``outputs`` names of ids (array<int>), decoded (text from these ids),
    n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes)."""
    types = {"n_tokens": pa.int64(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    spark_types = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    kind = docs.schema[id_col].dataType.simpleString()

    def row(ids: np.ndarray) -> dict:
        out: dict = {"n_tokens": len(ids)}
        chunks = [ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)]
        if "ids_sha256" in outputs:
            digest = hashlib.sha256()
            for i, some in enumerate(chunks):
                text = load(path, pattern).decimal.join(some)
                digest.update(text if i + 1 < len(chunks) else text[:-1])
            out["ids_sha256"] = digest.hexdigest()
        if "decoded" in outputs or "decoded_sha256" in outputs:
            digest, pieces = hashlib.sha256(), []
            for data, piece in decode_stream(chunks, path, pattern):
                digest.update(data)
                if "decoded" in outputs:
                    pieces.append(piece)
            out |= {"decoded_sha256": digest.hexdigest(), "decoded": "".join(pieces)}
        return out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in by_bytes(batch.column(1), SLICE_BYTES):
                ids = encode_texts(texts, path, pattern)
                rows = [row(x) for x in ids]
                columns = []
                for name in outputs:
                    if name == "ids":
                        stops = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(ids).view(np.int32))))
                    else:
                        columns.append(pa.array([r[name] for r in rows], types[name]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns], ["id", *outputs])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(encode), ", ".join([f"id {kind}", *(f"{n} {spark_types[n]}" for n in outputs)])).withColumnRenamed("id", id_col)
