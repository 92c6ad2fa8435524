"""Token ids in files: fixed-width bit packing with random access.

A file (shard) holds the ids of consecutive documents, each id in the minimum number of bits that the vocabulary
needs, in blocks of ``BLOCK`` ids:

    payload   blocks one after another, little-endian 64-bit words; 64 ids fill ``bits`` words
    tables    int64 arrays: block offsets in bytes (blocks + 1), first id of every document (documents + 1),
              document ids; then a byte per document, 1 if its id is null
    trailer   magic, bits, ids per block, number of documents, ids and blocks

Packing and unpacking are numpy operations over whole blocks; ``PackedReader.ids`` unpacks only the blocks that a
range of ids touches.

``write_token_files`` range-partitions documents by identifier, so that shards are consecutive and each is written
by one task as it encodes; a task that runs again writes the same bytes and renames them over. ``read_token_files``
reads shards in parallel; a shard's place among all ids comes from a running sum over the manifest, which has a
row per shard.

Defined cases: null text is the empty text; null identifiers come first; repeated rows are written each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from banstream.llm.segments import MEMO_SEGMENTS, SegmentMemo, by_bytes, in_chunks, segments
from banstream.llm.shared import fresh_path, materialize

MAGIC = b"IDPACK01"
TRAILER = struct.Struct("<8sIIQQQ")
BLOCK = 1 << 16
#: Blocks that a reader unpacks at once when it goes on.
WINDOW = 8


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string; the last group of 64 is filled up with zeros."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """All ids of a bit string, with the zeros that fill up the last group."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    rows = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        rows[:, j] = value & mask
    return rows.reshape(-1).astype(np.uint32)


class PackedWriter:
    """Writes one shard as documents come; holds at most a block of ids and the tables."""

    def __init__(self, sink, bits: int) -> None:
        self.sink, self.bits = sink, bits
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = self.at = 0
        self.blocks, self.starts, self.doc_ids, self.nulls = [0], [0], [], bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        if self.held >= BLOCK:
            whole = np.concatenate(self.rest)
            for i in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.rest = [whole[len(whole) // BLOCK * BLOCK :].copy()]
            self.held = len(self.rest[0])

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        for table in (self.blocks, self.starts, self.doc_ids):
            self.sink.write(np.array(table, "<i8").tobytes())
        self.sink.write(bytes(self.nulls))
        self.sink.write(TRAILER.pack(MAGIC, self.bits, BLOCK, len(self.doc_ids), self.n_ids, len(self.blocks) - 1))


class PackedReader:
    """Random access to one shard."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block, self.n_docs, self.n_ids, n_blocks = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        tables = (n_blocks + 1) + (self.n_docs + 1) + self.n_docs
        data = self.file.read_at(8 * tables + self.n_docs, size - TRAILER.size - 8 * tables - self.n_docs)
        numbers = np.frombuffer(data, "<i8", tables)
        self.blocks, self.starts, ids = np.split(numbers, [n_blocks + 1, n_blocks + self.n_docs + 2])
        self.doc_ids = [None if null else x for x, null in zip(ids.tolist(), data[8 * tables :], strict=True)]
        self.first, self.window = 0, np.zeros(0, np.uint32)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of this shard."""
        if not self.first <= start <= stop <= self.first + len(self.window):
            low = min(start // self.block, max(len(self.blocks) - 2, 0))
            high = min(max(-(-stop // self.block), low + WINDOW), len(self.blocks) - 1)
            self.first = low * self.block
            self.window = unpack(self.file.read_at(int(self.blocks[high] - self.blocks[low]), int(self.blocks[low])), self.bits)
        return self.window[start - self.first : stop - self.first]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


#: One space and then no white space.
_WORD = re.compile(r" \S+")


@lru_cache(maxsize=2)
def _memo(path: str) -> SegmentMemo | None:
    """Ids of segments as little-endian 32-bit strings, by the tokenizers library; None if it can't take segments."""
    tokenizer = _tokenizer(path)
    before = str(tokenizer.pre_tokenizer)
    if tokenizer.normalizer is not None or "ByteLevel(add_prefix_space=False" not in before or "use_regex=True" not in before:
        return None
    encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    feed = encode(["\n"])[0]

    def encoded(parts: list[str]) -> list[bytes]:
        # words go as lines of one text, and its ids are cut at the line feeds
        got: dict[str, bytes] = {}
        if len(feed) == 1:
            for some in in_chunks([s for s in parts if _WORD.fullmatch(s)]):
                ids = np.array(encode(["\n".join(some)])[0], "<u4")
                ends = [*np.flatnonzero(ids == feed[0]).tolist(), len(ids)]
                data = ids.tobytes()
                got.update((s, data[4 * a : 4 * b]) for s, a, b in zip(some, [0, *(x + 1 for x in ends[:-1])], ends, strict=True))
        others = [s for s in parts if s not in got]
        got.update((s, np.array(ids, "<u4").tobytes()) for s, ids in zip(others, encode(others), strict=True))
        return [got[s] for s in parts]

    return SegmentMemo(encoded, 2 * MEMO_SEGMENTS)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts."""
    memo = _memo(path)
    if memo is None:
        return [np.array(x.ids, "<u4") for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    cut = [segments(t) for t in texts]
    known = memo.look_up(cut)
    return [np.frombuffer(b"".join(map(known.__getitem__, own)), "<u4") for own in cut]


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None
) -> DataFrame:
    """Encode all texts, append ``end_id`` to each and write shards in ascending identifier order.

    ``shards`` defaults to the session's shuffle partitions: choose it so that a shard's texts pass through one task.
    Returns the manifest: shard, path, n_docs, n_ids.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = bits_for(vocabulary_size(tokenizer))
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        own, path = f"{base}/.{uuid.uuid4().hex}", f"{base}/{shard:08d}.ids"
        with fs.open_output_stream(own) as sink:
            writer = PackedWriter(sink, bits)
            for batch in batches:
                names = batch.column(0).to_pylist()
                for first, texts in by_bytes(batch.column(1)):
                    for i, ids in enumerate(encode_texts(texts, tokenizer), first):
                        writer.add(names[i], np.concatenate([ids, end]))
            writer.close()
        if writer.doc_ids:
            fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})
        else:
            fs.delete_file(own)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    return materialize(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest").withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers), shard."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                reader = PackedReader(fs, row["path"])
                sums = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(reader.n_docs)]
                starts = reader.starts + row["base"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64()), pa.array([row["shard"]] * reader.n_docs, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    n = max(1, manifest.count())
    spread = placed.repartitionByRange(n, "shard").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long, shard long")
    return spread.withColumnRenamed("id", id_col)


def stored_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files of ``docs`` to the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer, id_col=id_col, text_col=text_col), id_col)
