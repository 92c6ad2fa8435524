"""Token counts of texts, as a tokenizer library gives them, without keeping the ids.

Arrow batches are cut into slices of about equal bytes and texts at safe boundaries (see ``segments``); the
library is called with the segments of a slice that the worker has not met, and only lengths are kept.

A sentencepiece model takes the segments if none of its pieces holds a word mark after another character and its
normaliser leaves texts alone; ``.json`` files of the tokenizers library if they split as byte-level BPE does.
Models that do not allow this get whole texts.

Defined cases: null text is the empty text, with no tokens; repeated rows are counted each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banstream.llm.segments import SegmentMemo, by_bytes, in_chunks, segments

#: Texts that a normaliser which changes anything would not leave as they are.
_PROBES = ("ﬁ Ⅷ ½", "a\tb\r\nc", "é Å", "　x y", "A  B ")


@lru_cache(maxsize=2)
def _library(path: str) -> tuple[object, Callable[[list[str]], list[int]], bool]:
    """The loaded tokenizer, its counts for a list of texts, and whether texts can be cut at ``segments``."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        safe = not any("\n" in p or "▁" in p.lstrip("▁") for p in names) and all(model.normalize(t) == "▁" + t.replace(" ", "▁") for t in _PROBES)
        return model, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], safe
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    before = str(tokenizer.pre_tokenizer)
    safe = tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in before and "use_regex=True" in before
    return tokenizer, lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], safe


#: One space and then neither white space nor word marks.
_WORD = re.compile(r" [^\s▁]+")


def _piece_counts(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of segments for a sentencepiece model, which puts a word mark before every text.

    Words behind one space are sent as one line of words: each begins with the only piece that has a mark. Other
    segments are measured behind a line feed, whose own tokens are taken off.
    """
    model, counts, _ = _library(path)
    marked = np.array([model.id_to_piece(i).startswith("▁") for i in range(model.get_piece_size())])
    bare = counts(["\n"])[0]

    def measure(parts: list[str]) -> list[int]:
        words = [s for s in parts if _WORD.fullmatch(s)]
        got: dict[str, int] = {}
        for some in in_chunks(words):
            ids = np.array(model.encode("".join(some)[1:], num_threads=1))
            got.update(zip(some, np.diff(np.append(np.flatnonzero(marked[ids]), len(ids))).tolist(), strict=True))
        others = [s for s in parts if s not in got]
        got.update((s, n - bare) for s, n in zip(others, counts(["\n" + s for s in others]), strict=True))
        return [got[s] for s in parts]

    return measure


@lru_cache(maxsize=2)
def _memo(path: str) -> SegmentMemo | None:
    _, counts, safe = _library(path)
    if not safe:
        return None
    return SegmentMemo(_piece_counts(path) if path.endswith(".model") else counts)


def counts_of(texts: list[str], path: str) -> list[int]:
    """The number of tokens of every text."""
    memo = _memo(path)
    if memo is None:
        return _library(path)[1](texts)
    cut = [segments(t) for t in texts]
    if not path.endswith(".model"):
        known = memo.look_up(cut)
        return [sum(map(known.__getitem__, own)) for own in cut]
    heads = _library(path)[1]([own[0] if own else "" for own in cut])
    known = memo.look_up([own[1:] for own in cut])
    return [n + sum(map(known.__getitem__, own[1:])) for n, own in zip(heads, cut, strict=True)]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [c for _, texts in by_bytes(batch.column(2)) for c in counts_of(texts, path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
