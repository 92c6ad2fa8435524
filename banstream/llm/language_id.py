"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to 4 letters (case-folded; word edges count as a character), hashed into ``BUCKETS``. A text's feature value is
its relative frequency times its inverse document frequency; document frequencies are counted over all labelled
training rows. Weights come from follow-the-regularised-leader with elastic-net penalties, one language's weights
each, on at most ``rows_per_language`` training rows of each language, chosen by a hash of their text; the l1
penalty leaves most weights zero. A fifth of these rows is kept out of the fit and sets the temperature that the
scores are divided by, so that the reported probability is calibrated.

A fitted model is a table of ``BUCKETS`` x languages numbers, whatever the corpus is; predicting is one pass without
a shuffle, over whole texts.

Defined cases: null text and text without a letter are ``und`` with score 0; rows without a language are not
learned from; with no labelled row everything is ``und``; repeated rows count each in document frequencies and once
in the fit; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from banstream.llm.segments import by_bytes, resident, tidy
from banstream.llm.shingles import mix

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
#: Parts of each language whose least hashes are taken first.
PARTS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Per code point: its lower-case form if it is a letter, else 0."""
    return np.array([(ord(low) if len(low := chr(i).lower()) == 1 else i) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def ngrams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the buckets of all n-grams, one text after another, and each text's first.

    A run of anything but letters counts as one space; spaces alone are no n-gram.
    """
    table = resident("letters", _letters)
    code = np.frombuffer("".join(f" {t} \n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = table[code]
    lengths = np.array([len(t) for t in texts], np.int64) + 3
    stops = np.cumsum(lengths)
    keep = low > 0
    keep[1:] |= keep[:-1]  # the character after a letter stays, as the word's end
    keep[stops - lengths] = True
    at = np.flatnonzero(keep)
    low = low[at].astype(np.uint64) + np.uint64(1)
    owner = np.searchsorted(stops, at, "right")
    rows = np.arange(len(texts) + 1)
    out = []
    h, at_all = np.full(len(low), 7, np.uint64), np.arange(len(low))
    for size in range(1, max(SIZES) + 1):
        n = max(len(low) - size + 1, 0)
        h = (h[:n] ^ low[size - 1 : size - 1 + n]) * _STEP
        h ^= h >> np.uint64(29)
        if size in SIZES:
            good = owner[:n] == owner[size - 1 : size - 1 + n]
            if size == 1:
                good &= low > 1
            good = at_all[:n][good]
            out.append(((mix(h[good]) & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(owner[good], rows)))
    return out


def has_letter(texts: list[str]) -> list[bool]:
    return [any(map(str.isalpha, t)) for t in texts]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, a row per text."""
        out, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for hashed, first in ngrams(texts):
            n = np.diff(first)
            total += n
            full = np.flatnonzero(n)
            if len(full):
                out[full] += np.add.reduceat(self.table[hashed], first[:-1][full], axis=0, dtype=np.float64)
        return softmax((out / np.maximum(total, 1)[:, None] * SCALE + self.bias) / self.temperature)

    @cached_property
    def table(self) -> np.ndarray:
        """Weights times inverse document frequencies."""
        return (self.weights * self.idf[:, None]).astype(np.float32)


#: Relative frequencies are small; all values are taken this many times.
SCALE = 20.0


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, np.bool_)
        for batch in batches:
            for _, texts in by_bytes(batch.column(0)):
                grams = ngrams(texts)
                rows += len(texts)
                for i in range(len(texts)):
                    seen[:] = False
                    for hashed, first in grams:
                        seen[hashed[first[i] : first[i + 1]]] = True
                    total += seen
        # a row per bucket: counts are added up by Spark, not on the driver
        counts = np.concatenate([[rows], total])
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": met - 1, "n": counts[met]})

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS + 1, np.int64)
    table[counted["bucket"].to_numpy() + 1] = counted["n"].to_numpy()
    return table[1:], int(table[0])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float, beta: float, l1: float, l2: float, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the softmax loss: weights (buckets x classes) and unpenalised biases."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            w = weights(z[at], n[at])
            p = softmax((value @ w + bias)[None, :])[0]
            p[labels[i]] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += p * p
            bias -= alpha * p / (beta + np.sqrt(bias_n))
    return weights(z, n), bias


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    low, high, ratio = np.log(0.5), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", rows_per_language: int = 400, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, passes: int = 3, seed: int = 7
) -> Model:
    """Fit on the rows with a label. ``rows_per_language`` bounds what the fit itself sees; document frequencies count all rows."""
    known = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    df, total = document_frequencies(known, "text")
    idf = np.log((1 + total) / (1 + df)) + 1

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            labels, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for start, texts in by_bytes(batch.column(0)):
                grams = ngrams(texts)
                for i in range(len(texts)):
                    at, n = np.unique(np.concatenate([h[first[i] : first[i + 1]] for h, first in grams]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([labels[start + i]]), pa.array([keys[start + i]]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([n.tolist()], pa.list_(pa.int32()))], ["label", "key", "at", "n"]
                    )

    # the distinct texts with the least hashes of each language: those of each of PARTS parts first, so that no language is one task
    keyed = known.withColumn("key", F.xxhash64("text", F.lit(seed)))
    part = F.pmod(F.col("key"), F.lit(PARTS))
    chosen = keyed.select("label", "key").distinct()
    for own in (Window.partitionBy("label", part), Window.partitionBy("label")):
        chosen = chosen.withColumn("_place", F.row_number().over(own.orderBy("key"))).where(F.col("_place") <= rows_per_language).drop("_place")
    # copies go before their texts are moved, and again after
    texts = keyed.join(F.broadcast(chosen), ["label", "key"]).groupBy("label", "key").agg(F.min("text").alias("text"))
    sample = texts.select("text", "label", "key").mapInArrow(tidy(features), "label string, key long, at array<int>, n array<int>").toArrow().combine_chunks()
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[int] = []
    names, keys = sample["label"].to_pylist(), sample["key"].to_pylist()
    languages = tuple(sorted(set(names)))
    if not languages:
        return Model((), idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    for i in sorted(range(len(names)), key=lambda i: (keys[i], names[i])):
        at, n = (sample[c][i].values.to_numpy() for c in ("at", "n"))
        if len(at):
            rows.append((at, (SCALE * n / n.sum() * idf[at]).astype(np.float32)))
            labels.append(languages.index(names[i]))
    y = np.array(labels, np.int64)
    held, met = np.zeros(len(y), bool), np.zeros(len(languages), np.int64)
    for i, label in enumerate(labels):  # every fifth of a language, so that none is held out as a whole
        met[label] += 1
        held[i] = met[label] % 5 == 0
    weights, bias = fit_ftrl([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(languages), alpha, beta, l1, l2, passes, seed)
    logits = np.array([v @ weights[at] + bias for (at, v), h in zip(rows, held, strict=True) if h]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, y[held]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (the calibrated probability of lang_pred)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, texts in by_bytes(batch.column(1)):
                known = np.array(has_letter(texts), bool) & bool(own.languages)
                p = own.scores(texts) if own.languages else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                names += [own.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                scores += np.where(known, p[np.arange(len(texts)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least this probability, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            keep: list[bool] = []
            for _, texts in by_bytes(batch.column(place)):
                known = np.array(has_letter(texts), bool) & bool(own.languages)
                keep += (known & (own.scores(texts).max(axis=1) >= min_score) if own.languages else known).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: the CRC-32 of its identifier's text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **how) -> DataFrame:
    """Train on the documents that are not held out and predict all: id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(id_col)), text_col, label_col, **how)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
