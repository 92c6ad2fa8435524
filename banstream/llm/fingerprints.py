"""Document fingerprints by consistent weighted sampling.

A document's terms are its runs of five words (fewer words: the whole sequence), weighted by how often they occur.
For each of ``SAMPLES`` samples a term draws r and c from Gamma(2, 1) and b from [0, 1), by its hash, and takes
part with t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the pair (term, t) of the term with the least a
is the sample. Two documents have the same sample with the probability of their generalised Jaccard similarity
(sum of least weights over sum of largest), so the share of equal samples estimates it. Draws come from a table of
``DRAWS`` triples, which a sample and a term's hash choose from. A fingerprint has 16 bits of every sample, in
hexadecimal.

Defined cases: null text is the empty text; texts without words have the empty fingerprint, which is like itself
(1) and unlike any other (0); texts that differ only in white space or the case of A-Z have equal fingerprints;
repeated rows follow one another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banstream.llm.shingles import mix, random64, row_sets, shingle, text_slices, words

SHINGLE = 5
SAMPLES = 64
DRAWS = 1 << 16


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of every draw; ln a for weight 1; each sample's odd multiplier."""
    u = (random64(3, 5 * DRAWS).reshape(5, DRAWS) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54
    r, c, b = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
    return r, c, b, c - r * (1 - b), random64(4, SAMPLES) | np.uint64(1)


def _sample(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The samples of one document, 16 bits each."""
    r, c, b, single, odd = _draws()
    draw = ((terms[None, :] * odd[:, None]) >> np.uint64(48)).astype(np.intp)
    score = single[draw]
    more = np.flatnonzero(counts > 1)
    step = np.zeros((SAMPLES, len(more)))
    if len(more):
        d = draw[:, more]
        step = np.floor(np.log(counts[more])[None, :] / r[d] + b[d])
        score[:, more] = c[d] - r[d] * (step - b[d] + 1)
    best = score.argmin(axis=1)
    level = np.zeros(SAMPLES, np.uint64)
    if len(more):
        place = np.searchsorted(more, best)
        place[place == len(more)] = 0
        hit = more[place] == best
        level[hit] = step[np.flatnonzero(hit), place[hit]].astype(np.uint64)
    return (mix(terms[best] + level * odd) >> np.uint64(48)).astype(">u2")


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The samples of every text; none for a text without words."""
    out: list[np.ndarray] = []
    for _, data, offsets in text_slices(pa.array(texts, pa.string())):
        hashes, first, _, _ = words(data, offsets)
        terms, counts, begin = row_sets(*shingle(hashes, first, SHINGLE))
        for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            out.append(_sample(terms[a:z], counts[a:z]) if z > a else np.zeros(0, ">u2"))
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of equal samples."""
    if len(one) != len(other):
        return 0.0
    return float((one == other).mean()) if len(one) else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def dealt_in_order(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (id, text, part, ahead) sorted by identifier within parts that follow one another.

    Each part ends with a copy (``ahead``) of the document that comes after it, the last part with a copy of the
    first. Only the parts' limits, one identifier each, pass through the driver; texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    limits = rows.agg(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts)).alias("at")).first()["at"] if parts > 1 else []
    limits = sorted(set(limits or []))
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in limits]), lambda x: x <= F.col("id"))), F.lit(0)) if limits else F.lit(0)
    placed = rows.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(part))
    # a null identifier sorts first: it starts part 0 wherever there is one
    starts = {r["part"]: (r["first"], r["nulls"]) for r in placed.groupBy("part").agg(F.min("id").alias("first"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).collect()}
    order = sorted(starts)
    ahead = F.lit(None).cast("int")
    if order:
        before = {p: order[i - 1] for i, p in enumerate(order)}
        slots = range(max(order) + 1)
        first = F.get(F.array(*[F.lit(None if s not in starts or starts[s][1] else starts[s][0]).cast("long") for s in slots]), F.col("part"))
        previous = F.get(F.array(*[F.lit(before.get(s)).cast("int") for s in slots]), F.col("part"))
        ahead = F.when(F.col("id").eqNullSafe(first), previous)
    copies = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead")), F.when(ahead.isNotNull(), F.struct(ahead.alias("part"), F.lit(True).alias("ahead")))))
    spread = placed.select("id", "text", F.explode(copies).alias("to")).select("id", "text", "to.part", "to.ahead")
    return spread.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "ahead", F.col("id").asc_nulls_first(), "text")


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next identifier, after the last the first.
    """
    parts = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row that came, which waits for its next one
        for batch in batches:
            ids, parts_of, aheads = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for first, some in _slices(batch.column(1)):
                prints = fingerprints(some)
                at = range(first, first + len(some))
                rows = [*held, *zip([ids[i] for i in at], some, [parts_of[i] for i in at], [aheads[i] for i in at], prints, strict=True)]
                held = rows[-1:]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[3] and x[2] == y[2]]
                changed = [edited(x[1], y[1]) for x, y in pairs]
                new = fingerprints(changed)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([x[0] for x, _ in pairs], pa.int64()),
                        "n_chars": pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                        "fingerprint": pa.array([x[4].tobytes().hex() for x, _ in pairs], pa.string()),
                        "edited_fingerprint": pa.array([p.tobytes().hex() for p in new], pa.string()),
                        "near_edited": pa.array([likeness(x[4], p) for (x, _), p in zip(pairs, new, strict=True)], pa.float64()),
                        "near_next": pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                    }
                )

    return dealt_in_order(docs, id_col, text_col, parts).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for first, _, offsets in text_slices(column):
        yield first, column.slice(first, len(offsets) - 1).to_pylist()
