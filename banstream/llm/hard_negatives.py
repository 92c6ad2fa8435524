"""Hard negatives for contrastive training, by segment summary filtering.

Vectors are written once in blocks of at most ``BLOCK``, each with the mean and the deviation (root of the sum of
squared differences from the mean) of ``SEGMENTS[-1]`` segments of every vector. Over a segment the inner product of
two vectors is the length times the product of their means, plus or minus at most the product of their deviations.
Summed over the segments that is an interval for the score. Coarser segments' summaries follow from finer ones'. The
filter begins with the coarsest; pairs whose interval can't matter go, the others meet finer segments, and what is
left is scored exactly.

What matters is a task's own business: for each anchor the least score that can still enter its best few, as known
from the blocks that the task has seen. It only saves work; the best few of all tasks are ranked by Spark.

Anchors, a query set that the caller states by a condition, meet all rows in blocks: blocks of rows are dealt to
groups of ``GROUP`` blocks at most, blocks of anchors are copied to every group, and both are joined by the group. Up to ``GROUP``
groups there may be more than that takes, for work for all tasks. The copies are shuffled, never broadcast (Spark would judge them by
the size of one), and go without summaries, which are made where they arrive. A task holds a block of each and the
scores of the anchors it has seen last. First pass: the ``positives`` best rows of an anchor's
own label. Second pass: for each positive the best ``negatives`` rows of another label whose score lies in the window
given by the positive's. Vectors in random directions have most of what they are in their deviations: there the first two
levels left 95 % of all pairs and the third 30 %, for the best five. What is left of a block is scored as a whole where
it is more than ``DENSE``.

Defined cases: rows with a null identifier, label or vector, an empty vector, or a null or non-finite component take
no part; vectors with different numbers of components are no pair; rows that repeat an anchor's identifier are not
its positives or negatives, and the one with the least label and vector is the anchor; equal scores go by the
smaller identifier; an anchor without rows of its own label has no positives and no result; an empty table gives an
empty result; other columns are ignored. Components beyond ``vectors.LARGEST`` after scaling are an error.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.llm.shared import materialize
from banstream.llm.vectors import finite, scaled

#: Segments of a vector at each level of the filter, coarsest first; each number divides the next.
SEGMENTS = (2, 8, 32)
BLOCK = 1024
ANCHORS = 256
GROUP = 64
#: Blocks of anchors whose best scores a task remembers.
REMEMBERED = 256
#: If a larger share of a block's pairs is left, the block is scored as a whole.
DENSE = 0.05
SUMMARY = ("means", "deviations")
#: Less than any score; its negative is a number too.
NONE = np.iinfo(np.int64).min + 1


def summaries(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, deviations) of each row's segments, and a segment's length; the last is filled up with zeros."""
    length = -(-vectors.shape[1] // segments)
    parts = np.pad(vectors, ((0, 0), (0, segments * length - vectors.shape[1]))).reshape(len(vectors), segments, length).astype(np.float64)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2)), length


def coarser(means: np.ndarray, deviations: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The summaries of fewer segments, each made of as many of the given ones."""
    each = means.shape[1] // segments
    m, d = means.reshape(len(means), segments, each), deviations.reshape(len(means), segments, each)
    mean = m.mean(axis=2)
    return mean, np.sqrt((d**2 + length * (m - mean[:, :, None]) ** 2).sum(axis=2)), length * each


def bounds(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of each pair of rows, a unit wider than rounding can reach."""
    center = (one[0] * one[2]) @ other[0].T
    reach = one[1] @ other[1].T
    slack = 1 + 1e-9 * (np.abs(center).max(initial=0) + reach.max(initial=0))
    return center - reach - slack, center + reach + slack


def filtered(one: tuple, other: tuple, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the pairs ``alive`` (anchors x rows) those whose score may be from ``low`` to ``high`` of their anchor."""
    for level in SEGMENTS:
        least, most = bounds(*(coarser(*s, level) if level < s[0].shape[1] else s for s in (one, other)))
        alive = alive & (most >= low[:, None]) & (least <= high[:, None])
        if not alive.any():
            break
    return alive


def scores(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs alive. Doubles are exact: sums of products stay below 2^53."""
    a, r = np.nonzero(alive)
    if len(a) > DENSE * alive.size:
        every = anchors.astype(np.float64) @ rows.T.astype(np.float64)
        return a, r, every[a, r].astype(np.int64)
    return a, r, np.einsum("ij,ij->i", anchors[a].astype(np.int64), rows[r].astype(np.int64))


def leading(key: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` of each key: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    place = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
    return order[place < most]


def _pack(columns: dict[str, str], size: int, summed: bool):
    """mapInArrow function: rows (id, label, vector, ..) to blocks of at most ``size`` vectors of one length, ``summed``: with their summaries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b["vector"].value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                for i in range(0, len(at), size):
                    own = b.take(pa.array(at[i : i + size]))
                    vectors = own["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(own), dims)
                    known = [x.tobytes() for x in summaries(vectors, SEGMENTS[-1])[:2]] if summed else []
                    rest = [own[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() if kind == "array" else own[c].to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c, kind in columns.items()]
                    yield pa.record_batch([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in (int(dims), vectors.tobytes(), *known, *rest)], ["dims", "vectors", *SUMMARY[: len(known)], *columns])

    return pack


def _blocks(rows: DataFrame, columns: dict[str, str], size: int, name: str, summed: bool = False) -> DataFrame:
    kinds = ", ".join(f"{c} binary" for c in ("vectors", *(SUMMARY if summed else ()), *columns))
    return materialize(rows.mapInArrow(_pack(columns, size, summed), f"dims int, {kinds}"), name)


class Block:
    """One side of a pair of blocks, read from its row."""

    def __init__(self, row: dict, side: str) -> None:
        self.key, dims = row[f"{side}_ids"], row[f"{side}_dims"]
        self.ids, self.labels = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row[f"{side}_vectors"], np.int32).reshape(len(self.ids), dims)
        if f"{side}_means" in row:
            means, deviations = (np.frombuffer(row[f"{side}_{c}"], np.float64).reshape(len(self.ids), SEGMENTS[-1]) for c in SUMMARY)
            self.summary = (means, deviations, -(-dims // SEGMENTS[-1]))
        else:
            self.summary = summaries(self.vectors, SEGMENTS[-1])


class Seen(OrderedDict):
    """The best scores for a block of anchors, of the blocks seen last."""

    def best(self, key: bytes, shape: tuple[int, ...]) -> np.ndarray:
        if key not in self:
            self[key] = np.full(shape, NONE)
            if len(self) > REMEMBERED:
                self.popitem(last=False)
        self.move_to_end(key)
        return self[key]


def _remember(best: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
    """Merge scores (at most as many for a place as ``best`` has columns) into the rows of ``best``, kept in descending order."""
    order = np.lexsort((-score, place))
    p, s = place[order], score[order]
    own, starts = np.unique(p, return_index=True)
    new = np.full((len(own), best.shape[1]), NONE)
    new[np.searchsorted(own, p), np.arange(len(p)) - starts[np.searchsorted(own, p)]] = s
    best[own] = -np.sort(-np.concatenate([best[own], new], axis=1), axis=1)[:, : best.shape[1]]


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block]]:
    a = None
    for b in batches:
        for i in range(b.num_rows):  # a pair has some MB
            row = b.slice(i, 1).to_pylist()[0]
            if a is None or a.key != row["a_ids"]:  # it stays for all blocks of its group
                a = Block(row, "a")
            yield row, a, Block(row, "r")


def _best_of_label(most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for _, a, r in _each_pair(batches):
            best = seen.best(a.key, (len(a.ids), most))
            alive = (a.labels[:, None] == r.labels[None, :]) & (a.ids[:, None] != r.ids[None, :])
            floor = best[:, -1].copy()
            alive = filtered(a.summary, r.summary, alive, floor, np.full(len(floor), np.inf))
            i, j, s = scores(a.vectors, r.vectors, alive)
            good = s >= floor[i]
            i, j, s = i[good], j[good], s[good]
            top = leading(i, s, r.ids[j], most)
            if len(top):
                _remember(best, i[top], s[top])
                yield pa.record_batch([pa.array(a.ids[i[top]]), pa.array(r.ids[j[top]]), pa.array(s[top])], ["anchor_id", "positive_id", "positive_score"])

    return search


def _best_in_windows(most: int, positives: int, from_percent: int, to_percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for row, a, r in _each_pair(batches):
            n = len(a.ids)
            own = np.frombuffer(row["a_scores"], np.int64).reshape(n, positives)
            there = own != NONE
            safe = np.where(there, own, 0)
            low, high = np.where(there, -(-from_percent * safe // 100), 1), np.where(there, to_percent * safe // 100, 0)
            best = seen.best(a.key, (n * positives, most))
            floor = np.maximum(low, best[:, -1].reshape(n, positives))
            ends = np.where(floor <= high, floor, np.iinfo(np.int64).max).min(axis=1), np.where(floor <= high, high, NONE).max(axis=1)
            alive = a.labels[:, None] != r.labels[None, :]
            i, j, s = scores(a.vectors, r.vectors, filtered(a.summary, r.summary, alive, *ends))
            for p in range(positives):
                good = (s >= floor[i, p]) & (s <= high[i, p]) & (a.ids[i] != r.ids[j])
                gi, gj, gs = i[good], j[good], s[good]
                top = leading(gi, gs, r.ids[gj], most)
                if len(top):
                    _remember(best, gi[top] * positives + p, gs[top])
                    yield pa.record_batch([pa.array(a.ids[gi[top]]), pa.array(np.full(len(top), p, np.int32)), pa.array(r.ids[gj[top]]), pa.array(gs[top])], ["anchor_id", "p", "negative_id", "negative_score"])

    return search


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select("g", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "g"])


def _pairs(anchors: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Every block of anchors beside every block of rows of vectors as long."""
    spread = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return _side(spread, "a").hint("merge").join(_side(rows, "r"), "g").where("a_dims = r_dims")


def group_count(blocks: int, partitions: int) -> int:
    return max(1, -(-blocks // GROUP), min(blocks, partitions, GROUP))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    from_percent: int = 50,
    to_percent: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of which ``is_anchor`` holds.

    ``is_anchor`` speaks of a column ``id``. Scores are inner products of floor(scale * component); a positive's
    negatives have from ``from_percent`` to ``to_percent`` hundredths of its score.
    """
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    kept = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite(F.col("v"))
    vectors = given.where(kept).select(F.col("id").alias("ids"), F.col("label").alias("labels"), scaled(F.col("v"), scale, kept).alias("vector"))
    stored = _blocks(vectors, {"ids": "long", "labels": "long"}, BLOCK, "segments", summed=True)
    groups = group_count(stored.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored.withColumn("g", F.pmod(F.xxhash64("ids", "vectors"), F.lit(groups)).cast("int"))

    one = vectors.withColumnRenamed("ids", "id").where(is_anchor).groupBy("id").agg(F.min(F.struct("labels", "vector")).alias("own"))
    chosen = materialize(one.select(F.col("id").alias("ids"), "own.labels", "own.vector"), "anchors")
    found = _pairs(_blocks(chosen, {"ids": "long", "labels": "long"}, ANCHORS, "anchor-blocks"), dealt, groups).mapInArrow(
        _best_of_label(positives), "anchor_id long, positive_id long, positive_score long"
    )
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = materialize(found.withColumn("p", place - 1).where(F.col("p") < positives), "positives")

    # of each anchor at most ``positives`` rows
    own = best.groupBy(F.col("anchor_id").alias("ids")).agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("s"))
    scored = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda p: F.coalesce(F.get(F.col("s.positive_score"), p), F.lit(int(NONE))))
    armed = chosen.hint("merge").join(own, "ids").select("ids", "labels", "vector", scored.alias("scores"))
    pairs = _pairs(_blocks(armed, {"ids": "long", "labels": "long", "scores": "array"}, ANCHORS, "armed-blocks"), dealt, groups)
    hits = pairs.mapInArrow(_best_in_windows(negatives, positives, from_percent, to_percent), "anchor_id long, p int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "p").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.join(best.hint("merge"), ["anchor_id", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
