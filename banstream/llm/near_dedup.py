"""Near-duplicate detection by a signature-coordinate inverted join, with exact confirmation.

A document's set holds its distinct runs of ``size`` words. Sets are compared by MinHash signatures of ``COORDS``
coordinates, each coordinate-value pair being a posting:

* Documents with equal sets are one class and go on as one row.
* Prefix: signatures that agree in at least ``AGREE`` coordinates share one of their ``COORDS - AGREE + 1`` rarest
  postings, so a class is posted under those alone. Postings with a single class go.
* A posting is never expanded into all its pairs. First each class is compared with the leaders (least class) of its
  postings, those it collides with most often. A pair whose signatures collide in at least ``AGREE`` coordinates is
  retained; what of these is confirmed gives components.
* Skip: postings within one component are done with. In the others a class goes on if another of fit size in another
  component differs in no more of 256 further one-bit samples than similar sets do. Of those that go on, pairs
  across components are found by the prefixes of their full sets (``_across``), which loses none.
* Every link is confirmed on the full sets, natively, as 100 * intersection >= percent * union.

Words are compared by 64-bit hashes that mix after every eight bytes (``shingles``). Two sets of similarity 0.8 agree in fewer than ``AGREE`` coordinates, or differ in more than ``FAR`` bits, with a
probability below 1 in 100,000; nothing else is left out.

Defined cases: null text or text without words has an empty set, is linked with nothing and kept; a document with
fewer words than ``size`` has its whole sequence as one run; rows that share an identifier are one document; a row
without identifier is linked with nothing and kept; ties (several leaders with as many collisions) go to the least
identifier; a text of many megabytes is one slice; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.llm.components import components
from banstream.llm.segments import tidy
from banstream.llm.shared import materialize
from banstream.llm.shingles import mix, random64, row_sets, shingle, text_slices, words

COORDS = 32
AGREE = 15
BITS = 256
FAR = 48
#: Leaders that a class is compared with in a round.
LEADERS = 2

_COORD_MUL, _COORD_ADD = random64(5, COORDS) | np.uint64(1), random64(6, COORDS)
_BIT_MUL, _BIT_ADD = random64(7, BITS) | np.uint64(1), random64(8, BITS)


def _minima(values: np.ndarray, begin: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each row with values (begin: rows + 1) the least hash by each function: rows x functions."""
    full = np.flatnonzero(np.diff(begin))
    out = np.empty((len(full), len(mul)), np.uint64)
    for j in range(len(mul)):
        out[:, j] = np.minimum.reduceat((values ^ add[j]) * mul[j], begin[:-1][full]) if len(full) else 0
    return out


def _sketch(size: int, signed: bool):
    """A function over batches (id, text): id, n, k1, k2 (a 128-bit key of the set), and posts and bits if ``signed``, else the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for first, data, offsets in text_slices(column, 1 << 20):
                hashes, begin, _, _ = words(data, offsets)
                sets, _, begin = row_sets(*shingle(hashes, begin, size))
                n = np.diff(begin)
                keys = np.array([np.frombuffer(hashlib.blake2b(sets[a:z].tobytes(), digest_size=16).digest(), "<i8") for a, z in zip(begin[:-1], begin[1:], strict=True)])
                out = [batch.column(0).slice(first, len(n)), pa.array(n.astype(np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                if signed:
                    full = np.flatnonzero(n)
                    posts = np.zeros((len(n), COORDS), np.uint64)
                    posts[full] = mix(_minima(sets, begin, _COORD_MUL, _COORD_ADD) + _COORD_ADD)
                    ones = np.zeros((len(n), BITS), np.uint8)
                    ones[full] = (mix(_minima(sets, begin, _BIT_MUL, _BIT_ADD)) & np.uint64(1)).astype(np.uint8)
                    bits = np.packbits(ones, axis=1).view("<i8")
                    rows = np.arange(len(n) + 1, dtype=np.int32)
                    out += [
                        pa.ListArray.from_arrays(pa.array(rows * COORDS), pa.array(posts.reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(rows * (BITS // 64)), pa.array(bits.reshape(-1))),
                    ]
                    yield pa.RecordBatch.from_arrays(out, ["id", "n", "k1", "k2", "posts", "bits"])
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sets.view(np.int64))))
                    yield pa.RecordBatch.from_arrays(out, ["id", "n", "k1", "k2", "grams"])

    return run


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar: the smaller is at least ``percent`` of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets are similar. Texts are read again for the documents named alone."""
    pairs = materialize(pairs, "pairs")
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(
        texts.join(named.hint("merge"), "id", "left_semi").mapInArrow(tidy(_sketch(size, False), tables=True), "id long, n int, k1 long, k2 long, grams array<long>").select("id", "grams"), "sets"
    )
    one, other = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return materialize(pairs.join(one, "a").join(other, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b").distinct(), "links")


def _best(candidates: DataFrame) -> DataFrame:
    """Of (id, leader) with repeats the ``LEADERS`` most frequent leaders of each id, as pairs (a, b)."""
    counted = candidates.groupBy("id", "leader").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("id").orderBy(F.desc("c"), "leader")
    best = counted.withColumn("r", F.row_number().over(over)).where(F.col("r") <= LEADERS)
    return best.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures collide in enough coordinates; a posting's value belongs to one coordinate."""
    one, other = (classes.select(F.col("id").alias(c), F.col("posts").alias(f"p{c}")) for c in "ab")
    agree = F.size(F.array_intersect("pa", "pb"))
    return pairs.join(one, "a").join(other, "b").where(agree >= AGREE).select("a", "b")


def _postings(classes: DataFrame) -> DataFrame:
    """(id, n, bits, post) of every class under its rarest postings that it shares with another class."""
    posted = classes.select("id", F.explode("posts").alias("post"))
    shared = posted.groupBy("post").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = posted.join(shared, "post").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "post"))).alias("own"))  # at most COORDS entries
    # postings that are not shared are the rarest and come first
    prefix = own.select("id", F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - (AGREE - 1))).alias("own"))
    rare = prefix.select("id", F.explode("own.post").alias("post"))
    return materialize(classes.select("id", "n", "bits").join(rare, "id"), "postings")


def _across(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the classes (id, component), across components, that can be similar by their sets' prefixes.

    Sets are ordered by how often a run occurs among these classes. Similar sets share a run in the first
    n - ceil(n * percent / 100) + 1 places of each, and from the first that they share on, enough places are left
    in both; nearly all pairs of a large group that are not quite similar enough fail this.
    """
    sets = texts.join(open_.select("id").hint("merge"), "id", "left_semi").mapInArrow(tidy(_sketch(size, False), tables=True), "id long, n int, k1 long, k2 long, grams array<long>")
    runs = materialize(sets.select("id", "n", F.explode("grams").alias("g")).join(open_, "id"), "runs")
    shared = runs.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # runs of one class alone come first in every order: they are counted, not sorted
    own = runs.join(shared, "g").groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("own"))  # at most a document's runs
    alone = F.col("n") - F.size("own")
    prefix = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone).cast("int")
    placed = own.select("id", "n", "component", alone.alias("alone"), F.posexplode(F.slice("own.g", 1, prefix)).alias("at", "g"))
    placed = materialize(placed.select("g", "id", "component", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest")), "prefixes")
    left, right = (placed.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n", "rest"))) for s in "ab")
    most = F.least("rest_a", "rest_b")  # of shared runs, from here on
    can = most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent
    pairs = left.join(right, "g").where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & _fits("n_a", "n_b", percent) & can)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (the least identifier of a component stays)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = materialize(texts.mapInArrow(tidy(_sketch(size, True), tables=True), "id long, n int, k1 long, k2 long, posts array<long>, bits array<long>"), "sketches")
    # sets of n runs that are similar to another set have at least this many
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    classes = materialize(
        sketches.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.first("posts").alias("posts"), F.first("bits").alias("bits")), "classes"
    )
    postings = _postings(classes.where(F.col("n") >= least))

    heads = postings.groupBy("post").agg(F.min("id").alias("leader"), F.min_by("n", "id").alias("m"))
    met = _best(postings.join(heads, "post").where((F.col("id") != F.col("leader")) & _fits("n", "m", percent)).select("id", "leader"))
    links = _confirm(_matching(met, classes), texts, size, percent)
    labels = components(links)

    # skip: postings within one component are done with
    placed = postings.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("post").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("post")
    apart = materialize(placed.join(mixed, "post"), "apart")
    other = apart.select("post", *(F.col(c).alias(f"{c}_b") for c in ("n", "bits", "component")))
    met = (F.col("component") != F.col("component_b")) & _fits("n", "n_b", percent) & _near("bits", "bits_b")
    open_ = materialize(apart.join(other, (apart["post"] == other["post"]) & met, "left_semi").select("id", "component").distinct(), "open")
    labels = components(links.unionByName(_confirm(_across(open_, texts, size, percent), texts, size, percent)))

    known = classes.select("k1", "k2", "n", F.col("id").alias("rep"))
    placed = known.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    joined = sketches.select("id", "n", "k1", "k2").join(placed, ["k1", "k2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), (component.eqNullSafe(F.col("id"))).alias("kept")
    )


def _near(a: str, b: str) -> Column:
    """Whether the one-bit samples differ in few places."""
    differ = [F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i))) for i in range(1, BITS // 64 + 1)]
    return sum(differ[1:], differ[0]) <= FAR
