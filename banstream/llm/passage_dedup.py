"""Passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is a line of ``WORDS`` words or more. It is compared as the set of its runs of five words. ``tune_bands``
picks the fewest hashes for the wanted recall; paragraphs that meet in a band in different documents are compared with
the band's leader by exact Jaccard similarity. Of the members of bands that then still hold several components, all
other similar pairs are found exactly (``_across``), so the recall is that of the bands, whatever the leaders are. Links
are closed to clusters by components.

Passages are also copied into and out of lines. For these every text has windows: runs of ``WORDS`` words from an
anchor, which is among every ``SPAN`` neighbouring places the one whose next three words have the least hash. Anchors
depend on nothing but the words around them, so every passage of ``SPAN + WORDS`` = 50 words or more that two documents
share has a window in common, wherever it stands. A window is a band of its own: those that agree word for word are a
cluster. Windows that are removed are extended word by word as far as the text agrees with the one that stays.

Of a cluster all occurrences but those in its least document are removals, merged to spans. Bands are reduced before
they are joined again; no band is gathered or expanded into pairs.

Defined cases: null text, and text with fewer than ``WORDS`` words, has no paragraphs; repeats inside one document
alone are left; rows that share an identifier are one document; rows without identifier are ignored; ties go to the
least document, then the first place; a text of many megabytes is taken as one slice; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.llm.components import components
from banstream.llm.shared import materialize
from banstream.llm.shingles import mix, random64, row_sets, text_slices, words

WORDS, SPAN, RUN = 28, 22, 5
#: Parities of a set's runs; that many tell sets of hundreds of runs apart.
PARITIES = 512
#: Leaders of a posting that are tried before what is left is joined pair by pair.
HEADS = 8
#: A paragraph's least postings, which tell in which one of them a pair is put out.
LEAST = 32
_ANCHOR, _COMBINE = random64(9, 3) | np.uint64(1), random64(10, RUN) | np.uint64(1)


def tune_bands(similarity: float, recall: float, unlike: float = 0.3, chance: float = 0.3) -> tuple[int, int]:
    """Bands and rows with the fewest hashes such that pairs of this similarity meet with at least the probability
    ``recall``, and pairs of the similarity ``unlike`` in one band with at most ``chance`` (so that bands stay small)."""
    found = []
    for rows in range(1, 9):
        bands = next(b for b in range(1, 10_000) if 1 - (1 - similarity**rows) ** b >= recall)
        if unlike**rows <= chance / 3:
            found.append((bands * rows, bands, rows))
    return min(found)[1:]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    n = len(hashes) - len(multipliers) + 1
    return mix(sum(hashes[j : j + n] * m for j, m in enumerate(multipliers)))


def paragraphs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all paragraphs, as places among all words, and the row of each."""
    if len(hashes) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    threes = _runs(hashes, _ANCHOR)
    low = np.uint64((1 << 32) - 1)
    # the least value of a window, with its place in the low bits
    marked = (threes & ~low) | np.arange(len(threes), dtype=np.uint64)
    found = _least(marked, SPAN)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][row]
    start = np.arange(len(found))
    at = np.unique((found[start + SPAN + 2 <= last[: len(found)]] & low).astype(np.int64))
    at = at[at + WORDS <= last[at]]
    return at, row[at]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (size[0] of them), begin[1], .."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _keys(runs: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the runs of the paragraphs that begin at these words, with so many words: their mixed sum, in which no order cancels out."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(runs ^ _ANCHOR[0]))])
    return mix(total[at + size - RUN + 1] - total[at] + size.astype(np.uint64)).view(np.int64)


def _lines(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines with enough words: their first words as places among all, the numbers of their words, and their rows.

    ``starts``: where words begin; ``first``: the first word of every row.
    """
    feeds = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([np.searchsorted(starts, feeds), first]))
    size = np.diff(cuts)
    keep = size >= WORDS
    at, size = cuts[:-1][keep], size[keep]
    return at, size, np.searchsorted(first, at, "right") - 1


def _banded(bands: int, rows: int):
    """A function over batches (doc, text): band, para, doc, word, n, and whether it is a line."""
    odd = random64(11, bands * rows) | np.uint64(1)
    salt = random64(12, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(band, key, at, size, row, line: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"band": band, "para": key, "doc": ids[begin + row], "word": (at - first[row]).astype(np.int32), "n": size.astype(np.int32), "line": np.full(len(at), line)})

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for begin, data, offsets in text_slices(batch.column(1)):
                hashes, first, starts, _ = words(data, offsets)
                if len(hashes) < WORDS:
                    continue
                runs = _runs(hashes, _COMBINE)
                at, row = paragraphs(hashes, first)
                size = np.full(len(at), WORDS)
                if len(at):
                    key = _keys(runs, at, size)
                    yield out(key, key, at, size, row, False)
                at, size, row = _lines(data, starts, first)
                if not len(at):
                    continue
                key = _keys(runs, at, size)
                borders = np.stack([at, at + size - RUN + 1], axis=1).reshape(-1)
                for band in range(bands):
                    value = np.full(len(at), salt[band])
                    for m in odd[band * rows : (band + 1) * rows]:
                        value = mix(value ^ np.minimum.reduceat(np.append(mix(runs * m), _LAST), borders)[::2])
                    yield out(value.view(np.int64), key, at, size, row, True)

    return run


_LAST = np.uint64(2**64 - 1)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (text, places): the distinct runs of the lines at these words, ascending, if it is these that stand there."""
    for batch in batches:
        places = batch.column(1).to_pylist()
        for begin, data, offsets in text_slices(batch.column(0)):
            hashes, first, _, _ = words(data, offsets)
            own = [(p["para"], int(first[i]) + p["word"], p["n"]) for i in range(len(offsets) - 1) for p in places[begin + i] if first[i] + p["word"] + p["n"] <= first[i + 1]]
            if own:
                para, at, size = (np.array(x) for x in zip(*own, strict=True))
                runs = _runs(hashes, _COMBINE)
                there = _keys(runs, at, size) == para
                para, at, size = para[there], at[there], size[there] - RUN + 1
                values, _, stops = row_sets(runs[_ragged(at, size)], np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([pa.array(para), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(values.view(np.int64)))], ["para", "grams"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc, text, places): the hashes of the ``SPAN`` words before each place, nearest first, and of those from it on."""
    for batch in batches:
        places, docs = batch.column(2).to_pylist(), batch.column(0).to_pylist()
        for begin, data, offsets in text_slices(batch.column(1)):
            hashes, first, _, _ = words(data, offsets)
            hashes = hashes.view(np.int64)
            doc, word, left, right = [], [], [], []
            for i in range(len(offsets) - 1):
                own = hashes[first[i] : first[i + 1]]
                for at in places[begin + i]:
                    doc.append(docs[begin + i])
                    word.append(at)
                    left.append(own[max(at - SPAN, 0) : at][::-1])
                    right.append(own[at : at + SPAN])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(word, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (left, right))], ["doc", "word", "left", "right"])


@cache
def _prefixes(n: int, similarity: float) -> tuple[int, int]:
    """Of how many places a set of ``n`` runs posts its neighbours, and its single runs, so that it meets all similar sets.

    Sets in one order that share o runs and differ in d have o - 1 neighbours of the shared runs in common, of which
    a run that differs parts one at most: of the first d + 1 one is left in both. It begins at place d + 1, or later
    by the runs that only this set has. Where o - 1 < d + 1 (the smallest sets) a single run of the prefix is shared.
    """
    double = single = 0
    for m in range(max(1, math.ceil(similarity * n - 1e-9)), int(n / similarity + 1e-9) + 1):
        both = math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
        apart = n + m - 2 * both
        if both >= apart + 2:
            double = max(double, apart + 1 + n - both)
        else:
            single = max(single, n - both + 1)
    return min(double, n - 1), min(single, n)


def _posted(similarity: float):
    """A function over batches (para, component, grams): post, para, component, n, bits, the parity of the runs dealt over ``PARITIES`` bits, and least, the least postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            para, component = (batch.column(i).to_numpy() for i in (0, 1))
            begin = batch.column(2).offsets.to_numpy().astype(np.int64)
            values = batch.column(2).values.to_numpy().view(np.uint64)[begin[0] : begin[-1]]
            begin = begin - begin[0]
            n = np.diff(begin)
            place = mix(values)
            word, one = (place >> np.uint64(6)) % np.uint64(PARITIES // 64), np.uint64(1) << (place & np.uint64(63))
            bits = np.stack([np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), begin[:-1]) for w in range(PARITIES // 64)], axis=1)
            sizes, which = np.unique(n, return_inverse=True)
            limits = np.array([_prefixes(int(x), similarity) for x in sizes])[which]
            many = limits.reshape(-1)  # neighbours and single runs of each paragraph in turn
            row = np.repeat(np.arange(len(n)).repeat(2), many)
            at = _ragged(begin[:-1].repeat(2), many)
            single = np.repeat(np.tile([False, True], len(n)), many)
            post = np.where(single, values[at], mix(values[at]) ^ values[np.minimum(at + 1, len(values) - 1)])
            post, _, first = row_sets(post, np.concatenate([[0], np.cumsum(limits.sum(axis=1))]))
            count = np.diff(first)
            few = np.minimum(count, LEAST)
            least = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), pa.array(post[_ragged(first[:-1], few)].view(np.int64)))
            row = np.repeat(np.arange(len(n)), count)
            parities = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(bits.reshape(-1).view(np.int64)))
            for a in range(0, len(row), 1 << 16):
                own = row[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"post": post[a : a + (1 << 16)].view(np.int64), "para": para[own], "component": component[own], "n": n[own].astype(np.int32), "bits": parities.take(pa.array(own)), "least": least.take(pa.array(own))})

    return run


def _can(n_a: str, bits_a: str, n_b: Column, bits_b: Column, similarity: float) -> Column:
    """Whether two paragraphs can be similar: no more parities differ than their runs may, and sizes fit."""
    apart = [F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(PARITIES // 64)]
    return (sum(apart[1:], apart[0]) <= (1 - similarity) / (1 + similarity) * (F.col(n_a) + n_b) + 1e-9) & (
        F.least(F.col(n_a), n_b) >= similarity * F.greatest(F.col(n_a), n_b) - 1e-9
    )


def _pairs(met: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of two columns, the lesser first."""
    one, other = met.columns
    return met.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _confirm(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets are similar."""
    one, other = (grams.select(F.col("para").alias(c), F.col("grams").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(other, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def _open(members: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The members (key, para, ..) of groups that hold several components, with their component."""
    placed = members.join(labels.withColumnRenamed("node", "para"), "para", "left").withColumn("component", F.coalesce("component", "para"))
    mixed = placed.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(key)
    return placed.join(mixed, key)


def _across(open_: DataFrame, grams: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """The links and all others between similar paragraphs of ``open_`` (para, component) in different components."""
    sets = grams.join(open_, "para").select("para", "component", "grams")
    posted = sets.mapInArrow(_posted(similarity), "post long, para long, component long, n int, bits array<long>, least array<long>")
    mixed = posted.groupBy("post").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("post")
    postings = materialize(posted.join(mixed, "post"), "postings")
    # leaders first, several at once, so that a dense group becomes one component before its pairs are looked at
    head = [F.min_by(F.struct("para", "component", "n", "bits"), F.xxhash64("para", F.lit(i))) for i in range(HEADS)]
    led = postings.groupBy("post").agg(F.array_distinct(F.array(*head)).alias("heads")).withColumnRenamed("post", "led")
    fits = lambda h: (h["component"] != F.col("component")) & _can("n", "bits", h["n"], h["bits"], similarity)
    fit = postings.join(led, (F.col("post") == F.col("led")) & F.exists("heads", fits)).select("post", "para", F.filter("heads", fits).alias("heads"))
    # a paragraph has several postings under the same leaders: each names one of them
    one = F.get("heads", F.pmod(F.xxhash64("para", "post"), F.greatest(F.size("heads"), F.lit(1))).cast("int"))["para"]
    links = materialize(links.unionByName(_confirm(_pairs(fit.select("para", one.alias("other")).where("other is not null")), grams, similarity)), "links")
    postings = _open(postings.drop("component"), components(links), "post")
    left, right = (postings.select("post", *(F.col(c).alias(f"{c}_{s}") for c in ("para", "component", "n", "bits", "least"))) for s in "ab")
    # of the postings that both have one puts the pair out; where none of their least is shared, all do
    once = F.coalesce(F.array_min(F.array_intersect("least_a", "least_b")), F.col("post")) == F.col("post")
    can = (F.col("para_a") < F.col("para_b")) & (F.col("component_a") != F.col("component_b")) & _can("n_a", "bits_a", F.col("n_b"), F.col("bits_b"), similarity)
    return links.unionByName(_confirm(_pairs(left.join(right, "post").where(can & once).select("para_a", "para_b")), grams, similarity))


def _line_clusters(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the lines (band, para, doc, word, n) that are similar to another."""
    leaders = members.groupBy("band").agg(F.min("para").alias("leader"))
    near = materialize(members.join(leaders, "band").where("para <> leader").select(F.col("para").alias("a"), F.col("leader").alias("b")).distinct(), "near")
    named = near.select(F.col("a").alias("para")).unionByName(near.select(F.col("b").alias("para"))).distinct()
    places = members.groupBy("para").agg(F.min(F.struct("doc", "word", "n")).alias("at")).join(named, "para")
    wanted = places.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct("para", "at.word", "at.n")).alias("places"))  # at most a document's lines
    grams = materialize(texts.join(wanted, "doc").select("text", "places").mapInArrow(_grams, "para long, grams array<long>"), "grams")
    links = materialize(_confirm(near, grams, similarity), "links")
    open_ = _open(members.select("band", "para"), components(links), "band").select("para", "component").distinct()
    return components(_across(open_, grams, links, similarity))


def _spans(extra: DataFrame) -> DataFrame:
    """Occurrences (doc, word, stop, cluster, keeper, kept_word, line) merged to spans, with the first and the last of each, and the least document that keeps any."""
    order = Window.partitionBy("doc").orderBy("word", "stop", "cluster")
    new = F.coalesce((F.col("word") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    ends = F.struct("word", "stop", "line", "keeper", "kept_word", "cluster")
    return extra.withColumn("new", new).withColumn("span", F.sum("new").over(order)).groupBy("doc", "span").agg(
        F.min(ends).alias("head"), F.max_by(ends, F.struct("stop", "word", "cluster")).alias("tail"), F.min(F.struct("keeper", "cluster")).alias("kept")
    )


def _agree(a: str, b: str) -> Column:
    """How many leading items of two arrays are equal."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(apart > 0, apart.cast("int") - 1).otherwise(F.size(a))


def _extended(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (doc, word, stop, kept) whose ends, where they are windows, go as far as the texts agree."""
    spans = materialize(spans, "spans")
    # a window's text and its keeper's agree inside, so only what is before the first and after the last is compared
    sides = [
        spans.where("not head.line").select("doc", "span", F.lit("left").alias("side"), F.col("head.word").alias("word"), F.col("head.keeper").alias("other"), F.col("head.kept_word").alias("at")),
        spans.where("not tail.line").select("doc", "span", F.lit("right").alias("side"), F.col("tail.stop").alias("word"), F.col("tail.keeper").alias("other"), (F.col("tail.kept_word") + WORDS).alias("at")),
    ]
    pairs = sides[0].unionByName(sides[1])
    places = pairs.select("doc", "word").unionByName(pairs.select(F.col("other").alias("doc"), F.col("at").alias("word"))).distinct()
    wanted = places.groupBy("doc").agg(F.collect_set("word").alias("places"))  # at most a document's windows
    around = materialize(texts.join(wanted, "doc").select("doc", "text", "places").mapInArrow(_around, "doc long, word int, left array<long>, right array<long>").dropDuplicates(["doc", "word"]), "around")
    theirs = around.select(F.col("doc").alias("other"), F.col("word").alias("at"), F.col("left").alias("left_b"), F.col("right").alias("right_b"))
    grown = pairs.join(around, ["doc", "word"]).join(theirs, ["other", "at"]).select("doc", "span", F.when(F.col("side") == "left", _agree("left", "left_b")).alias("l"), F.when(F.col("side") == "right", _agree("right", "right_b")).alias("r"))
    more = grown.groupBy("doc", "span").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return spans.join(more, ["doc", "span"], "left").select(
        "doc", (F.col("head.word") - F.coalesce("l", F.lit(0))).alias("word"), (F.col("tail.stop") + F.coalesce("r", F.lit(0))).alias("stop"), "kept"
    )


def repeated_passages(docs: DataFrame, similarity: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage to remove: id, kept_<id> (the document that keeps it), first_word, n_words, cluster_id."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = own.where("doc is not null")
    banded = texts.mapInArrow(_banded(*tune_bands(similarity, recall)), "band long, para long, doc long, word int, n int, line boolean")
    # two narrow passes over all bands; everything after is about the few that are shared
    shared = banded.groupBy("band").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("band")
    members = materialize(banded.join(shared, "band"), "paragraphs")
    clusters = _line_clusters(members.where("line"), texts, similarity).withColumnRenamed("node", "para")
    lines = members.where("line").select("doc", "word", "n", "line", "para").distinct()
    found = lines.join(clusters, "para", "left").withColumn("cluster", F.coalesce("component", "para")).drop("component").unionByName(
        members.where("not line").select("doc", "word", "n", "line", "para", F.col("para").alias("cluster"))
    )
    found = materialize(found.select("doc", "word", (F.col("word") + F.col("n")).alias("stop"), "line", "cluster"), "occurrences")
    first = F.min(F.struct("doc", "word")).alias("k")
    keepers = found.groupBy("cluster", "line").agg(first, F.max("doc").alias("high")).where("k.doc < high").select("cluster", "line", F.col("k.doc").alias("keeper"), F.col("k.word").alias("kept_word"))
    extra = found.join(keepers, ["cluster", "line"]).where("doc <> keeper")
    # extended spans can meet
    order = Window.partitionBy("doc").orderBy("word", "stop", "kept")
    new = F.coalesce((F.col("word") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    merged = _extended(_spans(extra), texts).withColumn("new", new).withColumn("span", F.sum("new").over(order)).groupBy("doc", "span")
    out = merged.agg(F.min("word").alias("first_word"), F.max("stop").alias("stop"), F.min("kept").alias("kept"))
    return out.select(F.col("doc").alias(id_col), F.col("kept.keeper").alias(f"kept_{id_col}"), "first_word", (F.col("stop") - F.col("first_word")).alias("n_words"), F.col("kept.cluster").alias("cluster_id"))
