"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is a share of the whole by weight, never over ``max_copies`` times its size. Within a source
longer documents are worth more: a document is owed level * size ** ``size_power`` copies, at most ``max_copies``, with
the level at which the owed words add up to the target. The whole part is certain and is taken off first; the fraction
p is an inclusion probability, another for every size. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), with u drawn from a hash of the identifier, and taken in rank order up to what is left
of the target. Where the next document is larger than what is missing, smaller ones among the ``FILL_ROWS`` that follow
in rank fill the gap, in a few passes; what then is left, as where one document is much of a source, goes to further
copies of those around that have fewer than ``max_copies``.

No source is ever one task: ranked rows are dealt over ranges of (source, rank), each range's words are summed up, and
only rows of one range are sorted together; where the ranges part changes nothing in the result. Tables with a row per
source, per source and range, or per source and size are ordered as a whole.

Defined cases: null or empty text has size 0 and nothing is taken of it; null sources are one source, ordered
last; a source without words has target 0; repeated rows count each; equal ranks go by identifier, then size; texts of
many megabytes are counted like others; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.llm.shared import WORD, materialize

#: Rows on either side of where the target is reached that may fill what is left, passes over those not taken, and over all.
FILL_ROWS, FILL_PASSES, AGAIN_PASSES = 1000, 4, 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """A row per source: _source, source_size, n_rows, target.

    The weights are dealt out in source order. Sources are filled like vessels: with the level l at which the
    targets min(cap, l * weight) add up to the total, no excess is left to share again.
    """
    sizes = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    at = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    every = Window.partitionBy()
    dealt = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))).withColumns(
        {"_cap": (F.col("source_size") * max_copies).cast("double"), "_total": F.sum("source_size").over(every) * F.lit(float(share))}
    )
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    return dealt.withColumn("_level", level).select(
        "_source", "source_size", "n_rows", F.least(F.col("_cap"), F.max("_level").over(every) * F.col("_w")).alias("target")
    )


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) from the identifier: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def levels(sized: DataFrame, targets: DataFrame, size_power: float, max_copies: int) -> DataFrame:
    """A row per source: _source, level, certain (words of the whole copies).

    Sizes are filled like vessels: the largest are full first. With the level at which min(max_copies, level * worth)
    copies of all add up to the target, every other choice of those that are full gives a lower one.
    """
    worth = F.pow("size", F.lit(float(size_power))) if size_power != 0.5 else F.sqrt("size")
    sizes = sized.where("size > 0").groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_n")).withColumn("_words", F.col("size") * F.col("_n")).withColumn("_worth", F.col("_words") * worth)
    by_fill = Window.partitionBy("_source").orderBy(F.desc("size"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = sizes.withColumns({"_full": F.coalesce(F.sum("_words").over(before), F.lit(0)) * max_copies, "_rest": F.sum("_worth").over(onward)})
    aimed = targets.select(F.col("_source").alias("_s"), "target")
    tried = summed.join(aimed, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_level", (F.col("target") - F.col("_full")) / F.col("_rest"))
    level = tried.groupBy("_source").agg(F.max("_level").alias("level"))
    owed = sizes.join(level.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_owed", F.least(F.lit(float(max_copies)), F.col("level") * worth))
    return owed.groupBy("_source").agg(F.max("level").alias("level"), F.sum(F.floor("_owed") * F.col("_words")).alias("certain"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    size_power: float = 0.5,
    seed: int = 0,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), copies."""
    sized = materialize(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), word_count(F.col(f"`{text_col}`")).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, share, max_copies)
    level = levels(sized, targets, size_power, max_copies).withColumnRenamed("_source", "_s")
    known = materialize(targets.join(level, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0, ["level", "certain"]), "mix-sources")
    worth = F.pow("size", F.lit(float(size_power))) if size_power != 0.5 else F.sqrt("size")
    owed = F.when(F.col("size") > 0, F.least(F.lit(float(max_copies)), F.col("level") * worth)).otherwise(0.0)
    aimed = (
        sized.join(known.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_owed", owed)
        .withColumn("_certain", F.floor("_owed"))
        .withColumn("_p", F.col("_owed") - F.col("_certain"))
    )
    odds = lambda x: x / (1 - x)
    ranked = aimed.where("_p > 0").withColumn("_u", uniform("_id", seed)).withColumn("_rank", odds(F.col("_u")) / odds(F.col("_p")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(ranked.drop("_u", "_p", "_owed").repartitionByRange(parts, "_source", "_rank", "_id").withColumn("_range", F.spark_partition_id()), "mix-ranks")
    totals = dealt.groupBy("_source", "_range").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_words", "_rows")])
    upto = Window.partitionBy("_source", "_range").orderBy("_rank", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_words", F.col("_words_before") + F.sum("size").over(upto))
        .withColumn("_place", F.col("_rows_before") + F.row_number().over(upto))
        .withColumn("_gap", F.col("target") - F.col("certain"))
    )
    placed = materialize(placed.select("_id", "_source", "size", "source_size", "target", "_certain", "_rank", "_words", "_place", "_gap"), "mix-places")
    cut = placed.where("_words <= _gap").groupBy(F.col("_source").alias("_s")).agg(F.max("_place").alias("_cut"), F.max("_words").alias("_got"))
    known = placed.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumns({"_cut": F.coalesce("_cut", F.lit(0)), "_gap": F.col("_gap") - F.coalesce("_got", F.lit(0))})
    known = known.withColumn("_extra", (F.col("_place") <= F.col("_cut")).cast("int"))
    near = (F.col("_place") > F.col("_cut") - FILL_ROWS) & (F.col("_place") <= F.col("_cut") + FILL_ROWS)
    own = Window.partitionBy("_source")  # 2 x FILL_ROWS rows at most
    upto = own.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = known.where(near)
    for i in range(FILL_PASSES + AGAIN_PASSES):
        free = F.col("_extra") == 0 if i < FILL_PASSES else F.col("_certain") + F.col("_extra") < max_copies
        filled = (
            filled.withColumn("_fits", F.when(free & (F.col("size") <= F.col("_gap")), F.col("size")).otherwise(0))
            .withColumn("_sum", F.sum("_fits").over(upto))
            .withColumn("_now", (F.col("_fits") > 0) & (F.col("_sum") <= F.col("_gap")))
            .withColumn("_gap", F.col("_gap") - F.coalesce(F.max(F.when(F.col("_now"), F.col("_sum"))).over(own), F.lit(0)))
            .withColumn("_extra", F.col("_extra") + F.col("_now").cast("int"))
        )
    names = ["_id", "size", "source_size", "target", "_certain", "_extra"]
    out = aimed.where("_p = 0").withColumn("_extra", F.lit(0)).select(names).unionByName(known.where(~near).select(names)).unionByName(filled.select(names))
    copies = F.col("_certain") + F.col("_extra")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"))
