"""Exact deduplication by content sort, with DataFrame functions only.

Rows are range-partitioned on a key that follows the order of the normalised bytes: a bounded prefix, so that Spark
samples splitters without carrying whole texts to the driver, then a 64-bit hash of the text, so that texts which only
begin alike part. Inside a range Spark's external sort puts equal texts side by side, the identifier that stays first,
and each text is compared in full with its neighbour. A run of equal neighbours is a group, its first row stays, and
its rows are counted: nothing but the comparison decides.

A text that would fill more than a quarter of a task is hot. A first pass counts hashes and finds these (fewer than
four times the tasks, whatever the input is). They are sorted apart, with a salt from the identifier that deals
each over as many ranges as it needs, and their runs, a row per salt, meet again by their full texts.

Defined cases: null text is the empty text; texts are equal when identical after lower-casing A-Z; ties (rows that
repeat one identifier and text) leave one row; a null identifier loses against any other; an empty table gives an
empty result; texts of many megabytes are rows like others; other columns, whatever their names, are ignored by
``exact_groups`` and carried by ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.llm.shared import ascii_lower, materialize

PREFIX_CHARS = 48
#: Rows that a text has at least to be hot.
LEAST_HOT = 1000

_KEY = ("_prefix", "_hash", "_salt")


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(_id, _text, ..) with a sort key: the rows of texts that are not hot, and those of the hot ones, if any."""
    raw = F.coalesce(F.col("_text"), F.lit(""))
    # equal after lower-casing A-Z implies equal after full lower-casing, which costs less
    keyed = docs.withColumns({"_prefix": ascii_lower(F.substring(raw, 1, PREFIX_CHARS)), "_hash": F.xxhash64(F.lower(raw)), "_salt": F.lit(0)})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_HOT, docs.count() // (4 * parts))
    hot = materialize(keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_hash", F.ceil(F.col("n") / most).cast("int").alias("_salts")), "hot-texts")
    if hot.isEmpty():
        return keyed, None
    few = F.broadcast(hot)  # fewer than 4 x parts rows
    salted = keyed.join(few, "_hash").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")).drop("_salts")
    return keyed.join(few, "_hash", "left_anti"), salted


def _order(keep: str, col: str = "_id") -> Column:
    return F.asc_nulls_last(col) if keep == "min" else F.desc_nulls_last(col)


def _sorted(keyed: DataFrame, keep: str) -> DataFrame:
    """The rows in content order with _norm, _first (whether a row begins a run of equal texts) and _run, the run's number under its key."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *_KEY).withColumn("_norm", ascii_lower(F.coalesce(F.col("_text"), F.lit(""))))
    near = Window.partitionBy(*_KEY).orderBy("_norm", _order(keep))
    first = ranged.withColumn("_first", F.coalesce(F.col("_norm") != F.lag("_norm").over(near), F.lit(True)))
    return first.withColumn("_run", F.sum(F.col("_first").cast("int")).over(near))


def _best(keep: str, col: str) -> Column:
    return F.min(col) if keep == "min" else F.max(col)


def _grouped(keyed: DataFrame, keep: str, *extra: Column) -> DataFrame:
    """Every row with what its run says: the identifier that stays, the run's size and whether the row is its first."""
    runs = _sorted(keyed, keep).select("_id", *_KEY, "_run", "_first", F.sha2(F.encode("_norm", "utf-8"), 256).alias("_sha"), *extra)
    run = Window.partitionBy(*_KEY, "_run")
    return runs.withColumns({"_n": F.count(F.lit(1)).over(run), "_keep": _best(keep, "_id").over(run)})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep``: of equal texts the row with the smallest (``min``) or largest (``max``) identifier stays.
    """
    cold, hot = _keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    names = {"_keep": "keep_id", "_n": "group_size", "_first": "kept", "_sha": "text_sha256"}
    shown = lambda df: df.select(F.col("_id").alias(id_col), *[F.col(a).alias(b) for a, b in names.items()])
    out = shown(_grouped(cold, keep))
    if hot is None:
        return out
    rows = materialize(_grouped(hot, keep, F.when(F.col("_first"), F.col("_norm")).alias("_norm")), "hot-runs")
    # a row per run and salt: fewer than eight times the tasks
    whole = Window.partitionBy("_hash", "_norm")
    runs = rows.where("_first").select(
        *_KEY, "_run", F.sum("_n").over(whole).alias("_n"), _best(keep, "_keep").over(whole).alias("_keep"), (F.row_number().over(whole.orderBy(_order(keep, "_keep"), "_salt")) == 1).alias("_wins")
    )
    joined = rows.drop("_n", "_keep", "_norm").join(F.broadcast(runs), [*_KEY, "_run"]).withColumn("_first", F.col("_first") & F.col("_wins"))
    return out.unionByName(shown(joined))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    cold, hot = _keyed(packed)
    out = _sorted(cold, keep).where("_first").select("_row.*")
    if hot is None:
        return out
    runs = _sorted(hot, keep).where("_first").select("_id", "_hash", "_salt", "_norm", "_row")
    place = F.row_number().over(Window.partitionBy("_hash", "_norm").orderBy(_order(keep), "_salt"))
    return out.unionByName(runs.withColumn("_place", place).where("_place = 1").select("_row.*"))
