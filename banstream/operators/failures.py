"""Failures: counting them, and finding who reaches a threshold.

A failure has jail, ip, ts (epoch seconds) and seq, the place of its line in its source. Thresholds look at
failures in arrival order (seq), not in order of their dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.functions.rendering import verdict
from banstream.jails import Jail


#: The end of a ban that has none.
FOREVER = (1 << 63) - 1


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("jail", "ip").agg(F.count(F.lit(1)).alias("failures"))


def _limits(jails: Sequence[Jail]) -> tuple[list[int], Column]:
    """The distinct max_retry, and each jail's find_time as a column."""
    times = F.create_map(*[F.lit(x) for j in jails for x in (j.jail, j.find_time)])
    return sorted({j.max_retry for j in jails}), F.element_at(times, F.col("jail")).cast("long")


def threshold_hits(failures: DataFrame, jails: Sequence[Jail], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Adds ``hit``: whether the last max_retry failures of (jail, ip) up to this one span at most find_time.

    One expression for each distinct max_retry; failures of jails not given are dropped. Spark sorts (jail, ip)
    once for all of them.
    """
    sizes, find_time = _limits(jails)
    retry = F.element_at(F.create_map(*[F.lit(x) for j in jails for x in (j.jail, j.max_retry)]), F.col("jail"))
    over = Window.partitionBy("jail", "ip").orderBy(*order)
    known = failures.where(F.col("jail").isin([j.jail for j in jails]))
    oldest = F.coalesce(*[F.when(retry == n, F.lag("ts", n - 1).over(over) if n > 1 else F.col("ts")) for n in sizes])
    return known.withColumn("hit", F.coalesce(F.col("ts") - oldest <= find_time, F.lit(False)))


def would_ban(failures: DataFrame, jails: Sequence[Jail], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(jail, ip, failures, would_ban, first_hit_ts) for every address that failed."""
    hits = threshold_hits(failures, jails, order)
    return hits.groupBy("jail", "ip").agg(
        F.count(F.lit(1)).alias("failures"), F.max("hit").alias("would_ban"), F.min(F.when(F.col("hit"), F.col("ts"))).alias("first_hit_ts")
    )


def rolling_failures(failures: DataFrame, find_time: int) -> DataFrame:
    """Adds ``recent``: failures of (jail, ip) in the trailing find_time seconds, this one included."""
    over = Window.partitionBy("jail", "ip").orderBy("ts").rangeBetween(-find_time, 0)
    return failures.withColumn("recent", F.count(F.lit(1)).over(over))


def dry_run_summary(failures: DataFrame, jails: Sequence[Jail], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """What each enabled jail would have done, jails without a failure too."""
    spark = failures.sparkSession
    jails = [j for j in jails if j.enabled]
    found = would_ban(failures, jails, order).groupBy("jail").agg(
        F.sum("failures").alias("matches"), F.count(F.lit(1)).alias("unique_ips"), F.count_if("would_ban").alias("would_ban")
    )
    rows = [(j.jail, len(j.filter), j.max_retry, j.find_time, j.ban_time) for j in jails]
    table = spark.createDataFrame(rows, "jail string, patterns int, max_retry int, find_time long, ban_time long")
    return table.join(found, "jail", "left").fillna(0, ["matches", "unique_ips", "would_ban"])


def top_offenders(failures: DataFrame, jails: Sequence[Jail], n: int | None = None, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Addresses by failures, most first, each with the verdict on it; ``n`` of them, or all."""
    _, find_time = _limits(jails)
    retry = F.element_at(F.create_map(*[F.lit(x) for j in jails for x in (j.jail, j.max_retry)]), F.col("jail"))
    judged = would_ban(failures, jails, order).select("jail", "ip", "failures", verdict(F.col("failures"), retry, F.col("would_ban"), find_time).alias("verdict"))
    ordered = judged.orderBy(F.desc("failures"), "jail", "ip")
    return ordered if n is None else ordered.limit(n)


def dry_run(failures: DataFrame, jails: Sequence[Jail], order: Sequence[str] = ("ts", "seq")) -> tuple[DataFrame, DataFrame]:
    """Summary and offenders of a log; see ``plans.dry_run`` for the way from lines to here."""
    return dry_run_summary(failures, jails, order), top_offenders(failures, jails, None, order)


def suppress_banned(failures: DataFrame, bans: DataFrame, label: bool = False) -> DataFrame:
    """Failures that no ban of their jail and address covers; with ``label`` all of them, and ``banned`` says which are covered.

    Bans and failures of a jail and address are sorted together once: a failure is covered if the latest end of the
    bans that began by then is still to come. A row without address, jail or date is covered by nothing.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in failures.columns])
    fails = failures.select(F.col("ip").alias("_ip"), F.col("jail").alias("_jail"), F.col("ts").cast("long").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_until"), row.alias("_row"))
    none = F.lit(None).cast(fails.schema["_row"].dataType)
    until = F.coalesce(F.col("expires_at").cast("long"), F.lit(FOREVER))
    began = bans.where("ip is not null and jail is not null and banned_at is not null").select(
        F.col("ip").alias("_ip"), F.col("jail").alias("_jail"), F.col("banned_at").cast("long").alias("_at"), F.lit(0).alias("_turn"), until.alias("_until"), none.alias("_row")
    )
    so_far = Window.partitionBy("_ip", "_jail").orderBy(F.col("_at").asc_nulls_first(), "_turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = fails.unionByName(began).withColumn("_end", F.max("_until").over(so_far)).where("_turn = 1")
    covered = F.coalesce(F.col("_end") > F.col("_at"), F.lit(False))
    return swept.select("_row.*", covered.alias("banned")) if label else swept.where(~covered).select("_row.*")


def with_params(failures: DataFrame, jails: DataFrame) -> DataFrame:
    """Failures with their jail's limits; NULL for a jail that is not configured, which is counted and then ignored."""
    return failures.join(jails.select("jail", "max_retry", "find_time", "ban_time"), "jail", "left")


def prune_stale_failures(failures: DataFrame, jails: DataFrame, now: Column | int) -> DataFrame:
    """(jail, ip, newest) of configured jails whose newest failure is no older than find_time."""
    newest = failures.groupBy("jail", "ip").agg(F.max("ts").alias("newest"))
    return newest.join(jails.select("jail", "find_time"), "jail").where(F.col("newest") >= F.lit(now) - F.col("find_time")).select("jail", "ip", "newest")


def failure_rates(failures: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Failures of each jail in tumbling windows; works on streams, with ``late`` as the watermark."""
    timed = failures.withColumn("event_ts", F.timestamp_seconds("ts"))
    timed = timed.withWatermark("event_ts", late) if late else timed
    counted = timed.groupBy("jail", F.window("event_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return counted.select("jail", F.unix_timestamp("w.start").alias("window_start"), "failures")
