"""Bans: lists, statistics, escalation and comparison with what is configured or enforced.

A ban has ip, jail, banned_at and expires_at (NULL: permanent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.functions.rendering import format_banned_at, format_relative

#: Bans that one reconcile round asks for.
RECONCILE_LIMIT = 1000


def _active(now: Column | int) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def active_bans(bans: DataFrame, now: Column | int) -> DataFrame:
    return bans.where(_active(now))


def expired_bans(bans: DataFrame, now: Column | int) -> DataFrame:
    return bans.where(F.col("expires_at") <= now)


def list_bans(bans: DataFrame, now: int) -> DataFrame:
    """Bans by expiry, soonest first and permanent last, with the texts of the report."""
    shown = bans.select("jail", "ip", "banned_at", "expires_at", format_banned_at(F.col("banned_at")).alias("banned"), format_relative(F.col("expires_at") - now).alias("expires"))
    return shown.orderBy(F.asc_nulls_last("expires_at"), "jail", "ip")


def next_expiry(bans: DataFrame) -> DataFrame:
    return bans.agg(F.min("expires_at").alias("next_expiry"))


def latest_ban(bans: DataFrame) -> DataFrame:
    """The last ban of each (ip, jail); of several at one time the one that ends last, permanent before all."""
    order = F.struct("banned_at", F.col("expires_at").isNull(), "expires_at")
    last = F.max_by(F.struct("banned_at", "expires_at"), order).alias("b")
    return bans.groupBy("ip", "jail").agg(last).select("ip", "jail", "b.banned_at", "b.expires_at")


def ban_counts(bans: DataFrame) -> DataFrame:
    """Automatic bans of each address over all jails, and the last."""
    return bans.groupBy("ip").agg(F.count(F.lit(1)).cast("int").alias("count"), F.max("banned_at").alias("last_ban"))


def decayed_counts(counts: DataFrame, decay: int, now: int) -> DataFrame:
    """Counts that are forgotten: the last ban is more than ``decay`` seconds ago; 0 forgets none."""
    return counts.where(F.lit(decay > 0) & (F.col("last_ban") < now - decay))


def escalation_level(bans: DataFrame, decay: int) -> DataFrame:
    """Adds ``level``: the bans of the address since the last gap longer than ``decay``, this one not counted."""
    order = Window.partitionBy("ip").orderBy("banned_at", "jail")
    gap = F.col("banned_at") - F.lag("banned_at").over(order)
    broken = F.coalesce((gap > decay).cast("int"), F.lit(0)) if decay > 0 else F.lit(0)
    islands = bans.withColumn("_island", F.sum(broken).over(order))
    return islands.withColumn("level", F.row_number().over(Window.partitionBy("ip", "_island").orderBy("banned_at", "jail")) - 1).drop("_island")


def jail_stats(failures: DataFrame, actions: DataFrame, jails: DataFrame, now: int) -> DataFrame:
    """(jail, active_bans, total_bans, total_failures) of every configured jail; bans are actions of kind ``ban``.

    Failures count even where a ban covers them.
    """
    bans = actions.where("action = 'ban'")
    banned = bans.groupBy("jail").agg(F.count(F.lit(1)).alias("total_bans"), F.count_if(_active(now)).alias("active_bans"))
    failed = failures.groupBy("jail").agg(F.count(F.lit(1)).alias("total_failures"))
    joined = jails.select("jail").join(banned, "jail", "left").join(failed, "jail", "left").fillna(0)
    return joined.select("jail", "active_bans", "total_bans", "total_failures")


def global_stats(failures: DataFrame, actions: DataFrame, started_at: int, now: int) -> DataFrame:
    """One row: uptime, active and total bans, unbans and failures."""
    acted = actions.agg(
        F.count_if((F.col("action") == "ban") & _active(now)).alias("active_bans"), F.count_if(F.col("action") == "ban").alias("total_bans"), F.count_if(F.col("action") == "unban").alias("total_unbans")
    )
    failed = failures.agg(F.count(F.lit(1)).alias("total_failures"))
    return acted.join(failed).select(F.lit(max(now - started_at, 0)).cast("long").alias("uptime_secs"), "active_bans", "total_bans", "total_unbans", "total_failures")


def restorable_bans(bans: DataFrame, jails: DataFrame, now: int) -> DataFrame:
    """Active bans of configured jails that have not opted out of restoring."""
    return active_bans(bans, now).join(jails.where("enabled and reban_on_restart").select("jail"), "jail", "left_semi").select(bans.columns)


def reconcile(expected: DataFrame, observed: DataFrame, limit: int | None = RECONCILE_LIMIT, after: tuple[int, str, str] | None = None) -> DataFrame:
    """The bans that are not enforced, oldest first: ``limit`` of them, or all (None).

    ``after``, the (banned_at, ip, jail) of the last ban of a round, gives those of the next round.
    """
    missing = expected.join(observed.select("ip", "jail").distinct(), ["ip", "jail"], "left_anti").select(expected.columns)
    if after is not None:
        at, ip, jail = (F.lit(x) for x in after)
        same = F.col("banned_at") == at
        missing = missing.where((F.col("banned_at") > at) | (same & (F.col("ip") > ip)) | (same & (F.col("ip") == ip) & (F.col("jail") > jail)))
    return missing if limit is None else missing.orderBy("banned_at", "ip", "jail", "expires_at").limit(limit)


def diff_jails(old: DataFrame, new: DataFrame) -> DataFrame:
    """(jail, change) with change added, removed or kept; a jail whose backend differs is removed and added.

    Command backends differ if their texts do.
    """
    key = lambda df: df.where("enabled").select("jail", F.to_json("backend").alias("backend"))
    both = key(old).withColumnRenamed("backend", "_old").join(key(new).withColumnRenamed("backend", "_new"), "jail", "full_outer")
    changes = (
        F.when(F.col("_old").isNull(), F.array(F.lit("added")))
        .when(F.col("_new").isNull(), F.array(F.lit("removed")))
        .when(F.col("_old") == F.col("_new"), F.array(F.lit("kept")))
        .otherwise(F.array(F.lit("removed"), F.lit("added")))
    )
    return both.select("jail", F.explode(changes).alias("change"))


def restore_for_added(delta: DataFrame, bans: DataFrame) -> DataFrame:
    """The bans of jails that a new configuration adds."""
    return bans.join(delta.where("change = 'added'").select("jail"), "jail", "left_semi").select(bans.columns)


def seed_bans(store: DataFrame, restored: DataFrame) -> DataFrame:
    """The restored bans if the store has none, else the store."""
    return store if not store.isEmpty() else restored.select(store.columns)
