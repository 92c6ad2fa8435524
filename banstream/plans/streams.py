"""Registered queries of the live tracker: it reads the log's failures as files, part by part, until it has seen all."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.plans.lines import CUTS, JAILS, QUIET, failures_of, log_lines
from banstream.operators.timeline import ban_rows
from banstream.sources.state import work_folder
from banstream.streaming import live, sink
from banstream.streaming.tracker import late_rows, track_bans

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
FAILURES = "jail string, ip string, ts long, seq long"
#: Files of a micro-batch; a part has no more, for in a second micro-batch it would be behind its own first one.
FILES = 64
#: Failures of a log for each partition of a tracker's state, and groups of addresses in it. A group's turn has a
#: fixed cost in a micro-batch whatever it holds; too few groups would be dealt unevenly to the partitions.
ROWS, GROUPS = 250_000, 32


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """The state store that trackers need, for queries that start meanwhile; ``partitions`` is for their state.

    A micro-batch commits each partition, by what has changed in it; whole copies are made in the background.
    """
    wanted = {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", CHANGES: "true"}
    wanted |= {PARTITIONS: str(partitions)} if partitions else {}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def state_partitions(rows: int, cores: int) -> int:
    """Partitions of a tracker's state for a log of so many failures: one each core, more where these would hold too much.

    Each costs a Python worker and a commit in every micro-batch, and a store to open for every reader, so their number
    follows the rows and not what other shuffles of the session need.
    """
    return max(cores, ceil(rows / ROWS), 1)


@dataclass
class Tracked:
    """A tracker that has seen all its parts, and the number of the last micro-batch after each."""

    actions: DataFrame
    checkpoint: str
    batches: list[int]
    totals: dict[str, int]


def track(spark: SparkSession, sf_dir: str, part: Column, parts: int, **options) -> Tracked:
    """Track the log's failures, in parts by a number from 0 on; every part is a run that goes on from the one before.

    Actions are published by the sink of ``streaming.sink``.
    """
    folder = work_folder(spark, "tracker")
    failures_of(log_lines(spark, sf_dir), JAILS).withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    found = spark.read.schema(f"{FAILURES}, part int").parquet(f"{folder}/parts")
    partitions = state_partitions(found.count(), spark.sparkContext.defaultParallelism)
    listener, batches = live.StatsListener(), []
    spark.streams.addListener(listener)
    try:
        with rocksdb(spark, partitions):
            for k in range(parts):
                found.where(F.col("part") == k).drop("part").coalesce(FILES).write.mode("append").parquet(f"{folder}/failures")
                source = spark.readStream.schema(FAILURES).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/failures")
                actions = live.observed(track_bans(source, JAILS, groups=GROUPS * partitions, **options))
                run = sink.save_actions(actions, f"{folder}/actions", f"{folder}/checkpoint", available_now=True)
                run.awaitTermination()
                batches.append(run.lastProgress["batchId"])
                listener.wait(run.runId)
                totals = listener.totals(run.id)
    finally:
        spark.streams.removeListener(listener)
    return Tracked(sink.read_actions(spark, f"{folder}/actions"), f"{folder}/checkpoint", batches, dict(totals))


def _by_date() -> Column:
    return F.when(F.col("ts") < CUTS[0], 0).when(F.col("ts") < CUTS[1], 1).otherwise(2)


def _after_each(done: Tracked, read) -> DataFrame:
    """What ``read`` gives for the last batch of each part, with the part's number."""
    return reduce(DataFrame.unionByName, [read(b).withColumn("batch", F.lit(k)) for k, b in enumerate(done.batches)])


def track_bans_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bans of the batch timeline."""
    return ban_rows(track(spark, sf_dir, F.lit(0), 1).actions)


def track_actions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans and unbans over three runs, with counts that are forgotten after six quiet hours."""
    done = track(spark, sf_dir, _by_date(), 3, decay=QUIET).actions
    return done.select("ip", "jail", "action", "at", "expires_at", "ban_time", "reason", "level", F.when(F.col("action") == "ban", F.col("event_seq")).alias("seq"))


def live_bans_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans in force after each part."""
    done = track(spark, sf_dir, _by_date(), 3)
    return _after_each(done, lambda b: live.live_bans(spark, done.checkpoint, b))


def live_rings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has failures that still count after each part, and the newest."""
    done = track(spark, sf_dir, _by_date(), 3)
    return _after_each(done, lambda b: live.live_rings(spark, done.checkpoint, b)).select("batch", "ip", "jail", "newest")


def live_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each jail after each part."""
    done = track(spark, sf_dir, _by_date(), 3)
    return _after_each(done, lambda b: live.live_stats(spark, done.checkpoint, JAILS, b))


def late_rows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side output, where every part goes over all dates again and failures may be ten days behind."""
    return late_rows(track(spark, sf_dir, (F.col("seq") % 3).cast("int"), 3, late="10 days").actions)[1]


def late_totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each jail that the tracker has taken, by its state, and that came late, by the side output."""
    done = track(spark, sf_dir, (F.col("seq") % 3).cast("int"), 3, late="10 days")
    late = late_rows(done.actions)[1].groupBy("jail").agg(F.count(F.lit(1)).alias("late"))
    taken = live.live_stats(spark, done.checkpoint, JAILS).select("jail", F.col("total_failures").alias("in_time"))
    return taken.join(late, "jail", "left").fillna(0).where("in_time + late > 0")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the query's metrics add up to over the micro-batches of three runs."""
    done = track(spark, sf_dir, _by_date(), 3)
    own = {"read": "rows", "bans": "bans", "unbans": "unbans", "late": "late"}
    # the row belongs to the run: it is there only if the actions are
    return done.actions.agg(F.count(F.lit(1))).select(*[F.lit(done.totals.get(n, 0)).cast("long").alias(c) for c, n in own.items()])


QUERIES = {
    f.__name__: f
    for f in (track_bans_stream, track_actions_stream, live_bans_stream, live_rings_stream, live_stats_stream, late_rows_stream, late_totals_stream, stream_totals)
}
