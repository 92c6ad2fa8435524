"""Live queries over a tracker: its bans, rings and totals, read from the checkpoint while it runs or after.

Spark's state data source reads the addresses' state as of one committed batch. Nothing here touches the running
query: a reader sees the newest batch that is committed, or the one it names while the store still keeps it.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from banstream.jails import Jail
from banstream.streaming.tracker import ADDRESS


def read_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The tracker's state: what is stored of each address (``tracker.ADDRESS``)."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "address")
    values = (reader if batch is None else reader.option("batchId", batch)).load()
    return values.select(F.inline(F.from_json("value.addresses", f"array<struct<{ADDRESS}>>", {"mode": "FAILFAST"})))


def _by_jail(spark: SparkSession, checkpoint: str, name: str, batch: int | None) -> DataFrame:
    return read_state(spark, checkpoint, batch).select("ip", F.inline(name))


def live_bans(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(ip, jail, banned_at, expires_at) of the bans in force."""
    return _by_jail(spark, checkpoint, "bans", batch)


def live_rings(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(ip, jail, failures, newest) of the failures that still count toward a ban."""
    rings = _by_jail(spark, checkpoint, "rings", batch)
    return rings.select("ip", "jail", F.size("ts").alias("failures"), F.array_max("ts").alias("newest"))


def live_counts(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(ip, count, last_ban): the bans that lengthen an address's next one."""
    return read_state(spark, checkpoint, batch).select("ip", "count", "last_ban")


def live_stats(spark: SparkSession, checkpoint: str, jails: Sequence[Jail], batch: int | None = None) -> DataFrame:
    """(jail, active_bans, total_bans, total_unbans, total_failures) of every jail; failures count under a ban too."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def part(jail: Column, active: Column, bans: Column, unbans: Column, failures: Column) -> Column:
        return F.struct(jail.alias("jail"), active.alias("active"), bans.alias("bans"), unbans.alias("unbans"), failures.alias("failures"))

    # an address's totals and bans in one pass: a read of the state opens the store of every partition
    counted = F.transform("totals", lambda t: part(t["jail"], none, t["bans"], t["unbans"], t["failures"]))
    banned = F.transform("bans", lambda b: part(b["jail"], one, none, none, none))
    own = read_state(spark, checkpoint, batch).select(F.inline(F.concat(counted, banned)))
    names = {"active": "active_bans", "bans": "total_bans", "unbans": "total_unbans", "failures": "total_failures"}
    done = own.groupBy("jail").agg(*[F.sum(c).alias(name) for c, name in names.items()])
    every = spark.createDataFrame([(j.jail,) for j in jails], "jail string")
    return every.join(done, "jail", "left").fillna(0).select("jail", *names.values())


#: Name of the metrics that ``observed`` adds to a stream.
METRICS = "tracker"


def observed(actions: DataFrame) -> DataFrame:
    """The actions of a tracker, with bans, unbans and late failures of each micro-batch as metrics of the query."""
    counts = {"bans": "ban", "unbans": "unban", "late": "late"}
    return actions.observe(METRICS, *[F.count_if(F.col("action") == a).alias(n) for n, a in counts.items()])


class StatsListener(StreamingQueryListener):
    """Adds up the metrics of one query's micro-batches; a batch that is run again after a failure counts once.

    ``rows`` is what the query read, failures and commands. Register with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], Counter] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        own = Counter(rows=progress.numInputRows)
        if METRICS in progress.observedMetrics:
            own.update(progress.observedMetrics[METRICS].asDict())
        with self.changed:
            self.batches[str(progress.id), progress.batchId] = own

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until all metrics of a run that has ended are in."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(run_id) in self.ended, seconds):
                raise TimeoutError(f"no end of run {run_id} after {seconds} s")

    def totals(self, query_id: str) -> Counter:
        with self.changed:
            return sum((own for (query, _), own in self.batches.items() if query == str(query_id)), Counter())
