"""The tracker as a stream: live queries, late failures, pruning, restored bans and metrics."""

import json

import pytest

from banstream.jails import Jail
from banstream.operators.failures import failure_rates
from banstream.operators.timeline import ban_rows, ban_timeline
from banstream.plans.streams import rocksdb
from banstream.streaming import live, sink
from banstream.streaming.tracker import late_rows, track_bans

A = Jail("a", ("x <HOST>",), max_retry=3, find_time=60, ban_time=100, bantime_increment=True, bantime_maxtime=300)
B = Jail("b", ("x <HOST>",), max_retry=2, find_time=60, ban_time=-1)
ROW = "jail string, ip string, ts long, seq long"


class Feed:
    """A folder of failures, and the tracker that reads it."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0

    def add(self, *rows):
        data = [(jail, ip, ts, self.n + i) for i, (jail, ip, ts) in enumerate(rows)]
        self.n += len(data)
        self.spark.createDataFrame(data, ROW).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def start(self, available_now=True, **options):
        source = self.spark.readStream.schema(ROW).parquet(f"{self.path}/in")
        actions = live.observed(track_bans(source, [A, B], **options))
        writer = actions.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")).start()

    def run(self, **options):
        query = self.start(**options)
        query.awaitTermination()
        return query

    @property
    def checkpoint(self):
        return f"{self.path}/check"

    def actions(self):
        return self.spark.read.parquet(f"{self.path}/out")

    def state(self, read, *args):
        return sorted(tuple(r) for r in read(self.spark, self.checkpoint, *args).collect())


@pytest.fixture
def feed(spark, tmp_path):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    with rocksdb(spark):
        yield Feed(spark, str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_state_of_a_running_tracker(feed):
    feed.add(("a", "1", 1000), ("a", "1", 1001))
    query = feed.start(available_now=False)
    try:
        query.processAllAvailable()
        assert feed.state(live.live_bans) == [] and feed.state(live.live_rings) == [("1", "a", 2, 1001)]
        feed.add(("a", "1", 1002), ("b", "2", 1002), ("b", "2", 1003))
        query.processAllAvailable()
        assert query.isActive
        assert feed.state(live.live_bans) == [("1", "a", 1002, 1102), ("2", "b", 1003, None)]
        assert feed.state(live.live_counts) == [("1", 1, 1002), ("2", 1, 1003)] and feed.state(live.live_rings) == []
        stats = feed.state(live.live_stats, [A, B, Jail("c", ("x <HOST>",))])
        assert stats == [("a", 1, 1, 0, 3), ("b", 1, 1, 0, 2), ("c", 0, 0, 0, 0)]
    finally:
        query.stop()


def test_rings_go_from_the_store_when_they_are_out_of_reach(feed):
    feed.add(("a", "1", 1000), ("a", "2", 1050))
    feed.run()
    assert feed.state(live.live_rings) == [("1", "a", 1, 1000), ("2", "a", 1, 1050)]
    feed.add(("b", "3", 1060))  # find_time is inclusive
    feed.run()
    assert ("1", "a", 1, 1000) in feed.state(live.live_rings)
    feed.add(("b", "3", 1062))
    feed.run()
    assert {r[0] for r in feed.state(live.live_rings)} == {"2"}  # the other's second failure was a ban


def test_late_failures_are_put_out_or_taken(feed, spark, tmp_path):
    parts = [[("a", "1", 1000), ("a", "1", 2000)], [("a", "1", 1500), ("a", "1", 1990), ("b", "9", 0)], [("a", "1", 1995), ("a", "1", 2500), ("b", "9", 2400), ("b", "9", 2399)]]
    for part in parts:
        feed.add(*part)
        feed.run(late="20 seconds")
    acted, late = late_rows(feed.actions())
    assert sorted((r["jail"], r["ip"], r["ts"]) for r in late.collect()) == [("a", "1", 1500), ("b", "9", 0)]
    assert sorted((r["jail"], r["action"], r["at"]) for r in acted.collect()) == [("a", "ban", 1995), ("a", "unban", 2095), ("b", "ban", 2400)]
    total = sum(r[4] for r in feed.state(live.live_stats, [A, B]))
    assert total + late.count() == sum(map(len, parts))
    other = Feed(spark, str(tmp_path / "take"))
    for part in parts:
        other.add(*part)
        other.run(late="20 seconds", behind="take")
    assert late_rows(other.actions())[1].count() == 0
    assert sum(r[4] for r in other.state(live.live_stats, [A, B])) == sum(map(len, parts))
    with pytest.raises(ValueError):
        track_bans(spark.createDataFrame([], ROW), [A], behind="lose")


def test_restored_bans_run_on_and_expire(feed, spark):
    first = spark.createDataFrame([("1", "a", 900, 1050), ("2", "b", 900, None), ("3", "a", 900, 5000), ("4", "x", 900, 5000)], "ip string, jail string, banned_at long, expires_at long")
    feed.add(("a", "1", 1000), ("a", "1", 1001), ("a", "1", 1002), ("a", "9", 1100))
    feed.run(initial=first)
    assert [(r["ip"], r["jail"], r["action"], r["at"]) for r in feed.actions().collect()] == [("1", "a", "unban", 1050)]  # covered until then
    assert feed.state(live.live_bans) == [("2", "b", 900, None), ("3", "a", 900, 5000)]


def test_metrics_of_all_batches_and_of_several_runs(feed, spark):
    listener = live.StatsListener()
    spark.streams.addListener(listener)
    try:
        at = 1000
        for _ in range(3):
            feed.add(*[("a", str(i % 4), at + i) for i in range(40)])
            at += 500
            query = feed.run()
            listener.wait(query.runId)
        totals = listener.totals(query.id)
    finally:
        spark.streams.removeListener(listener)
    done = {r["action"]: r["count"] for r in feed.actions().groupBy("action").count().collect()}
    assert totals["rows"] == 120 and (totals["bans"], totals["unbans"]) == (done["ban"], done["unban"]) and totals["late"] == 0
    failures = spark.read.parquet(f"{feed.path}/in")
    assert ban_rows(ban_timeline(failures, [A, B])).count() == totals["bans"]
    with pytest.raises(TimeoutError):
        listener.wait("none", 0.01)


def broken(marker):
    """The sink with a task that dies half-way through its rows as long as there is no marker file."""

    class Writer(sink.ActionWriter):
        def line(self, row):
            import os

            self.n = getattr(self, "n", 0) + 1
            if self.n > 3 and not os.path.exists(marker):
                raise OSError("the disk is gone")
            return super().line(row)

    class Source(sink.ActionSource):
        def streamWriter(self, schema, overwrite):
            return Writer(self.options["path"], schema)

    return Source


def test_a_batch_is_published_once_or_not_at_all(feed, spark, tmp_path):
    feed.add(*[("a", str(i % 5), 1000 + i) for i in range(60)])

    def start(source):
        stream = track_bans(spark.readStream.schema(ROW).parquet(f"{feed.path}/in"), [A, B])
        return sink.save_actions(stream, f"file://{feed.path}/saved", feed.checkpoint, available_now=True, source=source)

    source = broken(str(tmp_path / "mended"))
    with pytest.raises(Exception, match="disk is gone"):
        start(source).awaitTermination()
    (tmp_path / "saved" / "commits").mkdir(exist_ok=True)
    assert sink.read_actions(spark, f"{feed.path}/saved").count() == 0
    (tmp_path / "mended").touch()
    start(source).awaitTermination()
    feed.add(*[("a", str(i % 5), 2000 + i) for i in range(60)])
    start(source).awaitTermination()
    got = sink.read_actions(spark, f"{feed.path}/saved")
    want = ban_timeline(spark.read.parquet(f"{feed.path}/in"), [A, B])
    columns = ["ip", "jail", "action", "at", "expires_at", "ban_time", "level"]
    key = lambda df: sorted(map(str, df.select(columns).where("action = 'ban'").collect()))
    assert key(got) == key(want) and got.where("action = 'unban'").count() == got.where("action = 'unban'").distinct().count()
    for path in (tmp_path / "saved" / "data").glob("*.json"):
        at = [json.loads(x)["at"] for x in path.read_text().splitlines()]
        assert at == sorted(at)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    from pyspark.sql.types import StructType

    writer = sink.ActionWriter(f"file://{tmp_path}", StructType.fromDDL(sink.ACTIONS))
    row = ("1", "a", "ban", 5, None, -1, "threshold", 0, 3)
    writer.commit([writer.write(iter([row, ("2", "a", "unban", 4, None, None, "expired", None, None)])), writer.write(iter([])), None], 0)
    writer.commit([writer.write(iter([row]))], 0)
    lost = writer.write(iter([row]))
    writer.abort([lost, None], 1)
    writer.write(iter([row]))  # of a task that was lost before it could report
    assert [(r["batch"], r["at"], r["ip"]) for r in sink.read_actions(spark, str(tmp_path)).orderBy("at").collect()] == [(0, 4, "2"), (0, 5, "1")]
    assert len(list((tmp_path / "data").glob("*.json"))) == 2


def test_failure_rates_of_a_stream(feed, spark):
    """Windows come out once the watermark has passed their end, late rows no longer change them."""
    feed.add(*[("a", "1", 1000 + 10 * i) for i in range(30)], ("b", "2", 1100))

    def run():
        source = spark.readStream.schema(ROW).parquet(f"{feed.path}/in")
        query = failure_rates(source, "100 seconds", late="50 seconds").writeStream.format("parquet").option("path", f"{feed.path}/rates").option("checkpointLocation", feed.checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["jail"], r["window_start"], r["failures"]) for r in spark.read.parquet(f"{feed.path}/rates").collect())

    assert run() == [("a", 1000, 10), ("a", 1100, 10), ("b", 1100, 1)]
    feed.add(("a", "1", 1055), ("a", "3", 1260), ("a", "1", 1500))
    want = [("a", 1000, 10), ("a", 1100, 10), ("a", 1200, 11), ("b", 1100, 1)]
    assert run() == want
    whole = failure_rates(spark.read.parquet(f"{feed.path}/in").where("ts <> 1055"), "100 seconds").where("window_start < 1300")
    assert sorted((r["jail"], r["window_start"], r["failures"]) for r in whole.collect()) == want


def test_an_address_takes_few_messages_to_its_state():
    """A turn of an address reads its state once and writes it once, however many jails and failures there are."""
    from pyspark.sql import Row

    from banstream.streaming.tracker import BanTracker

    said = []

    class Handle:
        value = None

        def __getattr__(self, name):
            return lambda *a: said.append(name) or (self if name.startswith("get") and name != "get" else None)

        def get(self):
            said.append("get")
            return self.value

        def update(self, value):
            said.append("update")
            self.value = value

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    tracker, handle = BanTracker({"a": A, "b": B}, 0, "event"), Handle()
    tracker.init(handle)
    rows = [Row(kind="failure", ip="1", jail=j, ban_time=None, ts=1000 + i, seq=i) for i, j in enumerate("abababab")]
    for part in (rows[:3], rows[3:]):
        said.clear()
        out = list(tracker.handleInputRows(("1",), iter(part), Times()))
        assert (said.count("get"), said.count("update")) == (1, 1) and len(said) <= 6
    assert handle.value is not None and [r.action for r in out] == ["ban", "ban"]


def test_a_group_takes_as_few_messages_as_an_address(feed, spark):
    """A turn of a group reads and writes its state once and has one timer, and groups change no action and no state."""
    from pyspark.sql import Row

    from banstream.streaming.tracker import BanTracker

    said = []

    class Handle:
        value = None

        def getValueState(self, *a):
            return self

        def get(self):
            said.append("get")
            return self.value

        def update(self, value):
            said.append("update")
            self.value = value

        def registerTimer(self, ms):
            said.append(ms)

        def deleteTimer(self, ms):
            said.append(-ms)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        def getExpiryTimeInMs(self):
            return 1077_000

    tracker, handle = BanTracker({"a": A, "b": B}, 0, "event"), Handle()
    tracker.init(handle)
    rows = [Row(kind="failure", ip=str(i % 50), jail="a", ban_time=None, ts=1000 + i // 5, seq=i) for i in range(130)]
    out = list(tracker.handleInputRows((7,), iter(rows), Times(0)))
    assert said == ["get", "update", 1077_000] and len(out) == 30  # then a ring of two failures is out of reach
    said.clear()
    out = list(tracker.handleExpiredTimer((7,), Times(1122_000), Times(0)))
    assert sorted(r.at for r in out) == [1120] * 5 + [1121] * 5 + [1122] * 5 and said == ["get", "update", 1123_000]

    data = [[("a", str(i % 3), 1000 + 9 * i) for i in range(40)], [("b", str(i % 9), 1500 + i) for i in range(30)] + [("a", "1", 1000)], [("a", "99", 9000)]]
    other, read = Feed(spark, f"{feed.path}/grouped"), ["ip", "jail", "action", "at", "expires_at", "level", "event_seq"]
    for part in data:
        feed.add(*part)
        other.add(*part)
        feed.run()
        other.run(groups=2)
        for what in (live.live_bans, live.live_rings, live.live_counts):
            assert feed.state(what) == other.state(what)
        assert feed.state(live.live_stats, [A, B]) == other.state(live.live_stats, [A, B])
    found, want = (sorted(map(str, f.actions().select(read).collect())) for f in (other, feed))
    assert found == want and any("unban" in r for r in found) and any("late" in r for r in found)


def test_a_tracker_has_partitions_by_its_rows(spark):
    """A micro-batch pays for every partition of the state, whatever other shuffles of the session need."""
    from banstream.plans import streams
    from pyspark.sql import functions as F

    assert [streams.state_partitions(n, 12) for n in (0, 3_000_000, 3_000_001, 21_600_000)] == [12, 12, 13, 87]
    spark.conf.set(streams.PARTITIONS, "23")
    try:
        done = streams.track(spark, "/root/testdata/sf0.001", F.lit(0), 1)
        assert spark.conf.get(streams.PARTITIONS) == "23" and spark.conf.get(streams.CHANGES, None) is None
    finally:
        spark.conf.set(streams.PARTITIONS, "4")
    assert {r["numPartitions"] for r in spark.read.format("state-metadata").load(done.checkpoint).collect()} == {spark.sparkContext.defaultParallelism}


def test_stats_read_the_state_once(feed, spark):
    """A read of the state opens the store of every partition; totals and bans come from one."""
    feed.add(*[("a", "1", 1000 + i) for i in range(3)], ("b", "2", 1000))
    feed.run(groups=2)
    stats = live.live_stats(spark, feed.checkpoint, [A, B])
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("storeName=") == 1
    assert sorted(map(tuple, stats.collect())) == [("a", 1, 1, 0, 3), ("b", 0, 0, 0, 1)]
    stored = spark.read.format("statestore").option("path", feed.checkpoint).option("stateVarName", "address").load()
    assert {f.name: f.dataType.simpleString() for f in stored.schema["value"].dataType} == {"addresses": "string"}
    assert stored.count() == 2


def test_a_tracker_takes_few_turns(spark):
    """A group's turn has a fixed cost in every micro-batch: a partition of the state has no more than 32."""
    from banstream.plans import streams
    from pyspark.sql import functions as F

    done = streams.track(spark, "/root/testdata/sf0.01", F.lit(0), 1)
    stored = spark.read.format("statestore").option("path", done.checkpoint).option("stateVarName", "address").load()
    numbers = [r[0] for r in stored.select("key.own").collect()]
    assert len(numbers) == len(set(numbers)) and max(numbers) < 32 * spark.sparkContext.defaultParallelism
    assert live.read_state(spark, done.checkpoint).select("ip").distinct().count() == 150
