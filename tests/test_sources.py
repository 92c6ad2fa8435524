"""Streams of log files, network tables, enabled jails and the JSON form of the event log."""

import json

from banstream.jails import Jail, enabled_jails, jails_frame
from banstream.operators import allowlist
from banstream.sources import logs, state


def test_stream_of_log_files(spark, tmp_path):
    """Each closed file once, bytes that are no UTF-8 replaced, line feeds alone end lines."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\r\ntwo \xff\n\nthree")
    stream = logs.stream_log_lines(spark, str(folder), files_per_trigger=1)
    assert stream.isStreaming and stream.columns == ["source", "line", "ingest_ts"]

    def run():
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["source"][-5:], r["line"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a.log", ""), ("a.log", "one\r"), ("a.log", "three"), ("a.log", "two �")]
    assert run() == first
    (folder / "b.log").write_bytes(b"four\n")
    assert run() == [*first, ("b.log", "four")] == run()


def test_networks_from_a_file(spark, tmp_path):
    (tmp_path / "nets.csv").write_text('cidr,asn,org,country,city\n10.0.0.0/8,1,"A, Inc",DE,\n2001:db8::/32,2,B,FR,Lyon\n10.1.0.0/16,,C,,\nbad,3,D,DE,\n10.0.0.0/33,4,E,DE,\n')
    nets = logs.geo_networks(spark, str(tmp_path / "nets.csv"))
    rows = {(r["family"], r["lo"], r["hi"], r["prefix"]): (r["asn"], r["org"], r["city"]) for r in nets.collect()}
    assert rows == {
        (4, "0a000000".rjust(32, "0"), "0affffff".rjust(32, "0"), 8): (1, "A, Inc", None),
        (4, "0a010000".rjust(32, "0"), "0a01ffff".rjust(32, "0"), 16): (None, "C", None),
        (6, "20010db8".ljust(32, "0"), "20010db8".ljust(32, "f"), 32): (2, "B", "Lyon"),
    }
    bans = spark.createDataFrame([("10.1.2.3",), ("10.2.2.3",), ("2001:db8::1",), ("9.9.9.9",)], "ip string")
    assert {r["ip"]: r["org"] for r in allowlist.enrich_geo(bans, nets, ["org"]).collect()} == {"10.1.2.3": "C", "10.2.2.3": "A, Inc", "2001:db8::1": "B", "9.9.9.9": None}


def test_enabled_jails(spark):
    jails = jails_frame(spark, [Jail("a", ("x <HOST>",)), Jail("b", ("x <HOST>",), enabled=False), Jail("c", ("x <HOST>",))])
    assert sorted(r["jail"] for r in enabled_jails(jails).collect()) == ["a", "c"]


def test_event_log_as_json(spark):
    events = spark.createDataFrame([(1, 'a "b"\n=', None), (2, "", 7)], "n int, text string, other int")
    got = [json.loads(r["line"]) for r in state.event_log(events, "seen", {"n": False, "text": True, "other": False}, fmt="json").collect()]
    assert got == [{"msg": "seen", "n": 1, "text": 'a "b"\n=', "other": None}, {"msg": "seen", "n": 2, "text": "", "other": 7}]


def test_a_file_of_the_log_is_sorted_in_pieces(spark):
    """No task sorts a whole file, and the pieces follow each other as the file's lines do."""
    from pyspark.sql import functions as F

    from banstream.plans import queries

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        made = queries._pieces(spark.range(20_000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("line")))
        rows = made.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sizes = {t: sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}}
    assert max(sizes.values()) < 20_000 / 8
    for part in range(4):
        own = [(r["piece"], int(r["value"])) for r in rows if r["part"] == part]
        want = sorted(range(part, 20_000, 4), key=lambda i: (i * 7919 % 10007, i))
        assert [v for _, v in sorted(own, key=lambda x: x[0])] == want
