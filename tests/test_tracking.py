"""Thresholds, the ban timeline, its stream, state and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from banstream.jails import Jail, jails_frame
from banstream.operators import bans, failures
from banstream.operators.timeline import State, ban_rows, ban_timeline, expire, step
from banstream.sources import logs, state
from banstream.streaming.tracker import track_bans

A = Jail("a", ("x <HOST>",), max_retry=3, find_time=60, ban_time=100, bantime_increment=True, bantime_maxtime=300)
B = Jail("b", ("x <HOST>",), max_retry=2, find_time=60, ban_time=-1)
JAILS = {"a": A, "b": B}


def fails(spark, rows):
    return spark.createDataFrame([(j, ip, ts, i) for i, (j, ip, ts) in enumerate(rows)], "jail string, ip string, ts long, seq long")


def acts(rows):
    return [(r["ip"], r["jail"], r["action"], r["at"], r["expires_at"]) for r in rows]


def test_threshold_is_inclusive_and_counts_in_arrival_order(spark):
    df = fails(spark, [("a", "1", 0), ("a", "1", 30), ("a", "1", 60), ("a", "1", 121), ("a", "2", 0), ("a", "2", 1), ("x", "1", 5)])
    hits = {r["seq"]: r["hit"] for r in failures.threshold_hits(df, [A], ("seq",)).collect()}
    assert hits == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}
    back = fails(spark, [("a", "1", 500), ("a", "1", 400), ("a", "1", 100)])
    assert failures.would_ban(back, [A], ("seq",)).first()["would_ban"]
    assert failures.would_ban(df.where(F.lit(False)), [A]).count() == 0


def test_step_escalates_over_jails_and_expires():
    s = State()
    run = lambda kind, jail, ts, **k: [(a[1], a[2], a[3], a[6]) for a in step(s, kind, jail, ts, JAILS, 1000, **k)]
    assert [run("failure", "a", t) for t in (0, 1, 2)] == [[], [], [("ban", 2, 102, 0)]]
    assert run("failure", "a", 50) == []  # covered by the ban and not stored
    assert run("failure", "b", 51) == []
    assert run("failure", "b", 52) == [("ban", 52, None, 1)]
    assert run("failure", "a", 102) == [("unban", 102, None, None)]
    assert [run("failure", "a", t) for t in (103, 104)] == [[], [("ban", 104, 404, 2)]]
    assert run("failure", "x", 110) == []
    assert expire(s, 403, 1000) == []
    assert expire(s, 404, 1000)[0][1:3] == ("unban", 404)
    assert s.count == 3
    expire(s, 1105, 1000)
    assert s.count == 0


def test_commands():
    s = State()
    run = lambda kind, jail, ts, **k: [(a[1], a[5]) for a in step(s, kind, jail, ts, JAILS, **k)]
    assert run("unban", "a", 1) == [("error", "not_banned")]
    assert run("ban", "a", 1) == [("ban", "manual")]
    assert run("ban", "a", 2) == [("error", "already_banned")]
    assert run("ban", "x", 2) == [("error", "unknown_jail")]
    assert run("apply_failed", "a", 3) == [("rollback", "firewall_ban_failed")]
    assert run("apply_failed", "a", 3) == []
    assert run("ban", "a", 4, ban_time=-1) == [("ban", "manual")]
    assert run("unban", "a", 5) == [("unban", "manual")]
    assert s.count == 0


@pytest.fixture(scope="module")
def many():
    rows, at = [], 1000
    for i in range(600):
        at += (i * 7919) % 3
        rows.append(("ab"[i % 3 == 0], f"10.0.0.{i % 7}", at))
    return rows


def replay(rows, until):
    states, out = {}, []
    for i, (jail, ip, ts) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        out += [(ip, *a[:4]) for a in step(states.setdefault(ip, State()), "failure", jail, ts, JAILS)]
    for ip, s in states.items():
        out += [(ip, *a[:4]) for a in expire(s, until, 30 * 86400)]
    return sorted((ip, jail, act, at, exp) for ip, jail, act, at, exp in out if True)


def key(row):
    return tuple(-1 if v is None else v for v in row)


def test_batch_timeline_is_the_replay(spark, many):
    got = acts(ban_timeline(fails(spark, many), [A, B], until=10**6).collect())
    assert sorted(got, key=key) == sorted(replay(many, 10**6), key=key)
    assert ban_timeline(fails(spark, many[:0]), [A, B]).count() == 0


@pytest.mark.parametrize("folded", [10_000, 3, 0])
def test_timeline_from_hits_is_the_replay(spark, folded):
    """Escalation over jails, permanent bans, single failures that ban, ties of dates, decay, and one hot address."""
    draw = random.Random(folded)
    own = [
        A,
        Jail("p", ("x <HOST>",), max_retry=4, find_time=400, ban_time=-1),
        Jail("m", ("x <HOST>",), max_retry=1, find_time=5, ban_time=40, bantime_increment=True, bantime_multipliers=(1, 3), bantime_factor=1.5),
        Jail("f", ("x <HOST>",), max_retry=2, find_time=20, ban_time=25),
    ]
    known = {j.jail: j for j in own}
    rows = [(draw.choice(["a", "a", "a", "f", "f", "m", "p", "x"]), str(draw.choice([1, 1, 1, 1, 2, 3, 4, 5, 6])), 1000 + draw.randint(0, 4000)) for _ in range(900)]
    states, want = {}, []
    for i, (jail, ip, ts) in sorted(enumerate(rows), key=lambda r: (r[1][2], r[0])):
        want += [(ip, *a, None if a[5] == "expired" else i) for a in step(states.setdefault(ip, State()), "failure", jail, ts, known, 500)]
    last = want + [(ip, *a, None) for ip, s in states.items() for a in expire(s, 10**6, 500)]
    data = fails(spark, rows).unionByName(spark.createDataFrame([("a", None, 5, 1), ("a", "1", None, 2)], "jail string, ip string, ts long, seq long"))
    for until, expected in ((None, want), (10**6, last)):
        got = ban_timeline(data, own, decay=500, until=until, folded=folded)
        assert sorted(map(key, map(tuple, got.collect())), key=str) == sorted(map(key, expected), key=str)
    assert {a[1] for a in want if a[2] == "ban"} == set(known) and max(a[7] or 0 for a in want) > 2
    assert ban_timeline(data, [Jail("z", ("x <HOST>",), ban_time=1, bantime_increment=True, bantime_factor=0.1)]).count() == 0
    assert ban_timeline(data, []).count() == 0


def test_bans_cover_whatever_their_number(spark):
    draw = random.Random(3)
    made = [(draw.choice("ab"), draw.choice(["1", "2", None]), draw.choice([None, draw.randint(0, 300)]), i) for i in range(300)]
    put = [(draw.choice(["1", "2", None]), draw.choice("ab"), at := draw.randint(0, 300), draw.choice([None, at, at + draw.randint(1, 30)]) if draw.random() < 0.9 else at + 1) for _ in range(25)]
    put = [(ip, jail, at, until if i % 9 else until or at + 9) for i, (ip, jail, at, until) in enumerate(put)]
    covered = {i for jail, ip, ts, i in made for bip, bjail, at, until in put if ip is not None and ts is not None and (bip, bjail) == (ip, jail) and at <= ts and (until is None or ts < until)}
    df = spark.createDataFrame([(*r, "x") for r in made], "jail string, ip string, ts long, seq long, banned_at string")
    bans_df = spark.createDataFrame(put, state.BANS).unionByName(spark.createDataFrame([("1", "a", None, None)], state.BANS))
    kept = failures.suppress_banned(df, bans_df)
    assert kept.columns == df.columns and {r["seq"] for r in kept.collect()} == set(range(300)) - covered and 0 < len(covered) < 300
    assert {r["seq"] for r in failures.suppress_banned(df, bans_df, label=True).where("banned").collect()} == covered


def test_stream_is_the_batch(spark, many, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fails(spark, many).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("jail string, ip string, ts long, seq long").parquet(str(tmp_path / "in"))
    state.write_actions(track_bans(source, [A, B]), state.parquet_sink(str(tmp_path / "out")), str(tmp_path / "check"), available_now=True).awaitTermination()
    got = ban_rows(spark.read.parquet(str(tmp_path / "out"))).select("ip", "jail", "banned_at", "expires_at").collect()
    want = ban_rows(ban_timeline(fails(spark, many), [A, B])).select("ip", "jail", "banned_at", "expires_at").collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len(want) > 20


def test_state_round_trip_and_version(spark, tmp_path):
    b = spark.createDataFrame([("1", "a", 5, None), ("2", "a", 5, 9)], state.BANS)
    state.save_bans(b, bans.ban_counts(b), str(tmp_path / "s"))
    again, counts = state.load_bans(spark, str(tmp_path / "s"))
    assert sorted(map(key, again.collect())) == sorted(map(key, b.collect()))
    assert counts.count() == 2
    state.save_bans(b.limit(1), bans.ban_counts(b), str(tmp_path / "s"))
    assert state.load_bans(spark, str(tmp_path / "s"))[0].count() == 1 and again.count() == 2  # what was saved before is still whole
    spark.sql("select 99 as version, 'x' as folder, timestamp '2999-01-01' as saved_at").write.mode("append").parquet(str(tmp_path / "s" / "saved"))
    with pytest.raises(state.StateVersionError):
        state.load_bans(spark, str(tmp_path / "s"))


def test_reports(spark):
    b = spark.createDataFrame([("1", "a", 5, None), ("2", "a", 5, 9), ("2", "b", 7, 99), ("2", "a", 50, 60)], state.BANS)
    assert [(r["ip"], r["expires"]) for r in bans.list_bans(b, 10).collect()] == [("2", "expired"), ("2", "0m remaining"), ("2", "1m remaining"), ("1", "permanent")]
    assert bans.active_bans(b, 9).count() == 3 and bans.expired_bans(b, 9).count() == 1
    assert {(r["ip"], r["jail"]): r["banned_at"] for r in bans.latest_ban(b).collect()} == {("1", "a"): 5, ("2", "a"): 50, ("2", "b"): 7}
    assert sorted((r["banned_at"], r["level"]) for r in bans.escalation_level(b.where("ip = '2'"), 40).collect()) == [(5, 0), (7, 1), (50, 0)]
    assert json.loads(state.bans_jsonl(b.where("ip = '1'")).first()["value"]) == {"jail": "a", "ip": "1", "banned_at": 5, "expires_at": None}
    assert bans.seed_bans(b.where(F.lit(False)), b).count() == 4 and bans.seed_bans(b.limit(1), b).count() == 1
    assert bans.decayed_counts(bans.ban_counts(b), 0, 10**9).count() == 0
    assert bans.reconcile(b, b.where("jail = 'a'")).collect()[0]["jail"] == "b"
    none = b.where(F.lit(False))
    first = bans.reconcile(b, none, limit=2).collect()
    rest = bans.reconcile(b, none, limit=None, after=(first[-1]["banned_at"], first[-1]["ip"], first[-1]["jail"])).collect()
    assert len(first) == 2 and sorted(r["banned_at"] for r in [*first, *rest]) == [5, 5, 7, 50]
    fails = spark.createDataFrame([("1", "a", 4), ("1", "a", 500), ("2", "a", 9)], "ip string, jail string, ts long")
    assert [r["ts"] for r in failures.suppress_banned(fails, b).orderBy("ts").collect()] == [4, 9]
    assert [r["banned"] for r in failures.suppress_banned(fails, b, label=True).orderBy("ts").collect()] == [False, False, True]


def test_jail_changes(spark):
    from banstream.jails import Backend

    old = jails_frame(spark, [A, B, Jail("c", ("x <HOST>",))])
    new = jails_frame(spark, [A, Jail("c", ("x <HOST>",), backend=Backend("script", "x", "y")), Jail("d", ("x <HOST>",))])
    got = sorted((r["jail"], r["change"]) for r in bans.diff_jails(old, new).collect())
    assert got == [("a", "kept"), ("b", "removed"), ("c", "added"), ("c", "removed"), ("d", "added")]


def test_journal(spark, tmp_path):
    rows = [{"MESSAGE": "one ", "SYSLOG_IDENTIFIER": "sshd", "_PID": "7", "_HOSTNAME": "h", "_SYSTEMD_UNIT": "ssh.service", "__REALTIME_TIMESTAMP": "5000000"}, {"MESSAGE": " ", "_SYSTEMD_UNIT": "ssh.service"}, {"MESSAGE": "two", "_SYSTEMD_UNIT": "cron.service"}]
    (tmp_path / "j.json").write_text("\n".join(map(json.dumps, rows)))
    got = logs.read_journal(spark, str(tmp_path / "j.json"), ["_SYSTEMD_UNIT=ssh.service", "_SYSTEMD_UNIT=sshd.service"]).collect()
    assert [(r["line"], r["ts"]) for r in got] == [("h sshd[7]: one", 5)]
