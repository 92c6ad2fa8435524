"""Durations, dates, addresses, ban times and texts against tables of cases."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from banstream.functions import addresses, bans, rendering, times


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_durations(spark):
    cases = {"600": 600, "10m": 600, "1h": 3600, " 7d ": 604800, "1w": 604800, "5 m": 300, "-1": -1, "": None, "m": None, "10x": None, "9223372036854775807w": None, None: None}
    assert column(spark, list(cases), times.parse_duration) == list(cases.values())


@pytest.mark.parametrize(
    ("fmt", "line", "want"),
    [
        ("iso8601", "2024-01-15T10:30:00Z x", 1705314600),
        ("iso8601", "x 2024-01-15 10:30:00.123+02:00 y", 1705307400),
        ("iso8601", "2024-01-15T10:30:00-0330", 1705327200),
        ("iso8601", "2024-02-31T00:00:00", 1709337600),  # day 31 runs on into the next month
        ("iso8601", "2024-13-01T00:00:00 2024-01-15T10:30:00", 1705314600),  # out of range: go on
        ("iso8601", "abcd-ef-ghTij:kl:mn 2024-01-15T10:30:00", None),  # the first shape has no digits
        ("iso8601", "2024-01-15T10:30:60", None),
        ("epoch", "at 1705314600.5 x", 1705314600),
        ("epoch", "99999999999999999999", None),
        ("common", "[15/Jan/2024:10:30:00 +0200]", 1705307400),
        ("common", "[15/Jan/2024:10:30:00]", 1705314600),
        ("common", "[31/Feb/2024:10:30:00]", None),
        ("syslog", "Jan 15 10:30:00 host", 1705314600),
        ("syslog", "Dec  5 10:30:00 host", 1701772200),  # the year before
        ("syslog", "Foo 15 10:30:00 host", None),
        ("syslog", None, None),
    ],
)
def test_dates(spark, fmt, line, want):
    assert column(spark, [line], lambda c: times.line_ts(c, fmt, ref_ts=F.lit(1705363200))) == [want]


def test_syslog_in_a_zone(spark):
    lines = ["Mar 10 02:30:00 x", "Nov  3 01:30:00 x", "Jul  1 12:00:00 x"]  # a gap, an hour that comes twice, a plain one
    got = column(spark, lines, lambda c: times.ts_syslog(c, F.lit(1733000000), "America/New_York"))
    assert got == [1710037800, 1730597400, 1719849600]


def test_unknown_format():
    with pytest.raises(ValueError, match="unknown date format"):
        times.line_ts(None, "x")


def test_addresses_agree_with_the_standard_library(spark):
    random.seed(5)
    tokens = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "::ffff:1.2.3.4", "::FFFF:10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3", ":1", "1:", "", "12345::", "1:2:3:4:5:6:7:8:9", "::ffff:102:304", "1:2:3:4:5:6:7::8"]
    for _ in range(150):
        groups = [random.choice(["0", "0", "0", "1", "ab", "2001", "0db8"]) for _ in range(8)]
        full = ":".join(groups)
        tokens += [full, str(ipaddress.ip_address(":".join(g.zfill(4) for g in groups))).upper()]

    def want(t):
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            return None
        return str(getattr(ip, "ipv4_mapped", None) or ip)

    got = column(spark, tokens, addresses.parse_ip)
    assert [(t, g) for t, g in zip(tokens, got, strict=True) if g != want(t)] == []
    assert column(spark, tokens, addresses.is_ip) == [want(t) is not None for t in tokens]
    texts = [g for g in got if g]
    assert column(spark, texts, addresses.ip_hex) == [f"{int(ipaddress.ip_address(t)):032x}" for t in texts]


def test_ports_and_networks(spark):
    assert column(spark, ["10.0.0.1:8080", "192.168.0.1:29530:", "2001:db8::1", "x:1", None], addresses.strip_port) == ["10.0.0.1", "192.168.0.1", "2001:db8::1", None, None]
    assert column(spark, ["10.0.0.255", "10.0.1.0", "::a00:1", None], lambda c: addresses.ip_in_net(c, "10.0.0.7/24")) == [True, False, False, None]
    with pytest.raises(ValueError):
        addresses.parse_cidr("10.0.0.0/33")


@pytest.mark.parametrize(
    ("base", "count", "inc", "factor", "steps", "cap", "want"),
    [(3600, 3, False, 1.0, [], 604800, 3600), (3600, 3, True, 1.0, [], 604800, 28800), (-1, 5, True, 2.0, [], 10, -1), (60, 9, True, 1.0, [1, 5, 30], 0, 1800), (3600, 99, True, 1.0, [], 604800, 604800), (7, 1, True, 1.5, [], 0, 21), (1 << 60, 20, True, 1.0, [], 0, (1 << 63) - 1)],
)
def test_ban_times(spark, base, count, inc, factor, steps, cap, want):
    out = bans.calc_ban_time(F.lit(base).cast("long"), F.lit(count), F.lit(inc), F.lit(factor), F.array(*[F.lit(s) for s in steps]).cast("array<int>"), F.lit(cap).cast("long"))
    assert spark.range(1).select(out.alias("x")).first()["x"] == want
    from banstream.jails import Jail
    from banstream.operators.timeline import ban_seconds

    if base > 0 and cap > 0:
        assert ban_seconds(Jail("j", ("<HOST>",), ban_time=base, bantime_increment=inc, bantime_factor=factor, bantime_multipliers=tuple(steps), bantime_maxtime=cap), count) == want


def test_texts(spark):
    assert column(spark, [None, 0, 59, 3600, 90061], rendering.format_relative, "long") == ["permanent", "expired", "0m remaining", "1h 0m remaining", "25h 1m remaining"]
    assert column(spark, ["a", "", "a b", 'q"q', "l\nl", "k=v", "b\\s"], rendering.logfmt_value) == ["a", '""', '"a b"', '"q\\"q"', '"l\\nl"', '"k=v"', "b\\s"]
    assert column(spark, ["ok_1", "bad;x", ""], lambda c: rendering.render_action("b <IP> <JAIL>", F.lit("1.1.1.1"), c)) == ["b 1.1.1.1 ok_1", None, None]
