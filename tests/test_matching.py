"""Patterns, matching, allow-lists and the rule catalog."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from banstream.functions import addresses
from banstream.jails import Jail, jails_frame
from banstream.operators import allowlist, matching
from banstream.operators.patterns import expand_host, host_extractor, host_group_index, index_keys, literal_prefix, required_literal
from banstream.plans.dry_run import dry_run_log
from banstream.plans.lines import sample
from banstream.sources.catalog import FILTERS
from banstream.sources.logs import filter_catalog, read_log_lines

LOG = [
    "Mar  3 23:58:40 gate sshd[70]: Invalid user oracle from 198.51.100.9 port 40122",
    "Mar  3 23:59:50 gate sshd[71]: Accepted password for deploy from 192.0.2.77 port 50505 ssh2",
    *[f"Mar  4 00:0{i}:15 gate sshd[72]: Failed password for mail from 203.0.113.250 port 5{i}000 ssh2" for i in range(3)],
    "\0 no \t service",
    "Mar  4 00:07:00 gate sshd[73]: Connection closed by authenticating user git 198.51.100.201 port 61000 [preauth]",
    "",
    "Mar  4 00:09:59 gate sshd[74]: Invalid user pi from 198.51.100.9 port 40999",
]


def lines(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, line string")


def ips(df):
    return [(r["seq"], r["ip"]) for r in df.select("seq", "ip").orderBy("seq").collect()]


def test_patterns():
    assert host_group_index(r"(a)(?:b)\((c[(])<HOST>") == 3
    assert literal_prefix(r"user .* <HOST>") == "user "
    assert literal_prefix("<HOST> x") is None
    assert host_extractor("^<HOST> x") == ("start", None)
    assert host_extractor(r"for .* from <HOST>") == ("after", " from ")
    assert host_extractor(r".* <HOST>, bad") == ("before", ", bad")
    assert host_extractor(r".* <HOST>.") == ("group", None)
    assert required_literal("(a|bcd) x<HOST>") is None
    assert required_literal("abcd? e<HOST>") == "abc"
    assert required_literal("(?i)abcd <HOST>") is None
    assert required_literal("abc <HOST>|x") is None
    for bad in ("none", "<HOST><HOST>"):
        with pytest.raises(ValueError):
            expand_host(bad)


def test_every_rule_compiles_and_is_unique(spark):
    assert len(FILTERS) == 88
    patterns = [p for f in FILTERS.values() for p in f.patterns]
    assert len(patterns) == 127
    assert all(re.compile(expand_host(p, "re2")) for p in patterns)
    assert filter_catalog(spark).count() == 88
    assert matching.pattern_hits(lines(spark, LOG), tuple(patterns)).where("hits > 0").count() == 3


def test_every_pattern_finds_its_sample(spark):
    """By itself, by its guards and by all rules together; and not without an address."""
    patterns = [p for f in FILTERS.values() for p in f.patterns]
    texts = [sample(p, "192.0.2.33") for p in patterns]
    groups = [re.search(expand_host(p, "re2"), t)[host_group_index(p)] for p, t in zip(patterns, texts, strict=True)]
    assert sum(g != "192.0.2.33" for g in groups) == 4  # what may stand right before the host takes digits of it
    good = ["." in g for g in groups]  # the rest is an address all the same, but for one
    assert [p[:8] for p, g in zip(patterns, good, strict=True) if not g] == ["SECURITY"]
    hits = {r["pattern_idx"]: r["hits"] for r in matching.pattern_hits(lines(spark, texts), tuple(patterns)).collect()}
    assert [hits[i] > 0 for i in range(len(patterns))] == good
    jails = [Jail(f"j-{f.name}", f.patterns) for f in FILTERS.values()]
    found = matching.match_jails(lines(spark, texts), jails).select("jail", "seq", "ip").collect()
    own = [f"j-{f.name}" for f in FILTERS.values() for _ in f.patterns]
    assert {(own[i], i, groups[i]) for i in range(len(texts)) if good[i]} <= {tuple(r) for r in found}
    none = matching.pattern_hits(lines(spark, [t.replace("192.0.2.33", "nowhere") for t in texts]), tuple(patterns))
    assert none.where("hits > 0").count() == 0


def test_match_modes(spark):
    jail = Jail("sshd", FILTERS["sshd"].patterns)
    df = lines(spark, LOG)
    want = [(0, "198.51.100.9"), *((i, "203.0.113.250") for i in (2, 3, 4)), (6, "198.51.100.201"), (8, "198.51.100.9")]
    assert ips(matching.match_lines(df, jail)) == want
    assert ips(matching.match_lines(df, jail, extractor="positional")) == want


def test_many_jails_in_one_scan(spark):
    jails = [Jail(f"j-{f.name}", f.patterns, log_path="a" if f.name == "sshd" else "b") for f in list(FILTERS.values())[:9]]
    jails += [Jail("sshd-again", FILTERS["sshd"].patterns[::-1], log_path="a", ignoreregex=("from 198[.]51",))]
    texts = [*LOG, *["dovecot: imap-login: auth failed, rip=1.2.3.4, x", "sshd[1]: Failed password for x from 999.1.1.1 port 22"] * 2]
    df = lines(spark, texts).withColumn("source", F.when(F.col("seq") % 2 == 0, "a").otherwise("b"))
    alone = sorted(
        (j.jail, r["seq"], r["ip"], r["pattern_idx"]) for j in jails for r in matching.match_lines(df.where(F.col("source") == j.log_path), j).select("seq", "ip", "pattern_idx").collect()
    )
    found = matching.match_all(df, jails)
    assert sorted(map(tuple, found.select("jail", "seq", "ip", "pattern_idx").collect())) == alone and len(alone) == 8
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


def token_ip(span, kind, literal):
    """The address of a matched text by its place, written plainly."""

    def parsed(token):
        while len(token) >= 2:
            try:
                ip = ipaddress.ip_address(token)
                return str(getattr(ip, "ipv4_mapped", None) or ip)
            except ValueError:
                token = token.rpartition(":")[0]
        return None

    at = lambda i: parsed(re.match(r"[0-9a-fA-F.:]*", span[i:])[0])
    if kind in ("start", "group"):
        return at(0)
    if kind == "after":
        places = (m.start() + len(literal) for m in re.finditer(f"(?={re.escape(literal)})", span))
        return next((ip for i in places if (ip := at(i))), None)
    head, found, _ = span.partition(literal)
    tokens = re.split(r"[^0-9a-fA-F.:]", head) if found else []
    return next((ip for t in reversed(tokens) if len(t) >= 2 and (ip := parsed(t))), None)


def test_tokens_of_spans(spark):
    draw = random.Random(6)
    parts = ["1.2.3.4", "1.2.3.4:80", "10.0.0.1:5:6", "999.1.1.1", "2001:db8::1", "2001:DB8::1:443", "::ffff:9.8.7.6:22", "fe80::", "::", ":", "a", "ff", "beef", "", "1.2.3", " ", ",", " from ", "rhost=", "fromfrom", "é", " x "]
    spans = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 6))) for _ in range(600)]
    df = spark.createDataFrame([(s,) for s in spans], "span string")
    for kind, literal in (("start", None), ("group", None), ("after", " from "), ("after", "fromfrom"), ("after", "aa"), ("before", " from "), ("before", ", ")):
        tokens = matching.host_tokens(F.col("span"), kind, literal)
        ip = F.get(F.filter(F.transform(tokens, addresses.strip_port), lambda t: t.isNotNull()), 0)
        got = {r["span"]: r["ip"] for r in df.select("span", ip.alias("ip")).collect()}
        assert got == {s: token_ip(s, kind, literal) for s in spans}, (kind, literal)


def test_order_of_patterns(spark):
    """Of patterns that all match, the one whose literal ends first in the line is tried first, then by number."""
    patterns = (r"late word .* <HOST>", r"early <HOST>", r"<HOST> any")
    jail = Jail("j", patterns)
    df = lines(spark, ["early 1.1.1.1 late word x 2.2.2.2", "late word early 3.3.3.3 any", "early none late word x 4.4.4.4", "x 5.5.5.5 any", "early none 6.6.6.6 any"])
    got = matching.match_lines(df, jail, extractor="positional")
    assert [(r["seq"], r["ip"], r["pattern_idx"]) for r in got.orderBy("seq").collect()] == [(0, "1.1.1.1", 1), (1, "3.3.3.3", 0), (2, "4.4.4.4", 0), (3, "5.5.5.5", 2)] + [(4, "6.6.6.6", 2)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    capture = matching.match_lines(df, jail)
    assert {r["seq"]: r["pattern_idx"] for r in capture.collect()}[0] == 0  # by number


def test_spoofed_lines(spark):
    df = lines(spark, ["sshd[1]: Failed password for x from 1.1.1.1 from 10.0.0.1 port 22", "sshd[1]: Failed password for x from 999.1.1.1 port 22"])
    jail = Jail("sshd", FILTERS["sshd"].patterns)
    assert ips(matching.match_lines(df, jail)) == [(0, "10.0.0.1")]
    assert ips(matching.match_lines(df, jail, extractor="positional")) == [(0, "1.1.1.1")]


def test_ipv6_and_ignored_lines(spark):
    df = lines(spark, ["sshd[1]: Invalid user a from 2001:DB8:0:0::1 port 1", "sshd[1]: Invalid user b from ::ffff:1.2.3.4 port 1", "sshd[1]: Invalid user skip from 1.1.1.1 port 1"])
    jail = Jail("sshd", FILTERS["sshd"].patterns, ignoreregex=("user skip",))
    assert ips(matching.match_lines(df, jail)) == [(0, "2001:db8::1"), (1, "1.2.3.4")]


def test_bounds_and_blanks(spark):
    df = lines(spark, ["a" * 65536, "a" * 65537, "é" * 40000, " \t", "x  "])
    assert [r["seq"] for r in matching.bound_lines(df).orderBy("seq").collect()] == [0, 3, 4]
    assert [r["seq"] for r in matching.skip_blank(df).orderBy("seq").collect()] == [0, 1, 2, 4]
    assert df.limit(1).select(matching.repair_utf8(F.lit(b"a\xffb").cast("string"))).first()[0] == "a�b"


def test_allow_lists(spark):
    fails = spark.createDataFrame([("10.0.0.1",), ("10.0.1.1",), ("127.0.0.1",), ("::1",), ("2001:db8::5",), (None,)], "ip string")
    kept = [r["ip"] for r in allowlist.drop_allowlisted(fails, ["10.0.0.0/24", "2001:db8::/32"]).collect()]
    assert kept == ["10.0.1.1", None]
    long = ["10.0.0.0/24", "2001:db8::/32", *(f"172.16.{i}.0/24" for i in range(250))]
    assert [r["ip"] for r in allowlist.drop_allowlisted(fails, long).orderBy(F.asc_nulls_last("ip")).collect()] == kept
    nets = allowlist.network_ranges(spark.createDataFrame([("10.0.0.9/24", "a"), ("10.0.0.0/8", "b"), ("2001:db8::/33", "c"), ("::/0", "d"), ("bad", "e"), ("1.1.1.1/40", "f")], "cidr string, org string"))
    assert nets.count() == 4
    geo = {r["ip"]: r["org"] for r in allowlist.enrich_geo(fails, nets, ["org"]).collect()}
    assert geo == {"10.0.0.1": "a", "10.0.1.1": "b", "127.0.0.1": None, "::1": "d", "2001:db8::5": "c", None: None}
    assert [r["ip"] for r in allowlist.drop_in_networks(fails, nets).collect()] == ["127.0.0.1", None]


def test_innermost_networks(spark):
    """Nested over many levels, equal, touching, wider and narrower than a bucket, both families."""
    draw = random.Random(2)
    v4 = [f"10.{draw.randint(0, 2)}.{draw.randint(0, 3)}.{draw.randint(0, 255)}/{draw.choice([8, 14, 15, 16, 17, 20, 23, 24, 25, 28, 30, 31, 32])}" for _ in range(150)]
    v6 = [f"2001:db8:{draw.randint(0, 1)}:{draw.choice([0, 0xFFFF]):x}::{draw.randint(0, 3):x}/{draw.choice([0, 31, 32, 47, 48, 49, 64, 120, 126, 127, 128])}" for _ in range(80)]
    nets = [ipaddress.ip_network(n, strict=False) for n in {*v4, *v6, "10.0.0.0/16", "10.0.0.0/17", "10.0.128.0/17", "10.0.255.255/32", "255.255.255.255/32"}]
    ips = {str(a) for n in nets for a in (n[0], n[-1], n[draw.randrange(min(n.num_addresses, 1 << 40))])}
    ips |= {str(a) for n in nets for b in (int(n[-1]) + 1, int(n[0]) - 1) if 0 <= b < (1 << (32 if n.version == 4 else 128)) for a in [(ipaddress.IPv4Address if n.version == 4 else ipaddress.IPv6Address)(b)]}
    ranges = allowlist.network_ranges(spark.createDataFrame([(str(n),) for n in nets] * 2, "cidr string"))
    rows = spark.createDataFrame([(i,) for i in [*ips, *list(ips)[:50], None, "no address"]], "ip string")
    got = allowlist.innermost(rows, ranges).collect()

    def want(text):
        a = ipaddress.ip_address(text)
        held = [n for n in nets if n.version == a.version and a in n]
        return max(held, key=lambda n: n.prefixlen) if held else None

    expected = {i: (n.version, n.prefixlen, f"{int(n[0]):032x}") for i in ips if ipaddress.ip_address(i).version == 4 or getattr(ipaddress.ip_address(i), "ipv4_mapped", None) is None for n in [want(i)] if n}
    assert {r["ip"]: (r["family"], r["prefix"], r["lo"]) for r in got if r["ip"] in expected} == expected and len(got) == len({r["ip"] for r in got})
    assert {r["ip"] for r in got} <= {*expected, "no address"}
    assert allowlist.innermost(rows, ranges.limit(0)).count() == 0


def test_jails_refuse_what_cannot_work(spark):
    good = Jail("a-1", ("x <HOST>",))
    assert jails_frame(spark, [good]).first()["max_retry"] == 5
    for change in ({"jail": "a b"}, {"filter": ()}, {"filter": ("x",)}, {"max_retry": 0}, {"find_time": 0}, {"ban_time": -2}, {"bantime_factor": float("nan")}, {"ignoreip": ("x",)}, {"webhook": "ftp://x"}, {"date_format": "x"}, {"maxmind": ("x",)}):
        with pytest.raises(ValueError):
            Jail(**({"jail": "a-1", "filter": ("x <HOST>",)} | change))


def test_dry_run(spark, tmp_path):
    (tmp_path / "auth.log").write_bytes("\n".join(LOG).encode() + b"\n\xff bad bytes\n")
    jails = [Jail("sshd", FILTERS["sshd"].patterns, max_retry=3, find_time=120)]
    summary, top = dry_run_log(spark, str(tmp_path / "auth.log"), jails, ref_ts=1709683200)
    assert summary.first().asDict() == {"jail": "sshd", "patterns": 4, "max_retry": 3, "find_time": 120, "ban_time": 3600, "matches": 6, "unique_ips": 3, "would_ban": 1}
    assert [(r["ip"], r["failures"], r["verdict"]) for r in top.collect()] == [("203.0.113.250", 3, "WOULD BAN"), ("198.51.100.9", 2, "1 more to ban"), ("198.51.100.201", 1, "2 more to ban")]


@pytest.fixture
def small_splits(spark):
    own = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "2"}
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_lines_of_split_files_have_their_place(spark, tmp_path, small_splits):
    draw = random.Random(8)
    files = {n: ["x" * draw.choice([0, 1, 5, 40, 700]) + f" {i}" if draw.random() < 0.9 else "" for i in range(size)] for n, size in (("a", 200), ("b", 1), ("c", 57), ("d", 0))}
    for name, texts in files.items():
        (tmp_path / name).write_text("".join(t + "\n" for t in texts))
    got = read_log_lines(spark, [str(tmp_path / n) for n in files])
    rows = sorted((r["source"][-1], r["seq"], r["line"]) for r in got.collect())
    assert rows == [(n, i, t) for n, texts in files.items() for i, t in enumerate(texts)]
    assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 20  # it was cut


def test_dry_run_counts_in_the_order_of_lines(spark, tmp_path, small_splits):
    """Dates go back and forth; only the order of the lines makes three of one address a ban."""
    stamps = ["00:00", "09:00", "00:10", "08:59", "08:58", "01:00", "20:00", "03:00"]
    texts = [f"2024-03-04T{t}:00Z gate sshd[1]: Failed password for x from 192.0.2.{1 + i // 5} port 1 ssh2" for i, t in enumerate(stamps)]
    (tmp_path / "auth.log").write_text("".join(f"{t}\n2024-03-04T05:00:00Z gate CRON[2]: {'y' * 250}\n" for t in texts))
    _, top = dry_run_log(spark, str(tmp_path), [Jail("sshd", FILTERS["sshd"].patterns, max_retry=3, find_time=60, date_format="iso8601")])
    ring = lambda own: any(own[i] - own[i - 2] <= 60 for i in range(2, len(own)))
    seconds = [3600 * int(t[:2]) + 60 * int(t[3:]) for t in stamps]
    want = {"192.0.2.1": ring(seconds[:5]), "192.0.2.2": ring(seconds[5:])}
    assert {r["ip"]: r["verdict"] == "WOULD BAN" for r in top.collect()} == want and set(want.values()) == {True, False}


def test_keys_of_rules():
    assert index_keys(expand_host(": Failed password for <HOST>")) == (("word", "password"),)
    assert index_keys("(?d)( one two | four five six ) x") == (("word", "two"), ("word", "five"))  # the parser takes the common space out
    assert index_keys("authfail=1 ") == (("gram", "authf"),)
    assert index_keys("a 123 4567 b") == (("gram", "a 123"),)
    assert index_keys("abc") == index_keys("(?i)failed for x") == index_keys("x*") == index_keys(r"(?<a>x)\p{Alpha}++ long text") == ()


def test_rule_tables_of_any_size(spark):
    """Words, grams, alternatives, rules without a literal, ties of rules, and more of them than a plan could hold."""
    draw = random.Random(5)
    host = expand_host("<HOST>").removeprefix("(?d)")
    names = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    shapes = [" bad {0} from ", "x={0}:", "( {0} one|two {0} ) ?", "(?i) {0}", "[0-9]{{3}} {0}?", "é{0}é"]
    rules = [(i, "(?d)" + draw.choice(shapes).format(draw.choice(names)) + host) for i in range(400)]
    rules = [(i, r, 2 if "one|two" in r else 1) for i, r in rules]
    forms = ["log bad {0} from {1}", "y x={0}:{1}", "two {0} {1}", " {0} one{1}", "a {0}{1}", "404 {0}{1}", "é{0}é{1}", "{0} {1}"]
    texts = [draw.choice(forms).format(draw.choice(names), draw.choice(["10.1.2.3", "999.1.1.1", "1.2.3.4", "none"])) for _ in range(500)]
    texts += ["", None, "🦀 bad"]
    lines_df = spark.createDataFrame(list(enumerate(texts)), "seq int, line string")

    def found(text):
        for i, regex, group in rules:
            m = re.search(regex.removeprefix("(?d)"), text or "")
            if m and re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m[group]) and all(int(x) < 256 for x in m[group].split(".")):
                return i, m[group]

    want = {(i, *hit) for i, t in enumerate(texts) if (hit := found(t))}
    got = matching.match_dynamic(lines_df, spark.createDataFrame(rules, "pattern_idx int, regex string, host_group int"), ["seq"])
    assert {(r["seq"], r["pattern_idx"], r["ip"]) for r in got.collect()} == want and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    many = spark.range(50_000).select(F.col("id").cast("int").alias("pattern_idx"), F.concat(F.lit("user w"), F.col("id").cast("string"), F.lit(f" from {host}")).alias("regex"), F.lit(1).alias("host_group"))
    few = spark.createDataFrame([(i, f"user w{i * 999} from 10.0.0.{i}") for i in range(60)], "seq int, line string")
    got = matching.match_dynamic(few, many, ["seq"]).collect()
    assert {(r["seq"], r["pattern_idx"], r["ip"]) for r in got} == {(i, i * 999, f"10.0.0.{i}") for i in range(60) if i * 999 < 50_000}
    assert matching.match_dynamic(few, many.limit(0), ["seq"]).count() == 0


def test_lines_for_a_rule_table_are_never_broadcast(spark, tmp_path):
    """A table of rules has no known size, a small file of lines has: Spark must not send the lines' words to all."""
    spark.range(60_000).select(F.col("id").alias("seq"), F.concat(F.lit("host sshd[1]: Failed password for me and many other words from 10.0.0."), F.col("id") % 200).alias("line")).coalesce(1).write.parquet(str(tmp_path / "lines"))
    lines_df = spark.read.parquet(str(tmp_path / "lines"))
    rules = spark.createDataFrame([(0, expand_host("Failed password for .* from <HOST>"), 1)], "pattern_idx int, regex string, host_group int")
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    try:
        for held in (matching.HELD_RULES, 0):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(matching, "HELD_RULES", held)
                assert matching.match_dynamic(lines_df, rules, ["seq"]).where("pattern_idx = 0 and ip is not null").count() == 60_000
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)


def test_rules_are_indexed_by_what_tells_them_apart(spark):
    """Equal expressions are one rule, and no key that all rules share takes them all."""
    host = expand_host("<HOST>").removeprefix("(?d)")
    own = [(100 + i, f": Failed password for user{i} from {host}", 1) for i in range(40)]
    same = [(i, f"user[0-9]*0 from {host}", 1) for i in (70, 60, 80)]
    rules = spark.createDataFrame(own + same, "pattern_idx int, regex string, host_group int")
    index = matching._rule_keys(rules).collect()
    assert [r["pattern_idx"] for r in index if "[0-9]*0" in r["regex"]] == [60] and len(index) == 41
    assert {r["key"] for r in index if r["pattern_idx"] >= 100} == {f"user{i}" for i in range(40)}
    lines_df = lines(spark, [f"sshd: Failed password for user{i} from 10.0.0.{i}" for i in range(40)])
    got = {(r["seq"], r["pattern_idx"]) for r in matching.match_dynamic(lines_df, rules, ["seq"]).collect()}
    assert got == {(i, 60 if i % 10 == 0 else 100 + i) for i in range(40)}
