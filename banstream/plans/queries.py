"""Registered queries: each operator over the log made of ``events``, or over the other given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.functions import addresses, bans as ban_times, rendering, times
from banstream.operators import allowlist, bans, failures, matching
from banstream.operators.patterns import expand_host, host_group_index
from banstream.operators.timeline import ban_rows, ban_timeline
from banstream.plans.lines import CLOSED, END, JAILS, NOW, QUIET, SSHD, address, catalog_lines, events_of, failures_of, log_lines, networks
from banstream.jails import jails_frame
from banstream.plans.dry_run import dry_run_log
from banstream.sources import logs, state
from banstream.sources.catalog import FILTERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ALLOWED = ("203.0.0.0/26", "203.0.1.16/29", "203.0.5.7")
DECAY = 3 * 86400


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures_of(log_lines(spark, sf_dir), JAILS)


def _bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third failure as a ban, every eleventh of all without an end."""
    until = F.when(F.col("seq") % 11 != 0, F.col("ts") + 3600 * (1 + F.col("seq") % 100))
    return _failures(spark, sf_dir).where("seq % 3 = 0").select("ip", "jail", F.col("ts").alias("banned_at"), until.alias("expires_at"))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table, for what reads them more than once."""
    path = state.work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bans, and the unbans of those that ended by ``NOW``."""
    b = _bans(spark, sf_dir)
    on = b.select(F.lit("ban").alias("action"), "ip", "jail", F.col("banned_at").alias("at"), "expires_at", (F.col("expires_at") - F.col("banned_at")).alias("ban_time"))
    off = bans.expired_bans(b, NOW).select(F.lit("unban").alias("action"), "ip", "jail", F.col("expires_at").alias("at"), F.lit(None).cast("long").alias("expires_at"), F.lit(None).cast("long").alias("ban_time"))
    return on.unionByName(off)


def _customer_jails(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """A jail per customer, of two configurations that differ in who is there and in some backends."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(F.col("c_custkey") % (5 if new else 1000) == 0, "iptables").otherwise("nftables")
    return c.select(
        F.concat(F.lit("jail-"), "c_custkey").alias("jail"),
        (F.col("c_custkey") % 7 != (0 if new else 1)).alias("enabled"),
        (F.col("c_custkey") % 4 != 0).alias("reban_on_restart"),
        F.struct(name.alias("name"), F.lit(None).cast("string").alias("ban_cmd"), F.lit(None).cast("string").alias("unban_cmd")).alias("backend"),
    )


def _customer_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir)
    return e.select(
        address(F.col("user_id")).alias("ip"),
        F.concat(F.lit("jail-"), F.col("event_id") % 2000).alias("jail"),
        F.lit(NOW).cast("long").alias("banned_at"),
        F.when(F.col("event_id") % 3 != 0, F.lit(NOW) + F.col("event_id") % 100 - 20).cast("long").alias("expires_at"),
    )


@query
def match_sshd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_lines(log_lines(spark, sf_dir), replace(SSHD, filter=FILTERS["sshd"].patterns)).select("seq", "ip", "ip_family", "ip_hex", "pattern_idx")


@query
def match_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_lines(log_lines(spark, sf_dir), replace(SSHD, filter=FILTERS["sshd"].patterns), extractor="positional")
    return found.select("seq", "ip", F.col("pattern_idx").cast("int").alias("pattern_idx"))


@query
def match_all_jails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_all(log_lines(spark, sf_dir), JAILS).select("jail", "seq", "ip", "pattern_idx")


@query
def match_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(i, expand_host(p), host_group_index(p)) for i, p in enumerate(FILTERS["sshd"].patterns)]
    table = spark.createDataFrame(rules, "pattern_idx int, regex string, host_group int")
    return matching.match_dynamic(log_lines(spark, sf_dir), table, ["seq"])


@query
def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = matching.route_lines(log_lines(spark, sf_dir), jails_frame(spark, JAILS))
    return routed.groupBy("jail").agg(F.count(F.lit(1)).alias("lines"), F.min("seq").alias("first_seq"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every user, of which one in ten needs no literal, behind the built-in ones."""
    built = spark.createDataFrame([(i, expand_host(p), host_group_index(p)) for i, p in enumerate(FILTERS["sshd"].patterns[2:])], "pattern_idx int, regex string, host_group int")
    user = events_of(spark, sf_dir).select(F.col("user_id").alias("u")).distinct()
    text = F.concat(F.lit(": Failed password for user"), F.col("u").cast("string"), F.lit(" from "))
    loose = F.concat(F.lit("user[0-9]*"), (F.col("u") % 10).cast("string"), F.lit(" from "))
    host = expand_host("<HOST>").removeprefix("(?d)")
    own = user.select((F.col("u") + 100).cast("int").alias("pattern_idx"), F.concat(F.when(F.col("u") % 10 == 0, loose).otherwise(text), F.lit(host)).alias("regex"), F.lit(1).alias("host_group"))
    return built.unionByName(own)


@query
def match_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are rows of a table made from the data: their literals are indexed, and lines meet them by words."""
    return matching.match_dynamic(log_lines(spark, sf_dir), _rules(spark, sf_dir), ["seq"])


@query
def log_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as four files, and where each line of them stands."""
    lines = logs.read_log_lines(spark, _log_files(spark, sf_dir))
    return lines.select(F.regexp_extract("source", "part=([0-9])", 1).cast("int").alias("part"), "seq", F.regexp_extract("line", r"\[([0-9]+)\]", 1).cast("long").alias("event_id"))


#: Each file is sorted in so many pieces.
PIECES = 32


def _pieces(lines: DataFrame) -> DataFrame:
    """(part, piece, value): the lines of four files in their order, a piece of a file in one task."""
    placed = lines.select((F.col("seq") % 4).alias("part"), (F.col("seq") * 7919 % 10007).alias("place"), "seq", F.col("line").alias("value"))
    cut = placed.withColumn("piece", F.floor(F.col("place") * PIECES / 10007).cast("int"))
    return cut.repartition(4 * PIECES, "part", "piece").sortWithinPartitions("part", "piece", "place", "seq").select("part", "piece", "value")


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """The log as four files in which dates go back and forth; sorted in pieces, whose bytes a task for each file then copies one after the other."""
    folder, pieces = state.work_folder(spark, "log"), state.work_folder(spark, "pieces")
    _pieces(log_lines(spark, sf_dir)).write.partitionBy("part", "piece").text(pieces)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for part in frame["id"]:
                (system, source), (_, target) = fs.FileSystem.from_uri(pieces), fs.FileSystem.from_uri(folder)
                own = f"{target}/part={part}"
                system.create_dir(own, recursive=True)
                draft = f"{own}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    for piece in range(PIECES):
                        found = system.get_file_info(fs.FileSelector(f"{source}/part={part}/piece={piece}", allow_not_found=True))
                        for path in sorted(f.path for f in found if f.base_name.startswith("part-")):
                            with system.open_input_stream(path) as read:
                                while chunk := read.read(1 << 20):
                                    out.write(chunk)
                system.move(draft, f"{own}/part-00000.txt")
            yield frame

    spark.range(0, 4, 1, 4).mapInPandas(join, "id long").write.format("noop").mode("overwrite").save()
    return folder


@query
def dry_run_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dry run over those files, failures in the order of their lines."""
    return dry_run_log(spark, _log_files(spark, sf_dir), JAILS)[1]


@query
def ignore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ignore_lines(log_lines(spark, sf_dir), (r"user\d*7 ", r"Accepted \w+ for")).select("seq", "line")


@query
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("line"))
    return matching.bound_lines(docs, 2000).select("doc_id", F.octet_length("line").alias("bytes"))


@query
def trim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat("text", F.lit(" \t ")).alias("line"))
    return matching.skip_blank(talk).select("conv_id", "turn", F.char_length(matching.trim_line(F.col("line"))).alias("chars"))


@query
def prefilter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.prefilter(log_lines(spark, sf_dir), FILTERS["sshd"].patterns[:2]).select("seq")


@query
def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pattern_hits(log_lines(spark, sf_dir), FILTERS["sshd"].patterns)


@query
def filter_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of the log every rule of the catalog finds, in one pass."""
    rules = list(FILTERS.values())
    patterns = [p for f in rules for p in f.patterns]
    hits = matching.pattern_hits(log_lines(spark, sf_dir), tuple(patterns))
    names = F.array(*[F.lit(f.name) for f in rules for _ in f.patterns])
    return hits.groupBy(F.element_at(names, F.col("pattern_idx") + 1).alias("filter")).agg(F.count(F.lit(1)).alias("patterns"), F.sum("hits").alias("hits"))


@query
def filter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines made from the catalog's patterns, with and without an address, each of its rules finds."""
    rules = list(FILTERS.values())
    hits = matching.pattern_hits(catalog_lines(spark, sf_dir), tuple(p for f in rules for p in f.patterns))
    names = F.array(*[F.lit(f.name) for f in rules for _ in f.patterns])
    return hits.groupBy(F.element_at(names, F.col("pattern_idx") + 1).alias("filter")).agg(F.sum("hits").alias("hits"))


@query
def ts_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).select("seq", times.ts_iso8601(F.col("line")).alias("ts"))


@query
def ts_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir, "common").select("seq", times.ts_common(F.col("line")).alias("ts"))


@query
def ts_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir, "epoch").select("seq", times.ts_epoch(F.col("line")).alias("ts"))


@query
def ts_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read on 2024-01-16: what is later in January belongs to the year before."""
    return log_lines(spark, sf_dir, "syslog").select("seq", times.ts_syslog(F.col("line"), F.lit(1_705_363_200)).alias("ts"))


@query
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "s", "m", "h", "d", "w", "x", " m")]), (F.col("event_id") % 8 + 1).cast("int"))
    return events_of(spark, sf_dir).select("event_id", times.parse_duration(F.concat(F.lit(" "), F.col("user_id").cast("string"), unit)).alias("seconds"))


@query
def ip_v4_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of which some are no addresses: octets over 255, zeros in front, ports, mapped addresses."""
    e = events_of(spark, sf_dir)
    n, kind = F.col("event_id"), F.col("event_id") % 5
    token = (
        F.when(kind == 0, F.format_string("10.%d.%d.1", F.floor(n / 4) % 300, n % 256))
        .when(kind == 1, F.format_string("10.0%d.3.4", n % 10))
        .when(kind == 2, F.format_string("::ffff:10.1.%d.%d", n % 256, n % 300))
        .when(kind == 3, F.format_string("10.1.2.%d:%d", n % 256, n))
        .otherwise(F.format_string("192.168.%d.%d", n % 256, F.floor(n / 256) % 256))
    )
    ip = addresses.parse_ip(token)
    return e.select("event_id", ip.alias("ip"), addresses.ip_hex(ip).alias("ip_hex"), addresses.strip_port(token).alias("without_port"))


@query
def ip_in_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _failures(spark, sf_dir)
    return f.select("seq", addresses.ip_in_net(F.col("ip"), "203.0.0.64/26").alias("inside"))


@query
def drop_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allowlist.drop_allowlisted(_failures(spark, sf_dir), ALLOWED).select("jail", "ip", "ts", "seq")


@query
def allowlist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = networks(spark, sf_dir).where("asn > 64400")
    return allowlist.drop_in_networks(_failures(spark, sf_dir), allowlist.network_ranges(nets)).select("jail", "ip", "ts", "seq")


@query
def geo_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = allowlist.network_ranges(networks(spark, sf_dir))
    return allowlist.enrich_geo(_kept(_bans(spark, sf_dir), "bans"), nets, ("asn", "country")).select("ip", "jail", "banned_at", "asn", "country")


@query
def asn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = allowlist.network_ranges(networks(spark, sf_dir))
    found = allowlist.enrich_geo(_bans(spark, sf_dir).select("ip").distinct(), nets, ("asn", "org"))
    return found.select("ip", rendering.asn_label(F.col("asn"), F.col("org")).alias("label"))


@query
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.failure_counts(_failures(spark, sf_dir))


@query
def threshold_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.threshold_hits(_failures(spark, sf_dir), JAILS).select("jail", "ip", "ts", "seq", "hit")


@query
def would_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.would_ban(_failures(spark, sf_dir), JAILS)


@query
def rolling_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.rolling_failures(_failures(spark, sf_dir), 86400).select("jail", "ip", "seq", "recent")


@query
def dry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.dry_run_summary(_failures(spark, sf_dir), JAILS)


@query
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.top_offenders(_failures(spark, sf_dir), JAILS)


@query
def stale_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.prune_stale_failures(_failures(spark, sf_dir), jails_frame(spark, JAILS), NOW)


@query
def suppress_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.suppress_banned(_failures(spark, sf_dir), _bans(spark, sf_dir)).select("jail", "ip", "ts", "seq")


@query
def label_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = failures.suppress_banned(_failures(spark, sf_dir), _bans(spark, sf_dir), label=True)
    return found.groupBy("jail", "ip", "banned").agg(F.count(F.lit(1)).alias("failures"))


@query
def failure_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = jails_frame(spark, [SSHD])
    return failures.with_params(_failures(spark, sf_dir), only).groupBy("jail", "max_retry").agg(F.count(F.lit(1)).alias("failures"))


@query
def failure_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.failure_rates(_failures(spark, sf_dir), "6 hours")


@query
def calc_ban_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_of(spark, sf_dir)
    n = F.col("event_id")
    steps = F.when(n % 3 == 0, F.array(*[F.lit(i) for i in (1, 5, 30)])).otherwise(F.array().cast("array<int>"))
    base = F.when(n % 10 == 0, -1).otherwise(60 + n % 5000)
    seconds = ban_times.calc_ban_time(base, n % 30, n % 4 != 0, 1.0 + (n % 5) / 2, steps, F.when(n % 6 == 0, 0).otherwise(604800))
    return e.select("event_id", seconds.alias("ban_time"), ban_times.ban_expiry(n, seconds).alias("expires_at"))


@query
def ban_timeline_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ban_rows(ban_timeline(_failures(spark, sf_dir), JAILS))


@query
def ban_timeline_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans and unbans, with counts that are forgotten after six quiet hours."""
    done = ban_timeline(_failures(spark, sf_dir), JAILS, decay=QUIET, until=END)
    return done.select("ip", "jail", "action", "at", "expires_at", "ban_time", "reason", "level", F.when(F.col("action") == "ban", F.col("event_seq")).alias("seq"))


@query
def ban_timeline_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All actions where logins in the log stand for commands: bans with and without a time, unbans, rollbacks, and a jail that nobody knows."""
    n = F.col("event_id")
    kind = F.when(n % 10 == 9, "ban").when(n % 3 == 0, "unban").when(n % 3 == 1, "ban").otherwise("apply_failed")
    jail = F.when(n % 10 == 9, "nowhere").when(n % 4 == 0, "sshd-closed").otherwise("sshd")
    commands = events_of(spark, sf_dir).where("event_type = 'view'").select(
        kind.alias("kind"), address(F.col("user_id")).alias("ip"), jail.alias("jail"), F.when(n % 2 == 0, 7200).cast("long").alias("ban_time"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), n.alias("seq")
    )
    done = ban_timeline(_failures(spark, sf_dir), JAILS, decay=QUIET, commands=commands, until=END)
    return done.select("ip", "jail", "action", "at", "expires_at", "ban_time", "reason", "level", F.col("event_seq").alias("seq"))


@query
def escalation_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.escalation_level(_bans(spark, sf_dir), DECAY).select("ip", "jail", "banned_at", F.col("level").cast("long").alias("level"))


@query
def latest_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.latest_ban(_bans(spark, sf_dir))


@query
def ban_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.ban_counts(_bans(spark, sf_dir))


@query
def decayed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.decayed_counts(bans.ban_counts(_bans(spark, sf_dir)), DECAY, NOW + 5 * 86400)


@query
def active_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.active_bans(_bans(spark, sf_dir), NOW)


@query
def expired_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.expired_bans(_bans(spark, sf_dir), NOW)


@query
def list_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.list_bans(_bans(spark, sf_dir), NOW)


@query
def next_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.next_expiry(bans.active_bans(_bans(spark, sf_dir), NOW))


@query
def jail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.jail_stats(_failures(spark, sf_dir), _actions(spark, sf_dir), jails_frame(spark, JAILS), NOW)


@query
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.global_stats(_failures(spark, sf_dir), _actions(spark, sf_dir), NOW - 1000, NOW)


@query
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bans(spark, sf_dir)
    return bans.reconcile(b, b.where("ip not like '%7'"))


@query
def reconcile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bans(spark, sf_dir)
    return bans.reconcile(b, b.where("ip not like '%7'"), limit=None)


@query
def diff_jails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.diff_jails(_customer_jails(spark, sf_dir, False), _customer_jails(spark, sf_dir, True))


@query
def restorable_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bans.restorable_bans(_customer_bans(spark, sf_dir), _customer_jails(spark, sf_dir, True), NOW)


@query
def restore_for_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = bans.diff_jails(_customer_jails(spark, sf_dir, False), _customer_jails(spark, sf_dir, True))
    return bans.restore_for_added(delta, _customer_bans(spark, sf_dir))


@query
def bans_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.bans_jsonl(_bans(spark, sf_dir))


@query
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.notifications(_actions(spark, sf_dir), jails_frame(spark, JAILS))


@query
def logfmt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = events_of(spark, sf_dir).select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("props"))
    return state.event_log(shown, "event seen", {"event_id": False, "event_type": True, "props": True})


@query
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "WARN", "INFO", "DEBUG", "TRACE", "OTHER")]), (F.col("event_id") % 6 + 1).cast("int"))
    return events_of(spark, sf_dir).groupBy(rendering.severity(level).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query
def render_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jail = F.when(F.col("seq") % 5 == 0, F.lit("bad; name")).otherwise(F.col("jail"))
    return _failures(spark, sf_dir).select("seq", "jail", rendering.render_action("block <IP> in <JAIL>", F.col("ip"), jail).alias("command"))


@query
def set_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bans(spark, sf_dir).select("ip", "jail", "banned_at", rendering.set_element(F.col("ip"), F.col("expires_at"), F.lit(NOW)).alias("element"))
