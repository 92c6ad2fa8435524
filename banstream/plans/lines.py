"""Log lines, failures and networks made of the event and nation tables: a deterministic log for queries and tests."""

from __future__ import annotations

from collections.abc import Sequence
from re import _parser  # the expression as a tree; there is no public way to it

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.jails import Backend, Jail
from banstream.operators.matching import jail_ts, match_jails
from banstream.operators.patterns import TAG
from banstream.sources.catalog import FILTERS

_SSHD = FILTERS["sshd"].patterns
_BAN = {"date_format": "iso8601", "log_path": "auth.log", "max_retry": 3, "find_time": 86400, "ban_time": 43200, "bantime_increment": True}
#: Failed logins and unknown users; and connections that close while they log in.
SSHD = Jail("sshd", _SSHD[:2], webhook="https://hooks.example.com/sshd", maxmind=("asn", "country"), **_BAN)
CLOSED = Jail("sshd-closed", _SSHD[2:], backend=Backend("script", "block <IP> <JAIL>", "free <IP> <JAIL>"), reban_on_restart=False, **_BAN)
OFF = Jail("nginx", FILTERS["nginx-auth"].patterns, enabled=False)
JAILS = [SSHD, CLOSED, OFF]
NOW = 1_706_000_000
#: After the last line; and the quiet time after which the timelines of all actions forget an address's bans.
END = 1_708_000_000
QUIET = 6 * 3600
#: The log is cut here where it comes in three parts.
CUTS = (1_704_900_000, 1_705_800_000)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def address(user: Column) -> Column:
    """An address of its own for every user: 203.0.0.0/8 for the first 16,777,216, and IPv6 for the rest."""
    octets = [(F.shiftright(user.cast("long"), bits) % 256).cast("string") for bits in (16, 8, 0)]
    groups = [F.shiftright(user.cast("long"), bits) % 65536 for bits in (48, 32, 16, 0)]
    return F.when(user >= 1 << 24, F.format_string("2001:db8:1:1:%x:%x:%x:%x", *groups)).otherwise(F.concat_ws(".", F.lit("203"), *octets))


def log_lines(spark: SparkSession, sf_dir: str, prefix: str = "iso8601") -> DataFrame:
    """(source, line, seq), a line per event, with the date in the named format."""
    e = events_of(spark, sf_dir)
    ip, port = address(F.col("user_id")), (1024 + F.col("event_id") % 60000).cast("string")
    stamps = {
        "iso8601": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z web1 '"),
        "common": F.date_format("ts", "'web1 ['dd/MMM/yyyy:HH:mm:ss' +0200] '"),
        "epoch": F.concat(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit(" web1 ")),
        "syslog": F.date_format("ts", "MMM d HH:mm:ss' web1 '"),
    }
    kind, pid, user = F.col("event_type"), F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]: ")), F.col("user_id").cast("string")
    text = (
        F.when(kind == "error", F.concat(F.lit("Failed password for user"), user, F.lit(" from "), ip, F.lit(" port "), port, F.lit(" ssh2")))
        .when(kind == "click", F.concat(F.lit("Invalid user u"), user, F.lit(" from "), ip, F.lit(" port "), port))
        .when(kind == "signup", F.concat(F.lit("Connection closed by authenticating user root "), ip, F.lit(" port "), port, F.lit(" [preauth]")))
        .when(kind == "view", F.concat(F.lit("Accepted publickey for user"), user, F.lit(" from "), ip, F.lit(" port 22 ssh2")))
        .otherwise(F.concat(F.lit("pam_unix(cron:session): session opened for user root from "), ip))
    )
    body = F.concat(F.when(kind.isin("error", "click", "signup", "view"), F.lit("sshd")).otherwise(F.lit("CRON")), pid, text)
    # a generator keeps Spark from putting the text's expression in place of the line in every condition on it
    return e.select(F.lit("auth.log").alias("source"), F.explode(F.array(F.concat(stamps[prefix], body))).alias("line"), F.col("event_id").alias("seq"))


_ANY = "x7A-_./:=@ ,;'\"()[]<>"
_HERE = "\ue000"


def sample(pattern: str, host: str) -> str:
    """A short text that a pattern matches, with this host; made from the parsed pattern, repeats as often as they must."""

    def one(of: list) -> str:
        inside = {_parser.CATEGORY_DIGIT: str.isdigit, _parser.CATEGORY_SPACE: str.isspace, _parser.CATEGORY_WORD: lambda c: c.isalnum() or c == "_"}
        outside = {_parser.CATEGORY_NOT_DIGIT: _parser.CATEGORY_DIGIT, _parser.CATEGORY_NOT_SPACE: _parser.CATEGORY_SPACE, _parser.CATEGORY_NOT_WORD: _parser.CATEGORY_WORD}

        def holds(kind, value, c: str) -> bool:
            if kind is _parser.LITERAL:
                return ord(c) == value
            if kind is _parser.RANGE:
                return value[0] <= ord(c) <= value[1]
            return not inside[outside[value]](c) if value in outside else inside[value](c)

        negated = of[0][0] is _parser.NEGATE
        items = of[negated:]
        starts = [chr(v if k is _parser.LITERAL else v[0]) for k, v in items if k in (_parser.LITERAL, _parser.RANGE)]
        return next(c for c in [*_ANY, *starts] if any(holds(k, v, c) for k, v in items) != negated)

    def text(items) -> str:
        out = ""
        for kind, value in items:
            if kind is _parser.LITERAL:
                out += chr(value)
            elif kind is _parser.ANY:
                out += "x"
            elif kind is _parser.NOT_LITERAL:
                out += next(c for c in _ANY if ord(c) != value)
            elif kind is _parser.IN:
                out += one(value)
            elif kind is _parser.SUBPATTERN:
                out += text(value[-1])
            elif kind is _parser.BRANCH:
                out += text(value[1][0])
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
                out += text(value[2]) * value[0]
        return out

    return text(_parser.parse(pattern.replace(TAG, _HERE))).replace(_HERE, host)


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line), for every event a line by one of the catalog's patterns in turn; every other time round without an address in it."""
    patterns = [p for f in FILTERS.values() for p in f.patterns]
    texts = spark.createDataFrame([(i, sample(p, _HERE)) for i, p in enumerate(patterns)], "i long, text string")
    e = events_of(spark, sf_dir).select(F.col("event_id").alias("seq"), address(F.col("user_id")).alias("ip"), (F.col("event_id") % len(patterns)).alias("i"), (F.floor(F.col("event_id") / len(patterns)) % 2).alias("odd"))
    host = F.when(F.col("odd") == 0, F.col("ip")).otherwise("nowhere")
    return e.join(F.broadcast(texts), "i").select("seq", F.explode(F.array(F.replace("text", F.lit(_HERE), host))).alias("line"))


def failures_of(lines: DataFrame, jails: Sequence[Jail], *more: str) -> DataFrame:
    """(jail, ip, ts, seq) of lines, for all enabled jails in one scan; ``more`` names further columns to keep."""
    own = [j for j in jails if j.enabled]
    return match_jails(lines, own).select("jail", "ip", jail_ts(own).alias("ts"), "seq", *more)


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic networks: one of each nation, from /27 to /29, and wider ones around and beside them."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    own = n.select(
        F.format_string("203.0.%d.%d/%d", F.floor(F.col("n_nationkey") / 8), F.col("n_nationkey") % 8 * 32, 29 - F.col("n_nationkey") % 3).alias("cidr"),
        (64500 + F.col("n_nationkey")).cast("int").alias("asn"),
        F.concat(F.lit("Net "), "n_name").alias("org"),
        F.col("n_name").alias("country"),
    )
    wide = spark.createDataFrame([("203.0.0.0/16", 64400, None, "WIDE"), ("203.0.4.0/22", 64401, "Middle", None), ("2001:db8::/32", 64402, "Six", "SIX")], own.schema)
    return own.unionByName(wide)
