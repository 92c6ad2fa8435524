"""Jails: the rules, thresholds and ban times of one service."""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from banstream.functions.addresses import parse_cidr
from banstream.functions.rendering import SAFE_NAME
from banstream.operators.patterns import expand_host

DATE_FORMATS = ("syslog", "iso8601", "epoch", "common")
GEO_FIELDS = ("asn", "country", "city")
#: Escalation counts are forgotten after so many quiet seconds.
DEFAULT_DECAY = 30 * 86400

SCHEMA = (
    "jail string, enabled boolean, log_path string, date_format string, filter array<string>, max_retry int, find_time long, ban_time long, "
    "port array<string>, protocol string, bantime_increment boolean, bantime_factor double, bantime_multipliers array<int>, bantime_maxtime long, "
    "log_backend string, journalmatch array<string>, backend struct<name: string, ban_cmd: string, unban_cmd: string>, ignoreregex array<string>, "
    "ignoreip array<string>, ignoreself boolean, reban_on_restart boolean, webhook string, maxmind array<string>"
)


@dataclass(frozen=True)
class Backend:
    """How bans are applied: a known firewall by name, or command templates."""

    name: str = "nftables"
    ban_cmd: str | None = None
    unban_cmd: str | None = None


@dataclass(frozen=True)
class Jail:
    """A detection rule set. Durations are seconds, a ban time of -1 is permanent. Raises ValueError for what can't work."""

    jail: str
    filter: tuple[str, ...]
    enabled: bool = True
    log_path: str = ""
    date_format: str = "syslog"
    max_retry: int = 5
    find_time: int = 600
    ban_time: int = 3600
    port: tuple[str, ...] = ()
    protocol: str = "tcp"
    bantime_increment: bool = False
    bantime_factor: float = 1.0
    bantime_multipliers: tuple[int, ...] = ()
    bantime_maxtime: int = 604_800
    log_backend: str = "file"
    journalmatch: tuple[str, ...] = ()
    backend: Backend = field(default_factory=Backend)
    ignoreregex: tuple[str, ...] = ()
    ignoreip: tuple[str, ...] = ()
    ignoreself: bool = True
    reban_on_restart: bool = True
    webhook: str | None = None
    maxmind: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        wrong = [
            (not re.match(SAFE_NAME, self.jail), "name must have 1 to 64 letters, digits, - or _"),
            (not self.filter, "needs a pattern"),
            (self.date_format not in DATE_FORMATS, f"unknown date format {self.date_format}"),
            (self.max_retry <= 0, "max_retry must be positive"),
            (self.find_time <= 0, "find_time must be positive"),
            (self.ban_time <= 0 and self.ban_time != -1, "ban_time must be positive or -1"),
            (self.bantime_maxtime <= 0, "bantime_maxtime must be positive"),
            (any(m == 0 for m in self.bantime_multipliers), "multipliers must not be 0"),
            (not (math.isfinite(self.bantime_factor) and self.bantime_factor > 0), "bantime_factor must be finite and positive"),
            (self.log_backend not in ("file", "systemd"), f"unknown log backend {self.log_backend}"),
            (self.webhook is not None and not re.match("https?://", self.webhook), "webhook must be http or https"),
            (not set(self.maxmind) <= set(GEO_FIELDS), "maxmind takes asn, country, city"),
        ]
        for bad, why in wrong:
            if bad:
                raise ValueError(f"jail {self.jail!r}: {why}")
        for pattern in self.filter:
            re.compile(expand_host(pattern).removeprefix("(?d)"))
        for pattern in self.ignoreregex:
            re.compile(pattern)
        for net in self.ignoreip:
            parse_cidr(net)


def jails_frame(spark: SparkSession, jails: list[Jail]) -> DataFrame:
    """Jails as a table of their fields."""
    names = [part.split()[0] for part in re.split(r", (?![^<]*>)", SCHEMA)]
    rows = [tuple((v if not isinstance(v := asdict(j)[n], tuple) else list(v)) for n in names) for j in jails]
    return spark.createDataFrame(rows, SCHEMA)


def enabled_jails(jails: DataFrame) -> DataFrame:
    return jails.where("enabled")
