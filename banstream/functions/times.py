"""Durations and log dates. All dates become epoch seconds; what can't be read becomes NULL."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from banstream.functions.columns import let

#: Seconds of each duration suffix.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
MONTHS = {name: i for i, name in enumerate(calendar.month_abbr) if name}

_SYSLOG = r"(?d)([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
_EPOCH = r"(?d)(\d{10,})"
_COMMON = r"(?d)(\d{2})/([A-Z][a-z]{2})/(\d{4}):(\d{2}):(\d{2}):(\d{2})(?:\s+([+-]\d{4}))?"
# a structural hit without digits ends the search; one that is out of range is passed over
_ISO_RANGE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d"
_ISO_SHAPE = r"[\s\S]{4}-[\s\S]{2}-[\s\S]{2}[T ][\s\S]{2}:[\s\S]{2}:[\s\S]{2}"
_ISO_DIGITS = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_ISO = rf"^(?:(?!{_ISO_SHAPE})[\s\S]|(?={_ISO_DIGITS})(?!{_ISO_RANGE})[\s\S])*?({_ISO_RANGE}(?:\.\d*)?(?:[+-]\d{{2}}(?::?\d{{2}})?)?)"
_ISO_ZONE = r"^.{19}(?:\.\d*)?([+-])(\d{2})(?::?(\d{2}))?$"


def parse_duration(text: Column) -> Column:
    """``10m``, ``1h``, ``7d``, ``1w`` or plain seconds, as seconds; NULL for anything else."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long"))
    value = F.regexp_extract(trimmed, r"^([+-]?\d+)\s*[smhdw]$", 1).try_cast("long")
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.regexp_extract(trimmed, r"([smhdw])$", 1)).cast("long")
    return F.coalesce(plain, F.try_multiply(value, unit))


def month_num(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), name)


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 by arithmetic; days beyond a month's end run on into the next."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((F.when(month > 2, month - 3).otherwise(month + 9) * 153 + 2) / 5) + day - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _part(line: Column, pattern: str, group: int, kind: str = "int") -> Column:
    return F.regexp_extract(line, pattern, group).try_cast(kind)


def _seconds(naive: Column) -> Column:
    """Epoch seconds of a timestamp without zone, read as UTC."""
    return F.unix_timestamp(naive.cast("timestamp"))


def ts_iso8601(line: Column) -> Column:
    """The first ``yyyy-MM-dd[T ]HH:mm:ss`` in range; fractions are skipped, an offset is applied, else UTC.

    A line that begins with one in UTC is read by its places alone.
    """
    number = lambda text, at, n: F.substring(text, at, n).try_cast("int")
    clock = lambda text: number(text, 12, 2) * 3600 + number(text, 15, 2) * 60 + number(text, 18, 2)
    first = F.unix_date(F.make_date(number(line, 1, 4), number(line, 6, 2), F.lit(1))) + number(line, 9, 2) - 1

    def anywhere(text: Column) -> Column:
        part = lambda group: F.regexp_extract(text, _ISO_ZONE, group)
        offset = part(2).try_cast("int") * 3600 + F.coalesce(part(3).try_cast("int"), F.lit(0)) * 60
        zone = F.coalesce(F.when(part(1) == "-", -offset).otherwise(offset), F.lit(0))
        days = days_from_civil(number(text, 1, 4), number(text, 6, 2), number(text, 9, 2))
        return F.when(text != "", (days * 86400 + clock(text) - zone).cast("long"))

    plain = line.rlike(rf"^{_ISO_RANGE}(?![.+-])")
    return F.when(plain, first.cast("long") * 86400 + clock(line)).otherwise(let(F.regexp_extract(line, _ISO, 1), anywhere))


def ts_epoch(line: Column) -> Column:
    """The first run of ten or more digits, as seconds."""
    return F.regexp_extract(line, _EPOCH, 1).try_cast("long")


def _naive(year: Column, month: Column, day: Column, line: Column, pattern: str, first: int) -> Column:
    h, m, s = (_part(line, pattern, first + i) for i in range(3))
    # second 60 would roll over: only 0 to 59 are taken
    return F.when(s <= 59, F.try_make_timestamp_ntz(year, month, day, h, m, s.cast("decimal(8,6)")))


def ts_common(line: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss`` with an optional ``+HHMM``."""

    def read(text: Column) -> Column:
        stamp = _naive(_part(text, _COMMON, 3), month_num(F.regexp_extract(text, _COMMON, 2)), _part(text, _COMMON, 1), text, _COMMON, 4)
        zone = F.regexp_extract(text, _COMMON, 7)
        minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
        offset = F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes) * 60
        return F.when(text != "", F.unix_timestamp(F.to_utc_timestamp(stamp, "UTC")) - F.coalesce(offset, F.lit(0)))

    return let(F.regexp_extract(line, _COMMON, 0), read)


def ts_syslog(line: Column, ref_ts: Column, tz: str = "UTC") -> Column:
    """``Mon d HH:mm:ss`` in the year of ``ref_ts``, or the year before if that is over a day later.

    Times that a zone has twice or not at all are read as UTC.
    """

    def at(text: Column, year: Column) -> Column:
        naive = _naive(year, month_num(F.regexp_extract(text, _SYSLOG, 1)), _part(text, _SYSLOG, 2), text, _SYSLOG, 3)

        def placed(local: Column) -> Column:
            utc = F.to_utc_timestamp(local, tz)
            back = lambda minutes: F.from_utc_timestamp(utc + F.make_dt_interval(mins=F.lit(minutes)), tz) == local
            odd = ~back(0) | back(60) | back(-60) | back(30) | back(-30)
            return F.unix_timestamp(F.when(odd, local).otherwise(utc))

        return let(naive.cast("timestamp"), placed)

    year = F.year(F.from_utc_timestamp(F.timestamp_seconds(ref_ts), tz))
    dated = lambda text: let(at(text, year), lambda this: F.when(this > ref_ts + 86400, at(text, year - 1)).otherwise(this))
    return let(F.regexp_extract(line, _SYSLOG, 0), lambda text: F.when(text != "", dated(text)))


def line_ts(line: Column, fmt: str, *, ref_ts: Column | None = None, tz: str = "UTC", default: Column | None = None) -> Column:
    """The date of a line by the format's name; ``default`` where there is none."""
    now = ref_ts if ref_ts is not None else F.unix_timestamp()
    by_name = {"iso8601": lambda: ts_iso8601(line), "epoch": lambda: ts_epoch(line), "common": lambda: ts_common(line), "syslog": lambda: ts_syslog(line, now, tz)}
    if fmt not in by_name:
        raise ValueError(f"unknown date format: {fmt}")
    found = by_name[fmt]()
    return found if default is None else F.coalesce(found, default)
