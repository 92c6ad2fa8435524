"""Texts for reports, logs and firewall commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Syslog priorities of log levels.
SEVERITIES = {"ERROR": 3, "WARN": 4, "INFO": 5, "DEBUG": 6, "TRACE": 7}
SAFE_NAME = r"^[A-Za-z0-9_-]{1,64}$"


def format_relative(secs: Column) -> Column:
    """What is left of a ban; NULL is a permanent one."""
    hours, minutes = F.floor(secs / 3600), F.floor(secs % 3600 / 60)
    some = F.when(hours > 0, F.format_string("%dh %dm remaining", hours, minutes)).otherwise(F.format_string("%dm remaining", minutes))
    return F.when(secs.isNull(), "permanent").when(secs <= 0, "expired").otherwise(some)


def format_banned_at(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "dd MMM HH:mm")


def logfmt_value(text: Column) -> Column:
    """A value as logfmt writes it: quoted if empty or with a space, quote, line feed or equals sign."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(text.rlike(r'^$|[ "\n=]'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)


def logfmt(message: Column, fields: dict[str, tuple[Column, bool]]) -> Column:
    """``message k=v ...``; for each field its column and whether it is text. NULL is written as null."""
    value = lambda c, text: F.coalesce(logfmt_value(c) if text else c.cast("string"), F.lit("null"))
    return F.concat_ws(" ", message, *[F.concat(F.lit(f"{k}="), value(c, text)) for k, (c, text) in fields.items()])


def severity(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), level)


def asn_label(number: Column, org: Column) -> Column:
    return F.when(number.isNotNull() & org.isNotNull(), F.format_string("AS%d (%s)", number, org)).when(number.isNotNull(), F.format_string("AS%d", number)).otherwise(org)


def render_action(template: Column | str, ip: Column, jail: Column) -> Column:
    """A command text; NULL for a jail whose name could do harm in a shell. It is data and never run here."""
    text = F.lit(template) if isinstance(template, str) else template
    return F.when(jail.rlike(SAFE_NAME), F.replace(F.replace(text, F.lit("<IP>"), ip), F.lit("<JAIL>"), jail))


def set_element(ip: Column, expires_at: Column, now: Column) -> Column:
    """An element of a firewall set, with its time-out (a second at least) unless permanent."""
    left = F.greatest(expires_at - now, F.lit(1))
    return F.when(expires_at.isNull(), F.format_string("{ %s }", ip)).otherwise(F.format_string("{ %s timeout %ds }", ip, left))


def is_http_url(url: Column) -> Column:
    return url.rlike("^https?://")


def verdict(count: Column, max_retry: Column, would_ban: Column, find_time: Column) -> Column:
    return (
        F.when(would_ban, "WOULD BAN")
        .when(count < max_retry, F.format_string("%d more to ban", max_retry - count))
        .otherwise(F.format_string("spread beyond %ds window", find_time))
    )
