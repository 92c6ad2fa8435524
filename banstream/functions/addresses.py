"""IP addresses and networks as columns, without leaving the JVM.

An address has a canonical text, a family (4 or 6) and 32 hex digits in which both families compare by number;
IPv4 stands at the end of these, after zeros, and the family is always compared too.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from banstream.functions.columns import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_MAPPED = rf"(?i)^(?:(?:0{{1,4}}:){{5}}|:(?::0{{1,4}}){{0,4}}:|(?:0{{1,4}}:){{1,4}}:)ffff:({V4})$"
_H = r"[0-9a-fA-F]{1,4}"
# eight groups, or at most seven around one "::"
_V6 = rf"^(?:{_H}(?::{_H}){{7}}|(?!:*{_H}(?::+{_H}){{7}})(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?)$"

# the same with the last two groups written as IPv4: six groups before it, or at most five around "::"
_V6_4 = rf"^(?:{_H}(?::{_H}){{5}}:|(?!:*{_H}(?::+{_H}){{5}}:+{V4}$)(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*:)?){V4}$"


def is_ip(token: Column) -> Column:
    return token.rlike(rf"^{V4}$") | (token.contains(":") & (token.rlike(_V6) | token.rlike(_MAPPED) | token.rlike(_V6_4)))


def _in_hex(token: Column) -> Column:
    """An IPv6 text that ends in IPv4 with two groups of hex digits instead."""
    octets = F.transform(F.split(F.regexp_extract(token, r"([^:]*)$", 1), r"\."), lambda o: F.lpad(F.hex(o.try_cast("int")), 2, "0"))
    return F.concat(F.regexp_extract(token, "^(.*:)", 1), F.get(octets, 0), F.get(octets, 1), F.lit(":"), F.get(octets, 2), F.get(octets, 3))


def _groups(token: Column) -> Column:
    """The eight groups of an IPv6 text, four digits each."""
    none = F.array().cast("array<string>")
    part = lambda n: let(F.split_part(token, F.lit("::"), F.lit(n)), lambda t: F.when(t == "", none).otherwise(F.split(t, ":")))
    whole = let(F.struct(part(1).alias("a"), part(2).alias("b")), lambda p: F.concat(p["a"], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(p["a"]) - F.size(p["b"]), F.lit(0))), p["b"]))
    return F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0"))


def _compressed(full: Column) -> Column:
    """The first longest run of two or more zero groups as ``::``."""
    out = full
    for n in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
        out = F.when(full.rlike(run), F.regexp_replace(full, run, "$1::")).otherwise(out)
    return out


def _v6_text(groups: Column) -> Column:
    """Canonical text; mapped IPv4 as IPv4."""
    tail = F.array_join(F.slice(groups, 7, 2), "")
    dotted = F.array_join(F.array(*[F.conv(F.substring(tail, i, 2), 16, 10) for i in (1, 3, 5, 7)]), ".")
    plain = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")
    return F.when(F.array_join(F.slice(groups, 1, 6), "") == "0" * 20 + "ffff", dotted).otherwise(let(plain, _compressed))


def parse_ip(token: Column) -> Column:
    """Canonical text of an address; mapped IPv4 becomes IPv4, anything else NULL."""
    text = lambda t: F.when(t.rlike(_V6), t).when(t.rlike(_V6_4), _in_hex(t))
    six = let(let(token, text), lambda t: F.when(t.isNotNull(), let(_groups(t), _v6_text)))
    return F.when(token.rlike(rf"^{V4}$"), token).when(token.rlike(_MAPPED), F.regexp_extract(token, _MAPPED, 1)).when(token.contains(":"), six)


def ip_family(ip: Column) -> Column:
    return F.when(ip.contains(":"), 6).when(ip.isNotNull(), 4).cast("tinyint")


def ip_hex(ip: Column) -> Column:
    """32 hex digits of a canonical address."""
    octets = [F.lpad(F.lower(F.hex(F.split_part(ip, F.lit("."), F.lit(i)).try_cast("int"))), 2, "0") for i in range(1, 5)]
    return F.when(ip.contains(":"), F.array_join(_groups(ip), "")).when(ip.isNotNull(), F.lpad(F.concat(*octets), 32, "0"))


def strip_port(token: Column) -> Column:
    """The address of a token that may end with ports: what follows a last ``:`` is cut off until an address is left.

    An IPv4 or mapped address ends at its fourth octet, so all ports go at once. An IPv6 text is itself full of
    colons: of a longer text its longest beginning counts, of at most eight groups.
    """
    four = F.regexp_replace(token, rf"^((?:::[fF]{{4}}:)?{V4})(?::[^:]*)*$", "$1")
    cuts = lambda t: F.transform(F.sequence(F.lit(0), F.regexp_count(t, F.lit(":"))), lambda n: F.array_join(F.slice(F.split(t, ":"), F.lit(1), F.size(F.split(t, ":")) - n), ":"))
    six = let(token, lambda t: F.when(t.contains(":"), parse_ip(F.get(F.filter(cuts(t), is_ip), 0))))
    return F.coalesce(let(four, parse_ip), six)


def parse_cidr(text: str) -> tuple[int, str, str, int]:
    """A network, or an address as one: family, first and last address in hex, prefix length. Host bits may be set."""
    net = ipaddress.ip_network(text.strip(), strict=False)
    return net.version, f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}", net.prefixlen


def ip_in_net(ip: Column, net: str) -> Column:
    family, low, high, _ = parse_cidr(net)
    return (ip_family(ip) == family) & ip_hex(ip).between(low, high)


def local_networks(addresses: tuple[str, ...] = ()) -> list[str]:
    """Loopback, and the addresses that the caller names as its own."""
    return ["127.0.0.0/8", "::1/128", *addresses]
