"""Address ranges: allow-lists and geographic networks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.functions.addresses import ip_family, ip_hex, local_networks, parse_cidr, parse_ip
from banstream.functions.columns import once

#: Fewer ranges than this are a predicate, more are a join.
MOST_IN_PLAN = 200


def drop_allowlisted(failures: DataFrame, cidrs: Sequence[str], local: Sequence[str] = (), ignoreself: bool = True, only: Column | None = None) -> DataFrame:
    """Drop addresses inside any of the networks, loopback and the caller's own addresses.

    A row without an address stays, however long the list is; so do rows for which ``only`` does not hold.
    """
    nets = [parse_cidr(c) for c in (*cidrs, *(local_networks(tuple(local)) if ignoreself else ()))]
    if len(nets) > MOST_IN_PLAN:
        table = failures.sparkSession.createDataFrame(nets, "family tinyint, lo string, hi string, prefix int")
        return drop_in_networks(failures, table, only)
    keyed = once(failures, _family=ip_family(F.col("ip")), _hex=ip_hex(F.col("ip")))
    inside = F.lit(False)
    for fam, low, high, _ in nets:
        inside = inside | ((F.col("_family") == fam) & F.col("_hex").between(low, high))
    drop = F.coalesce(inside, F.lit(False)) if only is None else F.coalesce(only & inside, F.lit(False))
    return keyed.where(~drop).select(failures.columns)


def network_ranges(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Adds family, lo, hi and prefix of an IPv4 or IPv6 network; rows whose text is none are dropped."""
    names = networks.columns
    length = F.when(F.col(cidr).contains("/"), F.split_part(F.col(cidr), F.lit("/"), F.lit(2)).try_cast("int"))
    out = once(networks, _ip=parse_ip(F.split_part(F.col(cidr), F.lit("/"), F.lit(1))), _length=length, _whole=~F.col(cidr).contains("/")).where("_ip is not null")
    out = once(out, family=ip_family(F.col("_ip")), _hex=ip_hex(F.col("_ip")))
    width = F.when(F.col("family") == 4, 32).otherwise(128)
    out = once(out, prefix=F.when(F.col("_whole"), width).otherwise(F.col("_length"))).where((F.col("prefix") >= 0) & (F.col("prefix") <= width))
    out = out.withColumn("_bits", F.col("prefix") + F.when(F.col("family") == 4, 96).otherwise(0)).withColumn("_keep", F.floor(F.col("_bits") / 4).cast("int"))
    out = once(
        out, _step=F.pow(F.lit(2), 4 - F.col("_bits") % 4).cast("int"), _digit=F.conv(F.substring("_hex", F.col("_keep") + 1, F.lit(1)), 16, 10).cast("int"), _head=F.substring("_hex", F.lit(1), F.col("_keep"))
    ).withColumn("_low", F.col("_digit") - F.col("_digit") % F.col("_step"))
    whole = F.col("_bits") % 4 == 0
    low = F.when(whole, F.col("_head")).otherwise(F.concat("_head", F.lower(F.hex("_low"))))
    high = F.when(whole, F.col("_head")).otherwise(F.concat("_head", F.lower(F.hex(F.col("_low") + F.col("_step") - 1))))
    return out.select(*names, "family", F.rpad(low, 32, "0").alias("lo"), F.rpad(high, 32, "f").alias("hi"), "prefix")


def _cut(digits: str, family: int, length: int) -> Column:
    """The hex digits of an address with all bits after the first ``length`` of its family set to 0."""
    bits = length + (96 if family == 4 else 0)
    whole, rest = divmod(bits, 4)
    head = F.substring(digits, 1, whole)
    if rest:
        step = 1 << (4 - rest)
        digit = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int")
        head = F.concat(head, F.lower(F.hex(digit - digit % step)))
    return F.rpad(head, 32, "0")


#: Hex digits of an address that name its bucket: a /16 of IPv4, a /48 of IPv6.
BUCKET = {4: 28, 6: 12}


def _holders(rows: DataFrame, digits: str, nets: DataFrame, lengths: Sequence[tuple[int, int]], shorter: Column | None = None) -> DataFrame:
    """The most specific network that holds each row (family, ``digits``) with one of some prefix lengths, as ``holder``; rows without one are left out."""
    keys = [F.when((F.col("family") == fam) & (F.lit(True) if shorter is None else F.lit(n) < shorter), F.struct(F.lit(n).alias("prefix"), _cut(digits, fam, n).alias("lo"))) for fam, n in lengths]
    spread = rows.withColumn("_k", F.explode(F.array_compact(F.array(*keys)))).select(*rows.columns, F.col("_k.prefix").alias("_prefix"), F.col("_k.lo").alias("_lo"))
    own = nets.select(F.col("family").alias("_family"), F.col("prefix").alias("_net"), F.col("lo").alias("_start"))
    found = spread.join(own, (F.col("family") == F.col("_family")) & (F.col("_prefix") == F.col("_net")) & (F.col("_lo") == F.col("_start")))
    return found.groupBy(*rows.columns).agg(F.max_by(F.struct(F.col("_prefix").alias("prefix"), F.col("_lo").alias("lo")), "_prefix").alias("holder"))


def innermost(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, family, prefix, lo): the most specific network (family, lo, hi, prefix) that holds each address of (ip), for those that have one.

    Networks lie in each other or apart, so they cut the addresses into ranges that each have one innermost network:
    it changes to a network where that starts, and back to the one around it where it ends. Starts, ends and addresses
    of a bucket are sorted together, and an address takes what was said last before it: one row for each address.
    Networks wider than a bucket neither start nor end in one; the innermost of these is looked up once for each
    bucket. Only the prefix lengths in use, 162 at most, come to the driver.
    """
    nets = ranges.select("family", "prefix", "lo", "hi").distinct()
    lengths = sorted((r["family"], r["prefix"]) for r in nets.select("family", "prefix").distinct().collect())
    own = once(addresses.select("ip").where("ip is not null").distinct(), family=ip_family(F.col("ip")), _hex=ip_hex(F.col("ip")))
    wide = [(f, n) for f, n in lengths if n + (96 if f == 4 else 0) <= 4 * BUCKET[f]]
    narrow = [x for x in lengths if x not in wide]
    digits = lambda c: F.when(F.col("family") == 4, F.substring(c, 1, BUCKET[4])).otherwise(F.substring(c, 1, BUCKET[6]))
    net = "struct<prefix: int, lo: string>"
    none = F.lit(None).cast(net)
    at = own.select("family", digits("_hex").alias("bucket"), F.col("_hex").alias("key"), F.lit(500).alias("turn"), "ip", F.lit(None).cast(f"struct<net: {net}>").alias("change"), none.alias("around"))
    parts = [at]
    if narrow:
        small = nets.where((F.col("prefix") + F.when(F.col("family") == 4, 96).otherwise(0)) > F.when(F.col("family") == 4, 4 * BUCKET[4]).otherwise(4 * BUCKET[6]))
        outer = _holders(small, "lo", small, narrow, F.col("prefix")).select("family", "prefix", "lo", "holder")
        known = small.join(outer, ["family", "prefix", "lo"], "left")
        # of what starts at one place the inner comes last, of what ends there the outer
        start = F.struct(F.col("lo").alias("key"), F.col("prefix").alias("turn"), F.struct(F.struct("prefix", "lo").cast(net).alias("net")).alias("change"))
        end = F.struct(F.concat("hi", F.lit("g")).alias("key"), (F.lit(1000) - F.col("prefix")).alias("turn"), F.struct(F.col("holder").cast(net).alias("net")).alias("change"))
        parts.append(known.select("family", digits("lo").alias("bucket"), F.inline(F.array(start, end))).select("family", "bucket", "key", "turn", F.lit(None).cast("string").alias("ip"), "change", none.alias("around")))
    if wide:
        buckets = at.select("family", "bucket").distinct().withColumn("_all", F.rpad("bucket", 32, "0"))
        seeds = _holders(buckets, "_all", nets, wide)
        parts.append(seeds.select("family", "bucket", F.lit("").alias("key"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("ip"), F.lit(None).cast(f"struct<net: {net}>").alias("change"), F.col("holder").cast(net).alias("around")))
    so_far = Window.partitionBy("family", "bucket").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = reduce(DataFrame.unionByName, parts).withColumns({"_last": F.last("change", ignorenulls=True).over(so_far), "_seed": F.last("around", ignorenulls=True).over(so_far)})
    found = swept.where("ip is not null").select("ip", "family", F.coalesce("_last.net", "_seed").alias("n"))
    return found.where("n is not null").select("ip", "family", "n.prefix", "n.lo")


def drop_in_networks(failures: DataFrame, ranges: DataFrame, only: Column | None = None) -> DataFrame:
    """Drop addresses inside any range of a table (family, lo, hi, prefix) of any size; rows without an address stay."""
    held = innermost(failures, ranges).select(F.col("ip").alias("_held"))
    same = F.col("ip") == F.col("_held")
    return failures.join(held, same if only is None else same & only, "left_anti").select(failures.columns)


def enrich_geo(bans: DataFrame, networks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds the named attributes of the most specific network that holds each address; NULL without one.

    ``networks`` has family, lo, prefix and the attributes; of a network given twice the least attributes count.
    """
    best = innermost(bans, networks)
    known = networks.groupBy("family", "prefix", "lo").agg(F.min(F.struct(*fields)).alias("f")).select("family", "prefix", "lo", "f.*")
    return bans.join(best.join(known, ["family", "prefix", "lo"]).select("ip", *fields), "ip", "left")
