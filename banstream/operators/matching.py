"""Lines to failures: which pattern matches, and which address it names."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banstream.functions.addresses import ip_family, ip_hex, is_ip, parse_ip, strip_port
from banstream.functions.columns import once
from banstream.functions.times import line_ts
from banstream.jails import Jail
from banstream.operators.patterns import GRAM, NO_WORD, expand_host, guards, host_extractor, host_group_index, index_choices, literal_prefix
from banstream.sources.state import work_folder

MAX_LINE_BYTES = 65536
#: Parts of the lines that rules without a literal are copied to.
SHARES = 64
#: Bytes of rules that every task holds; and keys of rules, by their hashes. More meet the lines by a shuffle.
HELD_RULES = 8 << 20
HELD_KEYS = 2_000_000


def bound_lines(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES, line: str = "line") -> DataFrame:
    """Drop lines over the limit; a cut line could name a wrong address."""
    return lines.where(F.octet_length(line) <= max_bytes)


def repair_utf8(text: Column) -> Column:
    """Bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(text)


def trim_line(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+$", "")


def skip_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(trim_line(F.col(line)) != "")


def _guarded(pattern: str, line: str) -> Column:
    """Whether a line can match at all: it holds a literal that matches need."""
    hit = F.lit(False)
    for text in guards(pattern) or ():
        hit = hit | F.col(line).contains(text)
    return hit if guards(pattern) else F.lit(True)


def prefilter(lines: DataFrame, patterns: tuple[str, ...], line: str = "line") -> DataFrame:
    """Lines that hold a literal which some pattern requires; all lines if a pattern requires none."""
    literals = [guards(p) for p in patterns]
    if not literals or None in literals:
        return lines
    hit = F.lit(False)
    for text in sorted({text for own in literals for text in own}):
        hit = hit | F.col(line).contains(text)
    return lines.where(hit)


def ignore_lines(lines: DataFrame, patterns: tuple[str, ...], line: str = "line") -> DataFrame:
    """Drop the lines that one of these patterns finds."""
    for pattern in patterns:
        lines = lines.where(~F.col(line).rlike(f"(?d){pattern}"))
    return lines


def match_lines(lines: DataFrame, jail: Jail, line: str = "line", extractor: str = "capture") -> DataFrame:
    """The lines with a failure: adds ip, ip_family, ip_hex and pattern_idx.

    The first pattern counts that matches and names a valid address. ``capture`` takes the address from the
    pattern's host group; ``positional`` looks for it in the matched text, as older tools do, in the order of the
    literals found.
    """
    if extractor == "positional":
        return _with_address(_positional(ignore_lines(lines, jail.ignoreregex, line), jail.filter, line))
    return match_jails(lines, [jail], line).drop("jail")


def match_jails(lines: DataFrame, jails: Sequence[Jail], line: str = "line", routed: bool = False) -> DataFrame:
    """The failures of several jails in one pass over the lines: adds jail, ip, ip_family, ip_hex and pattern_idx.

    A line gives at most one failure for each jail. ``routed``: a jail takes only the lines whose ``source`` is its
    log_path.
    """
    rules = [(j, i, p) for j in jails for i, p in enumerate(j.filter)]
    likely = prefilter(lines, tuple(p for _, _, p in rules), line)
    hits = _few_rules(likely, rules, line, routed) if len(rules) <= TOGETHER else _many_rules(likely, rules, line, routed)
    matched = hits.where("_hit is not null")
    own = {"jail": F.col("_hit.jail"), "ip": parse_ip(F.col("_hit.token")), "pattern_idx": F.col("_hit.pattern_idx")}
    return _with_address(matched.select(*[c for c in lines.columns if c not in own], *[c.alias(n) for n, c in own.items()]))


Rule = tuple[Jail, int, str]
#: Rules up to this many are compiled to one piece of code, in which each has a column; more are tried by number.
TOGETHER = 16


def _host(pattern: str, line: str) -> Column:
    return F.regexp_extract(line, expand_host(pattern), host_group_index(pattern))


def _heeds(jail: Jail, line: str, routed: bool) -> Column:
    """Whether a line is the jail's: it stands in the jail's log and the jail does not ignore it."""
    good = F.col("source") == jail.log_path if routed else F.lit(True)
    for ignored in jail.ignoreregex:
        good = good & ~F.col(line).rlike(f"(?d){ignored}")
    return good


def _few_rules(lines: DataFrame, rules: Sequence[Rule], line: str, routed: bool) -> DataFrame:
    """Adds _hit (jail, token, pattern_idx), a row for every jail."""
    patterns = list(dict.fromkeys(p for _, _, p in rules))
    cut = once(lines, **{f"_t{i}": F.when(_guarded(p, line), _host(p, line)) for i, p in enumerate(patterns)})
    hits = []
    for jail in dict.fromkeys(j for j, _, _ in rules):
        token = lambda p: F.col(f"_t{patterns.index(p)}")
        own = [F.when(is_ip(token(p)), F.struct(F.lit(jail.jail).alias("jail"), token(p).alias("token"), F.lit(i).alias("pattern_idx"))) for j, i, p in rules if j == jail]
        hits.append(F.when(_heeds(jail, line, routed), F.coalesce(*own)))
    return cut.select(*lines.columns, F.explode(F.array(*hits)).alias("_hit"))


def _by_number(patterns: Sequence[str], number: Column, line: str) -> Column:
    """The host by the pattern with this number."""
    out = F.when(number == 0, _host(patterns[0], line))
    for i, pattern in enumerate(patterns[1:], 1):
        out = out.when(number == i, _host(pattern, line))
    return out


def _candidates(lines: DataFrame, guarded: Sequence[Column]) -> DataFrame:
    """Adds _can, the numbers of the conditions that hold."""
    return lines.withColumn("_can", F.array_compact(F.array(*[F.when(g, i) for i, g in enumerate(guarded)])))


def _many_rules(lines: DataFrame, rules: Sequence[Rule], line: str, routed: bool) -> DataFrame:
    """Adds _hit as ``_few_rules``: a line meets the expressions of those rules alone of which it holds a literal."""
    patterns = [p for _, _, p in rules]
    cut = _candidates(lines, [_guarded(p, line) & _heeds(j, line, routed) for j, _, p in rules])
    names, numbers = F.array(*[F.lit(j.jail) for j, _, _ in rules]), F.array(*[F.lit(i) for _, i, _ in rules])
    tried = F.transform("_can", lambda n: F.struct(F.get(names, n).alias("jail"), _by_number(patterns, n, line).alias("token"), F.get(numbers, n).alias("pattern_idx")))
    valid = cut.withColumn("_valid", F.filter(tried, lambda h: is_ip(h["token"])))
    first = F.filter("_valid", lambda h, i: (i == 0) | (F.get("_valid", i - 1)["jail"] != h["jail"]))
    return valid.select(*lines.columns, F.explode_outer(first).alias("_hit"))


def _with_address(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"ip_family": ip_family(F.col("ip")), "ip_hex": ip_hex(F.col("ip"))})


#: The characters of addresses with ports.
_TOKEN = "[0-9a-fA-F.:]"


def host_tokens(span: Column, kind: str, literal: str | None) -> Column:
    """What may be the address in a matched text, first choice first: the token at its start, after each place of a
    literal, or those before a literal's first place, nearest first."""
    at = lambda text: F.regexp_extract(text, f"^{_TOKEN}*", 0)
    if kind in ("start", "group"):
        return F.array(at(span))
    if kind == "after":
        size = len(literal)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(span), F.lit(1))), lambda i: F.substring(span, i, F.lit(size)) == literal)
        return F.transform(starts, lambda i: at(F.substring(span, i + size, F.char_length(span))))
    before = F.split(F.substring_index(span, literal, 1), "[^0-9a-fA-F.:]", -1)
    return F.when(span.contains(literal), F.reverse(F.filter(before, lambda t: F.char_length(t) >= 2))).otherwise(F.array().cast("array<string>"))


def _positional(lines: DataFrame, patterns: tuple[str, ...], line: str) -> DataFrame:
    """All in the JVM: the patterns' matched texts, the tokens in each that may be the address, and the first that is
    one once its ports are off."""
    spans, ranks = [], []
    for pattern in patterns:
        text = expand_host(pattern)
        kind, _ = host_extractor(pattern)
        group = host_group_index(pattern) if kind == "group" else 0
        hit = F.col(line).rlike(text)
        literal = literal_prefix(pattern)
        there = F.locate(literal, F.col(line)) if literal else F.lit(0)
        # a pattern is tried if its literal occurs, first those whose literal ends first; without any literal in the line only patterns without one
        ranks.append(F.when(there > 0, there + F.char_length(F.lit(literal or ""))) if literal else F.lit(1 << 30))
        spans.append(F.when(hit & ((there > 0) if literal else F.lit(True)), F.regexp_extract(line, text, group)))
    cut = once(lines, _spans=F.array(*spans), _ranks=F.array(*ranks)).where(F.exists("_spans", lambda s: s.isNotNull()))
    first = F.array_min("_ranks")
    own = [(i, F.get("_spans", i), *host_extractor(p)) for i, p in enumerate(patterns)]
    tries = [F.when(span.isNotNull(), F.struct(F.lit(i).alias("i"), F.get("_ranks", i).eqNullSafe(first).alias("ahead"), host_tokens(span, kind, literal).alias("tokens"))) for i, span, kind, literal in own]
    tried = once(cut, _tries=F.array_compact(F.array(*tries)))
    address = lambda t: F.get(F.filter(F.transform(t["tokens"], strip_port), lambda ip: ip.isNotNull()), 0)
    found = once(tried, _found=F.filter(F.transform("_tries", lambda t: F.struct(address(t).alias("ip"), t["i"].alias("pattern_idx"), t["ahead"].alias("ahead"))), lambda f: f["ip"].isNotNull()))
    hit = F.coalesce(F.get(F.filter("_found", lambda f: f["ahead"]), 0), F.get("_found", 0))
    picked = found.withColumn("_hit", hit).where("_hit is not null")
    return picked.select(*[c for c in lines.columns if c not in ("ip", "pattern_idx")], F.col("_hit.ip").alias("ip"), F.col("_hit.pattern_idx").alias("pattern_idx"))


def _rule_keys(patterns: DataFrame) -> DataFrame:
    """(pattern_idx, regex, host_group, kind, key): a rule under a key for each of its literals, or under all of ``SHARES`` if it has none.

    Rules with the same expression and group are one, that with the least number. Of a literal's words the one counts
    that the fewest rules have, so that rules that differ in one word don't all stand under what they share.
    """

    @F.pandas_udf("array<array<struct<kind: string, key: string>>>")
    def choices(regexes: pd.Series) -> pd.Series:
        every = [[{"kind": "any", "key": str(i)}] for i in range(SHARES)]
        return regexes.map(lambda r: [[{"kind": k, "key": t} for k, t in own] for own in index_choices(r)] or every)

    rules = patterns.groupBy("regex", "host_group").agg(F.min("pattern_idx").alias("pattern_idx"))
    literals = rules.select("pattern_idx", "regex", "host_group", F.posexplode(choices("regex")).alias("literal", "own"))
    could = literals.select("pattern_idx", "regex", "host_group", "literal", F.inline("own"))
    shared = could.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = F.struct(F.coalesce("n", F.lit(1)), -F.char_length("key"), "key")
    best = could.join(shared, ["kind", "key"], "left").groupBy("pattern_idx", "regex", "host_group", "literal").agg(F.min_by(F.struct("kind", "key"), order).alias("k"))
    return best.select("pattern_idx", "regex", "host_group", "k.kind", "k.key")


def _line_keys(line: str, kinds: set[str]) -> Column:
    """All keys of a line, of the kinds that rules have."""
    text = F.col(line)
    words = F.filter(F.split(text, NO_WORD), lambda w: w.rlike("[^0-9]"))
    ends = F.char_length(text) - GRAM + 1
    grams = F.when(ends > 0, F.transform(F.sequence(F.lit(1), ends), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    share = F.array(F.pmod(F.xxhash64(text), F.lit(SHARES)).cast("string"))
    of_kind = lambda kind, found: F.transform(F.array_distinct(found), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    return F.concat(*[of_kind(n, c) for n, c in (("word", words), ("gram", grams), ("any", share)) if n in kinds])


def match_dynamic(lines: DataFrame, patterns: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Match against a table (pattern_idx, regex, host_group) of any size that is only known when the query runs.

    Rules are indexed by a word or gram of each literal that they need, lines meet them by equality of these, and only
    such candidates are tried. A rule that needs no literal meets every line: it stands once in each of ``SHARES``
    parts of the lines. The first rule with a valid address counts; of lines with the same ``keys`` any may.

    The index is a table. Up to ``HELD_RULES`` bytes of it go to every task; of a larger one only its keys' hashes, and
    what lines hold of these is shuffled. Lines are never sent through the driver.
    """
    spark = lines.sparkSession
    index = work_folder(spark, "rules")
    made = _rule_keys(patterns)
    made.write.parquet(index)
    rules = spark.read.schema(made.schema).parquet(index)
    size = rules.agg(F.collect_set("kind").alias("kinds"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("regex") + F.octet_length("key") + 64).alias("bytes")).first()
    if not size["n"]:
        return lines.select(*keys).limit(0).select(*keys, F.lit(0).alias("pattern_idx"), F.lit("").alias("ip"))
    keyed = lines.select(*keys, F.col(line).alias("_line"), F.inline(_line_keys(line, set(size["kinds"]))))
    if size["bytes"] <= HELD_RULES:
        rules = F.broadcast(rules)
    else:
        keyed = keyed.hint("merge")
        if size["n"] <= HELD_KEYS:
            held = rules.select(F.xxhash64("kind", "key").alias("_hash")).distinct()
            keyed = keyed.withColumn("_hash", F.xxhash64("kind", "key")).join(F.broadcast(held), "_hash", "left_semi").drop("_hash").hint("merge")
    tried = keyed.join(rules, ["kind", "key"]).where(F.expr("_line rlike regex"))
    # the generator keeps the host's expression behind the match
    named = once(tried.select(*keys, "pattern_idx", "_line", "regex", "host_group"), token=F.expr("regexp_extract(_line, regex, host_group)")).where(is_ip(F.col("token")))
    first = named.groupBy(*keys).agg(F.min_by("token", "pattern_idx").alias("token"), F.min("pattern_idx").alias("pattern_idx"))
    return first.withColumn("ip", parse_ip(F.col("token"))).drop("token")


def route_lines(lines: DataFrame, jails: DataFrame) -> DataFrame:
    """Each line once for every enabled jail that reads its source."""
    paths = jails.where("enabled").select("jail", F.col("log_path").alias("source"))
    return lines.join(paths, "source")


def jail_ts(jails: Sequence[Jail], line: str = "line", ref_ts: Column | None = None) -> Column:
    """The date of a failure's line in its jail's format, 0 where it has none."""
    out = F.lit(None).cast("long")
    for fmt in sorted({j.date_format for j in jails}):
        out = F.when(F.col("jail").isin([j.jail for j in jails if j.date_format == fmt]), line_ts(F.col(line), fmt, ref_ts=ref_ts, default=F.lit(0).cast("long"))).otherwise(out)
    return out


def match_all(lines: DataFrame, jails: list[Jail], line: str = "line") -> DataFrame:
    """Failures of all enabled jails over lines that carry their source, in one scan, with a jail column."""
    return match_jails(lines, [j for j in jails if j.enabled], line, routed=True)


def pattern_hits(lines: DataFrame, patterns: tuple[str, ...], line: str = "line") -> DataFrame:
    """For each pattern how many lines it finds with a valid address, zero too, in one pass over the lines.

    A pattern's expression is tried on lines that hold one of its literals alone.
    """
    can = _candidates(lines.select(line), [_guarded(p, line) for p in patterns])
    # across generators Spark does not put the expressions in place of their names; the outer one keeps it from testing the array for emptiness first
    tried = can.select(line, F.explode_outer("_can").alias("pattern_idx")).where("pattern_idx is not null")
    found = tried.select("pattern_idx", F.explode(F.array(_by_number(patterns, F.col("pattern_idx"), line))).alias("token")).where(is_ip(F.col("token")))
    counted = found.groupBy("pattern_idx").agg(F.count(F.lit(1)).alias("hits"))
    every = lines.sparkSession.range(len(patterns)).select(F.col("id").cast("int").alias("pattern_idx"))
    return every.join(counted, "pattern_idx", "left").fillna(0, ["hits"])
