"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

A rule is a host and the start of a path. Every url has a few candidate keys: the ends of its host with as many
labels as some rule's host, each with the starts of its path as long as some rule's path. All candidates of the
corpus are the key universe. Level 1 of a cascade encodes the listed keys, level 2 the keys of the universe that
level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and so on until none is left. A
key of the universe is listed exactly if the first level that lacks it has an even number, so every url is judged
exactly, in one scan without a join.

Level 1's rate of false positives is chosen from the number of listed keys and of candidates, so level 2 has about
as many keys as level 1 and the filters' total size follows the rules, not the corpus. They are literals of the
plan; ``MAX_BITS`` bounds them, and longer rule lists go by an equi-join on the same candidates instead.

Defined cases: a null url or one without ``://`` has empty host and path and no rule; host and path are taken as they are apart from lower-casing A-Z in the
host; an empty table gives an empty result; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.llm.shared import ascii_lower, materialize

MAX_BITS = 1 << 22
MAX_LEVELS = 60
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def candidate_keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The keys that could be rules, longest first, without repeats."""
    hosts, paths = zip(*(r.split("/", 1) for r in rules), strict=True)
    found = [
        F.when((host != "") & (F.char_length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in sorted({h.count(".") + 1 for h in hosts})
        for n in sorted({len(p) + 1 for p in paths})
    ]
    sized = F.transform(F.array_distinct(F.array_compact(F.array(*found))), lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key")))
    return F.transform(F.sort_array(sized, asc=False), lambda x: x["key"])


class Bloom:
    """A Bloom filter whose bits are a literal: built by aggregation, asked by column expressions."""

    def __init__(self, keys: DataFrame, n: int, rate: float, level: int) -> None:
        self.level = level
        self.bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / n * math.log(2)))
        at = F.explode(F.array(*self._places(F.col("key"))))
        found = keys.select(at.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word"))
        words = [0] * (self.bits // 64 + 1)  # as many as the bits that MAX_BITS bounds
        for word, value in found.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))"))).collect():
            words[word] = value
        self.words = F.array(*[F.lit(w).cast("long") for w in words])

    def _places(self, key: Column) -> list[Column]:
        first = F.pmod(F.xxhash64(key, F.lit(2 * self.level)), F.lit(self.bits))
        step = F.pmod(F.xxhash64(key, F.lit(2 * self.level + 1)), F.lit(self.bits - 1)) + 1
        return [(first + step * i) % self.bits for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self._places(key):
            word = F.element_at(self.words, (F.floor(at / 64) + 1).cast("int"))
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class Cascade:
    """Levels of filters that tell the listed keys from all others of ``universe`` (a column ``key``)."""

    def __init__(self, spark: SparkSession, listed: Sequence[str], universe: DataFrame, candidates: int) -> None:
        self.levels: list[Bloom] = []
        if not listed:
            return
        want = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        n = len(set(listed))
        rate = min(0.5, max(n, 1) / max(candidates, 1) / math.sqrt(2))
        self._add(want, n, rate)
        # about as many as the listed keys, by the choice of the rate
        wrong = materialize(universe.where(self.levels[0].has(F.col("key"))).distinct().join(want, "key", "left_anti"), "cascade")
        inside, outside = want, wrong
        n = outside.count()
        while n:
            if len(self.levels) >= MAX_LEVELS:
                raise ValueError("the cascade does not end")
            self._add(outside, n, 0.5)
            inside, outside = outside, inside.where(self.levels[-1].has(F.col("key")))
            n = outside.count()

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        self.levels.append(Bloom(keys, n, rate, len(self.levels)))

    def has(self, key: Column) -> Column:
        """Listed unless the first level that lacks the key has an even number; a key in all levels belongs to the last."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def judge_urls(
    pages: DataFrame, allow: Sequence[str], block: Sequence[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per url: id, host, path, rule (null if none fits), verdict (the longest rule's, else ``default``).

    Of a key in both lists, ``block`` counts.
    """
    rules = sorted({*allow, *block})
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = urls.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    spark = pages.sparkSession
    universe = urls.select(F.explode("_keys").alias("key"))
    candidates = urls.agg(F.sum(F.size("_keys"))).first()[0] or 0
    if len(rules) * (2 + 2 * math.log2(2 + candidates / len(rules))) > max_bits:
        return _judge_by_join(urls, spark, allow, block, id_col, default)
    blocked, allowed = (Cascade(spark, x, universe, candidates) for x in (block, allow))
    verdicts = F.transform("_keys", lambda k: F.struct(k.alias("rule"), F.when(blocked.has(k), "block").when(allowed.has(k), "allow").alias("verdict")))
    first = F.get(F.filter(verdicts, lambda x: x["verdict"].isNotNull()), 0)
    return urls.withColumn("_first", first).select(
        id_col, "host", "path", F.col("_first.rule").alias("rule"), F.coalesce("_first.verdict", F.lit(default)).alias("verdict")
    )


def _judge_by_join(urls: DataFrame, spark: SparkSession, allow: Sequence[str], block: Sequence[str], id_col: str, default: str) -> DataFrame:
    """For rule lists too long for literals: the same candidates, joined with the rules."""
    table = spark.createDataFrame([(k, "block" if k in block else "allow") for k in sorted({*allow, *block})], "rule string, verdict string")
    numbered = materialize(urls.withColumn("_row", F.monotonically_increasing_id()), "urls")
    hits = (
        numbered.select("_row", F.explode("_keys").alias("rule"))
        .join(table, "rule")
        .groupBy("_row")
        .agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("_hit"))
    )
    return numbered.join(hits, "_row", "left").select(id_col, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))
