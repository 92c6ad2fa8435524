"""Reading logs, journals and networks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from banstream.functions.addresses import ip_family, ip_hex
from banstream.operators.allowlist import network_ranges
from banstream.sources.catalog import FILTERS

NETWORKS = "cidr string, asn int, org string, country string, city string"
JOURNAL = "MESSAGE string, SYSLOG_IDENTIFIER string, _PID string, _HOSTNAME string, _SYSTEMD_UNIT string, __REALTIME_TIMESTAMP string"


def read_log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source, seq, line) of logs, split at line feeds only, bytes that are no UTF-8 replaced; ``seq`` is a line's place in its file, from 0.

    Spark cuts a file into splits and reads the lines of each in order. A first scan counts the lines of every split;
    sums over the splits before it, by where these begin in the file, place its first line. No line is moved or sorted.
    Both scans number rows in the order of the same splits, so files must not change meanwhile.
    """
    raw = spark.read.option("lineSep", "\n").text(list(paths) if not isinstance(paths, str) else paths)
    placed = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.make_valid_utf8("value").alias("line"))
    splits = placed.groupBy("source", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("source").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("source", "_split", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, ["source", "_split"]).select("source", (F.col("_row") + F.col("_shift")).alias("seq"), "line")


def stream_log_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(source, line, ingest_ts) of the closed chunks that arrive in a folder; each file is read once."""
    raw = spark.readStream.schema("value string").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.make_valid_utf8("value").alias("line"), F.current_timestamp().alias("ingest_ts"))


def read_journal(spark: SparkSession, path: str, journalmatch: Sequence[str] = ()) -> DataFrame:
    """(source, line, ts) of an exported journal; of ``FIELD=value`` terms those of one field are alternatives."""
    terms: dict[str, list[str]] = defaultdict(list)
    for term in journalmatch:
        name, _, value = term.partition("=")
        terms[name].append(value)
    extra = "".join(f", `{n}` string" for n in terms if n not in JOURNAL.replace(",", "").split())
    rows = spark.read.schema(JOURNAL + extra).json(path)
    for name, values in terms.items():
        rows = rows.where(F.col(f"`{name}`").isin(values))
    tag = F.concat(F.coalesce("SYSLOG_IDENTIFIER", F.lit("unknown")), F.when(F.col("_PID").isNotNull(), F.concat(F.lit("["), "_PID", F.lit("]"))).otherwise(""))
    line = F.concat(F.coalesce("_HOSTNAME", F.lit("localhost")), F.lit(" "), tag, F.lit(": "), F.coalesce("MESSAGE", F.lit("")))
    shown = rows.select(F.lit("journal").alias("source"), F.regexp_replace(line, r"\s+$", "").alias("line"), (F.col("__REALTIME_TIMESTAMP").try_cast("long") / 1_000_000).cast("long").alias("ts"), "MESSAGE")
    return shown.where("trim(MESSAGE) <> ''").drop("MESSAGE")


def filter_catalog(spark: SparkSession) -> DataFrame:
    """The built-in rules, a row each."""
    rows = [(f.group, f.name, f"Clients that fail at {f.name} ({f.group})", f.log_path, f.date_format, list(f.patterns)) for f in FILTERS.values()]
    return spark.createDataFrame(rows, "group string, name string, description string, log_path string, date_format string, patterns array<string>")


def geo_networks(spark: SparkSession, path: str) -> DataFrame:
    """Networks with their attributes from CSV, with family, lo, hi and prefix."""
    return network_ranges(spark.read.option("header", True).schema(NETWORKS).csv(path))


def addressed(rows: DataFrame, ip: str = "ip") -> DataFrame:
    return rows.withColumns({"ip_family": ip_family(F.col(ip)), "ip_hex": ip_hex(F.col(ip))})
