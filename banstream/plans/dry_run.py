"""Analyse a log without banning anyone: from files to a summary and the offenders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.jails import Jail
from banstream.operators.allowlist import drop_allowlisted
from banstream.operators.failures import dry_run
from banstream.operators.matching import jail_ts, match_jails
from banstream.sources.logs import read_log_lines


def dry_run_log(spark: SparkSession, paths: str | Sequence[str], jails: Sequence[Jail], ref_ts: int | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary, offenders) of logs by every enabled jail.

    ``compat`` leaves the jails' ignoreregex out, as older tools do here. A line without a date counts at 0.
    Failures count in the order in which their lines stand, file by file, whatever their dates.
    """
    own = [replace(j, ignoreregex=()) if compat else j for j in jails if j.enabled]
    ref = F.lit(ref_ts) if ref_ts is not None else None
    found = match_jails(read_log_lines(spark, paths), own)
    for cidrs, ignoreself in {(j.ignoreip, j.ignoreself) for j in own}:
        names = [j.jail for j in own if (j.ignoreip, j.ignoreself) == (cidrs, ignoreself)]
        found = drop_allowlisted(found, cidrs, ignoreself=ignoreself, only=F.col("jail").isin(names))
    return dry_run(found.select("jail", "ip", jail_ts(own, ref_ts=ref).alias("ts"), "source", "seq"), jails, ("source", "seq"))
