"""Ban state on storage, and what is published of it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.functions.rendering import is_http_url, logfmt

#: Goes up with the layout of the tables.
VERSION = 1
BANS = "ip string, jail string, banned_at long, expires_at long"
COUNTS = "ip string, count int, last_ban long"


class StateVersionError(ValueError):
    """The stored state has another layout; it is left as it is."""


def save_bans(bans: DataFrame, counts: DataFrame, path: str) -> None:
    """Write bans and counts to a new folder under ``path``, and only then the row that names it.

    What was saved before stays whole and is what a reader finds until that row is there, whenever the job ends.
    """
    spark, name = bans.sparkSession, uuid.uuid4().hex
    bans.select("ip", "jail", "banned_at", "expires_at").write.parquet(f"{path}/{name}/bans")
    counts.select("ip", F.col("count").cast("int").alias("count"), "last_ban").write.parquet(f"{path}/{name}/counts")
    row = spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(name).alias("folder"), F.expr("current_timestamp()").alias("saved_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/saved")


def load_bans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bans and counts that were saved last; StateVersionError if another version wrote them."""
    found = spark.read.schema("version int, folder string, saved_at timestamp").parquet(f"{path}/saved").orderBy(F.desc("saved_at"), "folder").first()
    if found is None or found["version"] != VERSION:
        raise StateVersionError(f"{path} holds version {found and found['version']}, not {VERSION}")
    return spark.read.schema(BANS).parquet(f"{path}/{found['folder']}/bans"), spark.read.schema(COUNTS).parquet(f"{path}/{found['folder']}/counts")


class ActionSink(Protocol):
    """What applies actions; called once for each micro-batch, again with the same number after a failure."""

    def __call__(self, actions: DataFrame, batch_id: int) -> None: ...


def write_actions(actions: DataFrame, sink: ActionSink | Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Start publishing a stream of actions, each batch in order of time."""

    def publish(batch: DataFrame, number: int) -> None:
        sink(batch.orderBy("at", "event_seq"), number)

    writer = actions.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its number, so that a repeated batch replaces itself."""
    return lambda actions, number: actions.write.mode("overwrite").parquet(f"{path}/batch={number}")


def bans_jsonl(bans: DataFrame) -> DataFrame:
    """One JSON object per ban; a permanent one has ``expires_at`` null."""
    return bans.select(F.to_json(F.struct("jail", "ip", "banned_at", "expires_at"), {"ignoreNullFields": "false"}).alias("value"))


def notifications(actions: DataFrame, jails: DataFrame) -> DataFrame:
    """(url, body) for each ban and unban of a jail with a web address; unbans have no ban time."""
    urls = jails.where(is_http_url(F.col("webhook"))).select("jail", F.col("webhook").alias("url"))
    stamp = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    body = F.struct(F.col("action").alias("event"), "ip", "jail", F.when(F.col("action") == "ban", F.col("ban_time")).alias("ban_time"), stamp.alias("timestamp"))
    return actions.where("action in ('ban', 'unban')").join(urls, "jail").select("url", F.to_json(body).alias("body"))


def event_log(events: DataFrame, message: str, fields: dict[str, bool], fmt: str = "logfmt") -> DataFrame:
    """Rows as log lines in ``logfmt`` or ``json``; ``fields`` says for each column whether it is text."""
    if fmt == "json":
        return events.select(F.to_json(F.struct(F.lit(message).alias("msg"), *fields), {"ignoreNullFields": "false"}).alias("line"))
    columns: dict[str, tuple[Column, bool]] = {name: (F.col(name), text) for name, text in fields.items()}
    return events.select(logfmt(F.lit(message), columns).alias("line"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; it goes with all in it when the application ends.

    Only a session of one machine (a local master) may leave that unset; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or "file://" + os.path.join(tempfile.gettempdir(), "banstream-shared")
    own = f"{base.rstrip('/')}/banstream/{spark.sparkContext.applicationId}"
    _delete_at_exit(spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=64)
def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
