"""A sink for actions as a data source of its own: each micro-batch is published whole and once, or not at all.

A task sorts its part of the batch by time, writes it to a file of a new name and reports that name. The driver commits
a batch by one small file that lists the names, written last; only listed files are read. A batch that Spark runs
again, because a task or the driver failed before Spark had noted it, finds its list there and its new files are
deleted; files of a batch that is aborted are deleted too. What a lost task has written is in no list.

A task holds its part of one micro-batch, so the trigger bounds its memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from banstream.operators.timeline import ACTIONS

NAME = "ban_actions"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: a file name, none for an empty part."""

    name: str | None
    rows: int


class ActionWriter(DataSourceStreamWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path, schema.names

    def _open(self):
        """The file system of the path, whatever it is, and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def line(self, row: Row) -> str:
        return json.dumps(dict(zip(self.columns, row, strict=True)))

    def write(self, iterator: Iterator[Row]) -> Written:
        at, seq = self.columns.index("at"), self.columns.index("event_seq")
        rows = sorted(iterator, key=lambda r: (r[at], r[seq] is None, r[seq] or 0))
        if not rows:
            return Written(None, 0)
        system, base = self._open()
        system.create_dir(f"{base}/data", recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{base}/data/{name}") as out:
            for row in rows:
                out.write(self.line(row).encode() + b"\n")
        return Written(name, len(rows))

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        from pyarrow import fs

        system, base = self._open()
        system.create_dir(f"{base}/commits", recursive=True)
        done = f"{base}/commits/{batchId}.json"
        if system.get_file_info(done).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        draft = f"{base}/commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            for m in messages:
                if m is not None and m.name:
                    out.write(json.dumps({"batch": batchId, "name": m.name, "rows": m.rows}).encode() + b"\n")
        system.move(draft, done)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, base = self._open()
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{base}/data/{m.name}")


class ActionSource(DataSource):
    """``writeStream.format("ban_actions").option("path", ..)``; the path is a URI that all executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ACTIONS

    def streamWriter(self, schema: StructType, overwrite: bool) -> ActionWriter:
        return ActionWriter(self.options["path"], schema)


def save_actions(actions: DataFrame, path: str, checkpoint: str, available_now: bool = False, source: type[DataSource] = ActionSource):
    """Start publishing a stream of actions under ``path``."""
    actions.sparkSession.dataSource.register(source)
    writer = actions.writeStream.format(source.name()).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """(batch, and the columns of actions) of the batches that are committed."""
    listed = spark.read.schema("batch long, name string, rows long").json(f"{path}/commits")
    rows = spark.read.schema(ACTIONS).json(f"{path}/data").withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(listed.select("batch", "name"), "name").drop("name")
