"""A sink for frames: an outbox that is written whole or not at all, with the frames that failed and why.

``df.write.format("frames").option("path", ...).option("batch", n)`` takes ``client_id, key, frame``. Each task writes its rows to a staged log;
the commit moves the logs to ``<path>/batch=<n>``, one JSON object a line: ``client_id, key, frame, error``. A batch that is there already stays as it is,
so doing one again (as ``foreachBatch`` does after a failure) sends and writes nothing twice.

With a ``sender`` each frame is also handed to it. A frame whose sending raises is a row with its ``error``; the others of its client and task go on.
The staged log survives an aborted attempt: the next one at the same batch skips what the log has, so frames sent before a task died aren't sent again. That
holds if the same rows come in the same tasks, as ``deal`` sees to.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: Tasks that a batch's frames are dealt to; a client's frames are in one of them.
PARTS = 16
SCHEMA = "client_id string, key string, frame string, error string, batch long"


def deal(frames: DataFrame, parts: int = PARTS) -> DataFrame:
    """``client_id, key, frame`` as the sink takes them: a client's frames in one task, in the order of their keys."""
    rows = frames.select(F.col("client_id").cast("string").alias("client_id"), F.col("key").cast("string").alias("key"), "frame")
    return rows.repartition(parts, "client_id").sortWithinPartitions("client_id", "key")


@dataclass
class Staged(WriterCommitMessage):
    name: str
    sent: int
    failed: int


class FrameSink(DataSource):
    """Options: ``path`` (a folder that all executors share; any URI that pyarrow opens), ``batch`` (of a batch write; a stream has its own numbers) and ``sender`` (see ``with_sender``; batch writes only)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "client_id string, key string, frame string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return FrameStreamWriter(self.options)


def with_sender(send: Callable[[str, str, str], None]) -> str:
    """A function of client, key and frame as the option ``sender``."""
    return base64.b64encode(cloudpickle.dumps(send)).decode()


class Outbox:
    def __init__(self, options: dict):
        given = options["path"]
        self.uri = given if "://" in given or given.startswith("file:") else None
        self.root = pyarrow.fs.FileSystem.from_uri(given)[1] if self.uri else given
        self.sender = options.get("sender")

    def fs(self) -> pyarrow.fs.FileSystem:
        return pyarrow.fs.FileSystem.from_uri(self.uri)[0] if self.uri else pyarrow.fs.LocalFileSystem()

    def has(self, folder: str) -> bool:
        return self.fs().get_file_info(f"{self.root}/{folder}/_SUCCESS").is_file

    def staged(self, batch: int) -> str:
        return f"{self.root}/_staged/{batch}"

    def log(self, name: str, rows: Iterator) -> tuple[int, int]:
        """Write (and send) the rows that the log doesn't have yet; how many went well and how many didn't, old ones included."""
        fs, sent, failed = self.fs(), 0, 0
        send = cloudpickle.loads(base64.b64decode(self.sender)) if self.sender else None
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        done, text = set(), b""
        if fs.get_file_info(name).is_file:
            with fs.open_input_stream(name) as f:
                text = f.read()
            text = text[: text.rfind(b"\n") + 1]  # the last line of a log that broke off isn't counted as sent
            for line in text.splitlines():
                r = json.loads(line)
                done.add((r["client_id"], r["key"]))
                sent, failed = sent + (r["error"] is None), failed + (r["error"] is not None)
        with fs.open_output_stream(name) as f:
            f.write(text)
            f.flush()
            for r in rows:
                if (r["client_id"], r["key"]) in done:
                    continue
                error = None
                if r["client_id"] is None or r["frame"] is None:
                    error = "no client" if r["client_id"] is None else "no frame"
                elif send:
                    try:
                        send(r["client_id"], r["key"], r["frame"])
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                sent, failed = sent + (error is None), failed + (error is not None)
                f.write(json.dumps({"client_id": r["client_id"], "key": r["key"], "frame": r["frame"], "error": error}).encode() + b"\n")
                if send:
                    f.flush()
        return sent, failed

    def publish(self, messages: list, batch: int) -> None:
        """Move the staged logs to the batch's folder; what was moved before a failure is moved no more."""
        fs, folder = self.fs(), f"{self.root}/batch={batch}"
        fs.create_dir(folder, recursive=True)
        for i, m in enumerate(sorted((m for m in messages if m), key=lambda m: m.name)):
            if m.sent + m.failed and fs.get_file_info(m.name).is_file:
                fs.move(m.name, f"{folder}/part-{i:05d}.json")
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.box, self.batch = Outbox(options), int(options["batch"])

    def write(self, iterator) -> Staged:
        part, rows = TaskContext.get().partitionId(), iterator
        if self.box.has(f"batch={self.batch}"):
            return Staged("", 0, 0)
        name = f"{self.box.staged(self.batch)}/part-{part:05d}.json"
        return Staged(name, *self.box.log(name, rows))

    def commit(self, messages: list) -> None:
        if not self.box.has(f"batch={self.batch}"):
            self.box.publish(messages, self.batch)

    def abort(self, messages: list) -> None:
        """The logs stay: they say what was sent."""


class FrameStreamWriter(DataSourceStreamWriter):
    """Writes the outbox alone: a stream's task doesn't know its batch before the commit, so what a broken attempt staged is dropped."""

    def __init__(self, options: dict):
        self.box = Outbox({**options, "sender": None})

    def write(self, iterator) -> Staged:
        context = TaskContext.get()
        name = f"{self.box.staged(-1)}/part-{context.partitionId():05d}-{context.taskAttemptId()}.json"
        return Staged(name, *self.box.log(name, iterator))

    def commit(self, messages: list, batchId: int) -> None:
        if not self.box.has(f"batch={batchId}"):
            self.box.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        fs = self.box.fs()
        for m in messages:
            if m and fs.get_file_info(m.name).is_file:
                fs.delete_file(m.name)


def write_frames(frames: DataFrame, path: str, batch: int, send: Callable[[str, str, str], None] | None = None, parts: int = PARTS) -> None:
    """One batch of frames into the outbox, and to ``send`` where given. Inside a stream's batches the sink has to be registered before the stream starts, as they run in a clone of the session."""
    frames.sparkSession.dataSource.register(FrameSink)
    writer = deal(frames, parts).write.format("frames").option("path", path).option("batch", batch).mode("append")
    (writer.option("sender", with_sender(send)) if send else writer).save()


def outbox(spark: SparkSession, path: str) -> DataFrame:
    """``client_id, key, frame, error, batch`` of all committed frames; ``error`` is null where nothing failed."""
    return spark.read.schema(SCHEMA).json(path)


def failures(spark: SparkSession, path: str) -> DataFrame:
    return outbox(spark, path).filter("error is not null")
