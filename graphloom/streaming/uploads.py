"""Chunked uploads: sessions, arriving chunks, their checks and their progress, in batch and as streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from graphloom.common import partitions, register
from graphloom.functions.rules import ACTIVE_UPLOADS, overall_progress, upload_progress

SESSION_HOURS = 24
#: Which status may follow which.
TRANSITIONS = {"uploading": ("finalizing", "cancelled", "failed"), "finalizing": ("converting", "failed"), "converting": ("ready", "failed")}


def received(sessions: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Sessions with the number of distinct chunks received, progress, and the sorted chunks that are missing. A chunk that arrives again counts once."""
    got = arrivals.groupBy("upload_id").agg(F.array_sort(F.collect_set("chunk")).alias("chunks_received"))
    whole = F.sequence(F.lit(0).cast("long"), F.col("total_chunks") - 1)
    none = F.expr("cast(array() as array<bigint>)")
    out = sessions.join(got, "upload_id", "left").withColumn("chunks_received", F.coalesce("chunks_received", none))
    missing = F.when(F.col("total_chunks") > 0, F.array_except(whole, "chunks_received")).otherwise(none)
    return out.withColumns({"n_received": F.size("chunks_received").cast("long"), "missing": missing, "upload_progress": F.round(upload_progress(F.size("chunks_received"), F.col("total_chunks")), 6)})


def may_finalize(sessions: DataFrame) -> DataFrame:
    """Sessions that have all their chunks and are still uploading, moved to finalizing."""
    return sessions.filter((F.size("missing") == 0) & (F.col("status") == "uploading")).withColumn("status", F.lit("finalizing"))


def expired(sessions: DataFrame, now: Column, hours: int = SESSION_HOURS) -> DataFrame:
    """Sessions still uploading that were created so many hours before now, as cancelled."""
    return sessions.filter((F.col("status") == "uploading") & (F.col("created_at") < now - F.expr(f"interval {hours} hours"))).withColumn("status", F.lit("cancelled"))


def active(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("status").isin(*ACTIVE_UPLOADS))


def move(sessions: DataFrame, status: str) -> DataFrame:
    """Sessions in `status`, where the state machine allows it; others stay as they are."""
    allowed = [k for k, v in TRANSITIONS.items() if status in v]
    return sessions.withColumn("status", F.when(F.col("status").isin(*allowed), status).otherwise(F.col("status")))


def verified(chunks: DataFrame) -> DataFrame:
    """Chunk rows (data, checksum) with their SHA-256 and whether it is the one given; a chunk without a given one passes."""
    sha = F.sha2("data", 256)
    return chunks.withColumns({"sha256": sha, "valid": F.coalesce(sha == F.lower("checksum"), F.lit(True))})


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task wrote of each upload, and where the last of them end."""

    parts: dict[str, tuple[int, int]]


class UploadWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        folder, self.suffix = options.get("path", ""), options.get("suffix", "")
        if "://" in folder and not folder.startswith("file://"):
            raise ValueError("parts are written by position, which this file system can't")
        self.folder = folder.removeprefix("file://").removeprefix("file:")

    def _path(self, upload: str, end: str) -> str:
        if not upload or "/" in upload or upload.startswith("."):
            raise ValueError(f"no name for an upload: {upload!r}")
        return os.path.join(self.folder, upload + end)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Puts each part at its place in the upload's unfinished file. A task that runs again writes the same bytes to the same places."""
        os.makedirs(self.folder, exist_ok=True)
        parts: dict[str, tuple[int, int]] = {}
        for batch in batches:
            for upload, at, data in zip(batch.column("upload_id"), batch.column("position"), batch.column("data"), strict=True):
                upload, at, data = str(upload.as_py()), at.as_py(), data.as_buffer()
                file = os.open(self._path(upload, ".part"), os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    done = 0
                    while done < data.size:
                        done += os.pwrite(file, data.slice(done), at + done)
                finally:
                    os.close(file)
                size, end = parts.get(upload, (0, 0))
                parts[upload] = size + data.size, max(end, at + data.size)
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        """Gives all uploads their names, if none has a hole; else all stay unfinished."""
        total: dict[str, tuple[int, int]] = {}
        for message in messages:
            for upload, (size, end) in (message.parts if message else {}).items():
                a, b = total.get(upload, (0, 0))
                total[upload] = a + size, max(b, end)
        short = sorted(upload for upload, (size, end) in total.items() if size != end)
        if short:
            raise ValueError(f"parts are missing or given twice: {', '.join(short[:5])}")
        for upload, (_, end) in total.items():
            os.truncate(self._path(upload, ".part"), end)
            os.replace(self._path(upload, ".part"), self._path(upload, self.suffix))

    def abort(self, messages: list[Written | None]) -> None:
        """Unfinished files stay, as a later write may complete them; see partial_uploads."""


class Uploads(DataSource):
    """df.write.format("uploads").save(folder): rows (upload_id, position, data) as files, each part put to its place by the task that has it, so that neither a file nor its parts meet in a task.
    The folder is one that all executors share. Option suffix: the end of the files' names."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def writer(self, schema, overwrite: bool) -> UploadWriter:
        return UploadWriter(self.options)


def assemble(chunks: DataFrame, folder: str, chunk_size: int | None = None, suffix: str = "") -> None:
    """Writes chunk rows (upload_id, chunk, data) as files. Of a chunk that arrives again the one of the least digest counts. With chunk_size, a chunk's place is its number times that, and holes are refused; without,
    places add up over the sizes of the chunks before."""
    spark = chunks.sparkSession
    register(spark, Uploads)
    digest = F.sha2("data", 256)
    rows = chunks.groupBy("upload_id", "chunk").agg(F.min_by("data", digest).alias("data"))
    if chunk_size is None:
        sizes = chunks.groupBy("upload_id", "chunk").agg(F.min(F.struct(digest.alias("d"), F.octet_length("data").alias("size"))).alias("f")).select("upload_id", "chunk", "f.size")
        place = F.sum("size").over(Window.partitionBy("upload_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # of numbers, not of data
        rows = rows.join(sizes.select("upload_id", "chunk", F.coalesce(place, F.lit(0)).alias("position")), ["upload_id", "chunk"])
    else:
        rows = rows.withColumn("position", F.col("chunk").cast("long") * chunk_size)
    rows.select(F.col("upload_id").cast("string"), F.col("position").cast("long"), F.col("data").cast("binary")).write.format("uploads").option("suffix", suffix).mode("append").save(folder)


def digests(spark, folder: str, most_bytes: int = 4 << 20) -> DataFrame:
    """path, size and sha256 of each file of a folder. A digest is of one stream: a task reads its files in order, most_bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                with FileSystem.from_uri(path)[0].open_input_stream(FileSystem.from_uri(path)[1]) as file:
                    while data := file.read(most_bytes):
                        digest.update(data)
                        size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["path", "size", "sha256"])

    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return listing(spark, folder).select(uri.alias("path")).repartition(partitions(listing(spark, folder)), "path").mapInArrow(run, "path string, size long, sha256 string")


def arrival_stream(arrivals: DataFrame, total_chunks: int, timeout: str = "24 hours") -> DataFrame:
    """A stream of arrivals (upload_id, chunk, at) as session updates: distinct chunks, progress, status; a session that gets nothing for so long by event time is cancelled. Output mode update."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = dt.timedelta(seconds=pd.Timedelta(timeout).total_seconds())

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        if state.hasTimedOut:
            state.remove()
            status = "cancelled"
        else:
            latest = pd.Timestamp(0)
            for rows in batches:
                seen.update(int(x) for x in rows["chunk"] if 0 <= x < total_chunks)
                latest = max(latest, rows["at"].max())
            status = "finalizing" if len(seen) == total_chunks else "uploading"
            if status == "uploading":
                state.update((sorted(seen),))
                state.setTimeoutTimestamp(max(int((latest + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame([{"upload_id": key[0], "n_received": len(seen), "progress": 100.0 * len(seen) / total_chunks, "status": status}])

    return arrivals.withWatermark("at", "10 minutes").groupBy("upload_id").applyInPandasWithState(run, "upload_id long, n_received long, progress double, status string", "chunks array<long>", "update", GroupStateTimeout.EventTimeTimeout)


#: Stages behind which a task says no more.
LAST_STAGES = ("complete", "failed")


class TaskProgress(StatefulProcessor):
    """State of each task: the time of the last event told, and whether the task has ended. A timer removes it `linger` after the task's end, and `silence` after its last event where the end never comes."""

    def __init__(self, linger: dt.timedelta, silence: dt.timedelta):
        self.waits = {True: int(linger.total_seconds() * 1000), False: int(silence.total_seconds() * 1000)}

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at double, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, ended = self.last.get() if self.last.exists() else (None, False)
        best = None
        for batch in rows:
            row = batch.loc[batch["at"].idxmax()]
            final = batch[batch["stage"].isin(LAST_STAGES)]
            row = final.loc[final["at"].idxmin()] if len(final) else row
            if best is None or row["stage"] in LAST_STAGES or row["at"] > best["at"]:
                best = row
        if not ended and best is not None and (at is None or best["at"].timestamp() >= at):
            ended = best["stage"] in LAST_STAGES
            self.last.update((best["at"].timestamp(), ended))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(int(best["at"].timestamp() * 1000) + self.waits[ended], timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame([{"task_id": key[0], **{k: best[k] for k in ("stage", "embedded", "persisted", "chunks")}, "last": ended}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, late: str = "1 minute", linger: str = "5 minutes", silence: str = "24 hours") -> DataFrame:
    """A stream of task events as progress (task_id, stage, progress, last): one row for each task and micro-batch, by its last event, until a row with `last`. What comes after a task's end says
    nothing. State is kept of running tasks, and `linger` longer of ended ones, by event time; events that come `late` after that are dropped by the watermark. Output mode update. The session
    needs the RocksDB state store."""
    wait = lambda x: dt.timedelta(seconds=pd.Timedelta(x).total_seconds())
    out = events.withWatermark("at", late).groupBy("task_id").transformWithStateInPandas(TaskProgress(wait(linger), wait(silence)), "task_id string, stage string, embedded int, persisted int, chunks int, last boolean", "update", "eventTime")
    return out.select("task_id", "stage", overall_progress(F.col("stage"), F.col("embedded"), F.col("persisted"), F.col("chunks")).alias("progress"), "last")


def partial_uploads(files: DataFrame) -> DataFrame:
    """upload_id and bytes of each unfinished file of a listing (path, length): those that end in .part."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.endswith(name, F.lit(".part"))).select(F.regexp_replace(name, "[.]part$", "").alias("upload_id"), "length")


def size_matches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """upload_id, length and whether a file has the size it should (expected: upload_id, total_size); false for files that aren't there."""
    return expected.join(partial_uploads(files), "upload_id", "left").select("upload_id", "length", F.coalesce(F.col("length") == F.col("total_size"), F.lit(False)).alias("whole"))


def listing(spark, folder: str) -> DataFrame:
    """path and length of the files of a folder and those below it; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def delete_file(spark, path: str) -> bool:
    """Deletes a file, through the file system that its path names; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False))


def free_bytes(spark, path: str) -> int:
    """Bytes that the file system of a path has left."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(at).getRemaining())


def latest_progress(events: DataFrame) -> DataFrame:
    """The last event of each task (task_id, at, stage, embedded, persisted, chunks) with its overall progress."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("stage", "embedded", "persisted", "chunks"), "at").alias("e"), F.max("at").alias("at"))
    rows = last.select("task_id", "at", "e.*")
    return rows.withColumn("progress", overall_progress(F.col("stage"), F.col("embedded"), F.col("persisted"), F.col("chunks")))
