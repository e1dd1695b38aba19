"""When consolidation runs: an interval that skips ticks while a run lasts, and a nightly window with a least time between the runs of a namespace.

Both are scans over ticks in order of time that keep the last run alone, so a partition of sorted ticks is read as a stream and no group is gathered. Running systems
put the same decision behind a trigger: `run_batch` is a foreachBatch function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rules import is_rem_time

MICROSECONDS = 1_000_000


def spaced(ticks: DataFrame, seconds: float, key: str = "namespace", at: str = "at") -> DataFrame:
    """The ticks of each key that start a run: the first, and each that comes so many seconds after the last one that did, or later."""
    rows = ticks.select(F.col(key).alias("key"), F.col(at).alias("at")).distinct()
    dealt = rows.repartition("key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keys, times = batch.column("key").to_pylist(), pc.cast(pc.cast(batch.column("at"), pa.timestamp("us", "UTC")), pa.int64()).to_pylist()
            keep = []
            for k, t in zip(keys, times, strict=True):
                if k != now or last is None:
                    now, last = k, None
                started = last is None or t - last >= seconds * MICROSECONDS
                if started:
                    last = t
                keep.append(started)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(run, f"key {kinds['key']}, at {kinds['at']}").select(F.col("key").alias(key), F.col("at").alias(at))


def interval_runs(ticks: DataFrame, run_seconds: float, key: str = "namespace", at: str = "at") -> DataFrame:
    """Ticks that start a run, when a run takes so long; those that come while one lasts are skipped."""
    return spaced(ticks, run_seconds, key, at)


def nightly_runs(ticks: DataFrame, start: int, end: int, least_hours: float, key: str = "namespace", at: str = "at") -> DataFrame:
    """Ticks within the window of hours that start a run of their namespace, so many hours after its last one."""
    return spaced(ticks.filter(is_rem_time(F.hour(at), start, end)), least_hours * 3600, key, at)


def run_batch(consolidate: Callable[[DataFrame], None], start: int, end: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that consolidates the namespaces of a micro-batch's ticks within the window. A batch runs to its end before the next, so runs don't overlap."""

    def each(batch: DataFrame, _: int) -> None:
        due = batch.filter(is_rem_time(F.hour("at"), start, end)).select("namespace").distinct()
        if not due.isEmpty():
            consolidate(due)

    return each
