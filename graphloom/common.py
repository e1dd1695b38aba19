"""Shared plumbing: written intermediate tables."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Compressed bytes of input for each shuffle partition at most, and bytes of text that a Python worker turns into objects at once.
TASK_BYTES, SLICE_BYTES = 64 << 20, 4 << 20

#: Folders of tables that are to be deleted, see clear().
_WRITTEN: list[str] = []


def scratch(spark) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only where it is unset and all runs in one process, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graphloom/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear(spark) -> int:
    """Deletes all tables that this process has written so far, and returns their number. Results that were made from them can't be read any more: call it when they are stored."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage of iterations and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most limit bytes of a text column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def register(spark, source: type) -> None:
    """Makes a Python data source known by its name. Spark looks names up in the session that is active in the calling thread, so this one becomes it: a thread of its own has none, or one that was left over."""
    spark.dataSource.register(source)
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of all files that df's plan reads; rows made in Python, whose bytes are unknown, count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)


def partitions(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """The session's number of shuffle partitions, or more where the scanned files ask for it, so that a task's share doesn't grow with the input.
    Given to repartition() where few bytes take long, as AQE would otherwise merge them into few tasks."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(scanned_bytes(df) / task_bytes))
