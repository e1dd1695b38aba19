"""Uploads written by position, and model files read by ranges, larger than a task should hold."""

import hashlib
import os
import resource
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.sources import gguf
from graphloom.streaming import uploads


def name(x):
    return struct.pack("<Q", len(x)) + x.encode()


def header(tensors, extra=b"", values=5):
    head = name("general.architecture") + struct.pack("<I", 8) + name("llama")
    head += b"".join(name(f"llama.{k}") + struct.pack("<II", 4, 16) for k in ("block_count", "embedding_length", "attention.head_count", "feed_forward_length")) + extra
    for tensor, size, kind, offset in tensors:
        head += name(tensor) + struct.pack("<I", 1) + struct.pack("<Q", size) + struct.pack("<IQ", kind, offset)
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), values) + head
    return head + b"\0" * (-len(head) % 32)


def test_a_model_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file of 5 GB: one tensor of 2^30 values, with some of its samples set, one of blocks and one at the end."""
    big, end = 1 << 30, 4 * (1 << 30) + 34 * 1000
    head = header([("blk.0.attn", big, 0, 0), ("blk.1.ffn", 32000, 8, 4 * big), ("blk.2.attn", 4, 0, end), ("blk.3.attn", 4, 0, end + 100)])
    path = tmp_path / "big.gguf"
    with open(path, "wb") as f:
        f.write(head)
        for k in (0, 3, 255):
            f.seek(len(head) + 4 * (big // 256) * k)
            f.write(struct.pack("<f", k + 0.5))
        f.seek(len(head) + 4 * big)
        f.write(struct.pack("<e", 2.0) + np.arange(32, dtype=np.int8).tobytes())
        f.seek(len(head) + end)
        f.write(np.arange(4, dtype="<f4").tobytes())
    assert os.path.getsize(path) > 2 << 30
    got = {r.tensor: r for r in gguf.read_models(spark, str(tmp_path), tensors=1).collect()}
    x = got["blk.0.attn"].samples
    assert len(x) == 256 and {k: v for k, v in enumerate(x) if v} == {0: 0.5, 3: 3.5, 255: 255.5}
    assert got["blk.1.ffn"].samples[:8] == [2.0 * k for k in range(8)] and got["blk.2.attn"].samples == [0, 1, 2, 3] and got["blk.3.attn"].samples == []
    assert [r.place for r in sorted(got.values(), key=lambda r: r.place)] == [0, 1, 2, 3]

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], ["kb"])

    assert max(r.kb for r in spark.range(0, 8, 1, 8).mapInArrow(held, "kb long").collect()) < 1 << 20


def test_headers(spark, tmp_path):
    words = name("words") + struct.pack("<IIQ", 9, 8, 5000) + b"".join(name(f"w{k}") for k in range(5000))
    numbers = name("numbers") + struct.pack("<IIQ", 9, 5, 3000) + bytes(12000)
    nested = name("nested") + struct.pack("<IIQ", 9, 9, 100) + (struct.pack("<IQ", 4, 1) + bytes(4)) * 100
    tensors = [(f"blk.{k}.x", 1, 0, 32 * k) for k in range(150)]
    (tmp_path / "m.gguf").write_bytes(header(tensors, words + numbers + nested, 8) + b"".join(struct.pack("<f", k).ljust(32, b"\0") for k in range(150)))
    (tmp_path / "short.gguf").write_bytes(header(tensors)[:500])
    (tmp_path / "none.gguf").write_bytes(b"")
    (tmp_path / "empty.gguf").write_bytes(header([]))
    (tmp_path / "_hidden").write_bytes(b"x")
    for step in (7, 64, 1000):
        rows = gguf.read_models(spark, str(tmp_path), tensors=step).collect()
        own = sorted((r.place, r.tensor, r.samples) for r in rows if r.error is None)
        assert own == [(k, f"blk.{k}.x", [float(k)]) for k in range(150)]
        assert sorted(os.path.basename(r.path) for r in rows if r.error) == ["none.gguf", "short.gguf"]
    assert gguf.read_models(spark, str(tmp_path / "m.gguf")).count() == 150
    os.makedirs(tmp_path / "void")
    assert gguf.read_models(spark, str(tmp_path / "void")).count() == 0


def test_many_small_model_files_are_few_tasks(spark, tmp_path):
    """Ranges of many files are dealt into tasks by their tensors; each range was a task of its own."""
    for k in range(300):
        (tmp_path / f"m{k:03d}.gguf").write_bytes(header([(f"blk.{j}.x", 1, 0, 32 * j) for j in range(3)]) + b"".join(struct.pack("<f", 10 * k + j).ljust(32, b"\0") for j in range(3)))
    (tmp_path / "n.gguf").write_bytes(b"no model")
    rows = gguf.read_models(spark, str(tmp_path), tensors=2)
    assert rows.rdd.getNumPartitions() <= 2 * gguf.LEAST_TASKS
    found = rows.collect()
    assert sorted((os.path.basename(r.path), r.tensor, r.samples) for r in found if r.error is None) == [(f"m{k:03d}.gguf", f"blk.{j}.x", [10.0 * k + j]) for k in range(300) for j in range(3)]
    assert [os.path.basename(r.path) for r in found if r.error] == ["n.gguf"]


def test_an_upload_larger_than_its_tasks_hold(spark, tmp_path):
    """400 MB in chunks of 1 MB that arrive in any order and in all tasks, some twice."""
    rows = spark.range(0, 420, 1, 12).select(F.lit("u").alias("upload_id"), F.pmod(F.col("id") * 7, F.lit(400)).alias("chunk"))
    data = F.expr("repeat(concat(lpad(cast(chunk as string), 15, '0'), '|'), 65536)").cast("binary")
    uploads.assemble(rows.withColumn("data", data), str(tmp_path), 1 << 20)
    whole = hashlib.sha256()
    for k in range(400):
        whole.update(f"{k:015d}|".encode() * 65536)
    got = uploads.digests(spark, str(tmp_path)).collect()
    assert [(os.path.basename(r.path), r.size, r.sha256) for r in got] == [("u", 400 << 20, whole.hexdigest())]


def test_uploads_with_holes_stay_unfinished(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, b"xy"), ("a", 2, b"z"), ("b", 0, b"")], "upload_id string, chunk long, data binary")
    with pytest.raises(Exception, match="missing or given twice: a"):
        uploads.assemble(chunks, str(tmp_path), 2)
    assert sorted(os.listdir(tmp_path)) == ["a.part", "b.part"]
    assert [(r.upload_id, r.length) for r in uploads.partial_uploads(uploads.listing(spark, str(tmp_path))).orderBy("upload_id").collect()] == [("a", 5)]  # files without bytes are no rows
    more = spark.createDataFrame([("a", 1, b"+-")], "upload_id string, chunk long, data binary")
    uploads.assemble(chunks.unionByName(more), str(tmp_path), 2, ".bin")
    assert (tmp_path / "a.bin").read_bytes() == b"xy+-z" and (tmp_path / "b.bin").read_bytes() == b"" and len(os.listdir(tmp_path)) == 2
    with pytest.raises(Exception, match="no name"):
        uploads.assemble(spark.createDataFrame([("../x", 0, b"z")], "upload_id string, chunk long, data binary"), str(tmp_path), 2)
    with pytest.raises(Exception, match="by position"):
        uploads.assemble(more, "s3://bucket/x", 2)


def test_sources_are_found_in_a_thread_without_session(spark, tmp_path):
    """Data sources are looked up in the calling thread's active session; queries that run beside each other in threads had none, or one that another test left."""
    chunks = spark.createDataFrame([("a", 0, header([]))], "upload_id string, chunk long, data binary")
    spark._jvm.org.apache.spark.sql.classic.SparkSession.clearActiveSession()
    uploads.assemble(chunks, str(tmp_path), 1 << 20, ".gguf")
    spark._jvm.org.apache.spark.sql.classic.SparkSession.clearActiveSession()
    assert [r.error for r in gguf.read_models(spark, str(tmp_path)).collect()] == []
