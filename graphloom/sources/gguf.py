"""Model files in the GGUF format, version 3, as a data source of rows: architecture, tensors and sampled tensor values."""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.common import register

#: Fixed values of the format: magic, alignment of tensor data, and the struct code of each scalar value type by its number.
MAGIC, ALIGNMENT = b"GGUF", 32
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9
#: Tensor types by number, and those that are stored in blocks of 32 with their bytes a block.
F32, F16, BF16 = 0, 1, 30
Q4_TYPES, Q8_TYPES, BLOCK, Q4_BYTES, Q8_BYTES = (2, 3, 12), (8, 9, 15), 32, 18, 34
MOST_SAMPLES, MOST_BLOCKS, DEFAULT_VOCABULARY = 256, 64, 32000
#: Items of a header's array that are kept, tensors of a range, and bytes that are read at once for samples that lie near each other.
MOST_ITEMS, RANGE_TENSORS, MOST_SPAN = 64, 64, 1 << 20
#: Tasks that ranges are dealt into before a task gets several, and tensors of such a task at most: a task costs as much as some hundred tensors.
LEAST_TASKS, TASK_TENSORS = 64, 4096


class Reader:
    """Values of a header, read on from where a file stands."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size

    def bytes(self, n: int) -> bytes:
        if self.file.tell() + n > self.size:
            raise ValueError("a value runs beyond the file")
        return self.file.read(n)

    def take(self, code: str):
        return struct.unpack("<" + code, self.bytes(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.bytes(self.take("Q")).decode()

    def value(self, kind: int):
        """A value; of an array, which may be a vocabulary, its first MOST_ITEMS."""
        if kind == STRING:
            return self.text()
        if kind == ARRAY:
            inner, size = self.take("I"), self.take("Q")
            held = [self.value(inner) for _ in range(min(size, MOST_ITEMS))]
            if inner in SCALARS and size > MOST_ITEMS:
                self.skip((size - MOST_ITEMS) * struct.calcsize("<" + SCALARS[inner]))
            else:
                for _ in range(size - len(held)):
                    self.skip(self.take("Q")) if inner == STRING else self.value(inner)
            return held
        if kind not in SCALARS:
            raise ValueError(f"no value type {kind}")
        return self.take(SCALARS[kind])

    def skip(self, n: int) -> None:
        if self.file.tell() + n > self.size:
            raise ValueError("a value runs beyond the file")
        self.file.seek(n, io.SEEK_CUR)


def counts(file: BinaryIO, size: int) -> tuple[int, int, int]:
    """Version, tensors and metadata values, from the first 24 bytes."""
    if file.read(4) != MAGIC:
        raise ValueError("not a GGUF file")
    r = Reader(file, size)
    return r.take("I"), r.take("Q"), r.take("Q")


def parse(file: BinaryIO, size: int, first: int = 0, last: int | None = None) -> dict:
    """Version, metadata as key: (type, value), tensors (name, dimensions, type, offset) first to last of all, and where their data begins."""
    version, tensors, values = counts(file, size)
    r = Reader(file, size)
    metadata = {}
    for _ in range(values):
        key, kind = r.text(), r.take("I")
        metadata[key] = (kind, r.value(kind))
    found = []
    for place in range(tensors):
        name = r.text()
        dimensions = [r.take("Q") for _ in range(r.take("I"))]
        tensor = {"place": place, "name": name, "dimensions": dimensions, "type": r.take("I"), "offset": r.take("Q")}
        if first <= place and (last is None or place < last):
            found.append(tensor)
    return {"version": version, "metadata": metadata, "tensors": found, "data_offset": -(-file.tell() // ALIGNMENT) * ALIGNMENT}


def architecture(metadata: dict) -> dict:
    """The model's shape. Only 32- and 64-bit unsigned numbers count; missing required keys raise an error."""

    def number(key: str) -> int | None:
        kind, value = metadata.get(key, (None, None))
        return value & 0xFFFFFFFF if kind in (4, 10) else None

    kind, name = metadata.get("general.architecture", (None, None))
    if kind != STRING:
        raise ValueError("general.architecture is missing")
    out = {"model_type": name}
    for field, key in (("n_layers", "block_count"), ("embedding_dim", "embedding_length"), ("n_heads", "attention.head_count"), ("ffn_dim", "feed_forward_length")):
        if (value := number(f"{name}.{key}")) is None:
            raise ValueError(f"{name}.{key} is missing")
        out[field] = value
    words = [number("tokenizer.ggml.tokens.length"), number(f"{name}.vocab_size"), DEFAULT_VOCABULARY]
    return out | {"vocab_size": next(x for x in words if x is not None)}


def gather(file: BinaryIO, size: int, places: np.ndarray, width: int) -> np.ndarray:
    """Rows of width bytes at ascending places; those that run beyond the file are left out. Near places are read at once, far ones each by itself."""
    places = places[places + width <= size]
    if not len(places):
        return np.zeros((0, width), np.uint8)
    if (span := int(places[-1]) + width - int(places[0])) <= MOST_SPAN:
        file.seek(int(places[0]))
        return np.frombuffer(file.read(span), np.uint8)[(places - places[0])[:, None] + np.arange(width)]
    rows = np.empty((len(places), width), np.uint8)
    for k, at in enumerate(places.tolist()):
        file.seek(at)
        rows[k] = np.frombuffer(file.read(width), np.uint8)
    return rows


def sample(file: BinaryIO, size: int, tensor: dict, data_offset: int, compat: bool = False) -> np.ndarray:
    """Up to MOST_SAMPLES values of a tensor at even steps; finite ones only. compat reads BF16 as F16, as some tools do."""
    begin, values = data_offset + tensor["offset"], int(np.prod(tensor["dimensions"], dtype=np.uint64)) if tensor["dimensions"] else 1
    if begin >= size or values == 0:
        return np.zeros(0)
    many = min(MOST_SAMPLES, values)
    step = max(1, values // many)
    kind = tensor["type"]
    strided = lambda dtype, count, apart: np.ascontiguousarray(gather(file, size, begin + np.arange(count, dtype=np.int64) * apart, np.dtype(dtype).itemsize)).view(dtype).ravel()
    if kind == F32:
        x = strided("<f4", many, 4 * step).astype(float)
        return x[np.isfinite(x) & (np.abs(x) < 1e6)]
    if kind in (F16, BF16):
        raw = strided("<u2", many, 2 * step)
        x = raw.view(np.float16).astype(float) if kind == F16 or compat else (raw.astype(np.uint32) << 16).view(np.float32).astype(float)
        return x[np.isfinite(x)]
    if kind in Q4_TYPES or kind in Q8_TYPES:
        width, many = (Q4_BYTES, 4) if kind in Q4_TYPES else (Q8_BYTES, 8)
        blocks = np.arange(0, -(-values // BLOCK), max(1, step // BLOCK))[:MOST_BLOCKS]
        rows = gather(file, size - (width - 2 - many), begin + blocks * width, 2 + many)  # whole blocks only
        scale = np.ascontiguousarray(rows[:, :2]).view("<f2").astype(float)
        packed = rows[:, 2:]
        quants = np.stack([packed & 15, packed >> 4], 2).reshape(len(rows), -1).astype(int) - 8 if kind in Q4_TYPES else np.ascontiguousarray(packed).view(np.int8).astype(int)
        x = (quants * scale).ravel()
        return x[np.isfinite(x)]
    x = strided("<f4", min(64, many), step).astype(float)
    return np.clip(x[~np.isnan(x)], -1e6, 1e6)


def fold(samples: list[tuple[str, np.ndarray]], dimension: int) -> np.ndarray:
    """A unit vector: sample i of a tensor is added at (31 i + length of its name) mod dimension; scaled by the root of the number of samples."""
    out, count = np.zeros(dimension), 0
    for name, x in samples:
        np.add.at(out, (31 * np.arange(len(x)) + len(name.encode())) % dimension, x)
        count += len(x)
    out = out / np.sqrt(count) if count else out
    length = np.sqrt((out * out).sum())
    return out / length if length > 1e-8 else out


ARCHITECTURE = ("n_layers", "embedding_dim", "vocab_size", "n_heads", "ffn_dim")
SCHEMA = f"path string, architecture struct<model_type:string,{','.join(f'{k}:long' for k in ARCHITECTURE)}>, place long, tensor string, dimensions array<long>, tensor_type long, samples array<double>, error string"


@dataclass
class TensorRange:
    """Tensors first to last of a file; error: why its beginning can't be read."""

    path: str
    size: int
    first: int
    last: int
    error: str | None = None


@dataclass
class Ranges(InputPartition):
    """What a task reads: ranges in the order of their files."""

    ranges: list[TensorRange]


class GgufReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("load() needs the path of a file or folder")
        self.path, self.tensors, self.compat = options["path"], int(options.get("tensors", RANGE_TENSORS)), options.get("compat", "false").lower() == "true"

    def partitions(self) -> list[Ranges]:
        """Ranges of all files, those that lie beside each other dealt into tasks. Of each file, 24 bytes are read here; each task reads on in the headers to its own ranges."""
        system, root = FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path.removeprefix("file:"))
        info = system.get_file_info(root)
        files = [info] if info.is_file else [x for x in system.get_file_info(FileSelector(root)) if x.is_file and not x.base_name.startswith((".", "_"))]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            try:
                with system.open_input_file(x.path) as file:
                    n = counts(file, x.size)[1]
                out += [TensorRange(x.path, x.size, k, min(n, k + self.tensors)) for k in range(0, max(1, n), self.tensors)]
            except (ValueError, struct.error) as e:
                out.append(TensorRange(x.path, x.size, 0, 0, str(e)))
        weights = [max(1, x.last - x.first) for x in out]
        most, tasks, held = min(TASK_TENSORS, -(-sum(weights) // LEAST_TASKS)), [Ranges([])], 0
        for x, weight in zip(out, weights, strict=True):
            if tasks[-1].ranges and held + weight > most:
                tasks.append(Ranges([]))
                held = 0
            tasks[-1].ranges.append(x)
            held += weight
        return tasks

    def _rows(self, ranges: list[TensorRange]) -> Iterator[list[tuple]]:
        """The rows of each range of one file, whose header is read once."""
        path, size, first = ranges[0].path, ranges[0].size, ranges[0].first
        try:
            if ranges[0].error:
                raise ValueError(ranges[0].error)
            system = FileSystem.from_uri(self.path)[0] if "://" in self.path else LocalFileSystem()
            with system.open_input_file(path) as file:
                model = parse(BufferedHeader(file), size, first, ranges[-1].last)
                arch = architecture(model["metadata"])
                for x in ranges:
                    own = model["tensors"][x.first - first : x.last - first]
                    yield [(path, arch, t["place"], t["name"], t["dimensions"], t["type"], sample(file, size, t, model["data_offset"], self.compat).tolist(), None) for t in own]
        except (ValueError, struct.error, UnicodeDecodeError) as e:
            yield [(path, None, None, None, None, None, None, str(e))] * (first == 0)

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.struct([("model_type", pa.string()), *((k, pa.int64()) for k in ARCHITECTURE)]), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()), pa.string()]
        names = ["path", "architecture", "place", "tensor", "dimensions", "tensor_type", "samples", "error"]
        for _, ranges in itertools.groupby(part.ranges, lambda x: x.path):
            for rows in self._rows(list(ranges)):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class BufferedHeader:
    """A file's beginning read by blocks: a header has many small values."""

    def __init__(self, file, block: int = 1 << 16):
        self.file, self.block, self.at, self.held, self.begin = file, block, 0, b"", 0

    def tell(self) -> int:
        return self.at

    def seek(self, n: int, whence: int = io.SEEK_CUR) -> None:
        self.at = self.at + n if whence == io.SEEK_CUR else n

    def read(self, n: int) -> bytes:
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.held):
            self.file.seek(self.at)
            self.begin, self.held = self.at, self.file.read(max(n, self.block))
        out = self.held[self.at - self.begin : self.at - self.begin + n]
        self.at += n
        return out


class Gguf(DataSource):
    """spark.read.format("gguf").load(path): a row for each tensor of the files of a folder, with its samples, or one with the error of a file that can't be read. A range has `tensors` tensors of
    one file, whose samples are sought; a task has a range, or several where there are many. No file is held, so their size has no bound. Paths are those of pyarrow's file systems. Option compat: see sample()."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GgufReader:
        return GgufReader(self.options)


def read_models(spark: SparkSession, path: str, compat: bool = False, tensors: int | None = None) -> DataFrame:
    register(spark, Gguf)
    return spark.read.format("gguf").option("compat", str(compat).lower()).option("tensors", tensors or RANGE_TENSORS).load(path)


def layer_groups(tensors: DataFrame) -> DataFrame:
    """Groups of layers of each model: special tensors (no layer number), then max(1, layers / 6) layers to a group; parameters, tensors and type of each."""
    from graphloom.functions.rules import layer_number

    layers, number = F.col("architecture.n_layers"), layer_number(F.col("tensor"))
    width = F.greatest(F.lit(1), F.floor(layers / 6))
    start = F.floor(number / width) * width
    placed = tensors.filter("error is null").withColumn("layer", number).withColumn("start", start.cast("int")).withColumn("end", F.when(number.isNotNull(), F.least(start + width - 1, layers - 1)).cast("int")).filter((F.col("layer") < layers) | F.col("layer").isNull())
    has = lambda *parts: F.bool_or(F.reduce(F.array(*(F.contains("tensor", F.lit(p)) for p in parts)), F.lit(False), lambda a, b: a | b))
    size = F.aggregate("dimensions", F.lit(1).cast("long"), lambda a, x: a * x)
    grouped = placed.groupBy("path", "start", "end").agg(
        F.count("*").alias("tensors"), F.sum(size).alias("total_params"), has("attn", "attention").alias("attn"), has("ffn", "mlp").alias("ffn"), F.array_sort(F.collect_list(F.struct("place", "tensor", "samples"))).alias("members"), F.first("architecture.embedding_dim").alias("embedding_dim")
    )
    kind = F.when(F.col("start").isNull(), "embedding").when(F.col("attn") & F.col("ffn"), "transformer").when(F.col("attn"), "attention").when(F.col("ffn"), "feedforward").otherwise("mixed")
    return grouped.select("path", F.coalesce("start", F.lit(0)).alias("layer_start"), F.coalesce("end", F.lit(0)).alias("layer_end"), kind.alias("layer_type"), "tensors", "total_params", "members", "embedding_dim")


def group_vectors(groups: DataFrame, dimension: int = 768) -> DataFrame:
    """groups with `vector`, the folded samples of its tensors; a group's samples are at most MOST_SAMPLES for each tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [fold([(m["tensor"], np.array(m["samples"])) for m in members], dimension).tolist() for members in batch.column("members").to_pylist()]
            rest = batch.drop_columns(["members", "embedding_dim"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(vectors, pa.list_(pa.float64()))], [*rest.schema.names, "vector"])

    kinds = {k: v for k, v in groups.dtypes if k not in ("members", "embedding_dim")}
    return groups.select(*kinds, "members", "embedding_dim").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", vector array<double>")
