"""A folder of Parquet tables as the store: create, read, upsert, delete.

A table is a log of versions; each names the folders of Parquet files that are the table then. A write adds its files first and then the next version, by a rename that fails if
the version is there already. So a crash leaves the table as it was, readers keep the files they began with, appends add files and rewrite nothing, and of two writers
the later one begins again (an append) or gets a Conflict. Files that no late version names are deleted by vacuum alone.

Tables with a key are written in ranges of it, and beside each write lies an index: the least and greatest key of each file and a Bloom filter of its keys. An append is checked against the
files whose ranges meet its own, and a row is looked up in those that may hold its key.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import StoreSettings
from graphloom.errors import Conflict, NotFound, StoreFailed
from graphloom.sources.tables import DDL, schema

#: Versions that vacuum keeps, for readers that still use them, and times that an append is tried.
KEPT_VERSIONS, TRIES = 10, 20
#: The column that identifies a row, for tables that have one.
KEYS = {"nodes": "node_id", "models": "id", "model_nodes": "id", "upload_sessions": "upload_id", "namespaces": "name"}


#: Bits for each key of a file's Bloom filter, at least, and bits that a key sets.
BLOOM_BITS, BLOOM_HASHES = 10, 5
#: Keys whose places in a filter are worked out at once.
INDEX_SLICE = 1 << 16


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")]


def _places(bits: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(BLOOM_HASHES)])


def _may_hold(bloom: bytes, a: int, b: int) -> bool:
    filled = np.frombuffer(bloom, np.uint8)
    at = _places(8 * len(filled), np.array([a]), np.array([b]))[:, 0].astype(np.int64)
    return bool(((filled[at >> 3] >> (7 - (at & 7))) & 1).all())


def _file_index(table: pa.Table) -> pa.Table:
    """The row of one file's keys: null keys aside, least, greatest, and their filter."""
    bits = 8 * max(1, -(-BLOOM_BITS * table.num_rows // 8))
    filled = np.zeros(bits, bool)
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    for k in range(0, len(a), INDEX_SLICE):
        filled[_places(bits, a[k : k + INDEX_SLICE], b[k : k + INDEX_SLICE]).ravel().astype(np.int64)] = True
    ends = pc.min_max(table.column("key"))
    return pa.table([table.column("file").slice(0, 1).combine_chunks(), pa.array([ends["min"].as_py()], pa.string()), pa.array([ends["max"].as_py()], pa.string()), pa.array([np.packbits(filled).tobytes()])], ["file", "low", "high", "bloom"])


class Repository:
    """Tables below `base`, a folder that all executors reach, with the schemas of the knowledge model."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    @classmethod
    def connect(cls, spark: SparkSession, settings: StoreSettings) -> Repository:
        """The store that the settings name, initialised; an error if it doesn't answer."""
        store = cls(spark, f"{settings.url.rstrip('/')}/{settings.namespace}/{settings.database}")
        if not store.healthy():
            raise StoreFailed(f"{store.base} doesn't answer")
        store.initialise()
        return store

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        at, fs = self._path(name, "log"), self._fs()
        if not fs.exists(at):
            return []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json"))

    def _folders(self, name: str, version: int) -> list[str]:
        stream = self._fs().open(self._path(name, "log", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, version: int, folders: list[str]) -> bool:
        """Writes the log entry of a version; False if another writer was faster."""
        fs, jvm = self._fs(), self.spark._jvm
        made, final = self._path(name, "log", f"{uuid.uuid4().hex}.tmp"), self._path(name, "log", f"{version:012d}.json")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(made, final, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            fs.delete(made, False)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False

    def _store(self, name: str, rows: DataFrame) -> str:
        folder = f"f-{uuid.uuid4().hex}"
        full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
        path, key = f"{self.base}/{name}/{folder}", KEYS.get(name)
        if not key:
            full.write.parquet(path)
            return folder
        full.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
        files = self.spark.read.schema(full.schema).parquet(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(key).alias("key"), *_hashes(F.col(key)))
        files.groupBy("file").applyInArrow(_file_index, "file string, low string, high string, bloom binary").write.parquet(f"{self.base}/{name}/index/{folder}")
        return folder

    def _index(self, name: str, folders: list[str]) -> DataFrame:
        """folder, file, low, high and bloom of all files of these writes."""
        rows = self.spark.read.schema("file string, low string, high string, bloom binary").parquet(*(f"{self.base}/{name}/index/{x}" for x in folders))
        return rows.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))

    def _now(self, name: str) -> list[str]:
        known = self.versions(name)
        return self._folders(name, known[-1]) if known else []

    def files_of(self, name: str, key: str) -> list[str]:
        """The files that may hold a key."""
        folders = self._now(name)
        if not folders:
            return []
        near = self._index(name, folders).filter((F.col("low") <= key) & (F.col("high") >= key)).withColumns({"a": _hashes(F.lit(key))[0], "b": _hashes(F.lit(key))[1]}).collect()  # a row for each file whose range has the key
        return sorted(f"{self.base}/{name}/{r.folder}/{r.file}" for r in near if _may_hold(bytes(r.bloom), r.a, r.b))

    def _check_new(self, name: str, rows: DataFrame, folders: list[str]) -> None:
        """Raises a Conflict if a key of rows is in these folders."""
        key = KEYS[name]
        ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        if not folders or ends.low is None:
            return
        near = [f"{self.base}/{name}/{r.folder}/{r.file}" for r in self._index(name, folders).filter((F.col("low") <= ends.high) & (F.col("high") >= ends.low)).select("folder", "file").collect()]
        if near and (clash := self.spark.read.schema(schema(name)).parquet(*near).select(key).join(rows.select(key), key, "left_semi").first()):
            raise Conflict(f"{name} has {clash[0]} already")

    def initialise(self) -> None:
        """Empty tables where there are none, and the global namespace, once."""
        for name in DDL:
            if not self.versions(name):
                self._commit(name, 0, [])
        seed = self.spark.createDataFrame([("global_knowledge", "global", "Shared knowledge")], "name string, namespace_type string, description string").withColumn("created_at", F.current_timestamp())
        new = seed.join(self.read("namespaces").select("name"), "name", "left_anti")
        if not new.isEmpty():
            self.append("namespaces", new)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of its last version, or of an earlier one that vacuum has kept."""
        known = self.versions(name)
        if version is not None and version not in known:
            raise NotFound(f"{name} has no version {version}")
        folders = self._folders(name, known[-1] if version is None else version) if known else []
        if not folders:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(*(f"{self.base}/{name}/{x}" for x in folders))

    def get(self, name: str, key: str) -> DataFrame:
        """The row with this id, or none, from the files that may hold it."""
        files = self.files_of(name, key)
        rows = self.spark.read.schema(schema(name)).parquet(*files) if files else self.spark.createDataFrame([], schema(name))
        return rows.filter(F.col(KEYS[name]) == key)

    def exists(self, name: str) -> bool:
        """Whether the table has any row, in any namespace."""
        return not self.read(name).isEmpty()

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; what is there isn't rewritten. Of a table with a key, a Conflict if a key comes twice or is there already."""
        key, checked = KEYS.get(name), set()
        if key and (twice := rows.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).first()):
            raise Conflict(f"{name} gets {twice[0]} twice")
        folder = self._store(name, rows)
        for _ in range(TRIES):
            known = self.versions(name)
            before = self._folders(name, known[-1]) if known else []
            if key:
                self._check_new(name, self.spark.read.schema(schema(name)).parquet(f"{self.base}/{name}/{folder}"), [x for x in before if x not in checked])
                checked.update(before)
            if self._commit(name, known[-1] + 1 if known else 0, [*before, folder]):
                return
        raise Conflict(f"{name}: {TRIES} other writes came first")

    def replace(self, name: str, rows: DataFrame, seen: int | None = None) -> None:
        """The rows as the whole table. seen: the version that they were made from; a Conflict if there is a later one."""
        known = self.versions(name)
        last = known[-1] if known else -1
        if seen is None:
            seen = last
        if seen != last or not self._commit(name, seen + 1, [self._store(name, rows)]):
            raise Conflict(f"{name} was written meanwhile")

    def compact(self, name: str) -> None:
        """The same rows in one folder."""
        known = self.versions(name)
        if known and len(self._folders(name, known[-1])) > 1:
            self.replace(name, self.read(name, known[-1]), known[-1])

    def vacuum(self, name: str, keep: int = KEPT_VERSIONS) -> int:
        """Deletes all but the last versions, and the folders that none of those names; returns the number of folders."""
        known = self.versions(name)
        late = known[-keep:]
        needed = {x for v in late for x in self._folders(name, v)}
        gone = {x for v in known[:-keep] for x in self._folders(name, v)} - needed
        for version in known[:-keep]:
            self._fs().delete(self._path(name, "log", f"{version:012d}.json"), False)
        for folder in gone:
            self._fs().delete(self._path(name, folder), True)
            self._fs().delete(self._path(name, "index", folder), True)
        return len(gone)

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        """Replaces rows with equal keys and adds the others. Of new rows with one key the last updated one counts, ties by hash."""
        known = self.versions(name)
        last = known[-1] if known else -1
        order = [F.desc_nulls_last("updated_at")] if "updated_at" in rows.columns else []
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.xxhash64(*rows.columns)))
        new = rows.withColumn("_place", place).filter("_place = 1").drop("_place")
        new = new.select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
        kept = self.read(name).join(new.select(key), key, "left_anti").select(*schema(name).names)
        self.replace(name, kept.unionByName(new), last)

    def update(self, name: str, where: Column, **changes: Column) -> int:
        """Sets columns of the rows for which a condition is true, and returns their number."""
        known = self.versions(name)
        rows = self.read(name)
        changed = rows.filter(where).count()
        if changed:
            own = F.coalesce(where, F.lit(False))
            self.replace(name, rows.select(*(F.when(own, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns)), known[-1])
        return changed

    def delete(self, name: str, where: Column) -> int:
        """Deletes the rows for which a condition is true, and returns their number."""
        known = self.versions(name)
        rows = self.read(name)
        gone = rows.filter(where).count()
        if gone:
            self.replace(name, rows.filter(~F.coalesce(where, F.lit(False))), known[-1])
        return gone

    def delete_model(self, model_id: str) -> int:
        """A model and its nodes; returns the number of nodes."""
        self.delete("models", F.col("id") == model_id)
        return self.delete("model_nodes", F.col("model_id") == model_id)

    def healthy(self) -> bool:
        """Whether the store answers: its folder can be listed, or created, and a job runs."""
        try:
            return bool(self._fs().exists(self._path()) or self._fs().mkdirs(self._path())) and self.spark.range(1).count() == 1
        except Py4JJavaError:
            return False
