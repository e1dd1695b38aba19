"""Caches: a table of embeddings with lifetimes, and an LRU cache as a stateful operator, the same steps replayed in batch and kept as state of a stream.

Operations of the latter are rows of cache, at (timestamp), op (get, put, remove, cleanup), key, value and ttl_seconds (null: the cache's default; negative: none). Eviction is global to a cache, so all of a
cache's operations pass through one state: what can be spread is the number of caches. The state holds at most `capacity` entries.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import written
from graphloom.functions.vectors import fnv1a

METRICS = ("hits", "misses", "evictions", "expirations", "size")


@dataclass
class LruState:
    capacity: int = 1000
    ttl: float | None = 3600.0
    entries: OrderedDict = field(default_factory=OrderedDict)  # key: [value, expiry or null, access count], least recently used first
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    expirations: int = 0

    def get(self, key: str, now: float):
        """The value, or null; an expired entry is removed and counts as a miss. A hit makes the entry the most recent."""
        entry = self.entries.get(key)
        if entry and entry[1] is not None and now > entry[1]:
            del self.entries[key]
            self.expirations += 1
            entry = None
        if entry is None:
            self.misses += 1
            return None
        self.hits += 1
        entry[2] += 1
        self.entries.move_to_end(key)
        return entry[0]

    def put(self, key: str, value, now: float, ttl: float | None = None) -> None:
        life = self.ttl if ttl is None else ttl
        if key not in self.entries and len(self.entries) >= self.capacity:
            self.evictions += 1
            self.entries.popitem(last=False)
        self.entries[key] = [value, None if life is None or life < 0 else now + life, 1]
        self.entries.move_to_end(key)

    def remove(self, key: str) -> None:
        self.entries.pop(key, None)

    def cleanup(self, now: float) -> int:
        gone = [k for k, (_, expiry, _) in self.entries.items() if expiry is not None and now > expiry]
        for k in gone:
            del self.entries[k]
        self.expirations += len(gone)
        return len(gone)

    def apply(self, op: str, key: str, value, now: float, ttl: float | None):
        if op == "get":
            return self.get(key, now)
        if op == "put":
            self.put(key, value, now, ttl)
        elif op == "remove":
            self.remove(key)
        elif op == "cleanup":
            self.cleanup(now)
        return None

    def metrics(self) -> dict:
        return {k: len(self.entries) if k == "size" else getattr(self, k) for k in METRICS}

    def dump(self) -> str:
        return json.dumps(asdict(self) | {"entries": list(self.entries.items())})

    @classmethod
    def load(cls, text: str) -> LruState:
        raw = json.loads(text)
        return cls(**(raw | {"entries": OrderedDict((k, v) for k, v in raw["entries"])}))


def _steps(state: LruState, rows: pd.DataFrame) -> None:
    rows = rows.sort_values(["at", "seq"], kind="stable")
    for op, key, value, at, ttl in zip(rows["op"], rows["key"], rows["value"], rows["at"], rows["ttl_seconds"], strict=True):
        state.apply(op, key, value, at.timestamp(), None if pd.isna(ttl) else float(ttl))


def replay(ops: DataFrame, capacity: int = 1000, ttl: float | None = 3600.0) -> DataFrame:
    """cache, hits, misses, evictions, expirations, size and hit_rate after all operations of each cache, in order of at, then seq. Operations are read as a sorted stream; only the state is held."""
    columns = ("cache", "at", "seq", "op", "key", "value", "ttl_seconds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for rows in batches:
            for name, part in rows.groupby("cache", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if state is not None and name != now:
                    yield pd.DataFrame([{"cache": now} | state.metrics()])
                    state = None
                now, state = name, state or LruState(capacity, ttl)
                _steps(state, part)
        if state is not None:
            yield pd.DataFrame([{"cache": now} | state.metrics()])

    dealt = ops.select(*columns).repartition("cache").sortWithinPartitions("cache", "at", "seq")
    out = dealt.mapInPandas(run, "cache string, " + ", ".join(f"{k} long" for k in METRICS))
    return out.withColumn("hit_rate", hit_rate())


def hit_rate():
    total = F.col("hits") + F.col("misses")
    return F.when(total == 0, 0.0).otherwise(F.col("hits") / total)


def stream(ops: DataFrame, capacity: int = 1000, ttl: float | None = 3600.0) -> DataFrame:
    """The same for a stream: a row of metrics for each cache and micro-batch (output mode update)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = LruState.load(kept.get[0]) if kept.exists else LruState(capacity, ttl)
        rows = pd.concat(list(batches))  # of one cache and micro-batch
        _steps(state, rows)
        kept.update((state.dump(),))
        yield pd.DataFrame([{"cache": key[0]} | state.metrics()])

    return ops.groupBy("cache").applyInPandasWithState(run, "cache string, " + ", ".join(f"{k} long" for k in METRICS), "state string", "update", GroupStateTimeout.NoTimeout)


#: Texts that an embedder gets at once, and how long their vectors are good.
EMBED_BATCH, EMBED_HOURS = 32, 24


class EmbeddingCache:
    """Vectors of texts, kept in a folder of Parquet files: key (FNV-1a of the text), digest (a second hash, as keys may clash), model, vector, expires. Only distinct texts that are unknown or expired
    are embedded, in batches; what they give is appended, so that runs one after another share it. Of several vectors of a text the last to expire counts."""

    SCHEMA = "key decimal(20,0), digest long, model string, vector array<double>, expires timestamp"

    def __init__(self, spark: SparkSession, folder: str, model: str, embed: Callable[[list[str]], list[list[float]]], hours: float = EMBED_HOURS, batch: int = EMBED_BATCH):
        self.spark, self.folder, self.model, self.embed, self.hours, self.batch = spark, folder, model, embed, hours, batch

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def live(self, now: Column) -> DataFrame:
        """key, digest and vector of what hasn't expired."""
        good = self.rows().filter((F.col("model") == self.model) & (F.col("expires") > now))
        return good.groupBy("key", "digest").agg(F.max_by("vector", "expires").alias("vector"))

    def vectors(self, texts: DataFrame, now: Column, id_col: str = "id", text: str = "text") -> tuple[DataFrame, int]:
        """id and vector of each text that isn't blank, and how many texts had to be embedded."""
        key, digest = fnv1a(F.col(text)).cast("decimal(20,0)"), F.xxhash64(text)
        asked = written(texts.filter(F.trim(text) != "").select(F.col(id_col).alias("id"), F.col(text).alias("text"), key.alias("key"), digest.alias("digest")))
        wanted = asked.join(self.live(now).select("key", "digest"), ["key", "digest"], "left_anti").groupBy("key", "digest").agg(F.min("text").alias("text"))
        embed, size = self.embed, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, rows.num_rows, size):
                    part = rows.slice(at, size)
                    found = pa.array(embed(part.column("text").to_pylist()), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("digest"), found], ["key", "digest", "vector"])

        made = written(wanted.mapInArrow(run, "key decimal(20,0), digest long, vector array<double>"))
        count = made.count()
        if count:
            life = F.make_dt_interval(hours=F.lit(int(self.hours)), mins=F.lit(round(self.hours % 1 * 60)))
            made.select("key", "digest", F.lit(self.model).alias("model"), "vector", (now + life).cast("timestamp").alias("expires")).write.mode("append").parquet(self.folder)
        return asked.select("id", "key", "digest").join(self.live(now), ["key", "digest"]).select(F.col("id").alias(id_col), "vector"), count

    def swept(self, now: Column) -> DataFrame:
        """The rows that a cleanup keeps: one for each live text."""
        good = self.rows().filter(F.col("expires") > now)
        return good.groupBy("key", "digest", "model").agg(F.max_by("vector", "expires").alias("vector"), F.max("expires").alias("expires"))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't materialised yet: what a cache of computed columns still has to compute, each key once."""
    return rows.join(known.select(key), key, "left_anti").dropDuplicates([key])
