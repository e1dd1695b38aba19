"""Unique keys, key lookups that open few files, and the table of embeddings."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import Conflict
from graphloom.sources.repository import Repository
from graphloom.streaming.cache import EmbeddingCache


def models(spark, keys):
    return spark.createDataFrame([(f"m{k:04d}", f"name {k}") for k in keys], "id string, name string")


def test_keys(spark, tmp_path):
    store = Repository(spark, str(tmp_path / "store"))
    store.append("models", models(spark, range(0, 400, 2)).repartition(3))
    store.append("models", models(spark, range(1, 400, 2)))
    for keys in ([7], [500, 8], [399, 600]):
        with pytest.raises(Conflict, match="already"):
            store.append("models", models(spark, keys))
    with pytest.raises(Conflict, match="twice"):
        store.append("models", models(spark, [700, 700]))
    store.append("models", models(spark, range(700, 720)))
    assert store.read("models").count() == 420
    files = sum(1 for x in (tmp_path / "store" / "models").glob("f-*/*.parquet"))
    assert files >= 5
    opened = [store.files_of("models", f"m{k:04d}") for k in (0, 77, 398, 399, 710)]
    assert all(len(x) in (1, 2) for x in opened) and sum(map(len, opened)) <= 6  # of all files
    assert [store.get("models", f"m{k:04d}").first().name for k in (0, 77, 710)] == ["name 0", "name 77", "name 710"]
    assert store.files_of("models", "zzz") == [] and store.get("models", "zzz").count() == 0 and store.get("models", "m0450").count() == 0
    store.upsert("models", models(spark, [7, 900]).withColumn("name", F.lit("new")), "id")
    assert store.get("models", "m0007").first().name == "new" and store.read("models").count() == 421
    assert store.vacuum("models", 1) and store.get("models", "m0077").count() == 1
    none = Repository(spark, str(tmp_path / "none"))
    none.initialise()
    assert none.get("models", "x").count() == 0 and none.files_of("nodes", "x") == []
    none.append("models", models(spark, []))
    assert none.read("models").count() == 0


def test_embedding_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        assert 0 < len(texts) <= 4 and all(x.strip() for x in texts)
        return [[float(len(x))] for x in texts]

    at = lambda hours: F.timestamp_seconds(F.lit(int(1704067200 + 3600 * hours)))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["a", "bb", "a", " ", None, "ccc", "é", ""] + [f"t{k}" for k in range(30)])], "id long, text string")
    cache = EmbeddingCache(spark, str(tmp_path / "v"), "m", embed, hours=1.5, batch=4)
    found, made = cache.vectors(rows, at(0))
    assert made == 34 == calls.value and {r.id: r.vector[0] for r in found.collect()}[2] == 1.0 and found.count() == 35
    assert cache.vectors(rows, at(1))[1] == 0 and calls.value == 34
    more = rows.unionByName(spark.createDataFrame([(99, "new")], "id long, text string"))
    assert cache.vectors(more, at(1))[1] == 1
    again, made = cache.vectors(more, at(2))  # all but the last have expired
    assert made == 34 and again.count() == 36 and cache.rows().count() == 69 and cache.swept(at(2)).count() == 35
    other = EmbeddingCache(spark, str(tmp_path / "v"), "other", embed, batch=4)
    assert other.vectors(rows.limit(1), at(0))[1] == 1 and cache.vectors(rows.limit(0), at(0))[1] == 0


def test_a_files_filter_is_filled_by_slices():
    """All places of a file's keys were held at once: 98 bytes for each key, with the filter."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from graphloom.sources import repository

    rng = np.random.default_rng(8)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, 300_000))
    table = pa.table({"file": pa.array(["x"]).take(pa.array(np.zeros(300_000, int))), "key": pa.array(a).cast("string"), "a": a, "b": b})
    tracemalloc.start()
    row = repository._file_index(table).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 300_000
    assert all(repository._may_hold(row["bloom"], int(a[k]), int(b[k])) for k in range(0, 300_000, 9973))
