import datetime as dt
import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.config import IngestionSettings
from graphloom.errors import Conflict, NotFound
from graphloom.plans import api
from graphloom.sources import gguf
from graphloom.sources.repository import Repository
from graphloom.streaming import cache, uploads
from graphloom.streaming.cache import LruState


def test_lru_state():
    s = LruState(3, None)
    for k in "123":
        s.put(k, k, 0)
    assert s.get("1", 0) == "1"
    s.put("4", "4", 0)
    assert s.get("2", 0) is None and s.get("1", 0) == "1" and s.evictions == 1
    t = LruState(3, 0.05)
    t.put("a", 1, 0)
    t.put("b", 2, 0, ttl=-1)
    assert t.get("a", 0.04) == 1 and t.get("a", 0.2) is None and t.get("b", 99) == 2
    assert t.metrics() == {"hits": 2, "misses": 1, "evictions": 0, "expirations": 1, "size": 1}
    t.put("c", 3, 100)
    assert t.cleanup(200) == 1 and LruState.load(t.dump()).metrics() == t.metrics()


OPS = "cache string, at timestamp, seq long, op string, key string, value string, ttl_seconds double"


def operations():
    at = dt.datetime(2024, 1, 1)
    return [("c", at + dt.timedelta(seconds=k), k, "put" if k % 3 == 0 else "get", str(k % 7), "v", None) for k in range(60)]


def test_cache_replay_and_stream_agree(spark, tmp_path):
    rows = operations()
    whole = cache.replay(spark.createDataFrame(rows, OPS), 3, 20.0).first()
    state = LruState(3, 20.0)
    for _, at, _, op, key, value, ttl in rows:
        state.apply(op, key, value, at.timestamp(), ttl)
    assert {k: whole[k] for k in cache.METRICS} == state.metrics()
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    source = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    run = cache.stream(source, 3, 20.0).writeStream.outputMode("update").format("memory").queryName("lru").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("lru").collect()
    assert len(got) == 3 and {k: max(r[k] for r in got) for k in ("hits", "misses")} == {k: whole[k] for k in ("hits", "misses")}


def test_upload_sessions(spark, tmp_path):
    now = dt.datetime(2024, 1, 3)
    sessions = spark.createDataFrame([(1, 10, "uploading", now), (2, 2, "uploading", now - dt.timedelta(hours=30)), (3, 0, "ready", now)], "upload_id long, total_chunks long, status string, created_at timestamp")
    arrivals = spark.createDataFrame([(1, 0), (1, 2), (1, 4), (1, 4), (2, 0), (2, 1)], "upload_id long, chunk long")
    got = {r.upload_id: r for r in uploads.received(sessions, arrivals).collect()}
    assert got[1].missing == [1, 3, 5, 6, 7, 8, 9] and got[1].upload_progress == 30 and got[2].missing == [] and got[3].missing == []
    assert [r.upload_id for r in uploads.may_finalize(uploads.received(sessions, arrivals)).collect()] == [2]
    assert [r.upload_id for r in uploads.expired(sessions, F.lit(now)).collect()] == [2]
    assert [r.status for r in uploads.move(sessions.orderBy("upload_id"), "finalizing").collect()] == ["finalizing", "finalizing", "ready"]
    data = [(1, 1, bytearray(b"lo"), None), (1, 0, bytearray(b"hel"), hashlib.sha256(b"hel").hexdigest().upper()), (1, 0, bytearray(b"hel"), "bad")]
    chunks = spark.createDataFrame(data, "upload_id long, chunk long, data binary, checksum string")
    assert sorted(r.valid for r in uploads.verified(chunks).collect()) == [False, True, True]
    uploads.assemble(chunks, str(tmp_path), suffix=".bin")
    whole = uploads.digests(spark, str(tmp_path)).first()
    assert (tmp_path / "1.bin").read_bytes() == b"hello" and whole.sha256 == hashlib.sha256(b"hello").hexdigest() and whole.size == 5


def test_arrival_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 0, at), (1, 1, at), (1, 1, at), (2, 0, at), (3, 0, at + dt.timedelta(days=3)), (3, 1, at + dt.timedelta(days=3)), (4, 0, at + dt.timedelta(days=3))]
    schema = "upload_id long, chunk long, at timestamp"
    for k in range(0, 7, 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = uploads.arrival_stream(source, 2).writeStream.outputMode("update").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.upload_id, r.status) for r in spark.table("arrived").collect()}
    assert {(1, "finalizing"), (3, "finalizing"), (2, "uploading"), (4, "uploading"), (2, "cancelled")} <= got


def test_progress(spark):
    rows = [("t", dt.datetime(2024, 1, 1, 0, k), stage, k, 0, 4) for k, stage in enumerate(["extracting", "chunking", "embedding"])]
    assert uploads.latest_progress(spark.createDataFrame(rows, "task_id string, at timestamp, stage string, embedded int, persisted int, chunks int")).first().progress == 45


def test_repository(spark, tmp_path):
    store = Repository(spark, str(tmp_path / "store"))
    store.initialise()
    store.initialise()
    assert [r.name for r in store.read("namespaces").collect()] == ["global_knowledge"] and store.healthy()
    rows = spark.createDataFrame([("a", "b", "semantic", 0.5), ("b", "c", "semantic", 0.9)], "src string, dst string, edge_type string, similarity float")
    store.append("edges", rows)
    assert store.read("edges").count() == 2 and store.delete("edges", F.col("src") == "a") == 1 and store.read("edges").count() == 1
    store.append("models", spark.createDataFrame([("m", "n", "ready")], "id string, name string, status string"))
    store.upsert("models", spark.createDataFrame([("m", "n", "failed")], "id string, name string, status string"), "id")
    assert [r.status for r in store.read("models").collect()] == ["failed"]
    store.append("model_nodes", spark.createDataFrame([("x", "m", 0), ("y", "m", 1), ("z", "o", 0)], "id string, model_id string, level int"))
    assert store.delete_model("m") == 2 and store.read("models").count() == 0 and [r.id for r in store.read("model_nodes").collect()] == ["z"]


def test_repository_keeps_what_readers_use(spark, tmp_path):
    store = Repository(spark, str(tmp_path / "log"))
    store.initialise()
    edge = lambda a, s: spark.createDataFrame([(a, "x", s)], "src string, dst string, similarity float")
    store.append("edges", edge("a", 0.5))
    files = set((tmp_path / "log" / "edges").glob("f-*/*.parquet"))
    old = store.read("edges")
    store.append("edges", edge("b", 0.6))
    assert files < set((tmp_path / "log" / "edges").glob("f-*/*.parquet"))  # an append rewrites nothing
    store.delete("edges", F.col("src") == "a")
    assert [r.src for r in old.collect()] == ["a"] and [r.src for r in store.read("edges").collect()] == ["b"]
    assert [store.read("edges", v).count() for v in store.versions("edges")] == [0, 1, 2, 1]
    seen = store.versions("edges")[-1]
    store.append("edges", edge("c", 0.7))
    with pytest.raises(Conflict):
        store.replace("edges", edge("d", 0.8), seen)
    assert not store._commit("edges", store.versions("edges")[-1], [])  # a version is written once
    store.compact("edges")
    assert sorted(r.src for r in store.read("edges").collect()) == ["b", "c"] and store.vacuum("edges", 1) == 4
    assert sorted(r.src for r in store.read("edges").collect()) == ["b", "c"]
    (tmp_path / "log" / "edges" / "log" / "x.tmp").write_text("left by a crash")
    assert store.read("edges").count() == 2
    with pytest.raises(NotFound):
        store.read("edges", 0)


def test_progress_stream_ends_with_the_task(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", 0, "chunking"), ("a", 1, "embedding"), ("b", 0, "extracting"), ("a", 2, "complete"), ("b", 1, "failed"), ("a", 3, "embedding"), ("b", 2, "chunking"), ("c", 3, "persisting")]
    rows += [("d", 30, "chunking"), ("c", 31, "persisting"), ("e", 32, "complete"), ("d", 60, "embedding"), ("d", 61, "embedding")]
    schema = "task_id string, at timestamp, stage string, embedded int, persisted int, chunks int"
    for k in range(0, len(rows), 3):
        spark.createDataFrame([(t, at + dt.timedelta(minutes=m), s, 1, 1, 2) for t, m, s in rows[k : k + 3]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        run = uploads.progress_stream(source).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
        run.processAllAvailable()
        kept = [x["stateOperators"][0]["numRowsTotal"] for x in run.recentProgress if x["stateOperators"]]
        run.stop()
    finally:
        spark.conf.set(key, before)
    got = {}
    for r in spark.table("progress").collect():
        got.setdefault(r.task_id, []).append((r.stage, r.progress, r["last"]))
    assert sorted(got["a"]) == [("complete", 100.0, True), ("embedding", 45.0, False)] and sorted(got["b"]) == [("extracting", 10.0, False), ("failed", 0.0, True)]
    assert got["c"] == [("persisting", 82.5, False)] * 2 and got["e"] == [("complete", 100.0, True)] and len(got["d"]) == 3
    live = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "cp"))
    assert sorted(r.key.task_id for r in live.collect()) == ["c", "d"] and max(kept) > kept[-1]  # ended tasks are forgotten, live ones stay


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "u1.part").write_bytes(b"12345")
    (tmp_path / "done.gguf").write_bytes(b"1")
    found = uploads.listing(spark, str(tmp_path))
    assert [(r.upload_id, r.length) for r in uploads.partial_uploads(found).collect()] == [("u1", 5)]
    assert uploads.free_bytes(spark, str(tmp_path)) > 0
    assert uploads.delete_file(spark, str(tmp_path / "done.gguf")) and not uploads.delete_file(spark, str(tmp_path / "done.gguf"))


def test_consolidation_by_batches(spark, tmp_path):
    from graphloom.streaming import schedule

    seen = []
    each = schedule.run_batch(lambda due: seen.append(sorted(r.namespace for r in due.collect())), 2, 5)
    ticks = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 3)), ("y", dt.datetime(2024, 1, 1, 12)), ("x", dt.datetime(2024, 1, 1, 4))], "namespace string, at timestamp")
    each(ticks, 0)
    each(ticks.filter("namespace = 'y'"), 1)
    assert seen == [["x"]]


def text(x):
    return struct.pack("<Q", len(x)) + x.encode()


def gguf_file(tensors, values, layers=12):
    body = b""
    keys = {"llama.block_count": layers, "llama.embedding_length": 8, "llama.attention.head_count": 2, "llama.feed_forward_length": 16} | values
    head = text("general.architecture") + struct.pack("<I", 8) + text("llama") + text("tags") + struct.pack("<IIQ", 9, 8, 2) + text("a") + text("b")
    head += b"".join(text(k) + struct.pack("<II", 4, v) for k, v in keys.items())
    for name, dims, kind, data in tensors:
        head += text(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<IQ", kind, len(body))
        body += data
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(keys) + 2) + head
    return head + b"\0" * (-len(head) % 32) + body


def test_gguf(spark, tmp_path):
    half = np.arange(6, dtype=np.float16)
    brain = (np.arange(4, dtype=np.float32).view(np.uint32) >> 16).astype(np.uint16)
    q8 = struct.pack("<e", 0.5) + np.arange(32, dtype=np.int8).tobytes()
    tensors = [("token_embd.weight", [4], 0, np.array([1, 2, np.inf, 4], "<f4").tobytes()), ("blk.0.attn_q.weight", [2, 3], 1, half.tobytes()), ("blk.1.ffn_up.weight", [4], 30, brain.tobytes()), ("blk.2.attn_k", [32], 8, q8), ("blk.2.mlp", [32], 2, struct.pack("<e", 2.0) + bytes(range(16)))]
    (tmp_path / "m.gguf").write_bytes(gguf_file(tensors, {}))
    (tmp_path / "bad.gguf").write_bytes(b"GGUF123")
    read = lambda: gguf.read_models(spark, str(tmp_path), tensors=2)
    rows = read().collect()
    assert sum(r.error is not None for r in rows) == 1
    got = {r.tensor: r for r in rows if r.tensor}
    assert got["token_embd.weight"].architecture.asDict() == {"model_type": "llama", "n_layers": 12, "embedding_dim": 8, "vocab_size": 32000, "n_heads": 2, "ffn_dim": 16}
    assert got["token_embd.weight"].samples == [1, 2, 4] and got["blk.0.attn_q.weight"].samples == list(range(6)) and got["blk.1.ffn_up.weight"].samples == [0, 1, 2, 3]
    assert got["blk.2.attn_k"].samples == [0.5 * k for k in range(8)] and got["blk.2.mlp"].samples[:4] == [-16, -16, -14, -16]
    groups = {(r.layer_start, r.layer_end, r.layer_type): r for r in gguf.layer_groups(read()).collect()}
    assert set(groups) == {(0, 0, "embedding"), (0, 1, "transformer"), (2, 3, "transformer")} and groups[0, 1, "transformer"].total_params == 10
    vectors = gguf.group_vectors(gguf.layer_groups(read()), 16).collect()
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in vectors)
    with pytest.raises(ValueError):
        gguf.architecture({"general.architecture": (8, "llama")})


def test_convert_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    shared = rng.normal(size=64).astype("<f4")
    tensors = [(f"blk.{k}.attn_q", [64], 0, (shared + rng.normal(size=64) * 0.1).astype("<f4").tobytes()) for k in range(12)]
    (tmp_path / "m.gguf").write_bytes(gguf_file(tensors, {}))
    (tmp_path / "bad.gguf").write_bytes(b"nothing")
    status, nodes = api.convert_models(spark, str(tmp_path), 32)
    assert sorted(r.status for r in status.collect()) == ["failed", "ready"]
    got = nodes.collect()
    roots = [r for r in got if r.parent_id is None]
    assert len(roots) >= 1 and {r.level for r in got} >= {0} and all(r.parent_id in {x.id for x in got} for r in got if r.parent_id)
    models = spark.createDataFrame([("m", "uploading", None), ("n", "ready", None)], "id string, status string, updated_at timestamp")
    new = {r.id: r for r in api.update_model(models, "m", status="ready").collect()}
    assert new["m"].status == "ready" and new["m"].updated_at and new["n"].updated_at is None
    children = spark.createDataFrame([("t:x", "p"), ("y", "p")], "id string, parent_id string")
    moved = api.update_parents(children, spark.createDataFrame([("x", "q")], "child string, parent string"))
    assert {r.id: r.parent_id for r in moved.collect()} == {"t:x": "q", "y": "p"}


def test_settings_and_providers(spark):
    from graphloom import config, errors, providers

    assert config.IngestionSettings.from_env({"INGESTION_CHUNK_SIZE": "500"}).chunk_size == 500 and config.CacheSettings.from_env({"CACHE_TRACK_METRICS": "off"}).track_metrics is False
    for cls, env in ((config.IngestionSettings, {"INGESTION_CHUNK_OVERLAP": "5000"}), (config.ModelSettings, {"LLM_TEMPERATURE": "3"}), (config.ModelSettings, {"LLM_PROVIDER": "far"}), (config.RemSettings, {"REM_START_HOUR": "x"})):
        with pytest.raises(errors.InvalidRequest):
            cls.from_env(env)
    brain = providers.Brain(dimension=8)
    brain.check(spark)
    assert brain.is_local and providers.SEARCHES.get("unknown") is providers.SEARCHES.get("mock")
    with pytest.raises(errors.NotFound):
        providers.EMBEDDERS.get("unknown")
    assert spark.range(1).select(brain.embed(F.lit("  ")).alias("v")).first().v is None
    assert errors.NotFound("x").body() == {"error": "not_found", "message": "x"} and errors.Conflict.status == 409


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Hello there.\r\n\r\nTwo sentences here. And one more.")
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.txt").write_bytes(b"")
    nodes, report = api.ingest_files(spark.read.format("binaryFile").load(str(tmp_path)), api.default_embedder(8))
    got = {r.content: r for r in nodes.collect()}
    assert set(got) == {"Hello there.\nTwo sentences here. And one more.", "bad � byte"} and all(len(r.vector) == 8 for r in got.values())
    assert {r.path.rsplit("/")[-1]: r.warning for r in report.collect()} == {"a.txt": None, "b.md": "some characters could not be decoded", "c.pdf": "no decoder for this type"}
    refused = api.ingest_files(spark.read.format("binaryFile").load(str(tmp_path)), api.default_embedder(8), settings=IngestionSettings(max_file_size=20, allowed="txt,pdf"))
    assert {r.path.rsplit("/")[-1]: r.warning for r in refused[1].collect()} == {"a.txt": "too large", "b.md": "type not allowed", "c.pdf": "no decoder for this type"} and refused[0].count() == 0


def test_ingest_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "Short test text", "s"), (2, "Short test text", "s"), (3, "  ", "s"), (4, None, "s")], "doc_id long, text string, source string")
    first, again = (api.ingest_documents(docs, api.default_embedder(8)).collect() for _ in range(2))
    assert len(first) == 1 and first[0].node_id == again[0].node_id and first[0].tags == ["chunk:1/1"]


def test_ask_and_update(spark):
    nodes = spark.createDataFrame([("a", "g", [1.0, 0.0], "about a", "s1", "pending", ["t"]), ("b", "g", [0.0, 1.0], "about b", "s2", "pending", ["t"])], "node_id string, namespace string, vector array<float>, content string, source string, status string, tags array<string>")
    questions = spark.createDataFrame([(1, [1.0, 0.1], "g"), (2, [-1.0, -1.0], "g")], "query_id long, vector array<float>, namespace string")
    got = {r.query_id: r for r in api.ask(nodes, questions).collect()}
    assert got[1].context == "[Source 1] (from: s1, relevance: 99.5%)\nabout a" and got[2].answer == api.NOTHING_FOUND
    changes = spark.createDataFrame([("a", "new", None, ["x"], None), ("b", None, None, None, True)], "node_id string, content string, status string, tags array<string>, deprecated boolean")
    new = {r.node_id: r for r in api.update_nodes(nodes, changes).collect()}
    assert new["a"].content == "new" and new["a"].updated_fields == ["content", "tags"] and new["b"].status == "deprecated" and new["b"].tags == ["t"]


def test_synthesis(spark):
    got = api.synthesize(spark.createDataFrame([("n", "What is quantum computing?")], "node_id string, content string")).first()
    assert got.n_sources == 5 and got.content.startswith("# Synthesized Knowledge\n\n**Original Query:** What is quantum computing?\n\n**Sources:**\n- https://en.wikipedia.org/search?q=What+is+quantum+computing?")
