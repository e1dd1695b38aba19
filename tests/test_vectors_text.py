import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import rules, text, vectors


def one(spark, **columns):
    return {k: v for k, v in spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict().items()}


def vec(*x):
    return F.array(*(F.lit(float(y)) for y in x))


def test_vectors(spark):
    got = one(spark, same=vectors.cosine(vec(1, 0, 0), vec(1, 0, 0)), across=vectors.cosine(vec(1, 0, 0), vec(0, 1, 0)), other=vectors.cosine(vec(1, 0), vec(1, 0, 0)), zero=vectors.cosine(vec(0, 0), vec(1, 0)), far=vectors.euclidean(vec(0, 0), vec(3, 4)), no=vectors.euclidean(vec(1), vec(1, 2)), unit=vectors.normalize(vec(3, 4)), still=vectors.normalize(vec(0, 0)), fixed=vectors.cosine_to(vec(1, 1), [1.0, 0.0]))
    assert got["same"] == 1 and got["across"] == 0 and got["other"] == 0 and got["zero"] == 0 and got["far"] == 5
    assert got["no"] == vectors.FLOAT_MAX and got["unit"] == [0.6, 0.8] and got["still"] == [0, 0] and abs(got["fixed"] - math.sqrt(0.5)) < 1e-12


@pytest.mark.parametrize("s, d", [(0.8, 1.25), (0.5, 2.0), (0.9, 1 / 0.9), (0.0, vectors.FLOAT_MAX), (-1.0, vectors.FLOAT_MAX)])
def test_distances(spark, s, d):
    got = one(spark, d=vectors.to_distance(F.lit(s)), w=rules.edge_weight(F.lit(s)), back=vectors.to_similarity(vectors.to_distance(F.lit(s))))
    assert got["d"] == got["w"] == pytest.approx(d) and got["back"] == pytest.approx(max(s, 0))


@pytest.mark.parametrize("x", ["", "a", "hello world", "naïve ß 日本 🙂"])
def test_hashes(spark, x):
    h, f = 5381, 14695981039346656037
    for b in x.encode():
        h = (h * 33 + b) % 2**64
        f = ((f ^ b) * 1099511628211) % 2**64
    raw = [((h + i) % 2**64 * 2654435761 % 2**64 % 10000) / 10000 - 0.5 for i in range(8)]
    n = math.sqrt(sum(y * y for y in raw))
    got = one(spark, h=vectors.text_hash(F.lit(x)), f=vectors.fnv1a(F.lit(x)), v=vectors.mock_embedding(F.lit(x), 8))
    assert int(got["h"]) == h and int(got["f"]) == f and got["v"] == pytest.approx([y / n for y in raw])


def test_hashes_of_long_texts(spark):
    """Texts of several pieces; a fold in the JVM made an object of each of their bytes."""
    data = ("aé日 " * 30000).encode()
    assert len(data) > 3 * vectors.PIECE
    h = 5381
    for b in data:
        h = (h * 33 + b) % 2**64
    assert vectors.hash_bytes(data) == h
    rows = spark.createDataFrame([(data.decode(),), (None,)], "t string").select(vectors.text_hash(F.col("t")).alias("h"), vectors.fnv1a(F.col("t")).alias("f")).collect()
    assert int(rows[0].h) == h and int(rows[0].f) == vectors.fnv1a_bytes(data) and rows[1].h is None and rows[1].f is None


def test_text(spark):
    got = one(spark, lines=text.unix_lines(F.lit("Line 1\r\nLine 2\rLine 3\nLine 4")), squeezed=text.squeeze(F.lit("  a \t b\n\n  c  \n d ")), clean=text.clean_extracted(F.lit("a\x00b�c"), True), q=text.search_query(F.lit(" one  two\nthree " + "x " * 200)), cut=text.shorten(F.lit("abcdef"), 3), dom=text.domain(F.lit("https://a.b.example/x?y")), none=text.domain(F.lit("not a url")))
    assert got["lines"] == "Line 1\nLine 2\nLine 3\nLine 4" and got["squeezed"] == "a b\nc \nd" and got["clean"] == "abc"
    assert got["q"] == "one two three x x x x x x x" and got["cut"] == "abc..." and got["dom"] == "a.b.example" and got["none"] is None


@pytest.mark.parametrize("data, want, encoding, lossy", [(b"\xef\xbb\xbfhi", "hi", "utf-8", False), ("hé".encode("utf-16"), "hé", "utf-16-le", False), (b"\xfe\xff\x00h\x00i", "hi", "utf-16-be", False), (b"a\xffb", "a�b", "utf-8", True), (b"plain", "plain", "utf-8", False)])
def test_decoding(spark, data, want, encoding, lossy):
    got = one(spark, d=text.decode_bytes(F.lit(bytearray(data))))["d"]
    assert (got.text.lstrip("﻿"), got.encoding, got.lossy) == (want, encoding, lossy)


def test_file_types(spark):
    names = {"a.TXT": "text", "x/y.md": "text", "b.pdf": "pdf", "c.JpEg": "image", "d.exe": "unknown", "none": "unknown"}
    for name, kind in names.items():
        assert one(spark, k=text.file_type(F.lit(name)))["k"] == kind
    magic = {"png": b"\x89PNG\r\n", "jpeg": b"\xff\xd8\xff\xe0", "gif": b"GIF89a", "webp": b"RIFF1234WEBP", "bmp": b"BM123", "tiff": b"II*\x00", None: b"hello"}
    for kind, data in magic.items():
        assert one(spark, k=text.sniff_image(F.lit(bytearray(data))))["k"] == kind


def test_rules(spark):
    n = lambda x: F.lit(x)
    for x, want in ((1500000000, "1.5B"), (7000000, "7.0M"), (1500, "1.5K"), (500, "500")):
        assert one(spark, p=rules.format_params(n(x)))["p"] == want
    for name, want in (("blk.12.attn_q.weight", 12), ("model.layers.3.mlp", 3), ("h.0.attn", 0), ("token_embd.weight", None), ("layers.x.1", None), ("blk.x.layers.7.y", 7)):
        assert one(spark, k=rules.layer_number(n(name)))["k"] == want, name
    hours = lambda a, b: [one(spark, x=rules.is_rem_time(n(h), a, b))["x"] for h in (0, 5, 6, 12, 22, 23)]
    assert hours(22, 6) == [True, True, False, False, True, True] and hours(5, 12) == [False, True, True, False, False, False] and all(hours(3, 3))
    for stage, want in (("extracting", 10), ("chunking", 20), ("embedding", 45), ("persisting", 82.5), ("complete", 100), ("odd", 0)):
        assert one(spark, p=rules.overall_progress(n(stage), n(1), n(1), n(2)))["p"] == want
    pair = one(spark, a=rules.thing_pair(n("x")), b=rules.thing_pair(n("t:x")), c=rules.thing_pair(n("a:b:c")))
    assert tuple(pair["a"]) == ("nodes", "x") and tuple(pair["b"]) == ("t", "x") and pair["c"] is None
    got = one(spark, ok=rules.edge_valid(n(1.0), n(0.5), n(1.0)), inf=rules.edge_valid(n(float("inf")), n(0.5), n(1.0)), high=rules.edge_valid(n(1.0), n(1.5), n(1.0)), up=rules.upload_progress(n(3), n(4)), none=rules.upload_progress(n(0), n(0)), h=rules.health(n(True), n(False)))
    assert got == {"ok": True, "inf": False, "high": False, "up": 75.0, "none": 0.0, "h": "degraded"}
