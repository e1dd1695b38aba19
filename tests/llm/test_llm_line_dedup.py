"""Line dedup against the plain rule."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import line_dedup as L
from graphloom.llm.common import U64

SCHEMA = "doc_id long, text string, gone string, k1 string, _k1 int, kept string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, least=40, most=5):
    docs = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                docs[key(line)].add(i)
    stays = {k: max(x for x in v if x is not None) for k, v in docs.items() if len(v) >= most}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in stays or stays[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    shared = [f"Shared line {k} É{'xyz' * k} of forty characters or about as many" for k in range(12)] + ["short", "é" * 39, "é" * 40, " \t" + "Q" * 40 + "\x0b ", "q" * 40, "Ä" * 40, "ä" * 40, "a" * 38 + "\x1c"]
    out = []
    for k in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own {k} {j} " + "w" * rng.randrange(60) for j in range(rng.randrange(9))]
        out.append((k, "\n".join(lines), "g", "k", 1, "kept"))
    out += [(None, "\n".join(shared), None, None, None, None)] * 2 + [(130, None, "", "", 1, ""), (131, "", "", "", 1, ""), (132, "\n", "", "", 1, ""), (133, shared[3] + "\r\n" + shared[3].upper() + "\n", "", "", 1, "")]
    out += [(134 + k, "\n".join([f"every {j} " + "z" * 50 for j in range(40)]), "", "", 1, "") for k in range(9)]  # copies
    return out + [out[4], (5, shared[0], "", "", 1, ""), (200, ("y" * 50 + "\n") * 3 + "tail", "", "", 1, ""), (201, "t" * 6_000_000 + "\n" + shared[1], "", "", 1, "")]


def test_dedup_lines(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for least, most in ((40, 5), (1, 2), (60, 30)):
        got = L.dedup_lines(df, least=least, most_docs=most)
        assert Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(plain(rows, least, most))


@pytest.mark.parametrize("bits, covered", [(8, 1 << 32), (20, 0), (20, 1 << 31), (23, 1 << 32)])
def test_filters_lose_no_repeat(spark, rows, monkeypatch, bits, covered):
    """Full, unused, half-used and ranged filters."""
    monkeypatch.setattr(L, "filter_bits", lambda docs: (bits, covered))
    got = L.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(plain(rows))


def test_filter_holds_what_is_seen_twice(spark, rows):
    twice = np.frombuffer(L.seen_twice(spark.createDataFrame(rows, SCHEMA), "text", 40, 20, 1 << 32), np.uint8)
    assert 0 < int(np.unpackbits(twice).sum()) < 1000
    at = np.unpackbits(np.packbits(np.isin(np.arange(64), [3, 9])))
    assert list(np.flatnonzero(at)) == [3, 9]
    assert list(L.unpacked(L.packed(np.array([0, 5, 9, 1 << 21])))) == [0, 5, 9, 1 << 21]
    assert L.positions(np.array([1, 2, 3], U64), 22).max() < 1 << 22


def test_none(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
