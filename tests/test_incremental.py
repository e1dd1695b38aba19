"""A hierarchy that grows by batches is the one that is built at once, and decides little again."""

import random

import numpy as np
import pytest

from graphloom.operators import cluster, incremental, search
from graphloom.operators.cluster import ClusterConfig

CONFIG = ClusterConfig(threshold=0.6, largest_size=4)


def frame(spark, data):
    return spark.createDataFrame([(k, g, v, f"text {k}") for k, g, v in data], "node_id string, namespace string, vector array<double>, content string")


def shape(tree):
    return sorted((r.group, r.cluster_id, r.depth, tuple(r.members), tuple(r.children), r.parent_id, r.text, round(r.internal_similarity, 6), r.is_root) for r in tree.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 5))
    return [(f"n{k:03d}", f"g{k % 2}", (centres[k % 9] + 0.45 * rng.normal(size=5)).tolist()) for k in range(40)] + [("n900", "g0", None), ("n901", "g2", [1.0] * 5)]


def test_batches_equal_one_build(spark, data, tmp_path):
    order = random.Random(1).sample(data, len(data))
    grown, so_far = None, []
    for at, to in ((0, 30), (30, 41), (41, 42)):
        grown = incremental.grow(spark, frame(spark, order[at:to]), grown, CONFIG)
        so_far += order[at:to]
        if at:
            assert shape(grown.tree(spark)) == shape(cluster.hierarchy(frame(spark, so_far), CONFIG))
    depth, pairs, redone = grown.work[0]
    assert depth == 0 and redone < pairs  # one row came: what stands before its first pair isn't decided again
    grown.save(str(tmp_path))
    again = incremental.Growing.open(spark, str(tmp_path), len(grown.levels))
    changed = [(k, g, v) for k, g, v in order[:3]]
    changed = [(changed[0][0], changed[0][1], [0.5, 0.1, -1.0, 0.2, 0.3])]
    gone = frame(spark, order[10:13])
    again = incremental.grow(spark, frame(spark, changed), again, CONFIG, gone)
    left = [x for x in order if x not in order[10:13] and x[0] != changed[0][0]] + changed
    assert shape(again.tree(spark)) == shape(cluster.hierarchy(frame(spark, left), CONFIG))


def test_large_groups_keep_only_pairs_that_decide(spark, monkeypatch):
    """A level of a large group had all links, whose number grows with the square of its items; what comes gives the decisions of all links still."""
    rng = np.random.default_rng(5)
    rows = {f"n{k:03d}": ("gh"[k % 5 == 0], np.round(rng.normal(size=3), 1).tolist()) for k in range(120)} | {"n500": ("g", None)}
    given = lambda ids: frame(spark, [(k, *rows[k]) for k in ids])
    order = random.Random(2).sample(sorted(rows), len(rows))
    config = ClusterConfig(threshold=0.2, largest_size=4)
    for name, value in (("VECTOR_BLOCK", 20), ("NARROW_BLOCK", 60), ("NARROW_ROWS", 20)):
        monkeypatch.setattr(search, name, value)
    items = lambda ids: cluster.written(cluster.lowest_items(given(ids), "namespace", "node_id", "content"))
    none = spark.createDataFrame([], "id string")
    old, _, (_, pairs, _) = incremental.grow_level(incremental._empty(spark), items(order[:100]), none, 0, config)
    assert pairs < 4 * 100 < search.similar_pairs(given(order[:100]), 0.2, "namespace").count()
    new, _, _ = incremental.grow_level(old, items(order[100:]), none, 0, config)
    log = lambda found: {(r.id, r.other, r.fits, r.size) for r in found.collect()}
    assert log(new.log) == log(cluster.decisions(search.similar_pairs(given(order), 0.2, "namespace"), 4))


def test_other_components_are_left_alone(spark):
    """Two groups of rows that share no pair: a row that comes to one of them redoes nothing of the other."""
    axis = np.eye(6)
    rng = np.random.default_rng(2)
    rows = [(f"{c}{k}", "g", (axis[c] + 0.1 * rng.normal(size=6)).tolist()) for c in range(3) for k in range(8)]
    first = incremental.grow(spark, frame(spark, rows), None, CONFIG)
    pairs = first.work[0][1]
    then = incremental.grow(spark, frame(spark, [("0z", "g", axis[0].tolist())]), first, CONFIG)
    assert pairs == 3 * 28 and then.work[0][1] == pairs + 8 and then.work[0][2] <= 36
    same = incremental.grow(spark, frame(spark, []), then, CONFIG)
    assert same.work == [(0, pairs + 8, 0)] and shape(same.tree(spark)) == shape(then.tree(spark))
    none = incremental.grow(spark, frame(spark, []), None, CONFIG)
    assert none.tree(spark).count() == 0


def test_texts_are_bounded(spark):
    rows = [(f"n{k}", "g", [1.0, 0.01 * k], ("x" * 3000) + str(k)) for k in range(8)]
    tree = cluster.hierarchy(spark.createDataFrame(rows, "node_id string, namespace string, vector array<double>, content string"), ClusterConfig(largest_size=3))
    texts = [r.text for r in tree.collect()]
    assert max(map(len, texts)) == cluster.MOST_TEXT and min(map(len, texts)) > 3000
