"""The extractive scorer against plain cosines, and summaries of summaries with bounded texts."""

import math
import random
from collections import Counter

import numpy as np

from graphloom.functions.text import shorten
from graphloom.operators import chunk, cluster, summary
from graphloom.operators.cluster import ClusterConfig


def plain(text, most):
    found = [x for x in chunk.sentences(text.strip()) if x]
    bags = [Counter(summary.WORD.findall(x.lower())) for x in found]

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return sum(x * b[w] for w, x in a.items()) / n if n else 0.0

    score = [sum(cos(a, b) for b in bags) for a in bags]
    kept, size = [], 0
    for k in sorted(range(len(found)), key=lambda k: (-round(score[k], 9), k)):
        if size + len(found[k]) + (1 if kept else 0) <= most:
            size += len(found[k]) + (1 if kept else 0)
            kept.append(k)
    return " ".join(found[k] for k in sorted(kept)) if kept else (found[0][:most] if found else "")


def test_central_sentences():
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join(" ".join(rng.choice("red blue green big small éa z".split()) for _ in range(rng.randrange(1, 9))).capitalize() + rng.choice(".!?") for _ in range(rng.randrange(12)))
        for most in (10, 80, 200):
            assert summary.central_sentences(text, most) == plain(text, most)
            assert len(summary.central_sentences(text, most)) <= most
    assert summary.central_sentences("", 50) == "" and summary.central_sentences("... !!!", 50) == plain("... !!!", 50)


def test_summaries_of_summaries(spark):
    rng = np.random.default_rng(8)
    rows = [(f"n{k:02d}", "g", rng.normal(size=3).tolist(), None if k == 3 else f"Text {k} says this. " * 200) for k in range(40)]
    df = spark.createDataFrame(rows, "node_id string, namespace string, vector array<double>, content string")
    tree = cluster.hierarchy(df, ClusterConfig(largest_size=4, threshold=0.6))
    told = {r.cluster_id: r for r in tree.collect()}
    for summarize, cut in ((lambda c: shorten(c, 60), lambda x: x[:60] + "..." if len(x) > 60 else x), (summary.central, summary.central_sentences)):
        texts = {i: c for i, _, _, c in rows}

        def wanted(i):
            t = told[i]
            parts = [cut(texts[m][: cluster.MOST_TEXT]) for m in sorted(t.members) if texts[m] is not None] if t.depth == 0 else [wanted(c) for c in sorted(t.children)]
            return cut("\n\n".join(parts))

        got = {r.cluster_id: r.summary for r in summary.tree_summaries(tree, df, summarize).collect()}
        assert got == {i: wanted(i) for i in told} and len(got) > 4 and max(r.depth for r in told.values()) >= 1
    assert summary.tree_summaries(tree.limit(0), df).count() == 0


def test_central_summaries_of_whole_texts(spark, tmp_path, monkeypatch):
    """The query reads texts to their ends: what a long one is about is said behind its first characters (F9)."""
    from graphloom.plans import index_queries

    text = "".join(f"Odd{k} lone{k} word{k}. " for k in range(300)) + "All of it ends here. " * 30
    assert text.index("All of it") > cluster.MOST_TEXT
    df = spark.createDataFrame([("n1", "g", [1.0, 0.0], text), ("n2", "g", [1.0, 0.1], None)], "node_id string, namespace string, vector array<double>, content string")
    monkeypatch.setattr(index_queries.tables, "nodes", lambda spark, d: df)
    got = index_queries.queries()["tree_summaries_central"](spark, "").filter("depth = 0").collect()
    assert [r.summary for r in got] == [summary.central_sentences(summary.central_sentences(text))] and "All of it ends here." in got[0].summary
    assert "ends here" not in summary.tree_summaries(cluster.hierarchy(df, index_queries.CLUSTERING, content=None), df).filter("depth = 0").first().summary
