import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunk, cluster, paths, search
from graphloom.operators.cluster import ClusterConfig


def frame(spark, rows, group="g"):
    return spark.createDataFrame([(str(k), group if isinstance(group, str) else group(k), [float(y) for y in x]) for k, x in rows], "node_id string, namespace string, vector array<float>")


def cos(a, b):
    a, b = np.array(a, float), np.array(b, float)
    n = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / n) if n else 0.0


def test_top_k_and_ties(spark):
    rows = frame(spark, [("b", (1, 0)), ("a", (2, 0)), ("c", (0, 1)), ("d", (1, 1)), ("e", (0, 0))])
    assert [r.node_id for r in search.top_k(rows, [1.0, 0.0], 3).collect()] == ["a", "b", "d"]
    assert [r.node_id for r in search.top_k(rows, [1.0, 0.0], 9, least=0.5).collect()] == ["a", "b", "d"]
    assert [r.node_id for r in search.nearest(rows, [0.0, 1.0], 2).collect()] == ["c", "d"]


def test_top_k_each_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    data = [(k, rng.integers(-2, 3, 4)) for k in range(60)]
    rows = frame(spark, data, lambda k: f"g{k % 2}")
    queries = rows.filter("cast(node_id as int) % 6 = 0").select(F.col("node_id").alias("query_id"), "vector", "namespace")
    for group in (None, "namespace"):
        got = {(r.query_id, r.rank): (r.node_id, r.similarity) for r in search.top_k_each(rows, queries, 4, group=group).collect()}
        for q in range(0, 60, 6):
            own = [(k, x) for k, x in data if not group or k % 2 == q % 2]
            best = sorted(((-round(cos(data[q][1], x), 6) + 0.0, str(k)) for k, x in own))[:4]
            for rank, (s, k) in enumerate(best, 1):
                assert got[str(q), rank][0] == k and got[str(q), rank][1] == pytest.approx(-s, abs=2e-6)


def test_similar_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(2)
    data = [(k, rng.normal(size=3)) for k in range(40)]
    got = {(r.a, r.b) for r in search.similar_pairs(frame(spark, data, lambda k: f"g{k % 2}"), 0.6, "namespace").collect()}
    want = {tuple(sorted((str(i), str(j)))) for (i, x), (j, y) in itertools.combinations(data, 2) if i % 2 == j % 2 and round(cos(np.float32(x), np.float32(y)), 6) >= 0.6}
    assert got == want


def test_pairs_of_a_block_make_no_objects():
    """All pairs of a block: ids of pairs were lists of strings, which took some 150 bytes a pair."""
    rng = np.random.default_rng(4)
    table = pa.table({"id": [f"n{k}" for k in range(600)] + ["n7"], "vector": pa.array(list(rng.normal(size=(601, 4))), pa.list_(pa.float64()))})
    every = np.arange(601)
    tracemalloc.start()
    a, b, s = search._pairs_of(table, every, every, -1.0, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(a, pa.Array) and len(a) == len(b) == len(s) == 600 * 599 // 2 + 599  # the repeated id pairs with all others
    assert all(x < y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True))
    assert peak < 60 * len(s)


def test_centroid_and_mean_similarity(spark):
    rows = frame(spark, [("a", (1, 0, 0)), ("b", (0, 1, 0))])
    assert search.centroids(rows, "namespace").first().centroid == [0.5, 0.5, 0]
    mixed = rows.unionByName(frame(spark, [("c", (1, 2))]))
    assert search.centroids(mixed, "namespace").first().centroid is None
    rng = np.random.default_rng(3)
    data = [(k, rng.normal(size=5)) for k in range(12)] + [(12, np.zeros(5))]
    want = np.mean([cos(np.float32(x), np.float32(y)) for (_, x), (_, y) in itertools.combinations(data, 2)])
    assert search.average_pairwise(frame(spark, data), "namespace").first().average_similarity == pytest.approx(want, abs=1e-6)
    assert search.average_pairwise(frame(spark, data[:1]), "namespace").first().average_similarity == 1


def literal_clusters(data, threshold, least, largest):
    """The greedy loop word for word: the most similar active pair, merged or its second end dropped."""
    members = {k: [k] for k, _ in data}
    active = sorted(members)
    sim = {(a, b): round(cos(np.float32(x), np.float32(y)), 6) for (a, x), (b, y) in itertools.product(data, data) if a < b}
    while True:
        pairs = [(-sim[a, b], a, b) for a, b in itertools.combinations(active, 2)]
        if not pairs or -min(pairs)[0] < threshold:
            break
        _, a, b = min(pairs)
        if len(members[a]) + len(members[b]) <= largest:
            members[a] += members[b]
        active.remove(b)
    return {(k, c) for c in active for k in (members[c] if len(members[c]) >= least else [c])}


@pytest.mark.parametrize("task_pairs", [cluster.TASK_PAIRS, 24, 0])  # in the middle, some groups go by rounds
def test_clusters_equal_the_literal_loop(spark, task_pairs):
    rng = np.random.default_rng(5)
    groups = {f"g{g}": [(f"{g}{k:02d}", np.round(rng.normal(size=2), 1)) for k in range(14)] for g in range(4)}
    rows = None
    for name, data in groups.items():
        part = frame(spark, data, name)
        rows = part if rows is None else rows.unionByName(part)
    for config in (ClusterConfig(2, 3, 0.8), ClusterConfig(3, 10, 0.5)):
        got = {(r.id, r.cluster) for r in cluster.clusters(rows, config, task_pairs=task_pairs).collect()}
        want = set().union(*(literal_clusters(data, config.threshold, config.least_size, config.largest_size) for data in groups.values()))
        assert got == want


def test_links_of_large_groups_are_not_written(spark, monkeypatch):
    """All links of a group were written before the first was dropped: they grow with the square of its rows. What the blocks leave now decides the same clusters."""
    rng = np.random.default_rng(6)
    data = [(f"{k:03d}", np.round(rng.normal(size=3), 1)) for k in range(60)] + [(f"{k:03d}", [1.0, 1.0, 0.0]) for k in range(60, 75)]  # ties, and copies
    rows = frame(spark, data).unionByName(frame(spark, [("x", (1, 2, 3)), ("y", (1, 2, 3.1))], "h"))
    every = search.similar_pairs(rows, 0.2, "namespace").count()
    for name, value in (("NARROW_ROWS", 0), ("VECTOR_BLOCK", 9), ("STRIP", 4)):
        monkeypatch.setattr(search, name, value)
    assert search.deciding_pairs(rows, 0.2, "namespace").count() < 4 * len(data) < every
    for config in (ClusterConfig(2, 4, 0.2), ClusterConfig(2, 10, 0.8)):
        got = {(r.id, r.cluster) for r in cluster.clusters(rows, config).collect()}
        assert got == literal_clusters(data, config.threshold, 2, config.largest_size) | {("x", "x"), ("y", "x")}


def test_products_find_all_pairs_at_the_bounds(monkeypatch):
    """Candidates are found in 32 bits by strips, with bounds by the smaller or the greater id, and each pair is given once."""
    monkeypatch.setattr(search, "STRIP", 4)
    monkeypatch.setattr(search, "HITS", 5)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 8))
    vectors[7] = vectors[3]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    every = {(a, b): round(float(unit[a] @ unit[b]), 6) for a in range(40) for b in range(a + 1, 40)}
    asked = {3, 11, 12, 30}
    whole = [(k, True, True, True) for k in range(40)]
    some = [(k, True, False, True) for k in asked] + [(k, False, True, k in asked) for k in range(40)]
    for sides, wanted in ((whole, every), (some, {x: s for x, s in every.items() if asked & set(x)})):
        sides = [sides[k] for k in rng.permutation(len(sides))]
        ids, left, right, once = zip(*sides, strict=True)
        table = pa.table({"id": [f"{k:02d}" for k in ids], "vector": [vectors[k].tolist() for k in ids], "left": left, "right": right, "once": once})
        product = search._Product(table, 0.1)
        bound = rng.choice([-np.inf, 0.2, 0.5], 40)
        for greater in (False, True):
            found = [(int(a), int(b), s) for x in product.pairs(bound, greater) for a, b, s in zip(*x, strict=True)]
            assert len(found) == len({x[:2] for x in found})
            got = {(a, b): round(float(s), 6) for a, b, s in found}
            assert all(got[x] == s for x, s in wanted.items() if s >= max(0.1, bound[x[greater]])) and all(wanted[x] == s >= 0.1 for x, s in got.items())


def test_pairs_of_one_node_are_decided_at_once(spark, monkeypatch):
    """A node whose pairs all come one after the other took a round for each of them."""
    tables = []
    monkeypatch.setattr(cluster, "written", lambda df, real=cluster.written: tables.append(1) or real(df))
    pairs = spark.createDataFrame([("a", f"b{k:02}", "g", 0.9 - k / 100) for k in range(15)], "a string, b string, group string, similarity double")
    got = {r.id: (r.other, r.fits, r.size) for r in cluster.decisions(pairs, 10, 0).collect()}
    assert got == {f"b{k:02}": ("a", k < 9, min(k + 2, 10)) for k in range(15)}
    assert len(tables) < 20


def test_texts_of_clusters_are_whole_where_asked(spark):
    rows = frame(spark, [("n1", (1, 0)), ("n2", (1, 0.1))]).withColumn("content", F.repeat("node_id", 3000))
    text = lambda **kw: cluster.hierarchy(rows, ClusterConfig(), **kw).first().text
    assert text(most_text=None) == "n1" * 3000 + "\n\n" + "n2" * 3000 and len(text()) == cluster.MOST_TEXT and text(content=None).strip() == ""


def test_hierarchy(spark):
    rows = frame(spark, [("n1", (1, 0)), ("n2", (0.9, 0.1)), ("n3", (0, 1)), ("n4", (0.1, 0.9))]).withColumn("content", F.col("node_id"))
    tree = cluster.hierarchy(rows, ClusterConfig(2, 10, 0.1, 5))
    leaves = {r.cluster_id: r for r in tree.filter("depth = 0").collect()}
    assert sum(len(r.members) for r in leaves.values()) == 4
    roots = tree.filter("is_root").collect()
    assert len(roots) == 1
    tree2 = cluster.hierarchy(rows, ClusterConfig(2, 2, 0.1, 5))
    got = {r.cluster_id: r for r in tree2.collect()}
    assert set(got) == {"0:n1", "0:n3", "1:n1"} or set(got) >= {"0:n1", "0:n3"}
    top = [r for r in got.values() if r.is_root]
    assert len(top) == 1 and sorted(top[0].children) == ["0:n1", "0:n3"] and top[0].text == "n1\n\nn2\n\n---\n\nn3\n\nn4"
    walked = {r.cluster_id: r.path for r in cluster.path_to_root(tree2).collect()}
    assert walked["0:n3"] == ["0:n3", "1:n1"] and walked["1:n1"] == ["1:n1"]
    near = {r.cluster_id for r in cluster.traverse(tree2, [1.0, 0.0], 0.3).collect()}
    assert near == {"1:n1", "0:n1"}
    parents, edges = cluster.tree_nodes(tree2)
    assert {(r.src, r.dst) for r in edges.collect()} == {("1:n1", "n1"), ("1:n1", "n3")} and parents.count() == 1
    assert cluster.hierarchy(rows.limit(0)).count() == 0


ABCD = [("A", "B", 0.9), ("A", "C", 0.5), ("B", "C", 0.8), ("B", "D", 0.7), ("C", "D", 0.6)]


def test_paths_of_the_small_graph(spark):
    edges = paths.clean_edges(spark.createDataFrame(ABCD, "src string, dst string, similarity double"), both_ways=True)
    source = spark.createDataFrame([("A",)], "source string")
    for found in (paths.settle(edges, source), paths.relax(edges, source)):
        got = {r.node: r for r in found.collect()}
        assert {k: round(r.distance, 4) for k, r in got.items()} == {"A": 0, "B": 1.1111, "C": 2.0, "D": 2.5397}
        assert got["D"].path == ["A", "B", "D"] and got["D"].hops == 2
    one = {r.node: r.distance for r in paths.settle(edges, source, 1).collect()}
    assert {k: round(v, 4) for k, v in one.items()} == {"A": 0, "B": 1.1111, "C": 2.0}  # tentative neighbours of the one settled node
    assert [r.node for r in paths.k_nearest(paths.relax(edges, source), 2).orderBy("rank").collect()] == ["A", "B"]
    shared = {r.node: r for r in paths.path_product(edges, paths.relax(edges, source)).collect()}
    assert shared["D"].product == pytest.approx(0.63) and shared["D"].average_similarity == pytest.approx(0.8)
    alone = paths.settle(edges, spark.createDataFrame([("Z",)], "source string")).collect()
    assert [(r.node, r.distance, r.path_similarity) for r in alone] == [("Z", 0.0, 1000.0)]


def test_foreign_nodes_are_reached_but_not_passed(spark):
    edges = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.9)], "src string, dst string, similarity double")
    spaces = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "node string, space string")
    got = {r.node for r in paths.settle(edges, spark.createDataFrame([("A",)], "source string"), spaces=spaces).collect()}
    assert got == {"A", "B"}


def test_searches_keep_what_they_can_settle(spark, monkeypatch):
    """The tables between rounds hold as many nodes of a search as it settles, however many edges a node has; they held all that was reached."""
    rng = random.Random(3)
    rows = [("s", f"n{k:02}", 0.3 + k / 100) for k in range(40)] + [(f"n{k:02}", f"m{k:02}", 0.9) for k in range(40)]
    rng.shuffle(rows)
    edges = paths.clean_edges(spark.createDataFrame(rows, "src string, dst string, similarity double"), both_ways=True)
    assert edges.count() == 160
    source = spark.createDataFrame([("s",)], "source string")
    everything = paths.k_nearest(paths.relax(edges, source), 4).select("source", "node", "distance", "rank").collect()
    plain = {(r.node, r.distance) for r in paths.relax(edges, source, 2).collect()}
    assert {(r.node, r.distance) for r in paths.relax(edges, source, 2, with_paths=False).collect()} == plain
    sizes = []

    def counted(df, real=paths.written):
        out = real(df)
        if "distance" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "written", counted)
    assert sorted(paths.nearest_nodes(edges, source, 4).collect()) == sorted(everything)
    assert paths.settle(edges, source, 3).count() == 43  # s, its 40 neighbours and those of the two nearest
    assert max(sizes) <= 4


def plain_search(graph, source, most_settled, spaces=None):
    """Dijkstra's search with a list of all open nodes; of equally near ones the greatest id is settled first."""
    best, done = {source: (0.0, [source])}, []
    while len(done) < most_settled and (left := [x for x in best if x not in done]):
        least = min(best[x][0] for x in left)
        now = max(x for x in left if best[x][0] == least)
        done.append(now)
        if spaces and spaces.get(now) != spaces.get(source):
            continue
        for to, similarity in graph.get(now, []):
            if to not in best or least + 1 / similarity < best[to][0]:
                best[to] = (least + 1 / similarity, best[now][1] + [to])
    return best


@pytest.mark.parametrize("most, apart", [(1, False), (4, False), (10, True)])
def test_capped_searches_equal_a_plain_one(spark, most, apart):
    rng = random.Random(most)
    rows = {(f"n{a}", f"n{b}"): rng.choice([0.25, 0.5, 1.0]) for a in range(30) for b in rng.sample(range(30), 3) if a != b}  # many ties
    graph = {}
    for (a, b), s in rows.items():
        graph.setdefault(a, []).append((b, s))
    spaces = {f"n{k}": "even" if k % 2 == 0 or k < 8 else "odd" for k in range(25)} if apart else None
    sources = [f"n{k}" for k in range(0, 30, 4)]
    given = spark.createDataFrame(list(spaces.items()), "node string, space string") if apart else None
    got = {}
    for r in paths.settle(spark.createDataFrame([(*k, v) for k, v in rows.items()], "src string, dst string, similarity double"), spark.createDataFrame([(x,) for x in sources], "source string"), most, given).collect():
        got[r.source, r.node] = r.distance
        assert r.path[0] == r.source and r.path[-1] == r.node and math.isclose(sum(1 / rows[x] for x in zip(r.path, r.path[1:], strict=False)), r.distance, abs_tol=1e-9)
    assert got == {(s, n): d for s in sources for n, (d, _) in plain_search(graph, s, most, spaces).items()}


def test_relaxation_equals_single_searches(spark):
    rng = random.Random(3)
    rows = {(f"n{a}", f"n{b}"): rng.choice([0.2, 0.5, 0.9, 1.0]) for a in range(12) for b in rng.sample(range(12), 3) if a != b}
    edges = spark.createDataFrame([(*k, v) for k, v in rows.items()], "src string, dst string, similarity double")
    graph = {}
    for (a, b), s in rows.items():
        graph.setdefault(a, []).append((b, s))
    sources = [f"n{k}" for k in range(0, 12, 3)]
    frame = spark.createDataFrame([(x,) for x in sources], "source string")
    want = {(s, n): d for s in sources for n, (d, _) in plain_search(graph, s, 1000).items()}
    got = {(r.source, r.node): r.distance for r in paths.relax(edges, frame).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    cuts = paths.hopset(edges, 1.0)
    wider = {(r.source, r.node): r.distance for r in paths.relax(paths.with_shortcuts(edges, cuts), frame).collect()}
    assert all(math.isclose(wider[k], want[k], abs_tol=1e-9) for k in want)


def test_fused_rank(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, "leaf"), (1, "b", 0.8, "leaf"), (1, "p", 0.7, "parent"), (2, "z", 0.5, "leaf")], "query_id long, node_id string, similarity double, node_type string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("q", "a", 0.6)], "src string, dst string, similarity double")
    parents = spark.createDataFrame([("q", "a", 0.6)], "src string, dst string, similarity double")
    got = {(r.query_id, r.node_id): r for r in paths.fused_rank(hits, edges, parents, 10).collect()}
    assert {tuple(r) for r in paths.fused_rank(hits, edges, parents, 10, task_edges=0).withColumn("path", F.array_join("path", ">")).collect()} == {tuple(r.asDict().values())[:5] + (">".join(r.path) if r.path else None, r["rank"]) for r in got.values()}
    assert got[1, "a"].score == pytest.approx(0.7 * 0.9 + 0.3) and got[1, "b"].score == pytest.approx(0.7 * 0.8 + 0.3 / 3) and got[1, "b"].path == ["a", "b"]
    assert got[1, "p"].score == pytest.approx(0.49) and got[1, "q"].similarity == pytest.approx(0.54) and got[1, "q"].score == pytest.approx(0.378)
    assert got[2, "z"].score == 0.5 and got[1, "a"].rank == 1


def test_top_k_each_equals_sorting(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"n{k}", rng.choice("gh"), [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)] if k % 9 else None) for k in range(60)]
    queries = [(k, rng.choice("ghx"), [rng.choice([1.0, -1.0, 0.5]) for _ in range(3)]) for k in range(12)]

    def cosine(x, y):
        x = x or [0.0, 0.0, 0.0]
        length = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / length, 6) if length else 0.0

    want = set()
    for q, own, y in queries:
        ranked = sorted((-cosine(x, y), n) for n, g, x in rows if g == own)[:4]
        want |= {(q, n, round(-s, 5), k) for k, (s, n) in enumerate(ranked, 1)}
    frames = spark.createDataFrame(rows, "node_id string, namespace string, vector array<double>"), spark.createDataFrame(queries, "query_id long, namespace string, vector array<double>")
    for block in (1000, 7):
        monkeypatch.setattr(search, "VECTOR_BLOCK", block)
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        assert {(r.query_id, r.node_id, round(r.similarity, 5), r["rank"]) for r in search.top_k_each(*frames, 4, group="namespace").collect()} == want
    across = {(r.a, r.b) for r in search.similar_across(frames[0], 0.9).collect()}
    by = {n: (g, x) for n, g, x in rows}
    assert across == {(a, b) for a in by for b in by if a < b and by[a][0] != by[b][0] and by[a][1] and by[b][1] and cosine(by[a][1], by[b][1]) >= 0.9}


LOREM = "Lorem ipsum dolor sit amet. " * 20


def test_chunks(spark):
    for body in (LOREM, "日本語のテキスト🙂。" * 60, "no breaks" * 80, "Señor Gómez. ¿Qué tal? " * 30):
        raw = body.strip().encode()
        got = chunk.windows(body, 100, 20, 50)
        assert got[0][1] == 0 and got[-1][2] == len(raw)
        for (text, a, b), after in zip(got, [*got[1:], None], strict=True):
            assert raw[a:b].decode().strip() == text and b - a <= 150 and (after is None or a < after[1] <= b)
    assert chunk.windows("  short ") == [("short", 0, 5)] and chunk.windows(" ") == []
    assert chunk.windows(LOREM, 100, 20, 50)[0][0].endswith("amet.")
    rows = chunk.chunked(spark.createDataFrame([(1, LOREM), (2, None), (3, "x")], "doc_id long, text string"), size=100, overlap=20, least=50).collect()
    assert {r.doc_id for r in rows} == {1, 3} and all(r.total == sum(x.doc_id == r.doc_id for x in rows) for r in rows)


def test_sentences():
    assert chunk.sentences("Dr. Smith met J. Doe. It was 3.5 km! Really? Yes") == ["Dr. Smith met J. Doe.", "It was 3.5 km!", "Really?", "Yes"]
    got = chunk.packed_sentences("One two three. " * 20, 60, 10, 5)
    assert all(len(x) <= 60 for x, _, _ in got) and got[1][1] == got[0][2] - 10
    assert chunk.packed_sentences("Hi.", 100, 10, 50) == []


def test_written_tables_can_be_cleared(spark):
    from pathlib import Path

    from graphloom import common

    path = common.scratch(spark)
    spark.range(3).write.parquet(path)
    kept, common._WRITTEN[:] = [x for x in common._WRITTEN if x != path], [path]
    assert common.clear(spark) == 1 and not Path(path).exists() and common._WRITTEN == []
    common._WRITTEN[:] = kept


def test_relaxation_by_blocks_equals_joins(spark, tmp_path):
    """Two spaces, many equal lengths: blocks and joins give the same paths, and candidates of a round are no rows."""
    import random

    rng = random.Random(5)
    ends = [("a", f"a{x}", f"a{y}") for x in range(70) for y in range(x) if rng.random() < 0.15] + [("b", f"b{x}", f"b{y}") for x in range(9) for y in range(x) if (x + y) % 3]
    rows = [(s, *p, rng.choice([1.0, 0.5, 0.4, 1 / 3, 0.3])) for s, x, y in ends for p in ((x, y), (y, x))]
    edges = spark.createDataFrame([r[1:] for r in rows], "src string, dst string, similarity double")
    spaces = spark.createDataFrame(sorted({(r[1], r[0]) for r in rows} | {("c", "c")}), "node string, space string")
    sources = spark.createDataFrame([("a1",), ("a5",), ("a60",), ("b2",), ("c",)], "source string")
    told = lambda found: sorted((r.source, r.node, r.distance, r.hops, *map(tuple, r[4:])) for r in found.collect())
    joined, apart, mixed = (told(paths.relax(edges, sources, 3, with_similarities=True, spaces=spaces, block_edges=n)) for n in (0, 10**6, 100))
    assert joined == apart == mixed
    assert [r[:4] for r in joined] == told(paths.relax(edges, sources, 3, with_paths=False))
    assert max(r[3] for r in joined) == 3 and [r[4] for r in joined if r[0] == "c"] == [("c",)]
    found = paths.relax(edges, sources, 3, with_similarities=True, spaces=spaces)
    product = lambda rows: {(r.source, r.node): (round(r.product, 9), round(r.cost, 9)) for r in paths.path_product(edges, rows).collect()}
    assert product(found) == product(found.drop("similarities"))
