import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rimward import centrality
from rimward.centrality import MEASURES, centralities
from rimward.storage import _KEY, tables_dir
from tests.helpers import values


def frames(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    return nodes, spark.createDataFrame(edges, "src long, dst long")


def scores(spark, n, edges, measure):
    return values(centralities(*frames(spark, n, edges), [measure]), measure).round(6).tolist()


def test_path(spark):
    path = [(0, 1), (2, 1)]
    assert scores(spark, 3, path, "betweenness") == [0, 1, 0]
    assert scores(spark, 3, path, "closeness") == [0.666667, 1, 0.666667]
    assert scores(spark, 3, path, "harmonic") == [0.75, 1, 0.75]
    assert scores(spark, 3, path, "degree") == [1, 2, 1]


def test_star_and_cycle(spark):
    assert scores(spark, 5, [(0, k) for k in range(1, 5)], "betweenness") == [1, 0, 0, 0, 0]
    assert scores(spark, 6, [(k, (k + 1) % 6) for k in range(6)], "betweenness") == [0.2] * 6


def test_clustering_of_triangles_and_an_isolated_node(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (4, 5), (5, 6), (4, 6)]
    assert scores(spark, 8, edges, "clustering") == [1, 1, 0.333333, 0, 1, 1, 1, 0]
    assert scores(spark, 8, edges, "closeness")[7] == 0


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    got = scores(spark, 4, [(0, 1), (1, 2)], "pagerank")
    assert abs(sum(got) - 1) < 1e-4 and got[1] == max(got) and got[3] == min(got)


def test_pagerank_of_many_samples_equals_that_of_few(spark, monkeypatch):
    nodes = spark.createDataFrame([(s, i) for s in "abc" for i in range(5)], "sample_id string, node_id long")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 0, 2), ("b", 0, 3), ("b", 0, 4), ("c", 3, 4)], "sample_id string, src long, dst long")
    rows = lambda: sorted(map(tuple, centralities(nodes, edges, ["pagerank"]).collect()))
    few = rows()
    monkeypatch.setattr(centrality, "FEW_SAMPLES", 0)
    assert rows() == few


@pytest.mark.parametrize("problem", [ArithmeticError("no"), ValueError("no"), RuntimeError("no")])
def test_a_measure_that_fails_is_left_out(spark, monkeypatch, problem):
    def fails(graph):
        raise problem

    monkeypatch.setattr(centrality, "clustering", fails)
    nodes, edges = frames(spark, 3, [(0, 1), (1, 2)])
    with pytest.warns(UserWarning, match="clustering failed"):
        got = centralities(nodes, edges, ["degree", "clustering", "closeness"])
    assert got.columns == ["sample_id", "node_id", "degree", "closeness"]


def test_a_failure_of_spark_is_raised(spark, monkeypatch):
    monkeypatch.setattr(centrality, "clustering", lambda g: g.filled(g.nodes.select("sample_id", "node_id", F.raise_error(F.lit("disk is full")).alias("clustering")), "clustering"))
    with pytest.raises(Exception, match="disk is full"):
        centralities(*frames(spark, 3, [(0, 1), (1, 2)]), ["degree", "clustering"])


def test_both_directions_are_one_edge_and_loops_count_twice(spark):
    assert scores(spark, 2, [(0, 1), (1, 0), (0, 0)], "degree") == [3, 1]


def test_samples_are_apart(spark):
    nodes = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1)], "sample_id string, node_id long")
    got = centralities(nodes, spark.createDataFrame([("a", 0, 1)], "sample_id string, src long, dst long"), ["degree"])
    assert {(r["sample_id"], r["node_id"]): r["degree"] for r in got.collect()} == {("a", 0): 1, ("a", 1): 1, ("b", 0): 0, ("b", 1): 0}


def test_all_measures_at_once_and_none(spark):
    nodes, edges = frames(spark, 4, [(0, 1), (1, 2), (2, 3)])
    assert set(centralities(nodes, edges, MEASURES).columns) == {"sample_id", "node_id", *MEASURES}
    assert centralities(nodes, edges, []).columns == ["sample_id", "node_id"]


def test_errors(spark):
    nodes, edges = frames(spark, 2, [(0, 7)])
    with pytest.raises(ValueError, match="nonsense"):
        centralities(nodes, edges, ["nonsense"])
    with pytest.raises(ValueError, match="aren't nodes"):
        centralities(nodes, edges, ["degree"])


def _from_all(n, edges):
    """Plain breadth-first searches and Brandes sums: closeness, harmonic and betweenness of each node."""
    near = {i: sorted({a + b - i for a, b in edges if i in (a, b) and a != b}) for i in range(n)}
    close, harm, between = [], [], [0.0] * n
    for s in range(n):
        far, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w], paths[w] = far[v] + 1, 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
            between[w] += owed[w] if w != s else 0
        r = len(far) - 1
        close.append(r / sum(far.values()) * r / (n - 1) if r else 0)
        harm.append(sum(1 / d for d in far.values() if d) / (n - 1))
    return {"closeness": close, "harmonic": harm, "betweenness": [b / (n - 1) / (n - 2) for b in between]}


def test_paths_in_batches_and_words_equal_plain_searches(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (190, 2))]  # over two words of sources, several parts, loops and repeats
    want = _from_all(150, edges)
    monkeypatch.setattr(centrality, "WORD_SOURCES", 80)
    monkeypatch.setattr(centrality, "PATH_SOURCES", 75)
    before = tables_dir(spark)
    spark.conf.set(_KEY, str(tmp_path))
    try:
        got = centralities(*frames(spark, 150, edges), list(want))
        for name, expected in want.items():
            assert np.allclose(values(got, name), expected), name
        left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
        assert not left & {"words", "level", "delta"}  # levels go once they are passed
    finally:
        spark.conf.set(_KEY, before)


@pytest.mark.parametrize("packed", [10**6, 100, 0])
def test_packed_searches_and_joins_equal_plain_searches(spark, monkeypatch, packed):
    rng = np.random.default_rng(9)
    edges = {"a": [(int(a), int(b)) for a, b in rng.integers(0, 90, (130, 2))], "b": [(int(a), int(b)) for a, b in rng.integers(0, 20, (25, 2))]}
    for name, value in {"PACKED_EDGES": packed, "TASK_WORK": 4_000, "HELD_WORDS": 1, "HELD_PATHS": 200}.items():  # many tasks, of several batches
        monkeypatch.setattr(centrality, name, value)
    joined = []
    for name in ("_reached_by_joins", "_owed_by_joins"):
        plain = getattr(centrality, name)
        monkeypatch.setattr(centrality, name, lambda g, plain=plain: joined.append({r[0] for r in g.nodes.select("sample_id").distinct().collect()}) or plain(g))
    nodes = spark.createDataFrame([("a", i) for i in range(90)] + [("b", i) for i in range(20)], "sample_id string, node_id long")
    got = centralities(nodes, spark.createDataFrame([(s, *e) for s, rows in edges.items() for e in rows], "sample_id string, src long, dst long"), ["closeness", "harmonic", "betweenness"])
    for sample, n in (("a", 90), ("b", 20)):
        for name, expected in _from_all(n, edges[sample]).items():
            assert np.allclose(values(got.where(f"sample_id = '{sample}'"), name), expected), (sample, name)
    assert joined == {10**6: [], 100: [{"a"}] * 2, 0: [{"a", "b"}] * 2}[packed]


@pytest.mark.parametrize(("side", "cost"), [(16_384, 50), (20, 10**9)])
def test_triangles_of_dense_samples_are_counted_without_wedges(spark, monkeypatch, side, cost):
    monkeypatch.setattr(centrality, "BITS_SIDE", side)
    monkeypatch.setattr(centrality, "WEDGE_WORDS", cost)
    made, store = {}, centrality.stored
    monkeypatch.setattr(centrality, "stored", lambda df, label, **kw: made.setdefault(label, store(df, label, **kw)))
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(12).integers(0, 70, (700, 2))]
    near = np.zeros((72, 72), int)
    for a, b in edges:
        near[a, b] = near[b, a] = a != b
    k, twice = near.sum(axis=1), np.diag(near @ near @ near)
    got = values(centralities(*frames(spark, 72, edges), ["clustering"]), "clustering")
    assert np.allclose(got, twice / np.maximum(k * (k - 1), 1)) and not made["oriented"].count()


def test_a_search_by_bits_touches_only_nodes_that_sources_come_to(monkeypatch):
    side = 48
    place = np.random.default_rng(1).permutation(side * side).reshape(side, side)
    ahead = np.concatenate([np.stack([place[:, :-1].ravel(), place[:, 1:].ravel()], axis=1), np.stack([place[:-1].ravel(), place[1:].ravel()], axis=1)])
    packed = centrality._pack(pd.DataFrame({"sample_id": "a", "src": np.concatenate(ahead.T), "dst": np.concatenate(ahead.T[::-1])})).iloc[0]
    ids, begins, ends = np.frombuffer(packed["ids"], np.int64), np.frombuffer(packed["begins"], np.int64), np.frombuffer(packed["ends"], np.int32)
    count, touched = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda bits: touched.append(bits.size) or count(bits))
    parts = [centrality._search_by_bits(begins, ends, *ends_of) for ends_of in ((0, 700), (700, side * side))]
    r, far, near = (sum(x) for x in zip(*parts, strict=True))
    i, j = np.divmod(np.argsort(place.ravel())[ids], side)
    gaps = np.abs(i[:, None] - i) + np.abs(j[:, None] - j)
    assert (r == side * side - 1).all() and (far == gaps.sum(axis=1)).all()
    assert np.allclose(near, (1 / np.maximum(gaps, 1)).sum(axis=1) - 1)
    levels, words = 2 * side - 2, side * side // 64
    assert sum(touched) < levels * words * side * side / 2


def test_near_order_holds_every_node_once():
    ring = np.arange(1200)
    src = np.concatenate([ring, (ring + 1) % 1200, [1200, 1201], [1202, 1203]])
    dst = np.concatenate([(ring + 1) % 1200, ring, [1201, 1200], [1203, 1202]])
    packed = centrality._pack(pd.DataFrame({"sample_id": "a", "src": src, "dst": dst})).iloc[0]
    ids = np.frombuffer(packed["ids"], np.int64)
    assert sorted(ids) == list(range(1204))
    begins, ends = np.frombuffer(packed["begins"], np.int64), np.frombuffer(packed["ends"], np.int32)
    found = {(ids[v], ids[w]) for v in range(1204) for w in ends[begins[v] : begins[v + 1]]}
    assert found == set(zip(src, dst, strict=True))
