import numpy as np
import pytest

from rimward import delaunay, graph, nearest, tiles
from rimward.geometry import hull_2d, hull_facets_3d, tetrahedralise, triangulate
from tests.helpers import nodes, pairs


@pytest.fixture
def jittered():
    """Two rows of five, each a little off its place."""
    rows = np.stack([np.tile(np.arange(5.0), 2), np.repeat([0.0, 1.0], 5)], axis=1)
    return rows + 0.04 * np.sin(np.arange(20.0).reshape(10, 2) * 7)


def test_knn_has_k_edges_per_node(spark, jittered):
    got = pairs(graph.knn_edges(nodes(spark, jittered), 2))
    d = np.linalg.norm(jittered[:, None] - jittered[None], axis=2) + np.diag([np.inf] * 10)
    assert got == {(i, int(j)) for i in range(10) for j in np.argsort(d[i])[:2]}


@pytest.mark.parametrize("dimensions", [2, 3])
def test_knn_by_grid_equals_brute_force(spark, monkeypatch, dimensions):
    monkeypatch.setattr(nearest, "DIRECT_ROWS", 0)
    p = np.vstack([np.random.default_rng(1).normal(size=(150, dimensions)), [[40.0] * dimensions]])
    got = pairs(graph.knn_edges(nodes(spark, p), 5))
    d = np.linalg.norm(p[:, None] - p[None], axis=2) + np.diag([np.inf] * len(p))
    assert got == {(i, int(j)) for i in range(len(p)) for j in np.argsort(d[i])[:5]}


@pytest.mark.parametrize("k", [1, 6])
def test_knn_of_clusters_outliers_and_equal_points(spark, monkeypatch, k):
    monkeypatch.setattr(nearest, "DIRECT_ROWS", 0)
    made, store = [], nearest.stored
    rng = np.random.default_rng(5)
    p = np.vstack([rng.normal(0, 1e-4, (700, 2)), rng.normal(50, 1e-2, (200, 2)), rng.uniform(-1000, 1000, (80, 2)), np.full((15, 2), 7.0), [[1e6, 0]]])
    monkeypatch.setattr(nearest, "stored", lambda df, label, **kw: made.append((label, df.count())) or store(df, label, **kw))
    got = pairs(graph.knn_edges(nodes(spark, p), k))
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(len(p)) for j in np.lexsort((np.arange(len(p)), d[i]))[:k]}
    assert {label for label, _ in made} >= {"cells", "queries", "near"}


def test_knn_needs_enough_nodes(spark, jittered):
    with pytest.raises(ValueError):
        graph.knn_edges(nodes(spark, jittered), 10)


def test_rnn(spark, jittered):
    d = np.linalg.norm(jittered[:, None] - jittered[None], axis=2)
    assert pairs(graph.rnn_edges(nodes(spark, jittered), 1.02)) == {(i, j) for i in range(10) for j in range(i + 1, 10) if d[i, j] <= 1.02}
    assert pairs(graph.rnn_edges(nodes(spark, jittered), 0)) == set()
    assert pairs(graph.rnn_edges(nodes(spark, [(1, 1), (1, 1), (2, 2)]), 0)) == {(0, 1)}


def test_delaunay_ties_fan_from_the_smallest_id(spark):
    grid = [(i, j) for i in range(5) for j in range(5)]
    assert len(pairs(graph.delaunay_edges(nodes(spark, grid)))) == 56
    hexagon = [(np.cos(k * np.pi / 3), np.sin(k * np.pi / 3)) for k in range(6)]
    got = pairs(graph.delaunay_edges(nodes(spark, hexagon)))
    assert len(got) == 9 and {(0, k) for k in range(1, 6)} <= got


def clouds():
    rng = np.random.default_rng(3)
    grid = np.array([(i, j) for i in range(14) for j in range(14)], float)
    cube = np.array([(i, j, k) for i in range(4) for j in range(4) for k in range(4)], float)
    return {
        "two squares": np.vstack([rng.uniform(0, 1, (300, 2)), rng.uniform(3, 4, (60, 2))]), "dense corner": np.vstack([rng.uniform(0.5, 0.6, (380, 2)), rng.uniform(0, 1, (20, 2))]),
        "grid": grid, "space": rng.uniform(0, 1, (90, 3)), "dense corner in space": np.vstack([rng.uniform(0.5, 0.55, (76, 3)), rng.uniform(0, 1, (4, 3))]), "cube": cube,
    }


@pytest.mark.parametrize("name", clouds())
def test_delaunay_in_tiles_equals_one_block(spark, monkeypatch, name):
    p, capacity, sizes = clouds()[name], 24, []
    stored = delaunay.stored

    def watched(df, label, **kw):
        out = stored(df, label, **kw)
        if label == "leaf-nodes":
            sizes.append(out.groupBy("depth", *[c for c in out.columns if c.startswith("t_")]).count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(tiles, "stored", watched)
    corners, _, _ = (triangulate if p.shape[1] == 2 else tetrahedralise)(p, np.arange(len(p)))
    if p.shape[1] == 2 and name != "grid":
        assert len(corners) == 2 * len(p) - 2 - len(hull_2d(p))
    got = delaunay.delaunay_simplices(nodes(spark, p), capacity).collect()
    assert sorted(r["corners"] for r in got) == sorted(sorted(c) for c in corners.tolist())
    assert sizes[0] <= capacity and (len(sizes) > 1 or p.shape[1] == 3)  # no leaf over the bound, and several levels


def test_blocks_leave_out_crowded_tiles(spark):
    p = np.vstack([np.random.default_rng(4).uniform(0.5, 0.6, (950, 2)), np.random.default_rng(5).uniform(0, 1, (50, 2))])
    df = nodes(spark, p)
    tree = tiles.Tree.of(tiles.finest(df, tiles.boxes(df, ["x", "y"]), ["x", "y"]), ["x", "y"], 20)
    assert tree.nodes.count() == 1000 and tree.leaves.agg({"n": "sum"}).first()[0] == 1000
    blocks = tree.blocks()
    assert blocks.where("core").count() == 1000
    assert blocks.groupBy("b_depth", "b_t_x", "b_t_y").count().agg({"count": "max"}).first()[0] <= 9 * 20
    assert blocks.where("left_out > 0").count() > 0


def test_blocks_hold_tiles_of_up_to_so_many_nodes(spark):
    p = np.vstack([np.random.default_rng(4).uniform(0.5, 0.6, (150, 2)), np.random.default_rng(5).uniform(0, 1, (50, 2))])
    df = nodes(spark, p)
    tree = tiles.Tree.of(tiles.finest(df, tiles.boxes(df, ["x", "y"]), ["x", "y"]), ["x", "y"], 20)
    strict, held = (tree.blocks(most).select("b_depth", "b_t_x", "b_t_y", "node_id", "core", "left_out").toPandas() for most in (0, 200))
    assert strict["left_out"].max() > 0 and held["left_out"].max() == 0
    assert held["core"].sum() == 200 and not held.duplicated(["b_depth", "b_t_x", "b_t_y", "node_id"]).any()
    assert len(held) > len(strict)


def test_tetrahedra_have_empty_spheres_and_fill_the_hull():
    p = np.random.default_rng(6).random((60, 3))
    corners, centres, radii = tetrahedralise(p, np.arange(60))
    away = np.linalg.norm(p[None] - centres[:, None], axis=2)
    assert (away > radii[:, None] * (1 - 1e-9)).all()
    volume = lambda q: abs(np.linalg.det(q[:, 1:] - q[:, :1])).sum() / 6
    middle = p.mean(axis=0)
    hull = [np.stack([middle, p[f[0]], p[a], p[b]]) for f in hull_facets_3d(p) for a, b in zip(f[1:-1], f[2:], strict=True)]
    assert np.isclose(volume(p[corners]), volume(np.array(hull)))
    assert len(tetrahedralise(np.c_[p[:, :2], np.zeros(60)], np.arange(60))[0]) == 0


def test_delaunay_in_space(spark):
    p = np.random.default_rng(7).random((30, 3))
    corners, _, _ = tetrahedralise(p, np.arange(30))
    assert pairs(graph.delaunay_edges(nodes(spark, p))) == {tuple(sorted((int(t[a]), int(t[b])))) for t in corners for a in range(4) for b in range(a)}
    with pytest.raises(ValueError, match="degenerate"):
        graph.delaunay_edges(nodes(spark, np.c_[p[:, :2], np.ones(30)]))


@pytest.mark.parametrize("dimensions", [2, 3])
def test_kernels_walk_only_around_the_core(dimensions):
    rng = np.random.default_rng(8)
    p, ids = np.vstack([rng.normal(size=(150, dimensions)), np.stack(np.meshgrid(*[np.arange(3.0)] * dimensions), axis=-1).reshape(-1, dimensions) + 5]), rng.permutation(150 + 3**dimensions)
    kernel, core = triangulate if dimensions == 2 else tetrahedralise, np.arange(len(p)) % 15 == 0
    whole, some = (sorted(sorted(c) for c in corners.tolist()) for corners, _, _ in (kernel(p, ids), kernel(p, ids, core)))
    around = [c for c in whole if core[c].any()]
    assert [c for c in some if core[c].any()] == around and len(around) < len(some) + 1 < 0.8 * len(whole)


def test_few_nodes_stay_open_beside_dense_tiles(spark, monkeypatch):
    """Uneven clouds: tiles beside a leaf that hold some more than a leaf may are still in its block."""
    p, left, stored = np.random.default_rng(9).normal(size=(900, 2)), [], delaunay.stored
    monkeypatch.setattr(delaunay, "stored", lambda df, label, **kw: (out := stored(df, label, **kw), left.append(out.count()) if label == "open-nodes" else None)[0])
    got = delaunay.delaunay_simplices(nodes(spark, p), 24).collect()
    corners, _, _ = triangulate(p, np.arange(len(p)))
    assert sorted(r["corners"] for r in got) == sorted(sorted(c) for c in corners.tolist())
    assert left[0] == 900 and left[1] < 200


def test_delaunay_of_a_line_is_an_error(spark):
    with pytest.raises(ValueError, match="degenerate"):
        graph.delaunay_edges(nodes(spark, [(0, 0), (1, 1), (2, 2)]))


def test_dispatch(spark, jittered):
    n = nodes(spark, jittered)
    assert pairs(graph.construct_graph(n, "knn", k=3)) == pairs(graph.knn_edges(n, 3))
    assert pairs(graph.construct_graph(n, "rnn", r=0.5)) == pairs(graph.rnn_edges(n, 0.5))
    for bad in ({"graph_type": "knn"}, {"graph_type": "rnn"}, {"graph_type": "other"}):
        with pytest.raises(ValueError):
            graph.construct_graph(n, **bad)
