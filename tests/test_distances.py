import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rimward import distances as di
from rimward import catalog, nearest, pieces, transform
from rimward.expr import segment_distance
from tests.helpers import nodes, values


def test_rectangle_has_corners_at_zero_and_the_centre_inside(spark):
    got = values(di.distance_to_rectangular_border(nodes(spark, [(-2, 1), (6, 1), (6, 4), (-2, 4), (3, 2)])), di.RECTANGLE)
    assert got.tolist() == [0, 0, 0, 0, 1]


def test_rectangle_needs_the_plane(spark):
    with pytest.raises(ValueError, match="Nx2"):
        di.distance_to_rectangular_border(nodes(spark, np.ones((5, 3))))


def test_hull_in_the_plane_matches_brute_force(spark):
    rng = np.random.default_rng(42)
    p = rng.uniform(0, 1, (40, 2))
    got = values(di.distance_to_convex_hull(nodes(spark, p)), di.HULL)
    sides = []
    for i in range(40):
        for j in range(i + 1, 40):
            side = (p[j, 0] - p[i, 0]) * (p[:, 1] - p[i, 1]) - (p[j, 1] - p[i, 1]) * (p[:, 0] - p[i, 0])
            if (np.delete(side, [i, j]) > 0).all() or (np.delete(side, [i, j]) < 0).all():
                ab = p[j] - p[i]
                t = np.clip((p - p[i]) @ ab / (ab @ ab), 0, 1)
                sides.append(np.linalg.norm(p - p[i] - t[:, None] * ab, axis=1))
    assert np.allclose(got, np.min(sides, axis=0))


def test_hull_of_border_and_inner_points(spark):
    border = [(-3, 0), (0, -4), (3, 0), (0, 4), (1.5, 2)]  # a rhombus with sides of length 5, and a point on one
    got = values(di.distance_to_convex_hull(nodes(spark, [*border, (0, 0), (0, 2), (1, 0)])), di.HULL)
    assert np.allclose(got, [0] * 5 + [2.4, 1.2, 1.6])


def test_hull_in_space(spark):
    cube = [(i, j, k) for i in range(3) for j in range(3) for k in range(3)]
    got = values(di.distance_to_convex_hull(nodes(spark, cube)), di.HULL)
    assert np.allclose(got, [min(*p, *(2 - c for c in p)) for p in cube])


def test_small_samples_are_all_border(spark):
    assert values(di.distance_to_convex_hull(nodes(spark, [(1, 1), (5, 2)])), di.HULL).tolist() == [0, 0]
    assert di.distance_to_convex_hull(nodes(spark, [])).count() == 0


def test_collinear_samples_have_no_hull(spark):
    with pytest.raises(ValueError, match="degenerate"):
        di.distance_to_convex_hull(nodes(spark, [(0, 0), (1, 1), (2, 2), (3, 3)]))


def test_pointset(spark):
    marks = spark.createDataFrame([(3.0, -1.0), (8.0, 8.0)], "x double, y double")
    got = values(di.distance_to_pointset(nodes(spark, [(8, 8), (6, 3), (0, 3)]), marks), di.POINTSET)
    assert np.allclose(got, [0, 5, 5])
    with pytest.raises(ValueError, match="at least one"):
        di.distance_to_pointset(nodes(spark, [(1, 0)]), marks.where("x > 50"))
    with pytest.raises(ValueError, match="dimensionality"):
        di.distance_to_pointset(nodes(spark, [(1, 0, 0)]), marks)


def test_pointset_of_all_samples_is_one_grid(spark, monkeypatch):
    monkeypatch.setattr(nearest, "DIRECT_ROWS", 50)
    rng = np.random.default_rng(13)
    marks, p = rng.normal(size=(400, 2)), np.vstack([rng.normal(size=(60, 2)), [[30.0, -40.0], [0.0, 500.0]]])
    df = nodes(spark, p, "one").unionByName(nodes(spark, p + 1, "two"))
    got = di.distance_to_pointset(df, spark.createDataFrame([tuple(map(float, m)) for m in marks], "x double, y double"))
    for sample, shift in (("one", 0), ("two", 1)):
        want = np.linalg.norm(p[:, None] + shift - marks[None], axis=2).min(axis=1)
        assert np.allclose(values(got.where(f"sample_id = '{sample}'"), di.POINTSET), want)


def test_distance_to_triangles_equals_dense_sampling(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PACK", 2)
    rng = np.random.default_rng(14)
    p, corners = rng.uniform(-2, 2, (40, 3)), rng.uniform(-1, 1, (5, 3, 3))
    corners[4, 2] = corners[4, 1]  # no area: a segment
    rows = [("all", *[c.tolist() for c in t]) for t in corners]
    got = values(di.distance_to_triangles(nodes(spark, p), spark.createDataFrame(rows, "sample_id string, a array<double>, b array<double>, c array<double>")), di.TRIANGLES)
    u, v = np.meshgrid(np.linspace(0, 1, 201), np.linspace(0, 1, 201))
    u, v = u[u + v <= 1 + 1e-12], v[u + v <= 1 + 1e-12]
    inside = np.concatenate([t[0] + u[:, None] * (t[1] - t[0]) + v[:, None] * (t[2] - t[0]) for t in corners])
    want = np.array([np.linalg.norm(inside - x, axis=1).min() for x in p])
    assert (got <= want + 1e-9).all() and np.allclose(got, want, atol=0.02)
    with pytest.raises(ValueError, match="three coordinates"):
        di.distance_to_triangles(nodes(spark, [(0, 0)]), spark.createDataFrame(rows, "sample_id string, a array<double>, b array<double>, c array<double>"))


def test_mask_rounds_half_to_even_and_clips(spark):
    on = spark.createDataFrame([(i, j) for i in range(5, 15) for j in range(5, 15)], "i int, j int")
    got = values(di.distance_to_mask(nodes(spark, [(10, 10), (4.5, 10), (5.5, 10), (-7, 10), (99, 99)]), on, (20, 20)), di.MASK)
    assert np.allclose(got, [0, 1, 0, 5, np.hypot(5, 5)])
    with pytest.raises(ValueError, match="dimensionality"):
        di.distance_to_mask(nodes(spark, [(1, 1)]), on, (20, 20, 20))
    with pytest.raises(ValueError, match="True"):
        di.distance_to_mask(nodes(spark, [(1, 1)]), on.where("i > 99"), (20, 20))


def _dense(spark, on, sample=None):
    rows = [(*([sample] if sample else []), *map(int, p)) for p in np.argwhere(on)]
    return spark.createDataFrame(rows, ("sample_id string, " if sample else "") + ", ".join(f"{a} int" for a in "ijk"[: on.ndim]))


@pytest.mark.parametrize(("shape", "share"), [((150, 70), 0.5), ((70, 150), 0.15), ((31, 20, 66), 0.3), ((25, 40, 9), 0.9)])
def test_dense_masks_equal_brute_force(spark, shape, share):
    rng = np.random.default_rng(23)
    on = rng.uniform(size=shape) < share
    on[tuple(slice(n // 3, n // 2) for n in shape)] = False  # a hole
    on[0] = False  # a line without a pixel
    p = rng.uniform(-3, max(shape) + 3, (200, len(shape)))
    p[:50] = np.array(shape) * 0.42 + rng.normal(size=(50, len(shape)))
    got = values(di.distance_to_mask(nodes(spark, p), _dense(spark, on), shape), di.MASK)
    cells = np.clip(np.rint(p), 0, np.array(shape) - 1)
    want = np.linalg.norm(cells[:, None] - np.argwhere(on)[None], axis=2).min(axis=1)
    assert on.sum() > nearest.DIRECT_ROWS and want.max() > 1 and np.allclose(got, want, atol=1e-12)


def test_dense_masks_of_samples_are_their_own(spark):
    rng = np.random.default_rng(24)
    first, second = np.zeros((60, 60), bool), np.zeros((60, 60), bool)
    first[:20], second[:, 45:] = True, True
    p = rng.uniform(0, 59, (40, 2))
    df = nodes(spark, p, "one").unionByName(nodes(spark, p, "two")).unionByName(nodes(spark, p, "unmasked"))
    rows = _dense(spark, first, "one").unionByName(_dense(spark, second, "two"))
    rows = rows.unionByName(rows).unionByName(spark.createDataFrame([("one", 60, 3), ("one", -1, 3)], rows.schema))  # repeated, and outside of the shape
    got = di.distance_to_mask(df, rows, (60, 60))
    assert np.allclose(values(got.where("sample_id = 'one'"), di.MASK), np.maximum(np.rint(p[:, 0]) - 19, 0))
    assert np.allclose(values(got.where("sample_id = 'two'"), di.MASK), np.maximum(45 - np.rint(p[:, 1]), 0))
    assert got.where("sample_id = 'unmasked'").count() == 0


def test_lower_envelope_equals_the_least_of_all_parabolas():
    rng = np.random.default_rng(25)
    for n in (1, 2, 9, 60):
        at = np.sort(rng.choice(200, n, replace=False))
        heights = rng.integers(0, 400, (n, 7)).astype(float) ** rng.integers(1, 3)
        x = np.unique(rng.integers(0, 200, 50))
        want = ((x[:, None] - at) ** 2)[:, :, None] + heights
        assert np.array_equal(transform.lower_envelope(at, heights, x), want.min(axis=1))


def test_mask_pixels(spark):
    rows = spark.createDataFrame([([[True, False], [False, True]],)], "mask array<array<boolean>>")
    assert {(r["i"], r["j"]) for r in di.mask_pixels(rows).collect()} == {(0, 0), (1, 1)}


def test_alpha_zero_is_the_hull(spark):
    p = nodes(spark, np.random.default_rng(31).normal(0, 20, (70, 2)))
    assert np.allclose(values(di.distance_to_alpha_shape(p, 0.0), di.ALPHA), values(di.distance_to_convex_hull(p), di.HULL))


def test_alpha_shape_follows_a_concave_border(spark):
    rng = np.random.default_rng(15)
    angle, radius = rng.uniform(0.3, 2 * np.pi - 0.3, 500), np.sqrt(rng.uniform(16, 36, 500))
    arc = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)  # a broken ring, and a node on its inner side
    p = nodes(spark, np.vstack([arc, [(-4.05, 0)]]))
    assert values(di.distance_to_alpha_shape(p, 0.8), di.ALPHA)[-1] < 0.5 < 1.5 < values(di.distance_to_alpha_shape(p, 0.0), di.ALPHA)[-1]


def test_alpha_shape_of_two_clouds_warns(spark):
    turn = np.arange(25.0)
    spiral = np.stack([np.sqrt(turn) * np.cos(2.4 * turn), np.sqrt(turn) * np.sin(2.4 * turn)], axis=1) / 8
    p = np.vstack([spiral, spiral + 20])
    with pytest.warns(UserWarning, match="MultiPolygon"):
        di.distance_to_alpha_shape(nodes(spark, p), 2.0)


def test_alpha_shape_errors(spark):
    with pytest.raises(ValueError, match="3 points"):
        di.distance_to_alpha_shape(nodes(spark, [(0, 0), (1, 1)]), 1.0)
    with pytest.raises(ValueError, match="Nx2"):
        di.distance_to_alpha_shape(nodes(spark, np.ones((4, 3))), 1.0)
    with warnings.catch_warnings(), pytest.raises(ValueError, match="empty"):
        di.distance_to_alpha_shape(nodes(spark, [(0, 0), (700, 40), (300, 900), (900, 800), (450, 350)]), 10.0)


def _circle_border(spark, n):
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (1 + 0.2 * np.sin(5 * turn))[:, None]
    edges = [("all", *map(float, (*a, *b))) for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True)]
    parts = spark.createDataFrame(edges, "sample_id string, ax double, ay double, bx double, by double")
    return ring, parts.select("sample_id", F.struct("ax", "ay", "bx", "by").alias("edge"))


def _edge_gap(e):
    return segment_distance([F.col("x"), F.col("y")], [e["ax"], e["ay"]], [e["bx"], e["by"]])


def _edge_corners(e):
    return [[e["ax"], e["ay"]], [e["bx"], e["by"]]]


def test_nodes_meet_few_of_a_large_borders_edges(spark):
    ring, parts = _circle_border(spark, 100_000)
    p = np.random.default_rng(21).uniform(-1.3, 1.3, (400, 2))
    p[:100] = p[:100] / 1000 + 0.6  # a dense corner
    df = nodes(spark, p)
    met = pieces._met(df, parts.withColumnRenamed("edge", "part"), ["x", "y"], _edge_corners)
    assert met.agg(F.sum(F.size("parts"))).first()[0] < 400 * 100_000 / 20
    got = values(pieces.least_gap(df, parts, "edge", _edge_gap, _edge_corners), "gap")
    side = np.roll(ring, -1, axis=0) - ring
    want = []
    for x in p:
        t = np.clip(((x - ring) * side).sum(1) / (side * side).sum(1), 0, 1)
        want.append(np.linalg.norm(x - ring - t[:, None] * side, axis=1).min())
    assert np.allclose(got, want, atol=1e-12)


def test_trees_of_cells_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(22)
    flat, space = nodes(spark, rng.normal(size=(300, 2))), nodes(spark, rng.normal(size=(300, 3)))
    tris = [("all", *[c.tolist() for c in rng.normal(size=3) * 3 + rng.normal(size=(3, 3)) * s]) for s in rng.choice([0.01, 3.0], 200)]
    triangles = spark.createDataFrame(tris + tris[:20], "sample_id string, a array<double>, b array<double>, c array<double>")
    ways = [lambda: di.distance_to_convex_hull(flat), lambda: di.distance_to_convex_hull(space), lambda: di.distance_to_alpha_shape(flat, 0.5), lambda: di.distance_to_triangles(space, triangles)]
    direct = [values(w(), w().columns[-1]) for w in ways]
    monkeypatch.setattr(pieces, "DIRECT_PIECES", 2)
    monkeypatch.setattr(pieces, "LEAF", 16)
    for way, want in zip(ways, direct, strict=True):
        assert np.allclose(values(way(), way().columns[-1]), want, atol=1e-12)


def test_pieces_in_one_place_are_met_whole(spark, monkeypatch):
    monkeypatch.setattr(pieces, "DIRECT_PIECES", 2)
    monkeypatch.setattr(pieces, "LEAF", 2)
    one = spark.createDataFrame([("all", 1.0, 1.0, 1.0, 1.0)] * 30, "sample_id string, ax double, ay double, bx double, by double").select("sample_id", F.struct("ax", "ay", "bx", "by").alias("edge"))
    got = values(pieces.least_gap(nodes(spark, [(1, 1), (4, 5)]), one, "edge", _edge_gap, _edge_corners), "gap")
    assert got.tolist() == [0, 5]


@pytest.mark.parametrize("kept", [catalog.TILES**2, catalog.TILES**2 - 40])
def test_dense_mask_query_where_nodes_take_all_tiles_or_almost_all(spark, tmp_path, kept):
    side = np.arange(catalog.TILES)
    a, b = (np.ravel(g) for g in np.meshgrid(side, side))
    x, y = ((g * catalog.TILE + 5 - catalog.TILES * catalog.TILE / 2) / (2.0 * catalog.TILES * catalog.TILE) for g in (a, b))
    rows = [(int(i), [float(x[i]), float(y[i])], int(i) % 2) for i in range(kept)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r[0], r[1]): r[2] for r in catalog.dist_mask_dense(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = {(r[0], r[1]): r[2] for r in db.sql(catalog.oracle_sql()["dist_mask_dense"]).fetchall()}
    assert got == want and len(got) == (0 if kept == catalog.TILES**2 else kept)


@pytest.mark.parametrize("most", [2, 1_024])
def test_gaps_to_pieces_are_compiled_rows_not_lambdas_over_arrays(spark, monkeypatch, most):
    monkeypatch.setattr(pieces, "DIRECT_PIECES", most)
    ring = [(float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 2 * np.pi, 9)]
    parts = spark.createDataFrame([("a", (*p, *q)) for p, q in zip(ring[:-1], ring[1:], strict=True)], "sample_id string, edge struct<ax: double, ay: double, bx: double, by: double>")
    got = pieces.least_gap(nodes(spark, [(0, 0), (0.5, 0.1), (0.9, 0.9)], "a"), parts, "edge", _edge_gap, _edge_corners)
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 3 and abs(got.where("node_id = 0").first()["gap"] - np.cos(np.pi / 8)) < 1e-12
