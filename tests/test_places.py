"""Spatial joins and density clusters against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotmark.operators import dbscan as grid, spatial
from plotmark.operators.components import connected_components


def brute_clusters(x, ids, min_pts):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 1 + 1e-9
    core = near.sum(1) >= min_pts
    none = np.iinfo(np.int64).max
    label = np.where(core, ids, none)
    links = near & core[:, None] & core[None]
    while True:
        least = np.where(core, np.where(links, label[None], none).min(1), none)
        if (least == label).all():
            break
        label = least
    out = np.where(core, label, np.where(near & core[None], label[None], none).min(1))
    return np.where(out == none, -1, out)


def cases():
    rng = np.random.default_rng(3)
    third = np.repeat([[4.0, 4.0]], 200, 0)
    yield "copies hold a third", np.concatenate([rng.uniform(0, 14, (400, 2)), third, third + [1.0, 0]])
    yield "dense blobs one radius apart", np.concatenate(
        [rng.uniform(0, 0.3, (200, 2)), rng.uniform(0, 0.3, (200, 2)) + [1.28, 0.1], rng.uniform(0, 0.3, (200, 2)) + [9, 9]]
    )
    yield "three dimensions", rng.normal(0, 1.6, (500, 3))
    line = np.column_stack([np.arange(300) * 0.3, np.zeros(300)])
    yield "one long chain", line


def runs():
    """Every case, and again with halving for the one with dense cells."""
    return [(n, x, d) for n, x in cases() for d in ([1024, 4] if "dense" in n else [1024])]


@pytest.mark.parametrize("name,x,direct", runs(), ids=[f"{n}-{d}" for n, _, d in runs()])
def test_dbscan(spark, monkeypatch, name, x, direct):
    monkeypatch.setattr(grid, "DIRECT_PAIRS", direct)
    ids = np.random.default_rng(0).permutation(len(x))
    axes = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame({"id": ids, **{a: x[:, i] for i, a in enumerate(axes)}}))
    got = grid.dbscan(df, "id", axes, 1.0, 5).toPandas().set_index("id").loc[ids].cluster.to_numpy()
    np.testing.assert_array_equal(got, brute_clusters(x, ids, 5))


def test_years_two_apart_are_neighbours(spark):
    """Half a radius per year: two years apart at one spot is exactly one radius, for every year."""
    for year in (1950.0, 1975.0, 2010.0):
        rows = [(i, 0.1, 0.2, year + 2 * (i // 4)) for i in range(12)]
        df = spark.createDataFrame(rows, "id long, lon double, lat double, y double")
        got = grid.dbscan(df, "id", ["lon", "lat", "y"], [0.0007, 0.0007, 2.0], 5)
        assert {r.cluster for r in got.collect()} == {0}


def test_text_ids(spark):
    df = spark.createDataFrame([(f"r{i}", 0.1 * i, 0.0) for i in range(6)] + [("far", 99.0, 0.0)], "id string, x double, y double")
    got = {r.id: r.cluster for r in grid.dbscan(df, "id", ["x", "y"], 1.0, 5).collect()}
    assert got["far"] == "-1" and got["r3"] == "r0"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 3), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def ring(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def test_polygon_edges_belong_to_one_side(spark):
    left, right = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((1, 0), (2, 0), (2, 1), (1, 1))
    one = spark.range(1)
    polygons = one.select(F.lit(1).alias("poly_id"), left.alias("ring")).unionByName(one.select(F.lit(2).alias("poly_id"), right.alias("ring")))
    points = [(0, 0.0, 0.0), (1, 1.0, 0.5), (2, 2.0, 0.5), (3, 0.5, 1.0), (4, 0.5, 0.5), (5, None, 0.5)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.id: r.poly_id for r in spatial.points_in_polygons(df, polygons).collect()}
    assert got == {0: 1, 1: 2, 2: None, 3: None, 4: 1, 5: None}
    assert spatial.points_in_polygons(df, polygons, "inner").count() == 3


def test_repeated_ids_keep_their_own_place(spark):
    square = spark.range(1).select(F.lit(1).alias("poly_id"), ring((0, 0), (1, 0), (1, 1), (0, 1)).alias("ring"))
    df = spark.createDataFrame([(7, 0.5, 0.5), (7, 9.0, 9.0), (7, 0.5, 0.5), (None, 0.1, 0.1)], "id int, x double, y double")
    got = sorted((r.x, r.poly_id) for r in spatial.points_in_polygons(df, square).collect())
    assert got == [(0.1, 1), (0.5, 1), (0.5, 1), (9.0, None)]


def test_holes_and_parts(spark):
    hole = F.array(ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3)))
    parts = F.array(ring((10, 0), (11, 0), (11, 1), (10, 1)), ring((20, 0), (21, 0), (21, 1), (20, 1)))
    one = spark.range(1)
    shapes = one.select(F.lit(1).alias("poly_id"), hole.alias("ring")).unionByName(one.select(F.lit(2).alias("poly_id"), parts.alias("ring")))
    points = [(0, 0.5, 2.0), (1, 2.0, 2.0), (2, 10.5, 0.5), (3, 15.0, 0.5), (4, 20.5, 0.5)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.id: r.poly_id for r in spatial.points_in_polygons(df, shapes).collect()}
    assert got == {0: 1, 1: None, 2: 2, 3: None, 4: 2}


def test_difference_takes_shared_cover_off_once(spark):
    box = "id int, min_x double, min_y double, max_x double, max_y double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (3, 0.0, 0.0, 0.1, 0.1)], box)
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.6, 1.0), (2, 0.0, 0.0, 0.6, 1.0), (3, 0.5, 0.0, 0.7, 0.5)], box).withColumnRenamed("id", "b")
    got = {r.id: round(r.area, 9) for r in spatial.bbox_overlay(a, b, "id", "b", "difference").collect()}
    assert got == {1: 0.35, 2: 1.0}


def test_polygons_of_very_different_size(spark):
    rng = np.random.default_rng(5)
    shapes, boxes = None, []
    for k, extent in enumerate([1e-3, 0.02, 0.5, 3.0, 70.0]):
        x, y = rng.uniform(-1, 1, 2)
        boxes.append((k, x, y, extent))
        row = spark.range(1).select(
            F.lit(k).alias("poly_id"), ring((x, y), (x + extent, y), (x + extent, y + extent / 2), (x, y + extent)).alias("ring")
        )
        shapes = row if shapes is None else shapes.unionByName(row)
    pts = np.concatenate([rng.uniform(-2, 2, (300, 2)), [[b[1] + b[3] / 3, b[2] + b[3] / 3] for b in boxes]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    got = {r.id: r.poly_id for r in spatial.points_in_polygons(df, shapes).collect()}
    for i, (px, py) in enumerate(pts):
        inside = [k for k, x, y, e in boxes if 0 <= px - x < e and 0 <= py - y < e - (px - x) / 2]
        want = min(inside) if inside else None
        assert got[i] == want or (got[i] is not None and want is not None and np.isnan(got[i])), (i, got[i], want)


def test_overlay_against_brute_force(spark):
    rng = np.random.default_rng(8)
    def boxes(n, top):
        lo = rng.uniform(0, 10, (n, 2))
        return np.hstack([lo, lo + rng.uniform(0.01, top, (n, 2))])
    a, b = boxes(60, 3.0), boxes(40, 0.5)
    names = ["min_x", "min_y", "max_x", "max_y"]
    fa = spark.createDataFrame(pd.DataFrame(a, columns=names).assign(a=range(60)))
    fb = spark.createDataFrame(pd.DataFrame(b, columns=names).assign(b=range(40)))
    got = {(r.a, r.b): r.area for r in spatial.bbox_overlay(fa, fb, "a", "b").collect()}
    want = {}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if w > 0 and h > 0:
                want[i, j] = w * h
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_plans_hold_no_cross_product(spark, sf):
    from checks import places

    for df in (places.point_in_rect(spark, sf), places.bbox_intersection(spark, sf), places.dbscan(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def star(n, arms, seed=0):
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = 3 + np.cos(arms * turn) + np.random.default_rng(seed).uniform(0, 0.001, n)
    return np.column_stack([far * np.cos(turn), far * np.sin(turn)])


def even_odd(points, ring):
    """Crossings of each point's ray with all edges."""
    odd = np.zeros(len(points), bool)
    x, y = points.T
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
        if ay != by:
            odd ^= ((ay <= y) != (by <= y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return odd


@pytest.mark.parametrize("n,arms", [(7, 2), (300, 5), (100_000, 6)])
def test_rings_of_many_points(spark, n, arms):
    shape = star(n, arms)
    at = np.random.default_rng(1).uniform(-4.2, 4.2, (400, 2))
    at = np.concatenate([at, shape[:: max(n // 40, 1)]])
    rings = spark.createDataFrame([(1, [(float(a), float(b)) for a, b in shape])], "poly_id int, ring array<struct<x:double,y:double>>")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1]}))
    found = spatial.points_in_polygons(df, rings, "inner")
    np.testing.assert_array_equal(np.sort([r.id for r in found.collect()]), np.flatnonzero(even_odd(at, shape)))
    strips = spatial.shape_strips(rings, "poly_id", "ring").selectExpr("size(edges) AS n")
    mean, total = strips.selectExpr("avg(n)", "sum(n)").first()
    assert total <= 3 * n + 3
    # A strip holds a few times the edges that a horizontal line meets on average.
    rise = np.abs(np.diff(np.append(shape[:, 1], shape[0, 1])))
    assert mean <= 8 * rise.sum() / np.ptp(shape[:, 1]) + 4


def test_no_ring_is_shuffled(spark):
    shape = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (2.0, 3.0)])], "poly_id int, ring array<struct<x:double,y:double>>")
    plan = spatial.points_in_polygons(spark.createDataFrame([(1, 2.0, 1.0)], "id int, x double, y double"), shape)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    joins = text[: text.index("collect_set")]
    assert "_rings" not in joins and "ring#" not in joins


def test_parts_in_rows_of_one_id_and_repeated_polygons(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    inner = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    odd = [(None, None), (1.0, 1.0), (1.0, 1.0)]
    schema = "poly_id int, ring array<struct<x:double,y:double>>"
    shapes = spark.createDataFrame([(1, square), (1, square), (1, inner), (2, []), (3, odd), (4, None)], schema)
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.2, 0.2), (3, 3.0, 1.0)], "id int, x double, y double")
    assert {r.id: r.poly_id for r in spatial.points_in_polygons(df, shapes).collect()} == {1: 1, 2: 1, 3: None}
    assert spatial.points_in_polygons(df, shapes.limit(0)).filter("poly_id IS NULL").count() == 3


def test_covered_box_stays_with_area_zero_on_request(spark):
    box = "id int, min_x double, min_y double, max_x double, max_y double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.3, 0.1), (2, 5.0, 5.0, 6.0, 7.0)], box)
    b = spark.createDataFrame([(1, -1.0, -1.0, 0.2, 1.0), (2, 0.1, -1.0, 1.0, 1.0)], box.replace("id", "b"))
    left = {r.id: r.area for r in spatial.bbox_overlay(a, b, "id", "b", "difference", keep_covered=True).collect()}
    assert left == {1: 0.0, 2: 2.0}
    assert [r.id for r in spatial.bbox_overlay(a, b, "id", "b", "difference").collect()] == [2]
