"""Areas that polygons share: hand-made shapes, convex clipping, and rings of many points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotmark.operators import overlay, spatial

RING = "array<struct<x: double, y: double>>"


def table(spark, rows, nested=True):
    def real(ring):
        return ring and [tuple(map(float, p)) if not isinstance(p, list) else real(p) for p in ring]

    rows = [(k, real(rings)) for k, rings in rows]
    return spark.createDataFrame(rows, f"id long, ring {'array<' + RING + '>' if nested else RING}")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def areas(a, b):
    b = b.withColumnRenamed("id", "of")
    return {(r.id, r.of): r.area for r in overlay.polygon_overlaps(a, b, "id", "of").collect()}


def clipped(p, q):
    """Area of two convex counter-clockwise rings, by cutting one at each edge of the other."""
    for k in range(len(q)):
        (ax, ay), (bx, by) = q[k], q[(k + 1) % len(q)]
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in p]
        out = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                out.append(p[i])
            if side[i] * side[j] < 0:
                t = side[i] / (side[i] - side[j])
                out.append(tuple(np.add(p[i], t * np.subtract(p[j], p[i]))))
        p = out
        if not p:
            return 0.0
    return abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p)))) / 2


def test_holes_parts_and_directions(spark):
    a = table(spark, [
        (1, [box(0, 0, 4, 4), box(1, 1, 2, 2)]),  # a hole that runs the same way
        (2, [box(0, 0, 4, 4)[::-1], box(1, 1, 2, 2)]),  # outer clockwise
        (3, [box(0, 0, 1, 1), box(3, 3, 1, 1)[::-1]]),  # two parts
        (4, [box(0, 0, 4, 4), box(1, 1, 2, 2), box(1.5, 1.5, 1, 1)]),  # an island in a hole
        (5, None), (None, [box(0, 0, 4, 4)]), (6, []), (7, [[]]),
    ])
    b = table(spark, [(1, [box(0, 0, 4, 2)]), (2, [box(1, 1, 2, 2)]), (3, [[(0, 0), (4, 0), (0, 4)]]), (4, [box(4, 0, 1, 4)])])
    got = {k: round(v, 9) for k, v in areas(a, b).items()}
    assert got == {
        (1, 1): 6, (2, 1): 6, (3, 1): 1, (4, 1): 6.5,
        (4, 2): 1, (1, 3): 6, (2, 3): 6, (3, 3): 1, (4, 3): 6.5,
    }
    assert {r.id: r.area for r in overlay.polygon_area(a, "id").filter("id < 5").collect()} == {1: 12, 2: 12, 3: 2, 4: 13}
    assert areas(a.limit(0), b) == {}


def test_convex_shapes_against_clipping(spark):
    rng = np.random.default_rng(4)

    def shapes(n):
        out = []
        for k in range(n):
            turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
            x, y, r = *rng.uniform(0, 3, 2) + 1000, rng.uniform(0.1, 1.5)
            out.append((k, [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t in turn]))
        return out

    a, b = shapes(40), shapes(40)
    got = areas(table(spark, a, False), table(spark, b, False))
    for i, p in a:
        for j, q in b:
            assert got.get((i, j), 0.0) == pytest.approx(clipped(p, q), abs=1e-9)


def test_many_edges_meet_few(spark):
    """Two rings of 5,000 points around nearly the same circle: the share of the discs, from few pairs of edges."""
    turn = np.linspace(0, 2 * np.pi, 5000, endpoint=False)

    def disc(x):
        return [(float(x + np.cos(t)), float(np.sin(t))) for t in turn]

    d = 0.5
    a, b = table(spark, [(1, disc(0))], False), table(spark, [(1, disc(d))], False)
    want = 2 * np.arccos(d / 2) - d / 2 * np.sqrt(4 - d * d)
    assert areas(a, b)[1, 1] == pytest.approx(want, rel=1e-5)


def test_rectangles_equal_the_box_overlay(spark):
    rng = np.random.default_rng(5)
    rows = [[(k, *map(float, (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(rng.uniform(0.01, 1, (60, 4)))] for _ in "ab"]
    names = "id long, min_x double, min_y double, max_x double, max_y double"
    a, b = (spark.createDataFrame(r, names) for r in rows)
    corners = spatial.rectangle_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    want = spatial.bbox_overlay(a, b.withColumnRenamed("id", "of"), "id", "of").collect()
    got = areas(a.select("id", corners.alias("ring")), b.select("id", corners.alias("ring")))
    assert got == pytest.approx({(r.id, r.of): r.area for r in want})
