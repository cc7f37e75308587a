"""Exact areas that polygons share (G6), from pairs of edges and without clipping.

A polygon's area is the signed sum of what lies below its upper edges less what lies below its
lower ones. The area that two polygons share is then the signed sum, over pairs of an
edge of each, of what lies below both, over the x that both span. Only edges near one
another in x are paired, and all is column expressions and plain equality joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plotmark.operators.spatial import crosses, overlapping_boxes
from plotmark.sources.layout import ring_bbox


def _edges(ring: Column) -> Column:
    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        ends = {"ax": p["x"], "ay": p["y"], "bx": q["x"], "by": q["y"]}
        return F.struct(*[v.cast("double").alias(n) for n, v in ends.items()])

    return F.filter(F.transform(ring, edge), lambda e: e["ax"].isNotNull() & e["ay"].isNotNull() & e["bx"].isNotNull() & e["by"].isNotNull())


def signed_edges(polygons: DataFrame, poly_id: str, ring: str) -> DataFrame:
    """Rows (poly_id, x1, y1, x2, y2, sign): edges from left to right, sign 1 for upper ones and -1 for lower.

    Rings may run either way. A ring inside an odd number of the polygon's other rings is a hole.
    Vertical edges have nothing below them and are left out.
    """
    nested = isinstance(polygons.schema[ring].dataType.elementType, T.ArrayType)
    rings = F.filter(F.transform(F.col(ring) if nested else F.array(F.col(ring)), _edges), lambda r: F.size(r) > 0)

    def turned(r: Column) -> Column:
        """1 for a ring that runs counter-clockwise, -1 for one that runs clockwise."""
        x0, y0 = r[0]["ax"], r[0]["ay"]
        twice = F.aggregate(r, F.lit(0.0), lambda s, e: s + (e["ax"] - x0) * (e["by"] - y0) - (e["bx"] - x0) * (e["ay"] - y0))
        return F.signum(twice)

    def hole(r: Column, i: Column) -> Column:
        x, y = (r[0]["ax"] + r[0]["bx"]) / 2, (r[0]["ay"] + r[0]["by"]) / 2
        others = F.flatten(F.filter("_rings", lambda q, j: j != i))
        sloping = F.filter(others, lambda e: e["ay"] != e["by"])
        return F.aggregate(sloping, F.lit(False), lambda odd, e: odd != crosses(x, y, e))

    def side(r: Column, i: Column) -> Column:
        return F.struct(r.alias("edges"), F.when(hole(r, i), -turned(r)).otherwise(turned(r)).alias("turn"))

    e = F.col("_edge")
    forward = e["ax"] < e["bx"]
    ends = [F.when(forward, e[a]).otherwise(e[b]).alias(n) for a, b, n in (("ax", "bx", "x1"), ("ay", "by", "y1"), ("bx", "ax", "x2"), ("by", "ay", "y2"))]
    return (
        polygons.select(poly_id, rings.alias("_rings"))
        .select(poly_id, F.explode(F.transform("_rings", side)).alias("_ring"))
        .select(poly_id, F.col("_ring.turn").alias("_turn"), F.explode("_ring.edges").alias("_edge"))
        .filter((e["ax"] != e["bx"]) & (F.col("_turn") != 0))
        .select(poly_id, *ends, F.when(forward, -F.col("_turn")).otherwise(F.col("_turn")).alias("sign"))
    )


def polygon_area(polygons: DataFrame, poly_id: str = "poly_id", ring: str = "ring") -> DataFrame:
    """(poly_id, area), holes taken off."""
    e = signed_edges(polygons, poly_id, ring)
    below = F.col("sign") * (F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2
    return e.groupBy(poly_id).agg(F.sum(below).alias("area"))


def polygon_overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, ring: str = "ring") -> DataFrame:
    """(a_id, b_id, area) of the polygons that share an area.

    ``ring`` is a ring, or an array of rings for polygons with holes or several parts, in both
    tables; parts in several rows of one id count as one polygon and must not overlap. Rows without an id
    or without a ring are left out; rings with a missing end lose the edges at it.

    Polygons meet by their boxes first. The x that a pair shares is cut into as many
    columns as the longer one has edges; an edge is listed in the columns it spans, and meets
    the few of the other polygon there. Areas under a millionth of a millionth of the shared box are rounding errors.
    """

    def boxed(df: DataFrame, id: str) -> DataFrame:
        nested = isinstance(df.schema[ring].dataType.elementType, T.ArrayType)
        box = df.select(id, *[v.cast("double").alias(n) for n, v in ring_bbox(F.flatten(ring) if nested else F.col(ring)).items()])
        ends = {"min_x": F.min, "min_y": F.min, "max_x": F.max, "max_y": F.max}
        return box.dropna().groupBy(id).agg(*[f(n).alias(n) for n, f in ends.items()])

    # Both sides under names of their own, so that the tables may share column names.
    a, b = a.select(F.col(a_id).alias("_a"), ring), b.select(F.col(b_id).alias("_b"), ring)
    edges_a, edges_b = signed_edges(a, "_a", ring), signed_edges(b, "_b", ring)
    count_a, count_b = (e.groupBy(k).agg(F.count("*").alias(f"{k}_n")) for e, k in ((edges_a, "_a"), (edges_b, "_b")))
    pairs = overlapping_boxes(boxed(a, "_a"), boxed(b, "_b"), "_a", "_b").join(count_a, "_a").join(count_b, "_b")
    columns = F.greatest("_a_n", "_b_n")
    pairs = pairs.select("_a", "_b", "min_x", "max_x", "min_y", F.col("area").alias("_box"), ((F.col("max_x") - F.col("min_x")) / columns).alias("_width"))

    def placed(edges: DataFrame, key: str, tag: str) -> DataFrame:
        """Edges of each pair by column, with their heights over the shared box's lower side."""
        near = pairs.join(edges, key).filter((F.col("x1") < F.col("max_x")) & (F.col("x2") > F.col("min_x")))
        first = F.floor((F.greatest("x1", "min_x") - F.col("min_x")) / F.col("_width"))
        last = F.floor((F.least("x2", "max_x") - F.col("min_x")) / F.col("_width"))
        own = [(F.col(c) if c[0] != "y" else F.col(c) - F.col("min_y")).alias(f"{tag}{c}") for c in ("x1", "y1", "x2", "y2", "sign")]
        shared = ["min_x", "max_x", "_box", "_width"] if tag == "a" else []
        return near.select("_a", "_b", *shared, *own, F.explode(F.sequence(first, last)).alias("_column"))

    met = placed(edges_a, "_a", "a").join(placed(edges_b, "_b", "b"), ["_a", "_b", "_column"])
    start = F.col("min_x") + F.col("_column") * F.col("_width")
    stop = F.col("min_x") + (F.col("_column") + 1) * F.col("_width")
    met = met.withColumns(
        {
            "_u": F.greatest("ax1", "bx1", "min_x", start),
            "_v": F.least("ax2", "bx2", "max_x", stop),
        }
    ).filter(F.col("_u") < F.col("_v"))

    def height(tag: str, x: str) -> Column:
        x1, y1, x2, y2 = (F.col(f"{tag}{c}") for c in ("x1", "y1", "x2", "y2"))
        return y1 + (y2 - y1) * (F.col(x) - x1) / (x2 - x1)

    at_u, at_v = height("a", "_u") - height("b", "_u"), height("a", "_v") - height("b", "_v")
    low, high = F.least(at_u, at_v), F.greatest(at_u, at_v)
    # Mean of the lesser height less that of b: edges that cross have a triangle only.
    less = F.when(high <= 0, (low + high) / 2).when(low >= 0, F.lit(0.0)).otherwise(-low * low / (2 * (high - low)))
    below = (F.col("_v") - F.col("_u")) * ((height("b", "_u") + height("b", "_v")) / 2 + less)
    area = F.sum(F.col("asign") * F.col("bsign") * below).alias("area")
    found = met.groupBy("_a", "_b", "_box").agg(area).filter(F.col("area") > 1e-12 * F.col("_box"))
    return found.select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), "area")
