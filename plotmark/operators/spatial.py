"""Points in polygons and rectangle overlays through grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plotmark.sources.layout import ring_bbox


def _level(extent: Column) -> Column:
    """Power-of-two cell size exponent: a shape covers at most 3 x 3 cells of half its extent."""
    return F.ceil(F.log2(F.greatest(extent, F.lit(1e-12)))).cast("int") - 1


def _span(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _cells(df: DataFrame, level: Column, out: str = "_cell") -> DataFrame:
    """One row per grid cell of ``level`` that the row's box touches."""
    size = F.pow(F.lit(2.0), level)
    xs, ys = _span(F.col("min_x"), F.col("max_x"), size), _span(F.col("min_y"), F.col("max_y"), size)
    cells = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return df.withColumn(out, F.explode(cells))


def crosses(x: Column, y: Column, edge: Column) -> Column:
    """Does the ray from a point to the right meet an edge, half open: its lower end counts, its upper does not.

    A point is inside if it meets an odd number of edges; left and bottom edges are inside, right
    and top are not, so that neighbouring polygons never share a point.
    """
    at = edge["ax"] + (y - edge["ay"]) * (edge["bx"] - edge["ax"]) / (edge["by"] - edge["ay"])
    return ((edge["ay"] <= y) != (edge["by"] <= y)) & (x < at)


def _sized_edges(polygons: DataFrame, poly_id: str, ring: str) -> DataFrame:
    """Polygons with box, edges and class: ``_level`` is the size class of the whole shape, ``_fine`` how
    often its cell is halved to give a strip. Even numbers keep the classes few.
    """
    nested = isinstance(polygons.schema[ring].dataType.elementType, T.ArrayType)
    rings = F.col(ring) if nested else F.array(ring)

    def edges(r: Column, of: Column) -> Column:
        def edge(p: Column, i: Column) -> Column:
            q = F.get(r, (i + 1) % F.size(r))
            ends = {"ax": p["x"], "ay": p["y"], "bx": q["x"], "by": q["y"]}
            return F.struct(of.alias("ring"), i.alias("at"), *[v.cast("double").alias(n) for n, v in ends.items()])

        # Level edges and edges without an end meet no ray.
        return F.filter(F.transform(r, edge), lambda e: (e["ay"] != e["by"]) & e["ax"].isNotNull() & e["bx"].isNotNull())

    boxes = polygons.select(poly_id, rings.alias("_rings")).withColumns(ring_bbox(F.flatten("_rings")))
    listed = boxes.withColumn("_edges", F.flatten(F.transform("_rings", edges)))
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    height = F.aggregate("_edges", F.lit(0.0), lambda total, e: total + F.abs(e["by"] - e["ay"])) / F.size("_edges")
    halved = F.col("_level") - F.floor(F.log2(height)).cast("int")
    return (
        listed.filter(F.size("_edges") > 0)
        .withColumn("_level", _level(extent))
        .withColumn("_fine", F.greatest(halved - F.pmod(halved, F.lit(2)), F.lit(0)))
    )


def shape_strips(polygons: DataFrame, poly_id: str, ring: str) -> DataFrame:
    """Polygons as rows (poly_id, box, _level, _fine, _strip, edges): the edges that touch each horizontal strip.

    A strip is as high as the polygon's edges are on average, to a power of two, so that an edge is in
    few strips and a strip holds about as many edges as a horizontal line meets, however many
    the ring has.
    """
    shape = ["min_x", "min_y", "max_x", "max_y", "_level", "_fine", "_shape"]
    # Parts of one id in several rows are told apart; equal rows count once, as their edges do.
    sized = _sized_edges(polygons, poly_id, ring).withColumn("_shape", F.xxhash64("_rings"))
    listed = sized.select(poly_id, *shape, F.explode("_edges").alias("_edge"))
    size = F.pow(F.lit(2.0), F.col("_level") - F.col("_fine"))
    low, high = F.least("_edge.ay", "_edge.by"), F.greatest("_edge.ay", "_edge.by")
    strips = listed.withColumn("_strip", F.explode(_span(low, high, size)))
    return strips.groupBy(poly_id, *shape, "_strip").agg(F.collect_set("_edge").alias("edges")).drop("_shape")


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    how: str = "left",
    x: str = "x",
    y: str = "y",
    poly_id: str = "poly_id",
    ring: str = "ring",
) -> DataFrame:
    """Each point with the polygon it lies in, the least id if there are several.

    ``ring`` is one ring of a polygon, or an array of rings for one with holes or several
    parts. Points are placed once per location and matched to their rows by it, so
    repeated ids or copies of a point do no harm.

    Polygons are cut into horizontal strips, which hold the few edges that a point there can
    meet (``shape_strips``); whole rings are never shuffled. A strip is listed under the
    columns of cells of its polygon's size class, and a point under its strip and column of each
    class in use. The join is a plain equality: Spark broadcasts a small side and splits a crowded key.
    """
    strips = shape_strips(polygons, poly_id, ring)
    column = _span(F.col("min_x"), F.col("max_x"), F.pow(F.lit(2.0), F.col("_level")))
    shapes = strips.withColumn("_column", F.explode(column))
    classes = _sized_edges(polygons, poly_id, ring).agg(F.collect_set(F.struct("_level", "_fine")).alias("c")).scalar()
    px, py = F.col("_x"), F.col("_y")
    level, fine = F.col("_class._level"), F.col("_class._fine")
    spots = (
        points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .dropna()
        .distinct()
        .withColumn("_class", F.explode(classes))
        .select(
            "_x",
            "_y",
            level.alias("_level"),
            fine.alias("_fine"),
            F.floor(px / F.pow(F.lit(2.0), level)).alias("_column"),
            F.floor(py / F.pow(F.lit(2.0), level - fine)).alias("_strip"),
        )
    )
    candidates = spots.join(shapes, ["_level", "_fine", "_column", "_strip"]).filter(
        px.between(F.col("min_x"), F.col("max_x")) & py.between(F.col("min_y"), F.col("max_y"))
    )
    inside = F.aggregate("edges", F.lit(False), lambda odd, e: odd != crosses(px, py, e))
    matches = candidates.filter(inside).groupBy("_x", "_y").agg(F.min(poly_id).alias(poly_id))
    at = (points[x].cast("double") == matches["_x"]) & (points[y].cast("double") == matches["_y"])
    return points.join(matches, at, how).drop("_x", "_y")


def rectangle_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    corners = [(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y)]
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])


def overlapping_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of boxes (``min_x`` ... ``max_y``) that share an area, with the area.

    A box is listed at its own cell size and at every larger one in use. A pair meets
    at the larger of its two sizes, and only in the cell of the lower left corner of
    the shared area, so each pair appears once.
    """

    def sized(df: DataFrame) -> DataFrame:
        extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
        return df.withColumn("_own", _level(extent))

    def side(df: DataFrame, id: str, tag: str, classes: Column) -> DataFrame:
        listed = df.select(F.col(id), "min_x", "min_y", "max_x", "max_y", "_own").withColumn("_level", F.explode(classes))
        listed = listed.filter(F.col("_level") >= F.col("_own"))
        names = {c: f"{tag}_{c}" for c in ("min_x", "min_y", "max_x", "max_y", "_own")}
        return _cells(listed, F.col("_level")).withColumnsRenamed(names)

    a, b = sized(a), sized(b)
    classes = (
        a.select("_own").unionByName(b.select("_own")).agg(F.collect_set("_own").alias("ls")).scalar()
    )
    left, right = side(a, a_id, "a", classes), side(b, b_id, "b", classes)
    lo_x, lo_y = F.greatest("a_min_x", "b_min_x"), F.greatest("a_min_y", "b_min_y")
    hi_x, hi_y = F.least("a_max_x", "b_max_x"), F.least("a_max_y", "b_max_y")
    size = F.pow(F.lit(2.0), F.col("_level"))
    here = (F.col("_cell.x") == F.floor(lo_x / size)) & (F.col("_cell.y") == F.floor(lo_y / size))
    shared = {"min_x": lo_x, "min_y": lo_y, "max_x": hi_x, "max_y": hi_y}
    return (
        left.join(right, ["_level", "_cell"])
        .filter((F.col("_level") == F.greatest("a__own", "b__own")) & here & (lo_x < hi_x) & (lo_y < hi_y))
        .select(a_id, b_id, ((hi_x - lo_x) * (hi_y - lo_y)).alias("area"), *[v.alias(n) for n, v in shared.items()])
    )


def covered_area(clipped: DataFrame, id: str) -> DataFrame:
    """(id, covered): the area of the union of each id's boxes.

    The distinct vertical edges of an id cut it into slabs; in each slab the boxes that
    cross it are intervals, whose union is summed from their running end.
    """
    edges = clipped.select(id, F.explode(F.array("min_x", "max_x")).alias("_from")).distinct()
    after = F.lead("_from").over(Window.partitionBy(id).orderBy("_from"))
    slabs = edges.withColumn("_to", after).filter(F.col("_to").isNotNull())
    crossing = clipped.join(slabs, id).filter((F.col("min_x") <= F.col("_from")) & (F.col("max_x") >= F.col("_to")))
    before = Window.partitionBy(id, "_from").orderBy("min_y", "max_y").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("min_y", F.coalesce(F.max("max_y").over(before), F.col("min_y")))
    gain = F.greatest(F.col("max_y") - reached, F.lit(0.0)) * (F.col("_to") - F.col("_from"))
    return crossing.select(id, gain.alias("_gain")).groupBy(id).agg(F.sum("_gain").alias("covered"))


def bbox_overlay(
    a: DataFrame, b: DataFrame, a_id: str, b_id: str, how: str = "intersection", keep_covered: bool = False
) -> DataFrame:
    """Rectangle overlay (G6): shared areas of pairs, or what is left of each ``a`` box.

    Boxes of ``b`` may overlap each other: what several of them cover is taken off once. An ``a`` box
    of which nothing is left has no row, or with ``keep_covered`` one with area 0.
    """
    pairs = overlapping_boxes(a, b, a_id, b_id)
    if how == "intersection":
        return pairs.select(a_id, b_id, "area")
    if how != "difference":
        raise ValueError(f"how must be intersection or difference, not {how}")
    own = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    covered = covered_area(pairs, a_id).withColumnRenamed("covered", "_covered")
    left = own - F.coalesce(F.col("_covered"), F.lit(0.0))
    # What is left of a box that is fully covered is a rounding error of its area.
    some = left > 1e-12 * own
    joined = a.join(covered, a_id, "left")
    if keep_covered:
        return joined.select(a_id, F.when(some, left).otherwise(0.0).alias("area"))
    return joined.filter(some).select(a_id, left.alias("area"))
