"""Density clustering on a grid (G1).

Cells have a diagonal of one radius, so all points of a cell are neighbours. A cell
with at least ``min_pts`` points is dense: its points are all core points of one
cluster and are never compared with each other. Only points of the remaining cells,
fewer than ``min_pts`` per cell, look for neighbours one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotmark.operators.components import connected_components
from plotmark.session import materialize, materialize_counted

# Points exactly one radius apart are neighbours whatever the rounding (squared distance, radius 1).
REACH = 1 + 1e-9
# Two boxes with at most this many point pairs are compared point by point.
DIRECT_PAIRS = 1024


def dbscan(
    df: DataFrame,
    id: str,
    coords: Sequence[str],
    eps: float | Sequence[float],
    min_pts: int,
    label: str = "cluster",
) -> DataFrame:
    """Rows with all coordinates and their cluster: the least id of its core points, or -1.

    ``eps`` is the radius, or one scale per coordinate. A point counts itself. A
    border point takes the least label among its core neighbours. Runs jobs.
    """
    dims = len(coords)
    scales = [float(eps)] * dims if isinstance(eps, (int, float)) else [float(e) for e in eps]
    side = 1 / math.sqrt(dims)
    u = [f"_u{i}" for i in range(dims)]
    c = [f"_c{i}" for i in range(dims)]
    rows = df.dropna(subset=list(coords)).withColumns(
        {u[i]: F.col(coords[i]).cast("double") / scales[i] for i in range(dims)}
    )

    # Copies of one location act as a single weighted point.
    spots = rows.groupBy(*u).agg(F.count("*").alias("w"), F.min(id).alias("p"))
    spots = materialize(spots.withColumns({c[i]: F.floor(F.col(u[i]) / side) for i in range(dims)}), "spots")
    box = [F.min(x).alias(f"lo{x}") for x in u] + [F.max(x).alias(f"hi{x}") for x in u]
    cells = spots.groupBy(*c).agg(F.count("*").alias("n"), F.sum("w").alias("cw"), F.min("p").alias("cell_p"), *box)
    cells = materialize(cells.withColumn("dense", F.col("cw") >= min_pts), "cells")
    # Both tables are plain scans here, so Spark can split a cell with many spots.
    spots = materialize(spots.join(cells.select(*c, "dense", "cell_p"), c), "spots")

    hits = materialize(_hits(spots, u, c, side), "hits")
    core = hits.groupBy("p", *c).agg(F.sum("w").alias("w")).filter(F.col("w") >= min_pts)
    core = materialize(core.select("p", *c), "core")
    nodes = (
        cells.filter("dense")
        .select(*c, F.col("cell_p").alias("node"))
        .unionByName(core.groupBy(*c).agg(F.min("p").alias("node")))
    )
    near_core = hits.filter("t_dense").unionByName(
        hits.filter("not t_dense").join(core.select(F.col("p").alias("q")), "q", "left_semi")
    )
    at_target = nodes.select(*[F.col(x).alias(f"t{x}") for x in c], F.col("node").alias("b"))
    to_core = near_core.join(at_target, [f"t{x}" for x in c]).select("p", *c, "b")
    to_core = materialize(to_core, "to_core")

    links = to_core.join(core.select("p"), "p", "left_semi").join(nodes.withColumnRenamed("node", "a"), c)
    roots = connected_components(links.select("a", "b").unionByName(_dense_links(spots, cells, u, c)))
    named = nodes.join(roots, "node", "left").select(*c, "node", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")

    inner = spots.filter("dense").join(named.drop("node"), c).select(*u, F.col("root").alias(label))
    border = to_core.join(named.select(F.col("node").alias("b"), "root"), "b").groupBy("p").agg(F.min("root").alias("near"))
    is_core = core.select("p", F.lit(True).alias("is_core"))
    outer = spots.filter("not dense").join(is_core, "p", "left").join(border, "p", "left")
    outer = outer.join(named.drop("node"), c, "left")
    noise = F.lit(-1).cast(df.schema[id].dataType)
    outer = outer.select(*u, F.when(F.col("is_core"), F.col("root")).otherwise(F.coalesce("near", noise)).alias(label))
    return rows.join(inner.unionByName(outer), u).drop(*u)


def _with_offsets(df: DataFrame, dims: int) -> DataFrame:
    """One row per cell that can hold a neighbour: at most ceil(sqrt(dims)) steps away on each axis."""
    reach = math.ceil(math.sqrt(dims))
    for i in range(dims):
        df = df.withColumn(f"_o{i}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    return df


def _distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)), F.lit(0.0))


def _hits(spots: DataFrame, u: list[str], c: list[str], side: float) -> DataFrame:
    """Weight within reach of each loose point, per dense cell or per loose neighbour.

    A cell is probed by a bounded number of loose points, so a crowded cell meets a
    few probes, never itself.
    """
    probes = _with_offsets(spots.filter("not dense").select("p", *u, *c), len(u))
    gap = F.lit(0.0)
    for i, x in enumerate(u):
        k, t = F.col(f"_o{i}"), F.col(c[i]) + F.col(f"_o{i}")
        g = F.when(k > 0, t * side - F.col(x)).when(k < 0, F.col(x) - (t + 1) * side).otherwise(0.0)
        gap = gap + g * g
    probes = probes.filter(gap <= REACH + 1e-9).select(
        "p", *u, *c, *[(F.col(x) + F.col(f"_o{i}")).alias(f"t{x}") for i, x in enumerate(c)]
    )
    seen = spots.select(
        *[F.col(x).alias(f"t{x}") for x in c],
        *[F.col(x).alias(f"q{x}") for x in u],
        F.col("p").alias("qp"),
        "w",
        F.col("dense").alias("t_dense"),
    )
    near = probes.join(seen, [f"t{x}" for x in c]).filter(_distance(u, [f"q{x}" for x in u]) <= REACH)
    single = F.when(~F.col("t_dense"), F.col("qp")).alias("q")
    return near.groupBy("p", *c, *[f"t{x}" for x in c], "t_dense", single).agg(F.sum("w").alias("w"))


def _dense_links(spots: DataFrame, cells: DataFrame, u: list[str], c: list[str]) -> DataFrame:
    """Pairs of dense cells with two points within reach.

    Pairs are decided by the tight boxes of their points where these are surely near
    or surely apart. Otherwise both boxes are halved on every axis and the parts
    compared, until few point pairs are left to test.
    """
    steps = [F.col(f"_o{i}") for i in range(len(u))]
    one_way = F.array(*steps) > F.array(*[F.lit(0)] * len(u))
    dense = cells.filter("dense").withColumnRenamed("cell_p", "node")
    other = dense.select(*c, F.col("node").alias("b"))
    pairs = (
        _with_offsets(dense.select(*c, F.col("node").alias("a")), len(u))
        .filter(one_way)
        .select("a", *[(F.col(x) + F.col(f"_o{i}")).alias(x) for i, x in enumerate(c)])
        .join(other, c)
        .select("a", "b", F.lit("").alias("sa"), F.lit("").alias("sb"))
    )
    lo, hi = [f"lo{x}" for x in u], [f"hi{x}" for x in u]
    boxes = dense.select("node", F.lit("").alias("part"), "n", *lo, *hi)
    points = spots.filter("dense").select(F.col("cell_p").alias("node"), F.lit("").alias("part"), *u)
    linked = []
    while True:
        heavy = ~F.col("near") & (F.col("pairs") > DIRECT_PAIRS)
        judged, seen = materialize_counted(_judge(pairs, boxes, lo, hi), "judged", heavy=F.count_if(heavy))
        linked.append(judged.filter("near").select("a", "b").distinct())
        open_pairs = judged.filter("not near")
        few = open_pairs.filter(F.col("pairs") <= DIRECT_PAIRS)
        linked.append(_direct(few, points, u))
        if not seen["heavy"]:
            break
        # A pair of cells that some part has linked needs no further test.
        many = open_pairs.filter(heavy).join(linked[-2], ["a", "b"], "left_anti")
        split = (
            many.select(F.col("a").alias("node"), F.col("sa").alias("part"))
            .unionByName(many.select(F.col("b").alias("node"), F.col("sb").alias("part")))
            .distinct()
            .join(boxes, ["node", "part"])
        )
        split = materialize(split, "split")
        halves = [F.when(F.col(x) * 2 >= F.col(l) + F.col(h), "1").otherwise("0") for x, l, h in zip(u, lo, hi)]
        parted = points.join(split, ["node", "part"]).select(
            "node", F.col("part").alias("from_part"), F.concat("part", *halves).alias("part"), *u
        )
        parted = materialize(parted, "parts")
        sizes = [F.min(x).alias(l) for x, l in zip(u, lo)] + [F.max(x).alias(h) for x, h in zip(u, hi)]
        boxes = parted.groupBy("node", "from_part", "part").agg(F.count("*").alias("n"), *sizes)
        boxes = materialize(boxes, "boxes")
        children = boxes.select("node", "from_part", "part")
        pairs = many.join(
            children.toDF("a", "sa", "na"), ["a", "sa"]
        ).join(children.toDF("b", "sb", "nb"), ["b", "sb"]).select("a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"))
        boxes, points = boxes.drop("from_part"), parted.drop("from_part")
    out = linked[0]
    for more in linked[1:]:
        out = out.unionByName(more)
    return out


def _judge(pairs: DataFrame, boxes: DataFrame, lo: list[str], hi: list[str]) -> DataFrame:
    def side(tag: str) -> DataFrame:
        return boxes.select(
            F.col("node").alias(tag),
            F.col("part").alias(f"s{tag}"),
            F.col("n").alias(f"n_{tag}"),
            *[F.col(x).alias(f"{tag}_{x}") for x in (*lo, *hi)],
        )

    least = most = F.lit(0.0)
    for l, h in zip(lo, hi):
        gap = F.greatest(F.col(f"a_{l}") - F.col(f"b_{h}"), F.col(f"b_{l}") - F.col(f"a_{h}"), F.lit(0.0))
        reach = F.greatest(F.col(f"a_{h}") - F.col(f"b_{l}"), F.col(f"b_{h}") - F.col(f"a_{l}"))
        least, most = least + gap * gap, most + reach * reach
    return (
        pairs.join(side("a"), ["a", "sa"])
        .join(side("b"), ["b", "sb"])
        .filter(least <= REACH)
        .select("a", "b", "sa", "sb", (F.col("n_a") * F.col("n_b")).alias("pairs"), (most <= REACH).alias("near"))
    )


def _direct(pairs: DataFrame, points: DataFrame, u: list[str]) -> DataFrame:
    def side(tag: str) -> DataFrame:
        return points.select(
            F.col("node").alias(tag), F.col("part").alias(f"s{tag}"), *[F.col(x).alias(f"{tag}{x}") for x in u]
        )

    return (
        pairs.join(side("a"), ["a", "sa"])
        .join(side("b"), ["b", "sb"])
        .filter(_distance([f"a{x}" for x in u], [f"b{x}" for x in u]) <= REACH)
        .select("a", "b")
        .distinct()
    )
