"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotmark.session import materialize, materialize_counted


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); the root is the least node.

    Each round hooks a node to its least neighbour, follows the hooks to their end,
    and replaces both ends of every edge by these roots. Edges inside a component
    vanish, so the table shrinks until it is empty. Each step reads a written table,
    which also lets Spark split the joins on a root that many nodes share.
    """
    edges, seen = materialize_counted(_normal(edges.select("a", "b")), "edges", rows=F.count("*"))
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first = True
    while seen["rows"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
        roots = _follow(materialize(hooks, "hooks"))
        # Written each round, so that the plan does not grow with the rounds.
        labels = roots if first else materialize(
            _step(labels, roots).select("node", F.col("_next").alias("root")), "labels"
        )
        first = False
        moved = (
            edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        )
        edges, seen = materialize_counted(_normal(moved), "edges", rows=F.count("*"))
    return labels


def _normal(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _step(labels: DataFrame, roots: DataFrame) -> DataFrame:
    further = roots.select(F.col("node").alias("root"), F.col("root").alias("_further"))
    return labels.join(further, "root", "left").select("node", "root", F.coalesce("_further", "root").alias("_next"))


def _follow(hooks: DataFrame) -> DataFrame:
    """Point every node at the end of its hook chain, doubling the step each time."""
    while True:
        ahead = _step(hooks, hooks).select("node", F.col("_next").alias("root"))
        further = _step(ahead, ahead)
        table, seen = materialize_counted(
            further, "roots", moved=F.count_if(F.col("_next") != F.col("root"))
        )
        hooks = table.select("node", F.col("_next").alias("root"))
        if not seen["moved"]:
            return hooks
