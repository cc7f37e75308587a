"""Group aggregates given back to rows without putting a large group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from plotmark.session import bytes_of, materialize

# A table of groups is sent to every executor up to this many bytes of its written form.
MAX_BROADCAST_BYTES = 8 << 20
# Any group outside the largest HEAVY_GROUPS holds under 1/HEAVY_GROUPS of the rows.
HEAVY_GROUPS = 4096


def attach_groups(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    size: str,
    how: str = "left",
    max_bytes: int | None = None,
    counts: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """Join one row per group back to the rows of the group.

    The aggregates are written first, which measures them. A small table is broadcast.
    From a larger one only the biggest groups are, so their rows never move; what is
    left has no large group and is joined by key. Rows with a null key keep null
    values, as they belong to no group. ``stats`` has one row per key and a row count
    column ``size``, which is dropped; ``counts`` gives (keys, count) in its place where
    ``stats`` does not come from the rows.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")
    keys = list(keys)
    table = materialize(stats.withColumnRenamed(size, "_size"), "groups")
    if bytes_of(table) <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes):
        joined = df.join(F.broadcast(table.drop("_size")), keys, how)
        values = [c for c in stats.columns if c not in keys and c != size]
        return joined.select(*df.columns, *values)
    if counts is not None:
        table = table.drop("_size").join(counts().withColumnRenamed("count", "_size"), keys, "left").fillna({"_size": 0})
    return _split_join(df, table, keys, how)


def _split_join(df: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    # Written once, as both branches read it and a caller may attach again.
    df = materialize(df, "rows")
    values = [c for c in table.columns if c not in keys and c != "_size"]
    packed = table.select(*keys, "_size", F.struct(F.lit(True).alias("_in"), *values).alias("_group"))
    heavy = packed.orderBy(F.col("_size").desc(), *keys).limit(HEAVY_GROUPS).drop("_size")
    marked = df.join(F.broadcast(heavy), keys, "left")
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    found = F.col("_group").isNotNull()
    near = marked.filter(found | no_key if how == "left" else found)
    far = marked.filter(~found & ~no_key).drop("_group").join(packed.drop("_size"), keys, how)
    return near.unionByName(far).select(*df.columns, *[F.col("_group")[v].alias(v) for v in values])


def with_group_values(df: DataFrame, keys: Sequence[str], **aggregates) -> DataFrame:
    """Aggregates of each row's group as columns (W1, A24), null for a null key."""
    keyed = df.dropna(subset=list(keys))
    stats = keyed.groupBy(*keys).agg(
        F.count("*").alias("_size"), *[expr.alias(name) for name, expr in aggregates.items()]
    )
    return attach_groups(df, stats, keys, "_size")
