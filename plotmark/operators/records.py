"""One row per key from many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from plotmark.functions.scalars import col
from plotmark.functions.status import combined_flag


def first_per_key(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str | Column],
    not_null: str | None = None,
) -> DataFrame:
    """First row of every key by ``order``, then by all remaining columns (rule Q1).

    The order is required: rows have none of their own. The least ordering struct is an
    ordinary aggregate: each task reduces its rows before the shuffle, so a key with many
    rows costs no more than another.
    """
    if not order:
        raise ValueError("the first row of a key needs an order, such as a sequence number")
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not_null:
        df = df.filter(F.col(not_null).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    ordering = [col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    first = F.min(F.struct(*ordering, *rest)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_values(df: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Each column's first non-null value per key by ``order``, all in one aggregate (A10)."""
    first = {c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("_o"), F.col(c)))) for c in columns}
    return df.groupBy(key).agg(*[first[c][c].alias(c) for c in columns])


def largest_per_key(df: DataFrame, keys: Sequence[str] | str, value: str, where: Column | None = None) -> DataFrame:
    """Largest value of every key among the rows that pass ``where``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if where is not None:
        df = df.filter(where)
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def child_flag(
    child: DataFrame,
    key: str,
    flags: Mapping[str, Column],
    mode: str = "any",
    order: Sequence[str | Column] = (),
    unset: bool = True,
) -> DataFrame:
    """0/1 flags per key from a child table.

    ``any``: set when some child row qualifies. ``first``: the answer of the first
    child row alone, which needs an ``order``. Without ``unset``, keys that set no flag
    may be missing, for joins that fill in 0: ``any`` then shuffles only rows that set one.
    """
    tests = {name: F.when(test, 1).otherwise(0) for name, test in flags.items()}
    if mode == "any":
        if not unset:
            child = child.filter(reduce(or_, flags.values()))
        return child.groupBy(key).agg(*[F.max(t).alias(n) for n, t in tests.items()])
    if mode != "first":
        raise ValueError(f"mode must be any or first, not {mode}")
    return first_per_key(child, key, order).select(key, *[t.alias(n) for n, t in tests.items()])


def assemble(
    parent: DataFrame,
    children: Sequence[DataFrame],
    key: str,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Parent rows with the columns of child tables that hold one row per key.

    Every child is already aggregated by the key, so the joins reuse its
    partitioning and the parent is shuffled once for all of them.
    """
    for child in children:
        parent = parent.join(child, key, "left")
    return parent.fillna(dict(defaults)) if defaults else parent


def ever_flag(
    events: DataFrame,
    key: str,
    flags: Mapping[str, Column],
    observed: Column,
    status: str = "status",
    observed_count: str = "observed_n",
) -> DataFrame:
    """Per entity: whether each flag was ever set, how often it was observed, and the status."""
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *[F.max(F.when(test, 1).otherwise(0)).alias(name) for name, test in flags.items()],
            F.sum(F.when(observed, 1).otherwise(0)).alias(observed_count),
        )
        .withColumn(status, combined_flag([F.col(n) for n in flags], F.col(observed_count)))
    )


def flag_counts(events: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    """How often each flag was set per entity."""
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.sum(F.when(test, 1).otherwise(0)).alias(name) for name, test in flags.items()])
    )
