"""Key contracts and size-checked lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plotmark.operators.skew import attach_groups


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key occurs twice; returns the table for chaining."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {twice[0].asDict()}")
    return df


def lookup(
    df: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "left", max_bytes: int | None = None
) -> DataFrame:
    """Many-to-one left or inner join to a dimension table.

    The columns are those of ``df`` followed by the dimension's values, whatever the
    sizes; a value column that ``df`` has too is refused. One small job on the dimension
    checks that its key is unique. It is then joined as a group attribute: sent to every
    executor if its written size is small, otherwise joined by key with the most frequent
    keys of ``df`` handled apart.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")
    if clash := sorted((set(df.columns) & set(dim.columns)) - set(on)):
        raise ValueError(f"both tables have {clash}")
    assert_unique(dim.dropna(subset=on), on)
    sized = dim.dropna(subset=on).withColumn("_rows", F.lit(1))
    return attach_groups(df, sized, on, "_rows", how, max_bytes, lambda: df.dropna(subset=on).groupBy(*on).count())

def semi_scan(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows whose key occurs in ``values``; the key list never leaves the executors."""
    return df.join(values.select(key), key, "left_semi")
