"""Area filters, modes and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotmark.operators.skew import attach_groups, with_group_values


def coverage_filter(df: DataFrame, value: str, area: str, region: str, min_n: int = 5000) -> DataFrame:
    """Drop regions that never show the value, and large areas that never show it.

    Rows without an area are dropped; an area with an unknown rate is kept.
    """
    df = df.filter(F.col(area).isNotNull()).withColumn("_region", F.coalesce(F.col(region).cast("string"), F.lit("")))
    areas = df.groupBy(area, "_region").agg(
        F.count("*").alias("_size"), F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    # These windows run over one row per area, not over the records.
    of_region, of_area = Window.partitionBy("_region"), Window.partitionBy(area)
    empty_region = (F.sum("_n").over(of_region) > 0) & (F.sum("_sum").over(of_region) == 0) & (F.col("_region") != "")
    area_n = F.sum("_n").over(of_area)
    empty_area = (area_n > 0) & (area_n >= min_n) & (F.sum("_sum").over(of_area) == 0)
    verdict = areas.select(area, "_region", "_size", (~F.coalesce(empty_region | empty_area, F.lit(False))).alias("_keep"))
    return attach_groups(df, verdict, [area, "_region"], "_size").filter("_keep").drop("_keep", "_region")


def support_filter(
    df: DataFrame,
    keys: Sequence[str] | str,
    min_n: int,
    count: str | None = None,
    rate: str | None = None,
    min_rate: float | None = None,
) -> DataFrame:
    """Rows of groups with enough rows (or enough values of ``count``) and a high enough mean of ``rate``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return attach_groups(df, qualified_groups(df, keys, min_n, count, rate, min_rate), keys, "_size", "inner").drop(
        "_n", "_rate"
    )


def qualified_groups(
    df: DataFrame,
    keys: Sequence[str],
    min_n: int,
    count: str | None = None,
    rate: str | None = None,
    min_rate: float | None = None,
) -> DataFrame:
    groups = (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_size"),
            F.count(count or F.lit(1)).alias("_n"),
            (F.avg(rate) if rate else F.lit(None).cast("double")).alias("_rate"),
        )
        .filter(F.col("_n") >= min_n)
    )
    return groups if min_rate is None else groups.filter(F.col("_rate") >= min_rate)


def group_share(
    df: DataFrame, keys: Sequence[str], value: str, share: str, min_n: int = 5, exclude: Column | None = None
) -> DataFrame:
    """Mean of ``value`` in each row's group, null for small or excluded groups."""
    source = df if exclude is None else df.withColumns(
        {k: F.when(~F.coalesce(exclude, F.lit(False)), F.col(k)) for k in keys}
    )
    stats = (
        source.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count("*").alias("_size"), F.avg(value).alias(share))
        .withColumn(share, F.when(F.col("_size") >= min_n, F.col(share)))
    )
    return attach_groups(df, stats, keys, "_size")


def group_mode(df: DataFrame, keys: Sequence[str], value: str, mode: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest on a tie, with the group's row count.

    Counting by value first keeps each group's state to one running best.
    """
    counts = df.dropna(subset=[*keys, value]).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(mode),
        F.sum("_n").alias("group_n"),
    )


def with_mode(df: DataFrame, keys: Sequence[str], value: str, mode: str = "mode") -> DataFrame:
    return attach_groups(df, group_mode(df, keys, value, mode), keys, "group_n")


def near_mode(df: DataFrame, keys: Sequence[str], value: str, width: float = 5) -> DataFrame:
    """Rows within ``width`` of their group's modal value."""
    return with_mode(df, keys, value, "_mode").filter((F.col(value) - F.col("_mode")).between(-width, width)).drop("_mode")


def group_size(df: DataFrame, keys: Sequence[str], name: str, no_name: Sequence[str] = ()) -> DataFrame:
    """Rows in each row's group; null where a key is missing or is a no-name value."""
    known = {k: F.when(~F.col(k).cast("string").isin(*no_name), F.col(k)) if no_name else F.col(k) for k in keys}
    marked = df.withColumns({f"_k_{k}": c for k, c in known.items()})
    return with_group_values(marked, [f"_k_{k}" for k in keys], **{name: F.count("*")}).drop(*[f"_k_{k}" for k in keys])


def usable_columns(df: DataFrame, by: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Columns with at least two distinct values, per group (P20).

    A column varies exactly when its least and greatest values differ, which needs
    no distinct count. The result is a side table, so all groups keep one schema.
    """
    source = df if where is None else df.filter(where)
    varies = [(F.min(c) != F.max(c)).alias(c) for c in columns]
    named = F.array_compact(F.array(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in columns]))
    return source.dropna(subset=[by]).groupBy(by).agg(*varies).select(by, named.alias("usable"))


def area_rates(
    df: DataFrame,
    levels: Sequence[str],
    rates: Mapping[str, Column],
) -> DataFrame:
    """Means by each level in one scan: rows (level, area, rate...).

    ``rates`` maps a name to a value column that is null where the row does not
    count. Rows are first reduced to the finest combination of levels; the grouping
    sets then run on that small table.
    """
    fine = df.groupBy(*levels).agg(
        *[F.sum(v).alias(f"_s_{n}") for n, v in rates.items()],
        *[F.count(v).alias(f"_n_{n}") for n, v in rates.items()],
    )
    members = F.explode(
        F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("area")) for c in levels])
    )
    names = list(rates)
    return (
        fine.select(members.alias("_m"), *[f"_s_{n}" for n in names], *[f"_n_{n}" for n in names])
        .filter(F.col("_m.area").isNotNull())
        .groupBy(F.col("_m.level").alias("level"), F.col("_m.area").alias("area"))
        .agg(*[F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_n_{n}")).alias(n) for n in names])
    )


def group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of each column per group, over rows with a complete key (A3)."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
