"""Dense numbers for groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plotmark.operators.skew import attach_groups
from plotmark.session import materialize


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in the order of some columns.

    Rows are range-partitioned and sorted inside partitions; a row's number is its place
    there plus the rows of the partitions before, a table of one row per partition.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts a partition's rows in its low 33 bits; the partition is above them.
    placed = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    number = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return joined.select(*df.columns, number.alias(name))


def group_number(df: DataFrame, keys: Sequence[str], name: str = "group_id") -> DataFrame:
    """The rank, from 1, of each row's key among the distinct keys: exact, without hashes.

    A row with a null in its key has no number.
    """
    keys = list(keys)
    sizes = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_rows"))
    return attach_groups(df, numbered(sizes, keys, name), keys, "_rows")
