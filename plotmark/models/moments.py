"""Sums of squares and products within absorbed groups.

Everything the models need comes from ``moments``: one row per fitted group with
means and cross-products. The fixed-effect transform never touches rows: products
around group means equal total products less the products of group means, and both
are ordinary sums that every task reduces before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotmark.operators.skew import attach_groups
from plotmark.session import materialize

# Up to this many columns, products are summed by column expressions; beyond, per Arrow batch.
NARROW = 7
# Groups of one batch that a task hands on together.
FLUSH_GROUPS = 256
# Shares of a column's whole sum of squares up to which what is left within groups is rounding: of
# centred products, whose means err by a few hundred last digits at most, and of differences of sums.
CENTRED_ROUNDING, DIFFERENCE_ROUNDING = 1e-25, 1e-11


def demean(df: DataFrame, columns: Sequence[str], by: Sequence[str] | str, suffix: str = "_dm") -> DataFrame:
    """Columns less their group means."""
    by = [by] if isinstance(by, str) else list(by)
    means = (
        df.dropna(subset=by)
        .groupBy(*by)
        .agg(F.count("*").alias("_size"), *[F.avg(c).alias(f"_m_{c}") for c in columns])
    )
    joined = attach_groups(df, means, by, "_size")
    return joined.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(
        *[f"_m_{c}" for c in columns]
    )


def triangle(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def prepare(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    absorb: Sequence[str],
    cluster: Sequence[str],
    write: bool = False,
) -> tuple[DataFrame, list[str], list[str], list[str], list[str]]:
    """Complete rows under fixed names: keys ``_b*``, ``_a*``, ``_c*`` and values ``v*``.

    Without ``by`` all rows form group 0. With ``write`` the columns are written before
    incomplete rows are left out, so that each is computed once.
    """
    keyed = {"_b": list(by), "_a": list(absorb), "_c": list(cluster)}
    keys = {tag: [f"{tag}{i}" for i in range(len(names))] for tag, names in keyed.items()}
    picked = [F.col(c).alias(k) for tag, names in keyed.items() for c, k in zip(names, keys[tag])]
    if not by:
        keys["_b"], picked = ["_b0"], [F.lit(0).alias("_b0"), *picked]
    v = [f"v{i}" for i in range(len(columns))]
    # Only floating columns can hold NaN; a needless test per dummy makes code too long to compile.
    whole = {f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.BooleanType, T.DecimalType))}
    values = [
        (F.col(c).cast("double") if c in whole else F.nullif(F.col(c).cast("double"), F.lit(float("nan")))).alias(n)
        for c, n in zip(columns, v)
    ]
    rows = df.select(*picked, *values)
    if write:
        rows = materialize(rows, "model")
    return rows.dropna(), keys["_b"], keys["_a"], keys["_c"], v


def beyond_rounding(product: Column | str, whole: Column | str, share: float) -> Column:
    """A column's own product, or 0 where it is no more than rounding errors of its whole sum of squares,
    so that a column which the groups explain shows no variation."""
    product, whole = (F.expr(c) if isinstance(c, str) else c for c in (product, whole))
    return F.when(product > share * whole, product).otherwise(0.0)


def cell_sums(work: DataFrame, keys: Sequence[str], v: Sequence[str]) -> DataFrame:
    """Count, means and centred products per cell, from numerically stable aggregates."""
    pairs = triangle(len(v))
    return work.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.expr(f"avg({x}) AS m_{x}") for x in v],
        *[F.expr(f"covar_pop({v[i]}, {v[j]}) * count(1) AS p_{i}_{j}") for i, j in pairs],
    )


def _packed(prefix: str, names: Sequence[str]) -> Column:
    return F.expr(f"array({', '.join(prefix + n for n in names)})")


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), absorb: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` group: keys ``_b*``, ``n``, ``groups``, ``means``, ``cross``.

    ``cross`` is the upper triangle of products around the means of the absorbed
    groups, or around the overall means when nothing is absorbed.
    """
    work, b, a, _, v = prepare(df, columns, by, absorb, (), write=len(columns) > NARROW)
    if len(v) > NARROW:
        return wide_moments(work, b, a, v)
    names = [f"{i}_{j}" for i, j in triangle(len(v))]
    cells = cell_sums(work, [*b, *a], v)
    summed = cells.groupBy(*b).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        *[F.expr(f"sum(n * m_{x}) / sum(n) AS m_{x}") for x in v],
        *[F.expr(f"sum(p_{n}) AS p_{n}") for n in names],
        *[F.expr(f"sum(n * m_{x} * m_{x}) AS q_{x}") for x in v],
    )
    own = {f"p_{i}_{i}": beyond_rounding(f"p_{i}_{i}", f"p_{i}_{i} + q_{x}", CENTRED_ROUNDING) for i, x in enumerate(v)}
    summed = summed.withColumns(own)
    return summed.select(*b, "n", "groups", _packed("m_", v).alias("means"), _packed("p_", names).alias("cross"))


def batch_products(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    weight: str | None = None,
    expand: Callable[[np.ndarray], np.ndarray] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Rows (keys, i, j, s): products of all value columns, one triangle per key and task.

    Rows are sorted by key inside their task first, without a shuffle, so a task meets each
    key once and holds few triangles however many keys there are. With ``weight``, each row's products are divided by it. ``expand`` turns the value
    columns of a batch into ``width`` model columns.
    """
    keys, values = list(keys), list(values)
    k = width or len(values)
    iu, ju = np.triu_indices(k)
    schema = T.StructType(
        [df.schema[c] for c in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())]
    )

    arrow = to_arrow_schema(schema)

    def rows(sums: dict) -> pa.RecordBatch:
        table = {name: [key[n] for key in sums for _ in iu] for n, name in enumerate(keys)}
        table |= {"i": np.tile(iu, len(sums)), "j": np.tile(ju, len(sums))}
        table["s"] = np.concatenate([m[iu, ju] for m in sums.values()])
        return pa.RecordBatch.from_pydict(table, schema=arrow)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            table = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in values])
            scale = 1 / batch.column(weight).to_numpy(zero_copy_only=False).astype(float) if weight else None
            for key, at in _positions(batch, keys):
                x = expand(table[at]) if expand else table[at]
                if key not in sums and len(sums) >= FLUSH_GROUPS:
                    yield rows(sums)
                    sums = {}
                sums[key] = sums.get(key, 0) + x.T @ (x * scale[at, None] if weight else x)
        if sums:
            yield rows(sums)

    used = [*keys, *values, *([weight] if weight else [])]
    return df.select(*used).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _positions(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[tuple, object]]:
    """Row positions of every key in a batch; one slice when the batch has a single key."""
    if batch.num_rows == 0:
        return []
    columns = [batch.column(k) for k in keys]
    if all(len(pc.unique(c)) == 1 for c in columns):
        return [(tuple(c[0].as_py() for c in columns), slice(None))]
    found = pa.Table.from_batches([batch]).select(keys).to_pandas().groupby(keys, sort=False, dropna=False).indices
    return [(tuple(c[int(at[0])].as_py() for c in columns), at) for at in found.values()]


def summed_entries(products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, s): sums of (i, j) entries, see ``pack_products``."""
    grouped = products.groupBy(*keys, "i", "j")
    if "whole" not in products.columns:
        return grouped.agg(F.sum("s").alias("s"))
    entries = grouped.agg(F.sum("s").alias("s"), F.sum("whole").alias("whole"))
    own = beyond_rounding("s", "whole", DIFFERENCE_ROUNDING)
    return entries.select(*keys, "i", "j", F.when(F.col("i") == F.col("j"), own).otherwise(F.col("s")).alias("s"))


def pack_products(products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum (i, j) entries per key and list them as the upper triangle ``cross``.

    With a column ``whole``, the part of each entry that counts towards whole sums of squares,
    entries on the diagonal that are rounding errors of these become 0.
    """
    entries = summed_entries(products, keys)
    listed = F.array_sort(F.collect_list(F.struct("i", "j", "s")))
    return entries.groupBy(*keys).agg(F.transform(listed, lambda e: e["s"]).alias("cross"))


def centre_of(work: DataFrame, v: Sequence[str]) -> dict[str, float]:
    """Overall means, by one job: as a subquery they would be planned once per column."""
    return {x: m or 0.0 for x, m in work.agg(*[F.avg(x).alias(x) for x in v]).first().asDict().items()}


def shifted(work: DataFrame, centre: dict[str, float]) -> DataFrame:
    """Values around their overall means, so that large offsets do not swamp the products."""
    return work.select(*[(F.col(c) - centre[c]).alias(c) if c in centre else F.col(c) for c in work.columns])


def wide_moments(work: DataFrame, b: list[str], a: list[str], v: list[str]) -> DataFrame:
    """``moments`` of many columns; ``work`` is a written table, as it is scanned several times
    and the plan of a wide model would otherwise be repeated in each."""
    centre = centre_of(work, v)
    moved = shifted(work, centre)
    groups = moved.groupBy(*b, *a).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in v])
    total = batch_products(moved, b, v).withColumn("whole", F.col("s"))
    between = batch_products(groups, b, v, weight="n").withColumns({"s": -F.col("s"), "whole": F.lit(0.0)})
    cross = pack_products(total.unionByName(between), b)
    counts = groups.groupBy(*b).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        *[F.expr(f"sum({x}) / sum(n)").alias(x) for x in v],
    )
    means = F.array(*[F.col(x) + centre[x] for x in v])
    return counts.select(*b, "n", "groups", means.alias("means")).join(cross, b)


def gram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of all columns in long form (R1): (by, i, j, value), 1-based."""
    work, b, _, _, v = prepare(df, columns, by, (), ())
    if len(v) > NARROW:
        entries = batch_products(work, b, v).groupBy(*b, "i", "j").agg(F.sum("s").alias("value"))
        long = entries.withColumns({"i": F.col("i") + 1, "j": F.col("j") + 1})
    else:
        pairs = triangle(len(v))
        sums = work.groupBy(*b).agg(*[F.expr(f"sum({v[i]} * {v[j]}) AS p_{i}_{j}") for i, j in pairs])
        entries = ", ".join(f"named_struct('i', {i + 1}, 'j', {j + 1}, 'value', p_{i}_{j})" for i, j in pairs)
        long = sums.select(*b, F.expr(f"inline(array({entries}))"))
    return long.select(*[F.col(k).alias(name) for k, name in zip(b, by)], "i", "j", "value")
