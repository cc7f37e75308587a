"""Correlations, single-trait fits and the second-stage table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotmark.functions.scalars import split_metro_name
from plotmark.models.numeric import t_pvalue
from plotmark.sources.contracts import lookup


def with_pvalue(df: DataFrame, t: str, dof: str, name: str = "p") -> DataFrame:
    """Two-sided p-value of a t column; meant for short tables of statistics."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                known = r[t] is not None and r[dof] is not None and r[dof] > 0
                r[name] = t_pvalue(r[t], r[dof]) if known else None
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairwise correlation with its count, t statistic and p-value."""
    both = df.dropna(subset=[a, b, *by])
    stats = both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).withColumn("dof", F.col("n") - 2)
    t = F.try_divide(F.col("r") * F.sqrt(F.col("dof")), F.sqrt(1 - F.col("r") * F.col("r")))
    return with_pvalue(stats.withColumn("t", F.when(F.col("dof") > 0, t)), "t", "dof")


def _simple_fit(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slope, intercept and errors of ``_y`` on ``_x`` per key, from one set of sums."""
    sums = source.groupBy(*keys).agg(
        F.regr_count("_y", "_x").alias("n"),
        F.regr_slope("_y", "_x").alias("coef"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("syy"),
        F.regr_sxy("_y", "_x").alias("sxy"),
    )
    rss = F.greatest(F.col("syy") - F.col("coef") * F.col("sxy"), F.lit(0.0))
    variance = F.try_divide(rss, (F.col("n") - 2) * F.col("sxx"))
    return sums.withColumn("se", F.when(F.col("n") > 2, F.sqrt(variance))).select(
        *keys, "n", "coef", "intercept", "se", "r2"
    )


def trait_screen(df: DataFrame, y: str, traits: Sequence[str]) -> DataFrame:
    """One single-regressor fit per trait, all in one aggregation."""
    cells = F.array(*[F.struct(F.lit(c).alias("trait"), F.col(c).cast("double").alias("_x")) for c in traits])
    return _simple_fit(df.select(F.col(y).cast("double").alias("_y"), F.inline(cells)), ["trait"])


def fitted_line(df: DataFrame, y: str, x: str, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Line of best fit, overall or per region."""
    source = df if where is None else df.filter(where)
    return _simple_fit(
        source.select(*by, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")), list(by)
    )


def metro_keys(df: DataFrame, name: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Replace a metro name by its first city and state."""
    city, state = split_metro_name(name, aliases)
    return df.withColumns({"msacity": city, "msastate": state}).drop(name)


def second_stage(
    results: DataFrame,
    regtype: str,
    by_code: Sequence[DataFrame],
    by_name: Sequence[tuple[DataFrame, str, Mapping[str, str]]],
    code: str = "cbsacode",
    names: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Metro coefficients of one model with supporting tables.

    ``by_code`` tables share the metro code; ``by_name`` tables are matched on the
    first city and state of their metro name. ``names`` gives the metro name by code.
    """
    df = results.filter(F.col("regtype") == regtype).dropDuplicates()
    df = df.withColumns({c: F.col(c).try_cast("double") for c in ("coef", "se", "N")})
    for table in by_code:
        df = lookup(df, table, code)
    if names is not None:
        df = lookup(df, metro_keys(names[0], names[1]), code)
    for table, name, aliases in by_name:
        df = lookup(df, metro_keys(table, name, aliases), ["msacity", "msastate"])
    return df
