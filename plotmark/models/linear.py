"""Least squares with one absorbed effect and clustered errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotmark.models.moments import (
    CENTRED_ROUNDING,
    NARROW,
    batch_products,
    beyond_rounding,
    cell_sums,
    centre_of,
    moments,
    pack_products,
    prepare,
    shifted,
    triangle,
    wide_moments,
)
from plotmark.models.numeric import solve_ols, t_pvalue, unpack
from plotmark.operators.skew import attach_groups
from plotmark.session import materialize

RESULT = [
    ("term", T.StringType()),
    ("coef", T.DoubleType()),
    ("se", T.DoubleType()),
    ("se_plain", T.DoubleType()),
    ("t", T.DoubleType()),
    ("p", T.DoubleType()),
    ("lo", T.DoubleType()),
    ("hi", T.DoubleType()),
    ("n", T.LongType()),
    ("groups", T.LongType()),
    ("clusters", T.LongType()),
    ("df_resid", T.LongType()),
    ("r2_within", T.DoubleType()),
    ("reason", T.StringType()),
]


def _names(value: Sequence[str] | str | None) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def ols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    absorb: Sequence[str] | str | None = None,
    cluster: Sequence[str] | str | None = None,
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Coefficient table of one regression, or of one per ``by`` group.

    Several ``absorb`` columns together form one effect. Rows with a missing value are
    left out. A term that earlier terms explain, or a group with too few rows, gets a
    null coefficient and a reason. ``lo`` and ``hi`` are coef -/+ 1.96 se. ``se`` is
    clustered when ``cluster`` is given (then the intercept has none).
    """
    x, by, absorb, cluster = list(x), _names(by), _names(absorb), _names(cluster)
    columns = [*x, y]
    if not cluster:
        stats = moments(df, columns, by, absorb).withColumns(
            {"clusters": F.lit(None).cast("long"), "meat": F.lit(None).cast("array<double>")}
        )
    elif len(columns) <= NARROW:
        stats = _clustered_narrow(df, columns, by, absorb, cluster)
    else:
        stats = _clustered_wide(df, columns, by, absorb, cluster)
    keys = [c for c in stats.columns if c.startswith("_b")]
    return _coefficients(stats, keys, by, x, not absorb)


def _coefficients(stats: DataFrame, keys: list[str], by: list[str], x: list[str], intercept: bool) -> DataFrame:
    named = [T.StructField(n, stats.schema[k].dataType) for k, n in zip(keys, by)]
    schema = T.StructType(named + [T.StructField(n, t) for n, t in RESULT])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = {n: r[k] for k, n in zip(keys, by)}
                rows += [{**key, **term} for term in _table(r, x, intercept)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return stats.mapInArrow(run, schema)


def _table(r: dict, x: list[str], intercept: bool) -> list[dict]:
    p, n, groups = len(x), r["n"], r["groups"]
    cross = unpack(np.asarray(r["cross"], float), p + 1)
    b, kept, inv, rss, tss = solve_ols(cross)
    k = len(kept) + groups
    df = n - k
    clusters = r["clusters"]
    shared = {
        "n": n, "groups": groups, "clusters": clusters, "df_resid": df,
        "r2_within": 1 - rss / tss if tss > 0 else None,
    }
    few = df <= 0 or (clusters is not None and clusters < 2)
    if few:
        return [{"term": name, "reason": "too few rows", **shared} for name in x]
    sigma2 = rss / df
    plain = np.full(p, np.nan)
    plain[kept] = np.sqrt(sigma2 * np.diag(inv))
    se, t_df = plain, df
    if clusters is not None:
        meat = unpack(np.asarray(r["meat"], float), p)[np.ix_(kept, kept)]
        factor = clusters / (clusters - 1) * (n - 1) / (n - k)
        se = np.full(p, np.nan)
        se[kept] = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0) * factor)
        t_df = clusters - 1
    out = []
    if intercept:
        m = np.asarray(r["means"], float)
        b0 = m[p] - float(np.nansum(m[:p] * b))
        se0 = float(np.sqrt(sigma2 * (1 / n + m[:p][kept] @ inv @ m[:p][kept])))
        out.append(_term("(intercept)", b0, None if clusters else se0, se0, t_df, shared))
    for i, name in enumerate(x):
        if i in kept:
            out.append(_term(name, b[i], se[i], plain[i], t_df, shared))
        else:
            out.append({"term": name, "reason": "collinear", **shared})
    return out


def _term(name: str, coef: float, se: float | None, plain: float, df: int, shared: dict) -> dict:
    row = {"term": name, "coef": float(coef), "se": se, "se_plain": float(plain), **shared}
    if se is not None:
        t = coef / se if se > 0 else float("nan")
        row |= {"se": float(se), "t": t, "p": t_pvalue(t, df), "lo": coef - 1.96 * se, "hi": coef + 1.96 * se}
    return row


def _solution(stats: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Coefficient array per fitted group, with 0 for a dropped term."""
    schema = T.StructType([stats.schema[k] for k in keys] + [T.StructField("beta", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["beta"] = np.nan_to_num(solve_ols(unpack(np.asarray(r.pop("cross"), float), p + 1))[0]).tolist()
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return stats.select(*keys, "cross").mapInArrow(run, schema)


def _give_back(df: DataFrame, stats: DataFrame, keys: list[str], size: str, single: bool) -> DataFrame:
    """Group values joined to rows; a single group is one row and needs no counting."""
    if single:
        return df.join(F.broadcast(stats.drop(size)), keys)
    return attach_groups(df, stats, keys, size)


def _clustered_narrow(df: DataFrame, columns: list[str], by: list[str], absorb: list[str], cluster: list[str]) -> DataFrame:
    """Moments and score products from one scan.

    Rows are reduced once to cells of (by, absorb, cluster); group means, cluster
    scores and the solution all come from the written cell table.
    """
    work, b, a, c, v = prepare(df, columns, by, absorb, cluster)
    pairs, p = triangle(len(v)), len(v) - 1
    cells = materialize(cell_sums(work, [*b, *a, *c], v), "cells")
    groups = cells.groupBy(*b, *a).agg(
        F.count("*").alias("_size"),
        F.sum("n").alias("g_n"),
        *[F.expr(f"sum(n * m_{x}) / sum(n) AS g_{x}") for x in v],
    )
    moved = _give_back(cells, groups, [*b, *a], "_size", not by and not a)
    around = [
        F.expr(f"sum(p_{i}_{j} + n * (m_{v[i]} - g_{v[i]}) * (m_{v[j]} - g_{v[j]})) AS p_{i}_{j}") for i, j in pairs
    ]
    squares = [F.expr(f"sum(n * g_{x} * g_{x}) AS q_{x}") for x in v]
    clusters = materialize(moved.groupBy(*b, *c).agg(F.sum("n").alias("n"), *around, *squares), "clusters")
    sums = clusters.groupBy(*b).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("clusters"),
        *[F.expr(f"sum(p_{i}_{j}) AS p_{i}_{j}") for i, j in pairs],
        *[F.expr(f"sum(q_{x}) AS q_{x}") for x in v],
    )
    own = {f"p_{i}_{i}": beyond_rounding(f"p_{i}_{i}", f"p_{i}_{i} + q_{x}", CENTRED_ROUNDING) for i, x in enumerate(v)}
    sums = sums.withColumns(own)
    cross = F.expr(f"array({', '.join(f'p_{i}_{j}' for i, j in pairs)})")
    sums = sums.select(*b, "n", "clusters", cross.alias("cross"))
    means = groups.groupBy(*b).agg(
        F.count("*").alias("groups"), F.array(*[F.expr(f"sum(g_n * g_{x}) / sum(g_n)") for x in v]).alias("means")
    )
    beta = _solution(sums, b, p).join(sums.select(*b, "clusters"), b)
    scored = _give_back(clusters, beta, b, "clusters", not by)

    def entry(i: int, j: int) -> str:
        return f"p_{min(i, j)}_{max(i, j)}"

    scores = [
        F.expr(" - ".join([entry(i, p), *[f"{entry(i, j)} * beta[{j}]" for j in range(p)]])).alias(f"s{i}")
        for i in range(p)
    ]
    meat = [f"sum(s{i} * s{j})" for i, j in triangle(p)]
    meat = scored.select(*b, *scores).groupBy(*b).agg(F.expr(f"array({', '.join(meat)})").alias("meat"))
    return sums.join(means, b).join(meat, b)


def _clustered_wide(df: DataFrame, columns: list[str], by: list[str], absorb: list[str], cluster: list[str]) -> DataFrame:
    """As above for many columns: a second scan sums residual scores instead of products."""
    work, b, a, c, v = prepare(df, columns, by, absorb, cluster, write=True)
    stats = materialize(wide_moments(work, b, a, v), "moments")
    p = len(v) - 1
    xs = v[:p]
    beta = _solution(stats, b, p).join(stats.select(*b, "n"), b)
    moved = _give_back(shifted(work, centre_of(work, v)), beta, b, "n", not by)
    fitted = " - ".join([v[p], *[f"{x} * beta[{i}]" for i, x in enumerate(xs)]])
    cells = moved.withColumn("e", F.expr(fitted)).groupBy(*b, *a, *c).agg(
        F.count("*").alias("n"),
        F.sum("e").alias("e"),
        *[F.expr(f"sum({x}) AS x_{x}") for x in xs],
        *[F.expr(f"sum({x} * e) AS xe_{x}") for x in xs],
    )
    cells = materialize(cells, "cells")
    groups = cells.groupBy(*b, *a).agg(
        F.count("*").alias("_size"),
        F.expr("sum(e) / sum(n) AS g_e"),
        *[F.expr(f"sum(x_{x}) / sum(n) AS g_{x}") for x in xs],
    )
    near = _give_back(cells, groups, [*b, *a], "_size", not by and not a)
    scores = [F.expr(f"sum(xe_{x} - g_e * x_{x} - g_{x} * e + n * g_{x} * g_e) AS s_{x}") for x in xs]
    clusters = materialize(near.groupBy(*b, *c).agg(*scores), "scores")
    meat = pack_products(batch_products(clusters, b, [f"s_{x}" for x in xs]), b).withColumnRenamed("cross", "meat")
    counts = clusters.groupBy(*b).agg(F.count("*").alias("clusters"))
    return stats.join(counts, b).join(meat, b)


def _part(stats: DataFrame, keys: list[str], places: list[int], width: int) -> DataFrame:
    """Moments of some of the columns of ``stats``, in the order of ``places``."""
    at = {pair: k for k, pair in enumerate(triangle(width))}
    cross = [at[min(i, j), max(i, j)] for n, i in enumerate(places) for j in places[n:]]
    return stats.select(
        *keys, "n", "groups",
        F.array(*[F.col("means")[i] for i in places]).alias("means"),
        F.array(*[F.col("cross")[k] for k in cross]).alias("cross"),
    )


def _fit_superset(df: DataFrame, y: str, models: Mapping[str, list[str]], absorb: list[str], cluster: list[str], by: list[str]) -> DataFrame:
    """Fits of several sets of columns on the same rows under one effect, each labelled ``model``.

    One table of moments holds the columns of all; a model is a part of it. Clustered errors
    come from one more scan, in which each row gives its residual in every model.
    """
    union = list(dict.fromkeys(c for x in models.values() for c in x))
    work, b, a, c, v = prepare(df, [*union, y], by, absorb, cluster, write=True)
    place, k = {name: i for i, name in enumerate(union)}, len(v)
    stats = materialize(wide_moments(work, b, a, v), "moments")
    places = {m: [*(place[x] for x in xs), k - 1] for m, xs in models.items()}
    parts = {m: _part(stats, b, at, k) for m, at in places.items()}
    if cluster:
        parts = _superset_meat(work, stats, parts, places, b, a, c, v, not by)
    out = None
    for m, xs in models.items():
        part = parts[m]
        if not cluster:
            part = part.withColumns({"clusters": F.lit(None).cast("long"), "meat": F.lit(None).cast("array<double>")})
        fit = _coefficients(part, b, by, xs, not absorb).withColumn("model", F.lit(m))
        out = fit if out is None else out.unionByName(fit)
    return out


def _superset_meat(
    work: DataFrame, stats: DataFrame, parts: dict[str, DataFrame], places: dict[str, list[int]],
    b: list[str], a: list[str], c: list[str], v: list[str], single: bool,
) -> dict[str, DataFrame]:
    """The parts with ``clusters`` and ``meat`` of each, from one scan of the rows."""
    beta = stats.select(*b, "n")
    for i, (m, at) in enumerate(places.items()):
        beta = beta.join(_solution(parts[m], b, len(at) - 1).withColumnRenamed("beta", f"b{i}"), b)
    moved = _give_back(shifted(work, centre_of(work, v)), materialize(beta, "solutions"), b, "n", single)
    own = {i: [v[k] for k in at[:-1]] for i, at in enumerate(places.values())}
    resid = {f"e{i}": F.expr(" - ".join([v[-1], *[f"{x} * b{i}[{j}]" for j, x in enumerate(xs)]])) for i, xs in own.items()}
    sums = [F.count("*").alias("n"), *[F.expr(f"sum({x}) AS x_{x}") for x in v[:-1]]]
    for i, xs in own.items():
        sums += [F.expr(f"sum(e{i}) AS e{i}"), *[F.expr(f"sum({x} * e{i}) AS t{i}_{x}") for x in xs]]
    cells = materialize(moved.withColumns(resid).groupBy(*b, *a, *c).agg(*sums), "cells")
    groups = cells.groupBy(*b, *a).agg(
        F.count("*").alias("_size"),
        *[F.expr(f"sum(e{i}) / sum(n) AS g_e{i}") for i in own],
        *[F.expr(f"sum(x_{x}) / sum(n) AS g_{x}") for x in v[:-1]],
    )
    near = _give_back(cells, groups, [*b, *a], "_size", single and not a)
    scores = [
        F.expr(f"sum(t{i}_{x} - g_e{i} * x_{x} - g_{x} * e{i} + n * g_{x} * g_e{i}) AS s{i}_{x}") for i, xs in own.items() for x in xs
    ]
    clusters = materialize(near.groupBy(*b, *c).agg(*scores), "scores")
    counts = clusters.groupBy(*b).agg(F.count("*").alias("clusters"))
    out = {}
    for i, m in enumerate(places):
        products = batch_products(clusters, b, [f"s{i}_{x}" for x in own[i]])
        out[m] = parts[m].join(counts, b).join(pack_products(products, b).withColumnRenamed("cross", "meat"), b)
    return out


def _known(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether all columns have a value; NaN is none."""
    kinds, known = dict(df.dtypes), F.lit(True)
    for c in columns:
        known = known & F.col(f"`{c}`").isNotNull()
        if kinds[c] in ("double", "float"):
            known = known & ~F.isnan(f"`{c}`")
    return known


def _same_rows(rows: DataFrame, sets: list[list[list[str]]]) -> list[bool]:
    """For each list of column sets, whether they are complete in the same rows; one scan for all."""
    counts = []
    for i, of in enumerate(sets):
        union = list(dict.fromkeys(c for columns in of for c in columns))
        counts += [F.count_if(_known(rows, columns)).alias(f"c{i}_{j}") for j, columns in enumerate([union, *of])]
    found = rows.agg(*counts).first().asDict()
    return [len({found[f"c{i}_{j}"] for j in range(len(of) + 1)}) == 1 for i, of in enumerate(sets)]


def fit_specs(df: DataFrame, specs: Mapping[str, Mapping]) -> DataFrame:
    """Variants of one model stacked under a ``model`` label.

    A spec holds the arguments of ``ols`` and, optionally, ``factors`` (see ``models.factors``)
    and ``where`` for its subset. The columns and subsets that the specs need are computed and
    written once. Specs with the same response, effect, clusters, groups and subset, whose
    columns are complete in the same rows, are fitted together from one table of moments;
    others scan their own columns of the written table.
    """
    from plotmark.models.factors import factor_ols

    used: dict[str, None] = {}
    for spec in specs.values():
        named = [*_names(spec["y"]), *spec["x"], *(c for k in ("absorb", "cluster", "by", "factors") for c in _names(spec.get(k)))]
        used |= dict.fromkeys(named)
    wheres = {name: spec["where"] for name, spec in specs.items() if spec.get("where") is not None}
    inside = {name: f"_in_{i}" for i, name in enumerate(wheres)}
    flags = [(F.expr(w) if isinstance(w, str) else w).alias(inside[name]) for name, w in wheres.items()]
    table = materialize(df.select(*[F.col(f"`{c}`") for c in used], *flags), "specs") if len(specs) > 1 else None
    alike: dict[tuple, list[str]] = {}
    for name, spec in specs.items():
        if not spec.get("factors"):
            where = spec.get("where")
            keys = tuple(tuple(_names(spec.get(k))) for k in ("y", "absorb", "cluster", "by"))
            alike.setdefault((*keys, where if where is None or isinstance(where, str) else id(where)), []).append(name)
    shared = [names for names in alike.values() if len(names) > 1]
    complete = lambda spec: [*spec["x"], *(c for k in ("y", "absorb", "cluster", "by") for c in _names(spec.get(k)))]
    same = _same_rows(table, [[complete(specs[n]) for n in names] for names in shared]) if shared else []
    fits, together = [], set()
    for names, ok in zip(shared, same):
        if ok:
            first, rows = specs[names[0]], table
            if names[0] in inside:
                rows = rows.filter(F.col(inside[names[0]]))
            models = {n: list(specs[n]["x"]) for n in names}
            effects = [_names(first.get(k)) for k in ("absorb", "cluster", "by")]
            fits.append(_fit_superset(rows, first["y"], models, *effects))
            together |= set(names)
    for name, spec in specs.items():
        if name in together:
            continue
        spec = dict(spec)
        where = spec.pop("where", None)
        rows = df if table is None else table
        if where is not None:
            rows = rows.filter(where if table is None else F.col(inside[name]))
        fits.append((factor_ols if spec.get("factors") else ols)(rows, **spec).withColumn("model", F.lit(name)))
    out = fits[0]
    for fit in fits[1:]:
        out = out.unionByName(fit)
    return out


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def coef_table(results: DataFrame, models: Sequence[str], digits: int = 3) -> DataFrame:
    """Terms by model, each cell ``coef stars (se)``."""
    cell = F.format_string(
        f"%.{digits}f%s (%.{digits}f)", F.col("coef"), stars(F.col("p")), F.col("se")
    )
    shown = results.withColumn("_cell", F.when(F.col("coef").isNotNull() & F.col("se").isNotNull(), cell))
    return shown.groupBy("term").agg(*[F.max(F.when(F.col("model") == m, F.col("_cell"))).alias(m) for m in models])
