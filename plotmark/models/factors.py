"""Least squares with categorical factors of many levels, without dummy columns.

Products of dummies are counts: of a factor with itself its level counts, with a number its level
sums, with another factor its pair counts. All are grouped sums of one table of cells, so that
a factor of 145 months costs three aggregations and no product per row. The factor with
most levels is eliminated: what its groups explain is taken off each product by sums
over groups (a Schur complement), and its own columns never form. The other factors' levels and
the numeric columns make one small system per fitted group, solved in a task; its size is
the square of the levels of all factors but the largest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plotmark.models.linear import RESULT, _give_back, _names, _term
from plotmark.models.moments import NARROW, batch_products, centre_of, pack_products, prepare, shifted, summed_entries, triangle
from plotmark.models.numeric import COLLINEAR, unpack
from plotmark.operators.skew import attach_groups
from plotmark.session import materialize

# Levels whose counts meet in one task's table before it is handed on.
FLUSH_LEVELS = 2000
# Groups count densely if their pairs fill one DENSE-th of the table; else so many pairs are held at a time.
DENSE, PAIRS = 16, 1 << 20


def cholesky(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(L, kept): factors of a cross-product matrix over the columns that no earlier one explains."""
    work, d = a.astype(float).copy(), np.diag(a).copy()
    kept, rows = [], []
    for j in range(len(a)):
        if not d[j] > 0 or work[j, j] <= COLLINEAR * d[j]:
            continue
        column = work[:, j] / np.sqrt(work[j, j])
        column[:j] = 0
        work[j:, j:] -= np.outer(column[j:], column[j:])
        kept.append(j)
        rows.append(column)
    if not kept:
        return np.zeros((0, 0)), kept
    return np.array(rows).T[kept], kept


def _shares(group: np.ndarray, level: np.ndarray, levels: int, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Products of the counts ``n`` of all pairs of levels over their group's size, summed over groups.

    Rows of a group are together. Groups that have most levels give a dense matrix of counts, others
    their own pairs.
    """
    new = np.r_[True, group[1:] != group[:-1]]
    starts, which = np.flatnonzero(new), np.cumsum(new) - 1
    sizes = np.diff(np.r_[starts, len(group)])
    if DENSE * (sizes.astype(float) ** 2).sum() >= len(starts) * levels**2:
        counts = np.zeros((len(starts), levels))
        np.add.at(counts, (which, level), n / np.sqrt(size))
        return counts.T @ counts
    out = np.zeros(levels * levels)
    partners = sizes[which]
    ends = np.cumsum(partners)
    low = 0
    while low < len(level):
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")), low + 1)
        m = partners[low:high]
        i = np.repeat(np.arange(low, high), m)
        j = np.repeat(starts[which[low:high]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out += np.bincount(level[i] * levels + level[j], n[i] * n[j] / size[i], len(out))
        low = high
    return out.reshape(levels, levels)


def _pair_shares(cells: DataFrame, b: list[str], group: list[str], levels: list[str]) -> DataFrame:
    """(b, i, j, s): sums over groups of the products of level counts over the group's size.

    Rows of a group meet in one task, as one row per level of each factor.
    """
    listed = cells.select(*b, *group, "n", F.explode(F.array(*levels)).alias("level"))
    counts = listed.groupBy(*b, *group, "level").agg(F.sum("n").alias("n"))
    sizes = cells.groupBy(*b, *group).agg(F.count("*").alias("_size"), F.sum("n").alias("g_n"))
    sized = attach_groups(counts, sizes, [*b, *group], "_size", "inner")
    # A name per group, as its keys may have any type.
    named = sized.select(*b, F.to_json(F.struct(*group)).alias("group") if group else F.lit("").alias("group"), "level", "n", "g_n")
    keys = [named.schema[k] for k in b]
    schema = T.StructType(
        [*keys, T.StructField("i", T.StringType()), T.StructField("j", T.StringType()), T.StructField("s", T.DoubleType())]
    )

    def rows(by: tuple, names: dict, table: np.ndarray) -> pd.DataFrame:
        k = len(names)
        i, j = np.nonzero(np.triu(table[:k, :k]))
        label = np.array(list(names), object)
        one, two = label[i], label[j]
        low, high = np.minimum(one, two), np.maximum(one, two)
        out = pd.DataFrame({"i": low, "j": high, "s": table[i, j]})
        for name, value in zip(b[::-1], by[::-1]):
            out.insert(0, name, value)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, names, table = None, None, {}, np.zeros((64, 64))

        def add(part: pd.DataFrame, key: tuple) -> Iterator[pd.DataFrame]:
            """Whole groups of one key with at most ``FLUSH_LEVELS`` rows, or a single group."""
            nonlocal at, names, table
            own, levels = pd.factorize(part["level"])
            new = sum(level not in names for level in levels)
            if at is not None and (key != at or (names and len(names) + new > FLUSH_LEVELS)):
                yield rows(at, names, table)
                names, table = {}, np.zeros((64, 64))
            at = key
            for level in levels:
                names.setdefault(level, len(names))
            if len(names) > len(table):
                grown = np.zeros((max(len(names), 2 * len(table)),) * 2)
                grown[: len(table), : len(table)] = table
                table = grown
            index = np.array([names[level] for level in levels])
            group = part["group"].to_numpy()
            shares = _shares(group, own, len(levels), part["n"].to_numpy(float), part["g_n"].to_numpy(float))
            table[np.ix_(index, index)] += shares

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = None
            if not len(frame):
                continue
            # Null keys count as equal.
            code = [pd.factorize(frame[c], use_na_sentinel=False)[0] for c in [*b, "group"]]
            change = lambda codes: np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
            starts = change(code) if len(frame) > 1 else np.zeros(1, int)
            # The last group may go on in the next frame.
            held = frame.iloc[starts[-1] :]
            keyed = set(change(code[:-1])) if len(frame) > 1 and b else {0}
            low = 0
            for k in range(1, len(starts)):
                end = starts[k]
                after = starts[k + 1] if k + 1 < len(starts) else None
                if after is None or end in keyed or after - starts[low] > FLUSH_LEVELS:
                    part = frame.iloc[starts[low] : end]
                    yield from add(part, tuple(part[c].iloc[0] for c in b))
                    low = k
        if held is not None:
            yield from add(held, tuple(held[c].iloc[0] for c in b))
        if at is not None:
            yield rows(at, names, table)

    order = [*b, "group"]
    return named.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, schema).groupBy(*b, "i", "j").agg(F.sum("s").alias("s"))


class _Cells:
    """The grouped sums of one model: everything its fits need."""

    def __init__(self, df: DataFrame, y: str, x: list[str], factors: list[str], absorb: list[str], cluster: list[str], by: list[str]):
        effects = [[f] for f in factors] + ([absorb] if absorb else [])
        self.work, self.b, keys, self.c, self.v = prepare(df, [*x, y], by, [c for e in effects for c in e], cluster, write=True)
        taken = iter(keys)
        self.effects = [[next(taken) for _ in e] for e in effects]
        self.centre = centre_of(self.work, self.v)
        self.rows = shifted(self.work, self.centre)
        sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in self.v]]
        # Products of few columns come with the cells, so that rows need no scan of their own.
        self.pairs = triangle(len(self.v)) if len(self.v) <= NARROW else []
        sums += [F.expr(f"sum({self.v[i]} * {self.v[j]}) AS p_{i}_{j}") for i, j in self.pairs]
        self.cells = materialize(self.rows.groupBy(*self.b, *keys).agg(*sums), "cells")
        sizes = self.cells.agg(*[F.approx_count_distinct(F.struct(*e)) for e in self.effects]).first()
        self.largest = max(range(len(effects)), key=lambda k: sizes[k])
        self.group = self.effects[self.largest]
        self.small = [k for k in range(len(effects)) if k != self.largest]

    def level(self, k: int) -> Column:
        """The name of a row's level of an effect; names of one effect sort like its levels."""
        return F.concat(F.lit(f"{k}:"), *[c for n, e in enumerate(self.effects[k]) for c in ([F.lit("|")] * (n > 0) + [F.col(e).cast("string")])])

    def groups(self) -> DataFrame:
        sums = [F.sum("n").alias("g_n"), *[F.sum(c).alias(f"g_{c}") for c in self.v]]
        return self.cells.groupBy(*self.b, *self.group).agg(F.count("*").alias("_size"), *sums)

    def products(self) -> DataFrame:
        """(b, i, j, s): products of the numeric columns over all rows, i and j by number."""
        if not self.pairs:
            return batch_products(self.rows, self.b, self.v)
        summed = self.cells.groupBy(*self.b).agg(*[F.expr(f"sum(p_{i}_{j}) AS p_{i}_{j}") for i, j in self.pairs])
        listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p_{i}_{j}").alias("s")) for i, j in self.pairs])
        return summed.select(*self.b, F.inline(listed))

    def entries(self) -> DataFrame:
        """(b, i, j, s): the products of all columns around the means of the eliminated groups.

        Numeric columns are called ``~`` and their number, so that they sort behind levels.
        """
        b, v = self.b, self.v
        number = lambda c: F.format_string("~%05d", F.col(c))
        groups = self.groups().drop("_size").select(*b, *self.group, F.col("g_n").alias("n"), *[F.col(f"g_{c}").alias(c) for c in v])
        taken = lambda d: d.withColumns({"s": -F.col("s"), "whole": F.lit(0.0)})
        between = taken(batch_products(groups, b, v, weight="n"))
        total = self.products().withColumn("whole", F.col("s"))
        out = total.unionByName(between).withColumns({"i": number("i"), "j": number("j")})
        if not self.small:
            return summed_entries(out, b)
        near = _give_back(self.cells, self.groups(), [*b, *self.group], "_size", False)
        left = [(F.col(c) - F.col("n") * F.col(f"g_{c}") / F.col("g_n")).alias(c) for c in v]
        levels = F.explode(F.array(*[self.level(k) for k in self.small])).alias("i")
        summed = near.select(*b, "n", *left, levels).groupBy(*b, "i").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in v])
        own = summed.select(*b, "i", F.col("i").alias("j"), F.col("n").cast("double").alias("s"))
        mixed = summed.select(
            *b, "i", F.inline(F.array(*[F.struct(F.lit(f"~{k:05d}").alias("j"), F.col(c).alias("s")) for k, c in enumerate(v)]))
        )
        whole = lambda d: d.withColumn("whole", F.col("s"))
        out = out.unionByName(whole(own)).unionByName(whole(mixed))
        named = self.cells.select(*b, *self.group, "n", *[self.level(k).alias(f"e{k}") for k in self.small])
        names = [f"e{k}" for k in self.small]
        for p in range(len(names)):
            for q in range(p + 1, len(names)):
                pairs = named.groupBy(*b, F.least(names[p], names[q]).alias("i"), F.greatest(names[p], names[q]).alias("j"))
                out = out.unionByName(whole(pairs.agg(F.sum("n").cast("double").alias("s"))))
        shares = taken(_pair_shares(named, b, self.group, names))
        return summed_entries(out.unionByName(shares), b)

    def solutions(self) -> DataFrame:
        """One row per fitted group: names, coefficients, kept columns and the inverse over these."""
        b, p = self.b, len(self.v) - 1
        counts = self.groups().groupBy(*b).agg(
            F.sum("g_n").alias("n"), F.count("*").alias("groups"), *[F.expr(f"sum(g_{c}) / sum(g_n)").alias(f"m_{c}") for c in self.v]
        )
        schema = T.StructType(
            [self.cells.schema[k] for k in b]
            + [T.StructField("names", T.ArrayType(T.StringType())), T.StructField("beta", T.ArrayType(T.DoubleType()))]
            + [T.StructField("kept", T.ArrayType(T.IntegerType())), T.StructField("slopes", T.ArrayType(T.ArrayType(T.DoubleType())))]
            + [T.StructField("inverse", T.ArrayType(T.DoubleType()))]
            + [T.StructField("rss", T.DoubleType()), T.StructField("tss", T.DoubleType())]
        )

        def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            names = sorted(set(frame["i"]) | set(frame["j"]))
            at = {n: k for k, n in enumerate(names)}
            m = np.zeros((len(names),) * 2)
            i, j = frame["i"].map(at).to_numpy(), frame["j"].map(at).to_numpy()
            np.add.at(m, (i, j), frame["s"].to_numpy())
            m = m + np.triu(m, 1).T
            # The first level of each effect is the one the others are compared with.
            first = [k for k in range(len(names) - p - 1) if not k or names[k].split(":")[0] != names[k - 1].split(":")[0]]
            use = [k for k in range(len(names) - 1) if k not in set(first)]
            # What the largest effect explains entirely has no variation left.
            root, kept = cholesky(m[np.ix_(use, use)])
            y = m[use, -1]
            inner = np.linalg.inv(root) if kept else root
            beta = np.zeros(len(use))
            beta[kept] = inner.T @ (inner @ y[kept])
            inverse = inner.T @ inner
            number = [k for k, u in enumerate(use) if names[u].startswith("~")]
            place = {k: r for r, k in enumerate(kept)}
            slopes = np.zeros((p, len(use)))
            for r, k in enumerate(number):
                if k in place:
                    slopes[r, kept] = inverse[place[k]]
            diagonal = np.full(len(use), np.nan)
            diagonal[kept] = np.diag(inverse)
            row = {
                "names": [names[u] for u in use], "beta": beta.tolist(), "kept": [int(k) for k in kept],
                "slopes": slopes.T.tolist(), "inverse": diagonal.tolist(),
                "rss": max(float(m[-1, -1] - beta @ y), 0.0), "tss": float(m[-1, -1]),
            }
            return pd.DataFrame([{**dict(zip(b, key)), **row}])

        solved = self.entries().groupBy(*b).applyInPandas(solve, schema)
        return materialize(solved.join(counts, b), "solutions")

    def meat(self, solutions: DataFrame) -> DataFrame:
        """(b, clusters, meat): products of the cluster sums of each numeric column's influence."""
        b, v = self.b, self.v
        p = len(v) - 1
        slot = F.posexplode(F.arrays_zip("names", "beta", "slopes")).alias("at", "e")
        per = solutions.select(*b, slot).select(*b, "e.names", "e.beta", "e.slopes")
        rows = self.rows
        numeric = [f"~{k:05d}" for k in range(p)]
        one = per.filter(F.col("names").startswith("~")).groupBy(*b).agg(
            F.sort_array(F.collect_list(F.struct("names", "beta", "slopes"))).alias("numbers"), F.count("*").alias("_size")
        )
        rows = _give_back(rows, one, b, "_size", False)
        add_w = [[f"{x} * numbers[{i}].slopes[{k}]" for i, x in enumerate(v[:p])] for k in range(p)]
        add_e = [v[p], *[f"- {x} * numbers[{i}].beta" for i, x in enumerate(v[:p])]]
        for k in self.small:
            of = per.filter(F.col("names").startswith(f"{k}:")).select(
                *b, F.col("names").alias(f"l{k}"), F.struct("beta", "slopes").alias(f"s{k}"), F.lit(1).alias("_size")
            )
            rows = rows.withColumn(f"l{k}", self.level(k))
            rows = attach_groups(rows, of, [*b, f"l{k}"], "_size", counts=lambda r=rows, k=k: r.groupBy(*b, f"l{k}").count())
            add_e.append(f"- coalesce(s{k}.beta, 0)")
            for r in range(p):
                add_w[r].append(f"coalesce(s{k}.slopes[{r}], 0)")
        assert len(numeric) == p
        w = [f"w{k}" for k in range(p)]
        scored = rows.select(*b, *self.group, *self.c, F.expr(" ".join(add_e)).alias("e"), *[F.expr(" + ".join(t)).alias(c) for t, c in zip(add_w, w)])
        cells = materialize(
            scored.groupBy(*b, *self.group, *self.c).agg(
                F.count("*").alias("n"), F.sum("e").alias("e"), *[F.sum(c).alias(c) for c in w], *[F.expr(f"sum({c} * e)").alias(f"{c}e") for c in w]
            ),
            "scores",
        )
        means = cells.groupBy(*b, *self.group).agg(
            F.count("*").alias("_size"), F.expr("sum(e) / sum(n)").alias("g_e"), *[F.expr(f"sum({c}) / sum(n)").alias(f"g_{c}") for c in w]
        )
        near = _give_back(cells, means, [*b, *self.group], "_size", False)
        sums = [F.expr(f"sum({c}e - g_e * {c} - g_{c} * e + n * g_{c} * g_e)").alias(c) for c in w]
        clusters = materialize(near.groupBy(*b, *self.c).agg(*sums), "clusters")
        products = pack_products(batch_products(clusters, b, w), b).withColumnRenamed("cross", "meat")
        return clusters.groupBy(*b).agg(F.count("*").alias("clusters")).join(products, b)


def factor_ols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    factors: Sequence[str],
    absorb: Sequence[str] | str | None = None,
    cluster: Sequence[str] | str | None = None,
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Coefficient table like that of ``linear.ols``, with factors beside the numeric columns.

    Several ``absorb`` columns together form one effect. Factor levels compare with the first one, in the
    order of their text; a term that factors, effects or earlier terms explain is
    reported as collinear. Terms of levels are not listed, see ``factor_index``. With
    ``cluster``, standard errors are clustered. Rows with a missing value are left out.
    """
    x, by = list(x), _names(by)
    cells = _Cells(df, y, x, list(factors), _names(absorb), _names(cluster), by)
    stats = cells.solutions()
    if cells.c:
        stats = stats.join(cells.meat(stats), cells.b)
    else:
        stats = stats.withColumns({"clusters": F.lit(None).cast("long"), "meat": F.lit(None).cast("array<double>")})
    b, p = cells.b, len(x)
    schema = T.StructType(
        [T.StructField(n, stats.schema[k].dataType) for k, n in zip(b, by)] + [T.StructField(n, t) for n, t in RESULT]
    )
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [{n: r[k] for k, n in zip(b, by)} | term for term in _terms(r, x, p)]
            yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in names} for row in rows], schema=to_arrow_schema(schema))

    return stats.mapInArrow(run, schema)


def _terms(r: dict, x: list[str], p: int) -> list[dict]:
    n, clusters = r["n"], r["clusters"]
    k = len(r["kept"]) + r["groups"]
    shared = {
        "n": n, "groups": r["groups"], "clusters": clusters, "df_resid": n - k,
        "r2_within": 1 - r["rss"] / r["tss"] if r["tss"] > 0 else None,
    }
    if n - k <= 0 or (clusters is not None and clusters < 2):
        return [{"term": name, "reason": "too few rows", **shared} for name in x]
    kept = {r["names"][u] for u in r["kept"]}
    at = {name: u for u, name in enumerate(r["names"])}
    meat = None if clusters is None else unpack(np.asarray(r["meat"], float), p)
    out = []
    for i, name in enumerate(x):
        label = f"~{i:05d}"
        if label not in kept:
            out.append({"term": name, "reason": "collinear", **shared})
            continue
        plain = float(np.sqrt(r["rss"] / (n - k) * r["inverse"][at[label]]))
        se, df = plain, n - k
        if meat is not None:
            factor = clusters / (clusters - 1) * (n - 1) / (n - k)
            se, df = float(np.sqrt(max(meat[i, i], 0) * factor)), clusters - 1
        out.append(_term(name, r["beta"][at[label]], se, plain, df, shared))
    return out


def factor_index(df: DataFrame, y: str, factors: Sequence[str], by: Sequence[str] | str | None = None, name: str = "index") -> DataFrame:
    """Fitted values of ``y`` on factors of any number of levels, as a column.

    A missing factor, or a level that no complete row has, gives a null index.
    """
    by, factors = _names(by), list(factors)
    cells = _Cells(df, y, [], factors, [], [], by)
    b = cells.b
    solutions = cells.solutions()
    per = solutions.select(*b, F.posexplode(F.arrays_zip("names", "beta")).alias("at", "e")).select(*b, "e.names", "e.beta")
    # The largest factor's effects are what the others leave of its group means.
    near = cells.cells
    left = F.col(cells.v[0])
    for k in cells.small:
        of = per.filter(F.col("names").startswith(f"{k}:")).select(*b, F.col("names").alias(f"l{k}"), F.col("beta").alias(f"e{k}"), F.lit(1).alias("_size"))
        near = near.withColumn(f"l{k}", cells.level(k))
        near = attach_groups(near, of, [*b, f"l{k}"], "_size", counts=lambda r=near, k=k: r.groupBy(*b, f"l{k}").count())
        left = left - F.col("n") * F.coalesce(f"e{k}", F.lit(0.0))
    centre = cells.centre[cells.v[0]]
    largest = near.groupBy(*b, *cells.group).agg(F.sum("n").alias("_size"), (F.sum(left) / F.sum("n") + centre).alias("beta"))
    rows = df
    keys = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    total = None
    for k, f in enumerate(factors):
        if k == cells.largest:
            effects = largest.select(*[F.col(c).alias(n) for c, n in zip([*b, *cells.group], [*keys, f])], F.col("beta").alias(f"_e{k}"), "_size")
        else:
            seen = cells.cells.groupBy(*b, *cells.effects[k]).agg(F.sum("n").alias("_size")).withColumn("names", cells.level(k))
            seen = seen.join(per, [*b, "names"], "left")
            effects = seen.select(
                *[F.col(c).alias(n) for c, n in zip([*b, *cells.effects[k]], [*keys, f])], F.coalesce("beta", F.lit(0.0)).alias(f"_e{k}"), "_size"
            )
        rows = attach_groups(rows, effects, [*keys, f], "_size")
        total = F.col(f"_e{k}") if total is None else total + F.col(f"_e{k}")
    return rows.withColumn(name, total).select(*df.columns, name)
