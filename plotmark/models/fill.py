"""Fitted index of factors (R12) and linear imputation.

Rows are grouped by which columns they miss; one scan sums a triangle of products per pattern. In
a pattern, every filled value is a linear function of the known ones, so each step of a chain of
predictions is fitted on these sums alone and extends the functions of the patterns that miss its
target. Rows are read once, whatever the number of targets; patterns stay a Spark table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotmark.models.factors import factor_index
from plotmark.models.moments import batch_products, pack_products
from plotmark.models.numeric import solve_ols, unpack
from plotmark.operators.skew import attach_groups
from plotmark.session import materialize

def feature_index(
    df: DataFrame, y: str, factors: Sequence[str], by: Sequence[str] | str | None = None, name: str = "index"
) -> DataFrame:
    """Fitted values of ``y`` on factors of any number of levels (R12); see ``factor_index``."""
    return factor_index(df, y, factors, by, name)


class _Patterns:
    """Sums of products of the known values, by the columns that rows miss."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns, self.k = columns, len(columns)
        value = {c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns}
        # Any centre keeps the sums exact; one near the values keeps them well conditioned.
        near = df.select(*[v.alias(f"v{i}") for i, v in enumerate(value.values())]).limit(1000)
        first = near.agg(*[F.avg(f"v{i}") for i in range(self.k)]).first()
        self.centre = np.array([m or 0.0 for m in first])
        self.missing = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in value.values()])
        self.known = [F.coalesce(v - float(m), F.lit(0.0)) for v, m in zip(value.values(), self.centre)]
        z = [f"z{i}" for i in range(self.k)]
        rows = df.select(self.missing.alias("pattern"), F.lit(1.0).alias("one"), *[x.alias(n) for x, n in zip(self.known, z)])
        self.table = materialize(pack_products(batch_products(rows, ["pattern"], ["one", *z]), ["pattern"]), "patterns")

    def total(self, of: Callable[[str, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over patterns of an array of ``size`` numbers of each."""
        k = self.k + 1

        def run(batches):
            out = np.zeros(size)
            for batch in batches:
                for pattern, cross in zip(batch.column("pattern").to_pylist(), batch.column("cross").to_pylist()):
                    out += of(pattern, unpack(np.asarray(cross, float), k)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        # One row a task.
        found = self.table.mapInArrow(run, "s array<double>").collect()
        return np.sum([r.s for r in found], axis=0) if found else np.zeros(size)

    def pairs(self) -> np.ndarray:
        """[i, j]: over rows that know both, n and the sums of i, j, ii, jj, ij; over rows that know j,
        how many miss i, and their sum of j."""
        k = self.k

        def of(pattern: str, m: np.ndarray) -> np.ndarray:
            known = np.array([c == "0" for c in pattern])
            n, s = m[0, 0], m[0, 1:]
            both = np.outer(known, known)
            shown = np.zeros((k, k, 8))
            squares = np.diag(m)[1:]
            for place, x in enumerate((n, s[:, None], s[None, :], squares[:, None], squares[None, :], m[1:, 1:])):
                shown[:, :, place] = np.where(both, x, 0)
            alone = np.outer(~known, known)
            shown[:, :, 6] = np.where(alone, n, 0)
            shown[:, :, 7] = np.where(alone, s[None, :], 0)
            return shown

        return self.total(of, k * k * 8).reshape(k, k, 8)


def _filled(pattern: str, means: np.ndarray, steps: list[tuple[int, list[int], np.ndarray]]) -> np.ndarray:
    """Each column as a linear function of one and the known values, after the steps so far."""
    k = len(means)
    out = np.zeros((k, k + 1))
    for i, c in enumerate(pattern):
        out[i, 0 if c == "1" else i + 1] = means[i] if c == "1" else 1.0
    for target, used, b in steps:
        if pattern[target] == "1":
            out[target] = b[1:] @ out[used] if used else 0.0
            out[target, 0] += b[0]
    return out


def _corr(n: float, x: float, y: float, xx: float, yy: float, xy: float) -> float:
    if not n > 0:
        return 0.0
    vx, vy = xx - x * x / n, yy - y * y / n
    # Of a constant column only rounding is left.
    if vx <= 1e-12 * abs(xx) or vy <= 1e-12 * abs(yy) or vx <= 0 or vy <= 0:
        return 0.0
    return (xy - x * y / n) / np.sqrt(vx * vy)


def _choose(
    patterns: _Patterns, targets: Sequence[str], predictors: Sequence[str], mincor: float, minpuc: float
) -> tuple[dict[str, list[str]], np.ndarray]:
    """Predictors per target with missing rows, and the means of the columns around the centre."""
    columns, sums = patterns.columns, patterns.pairs()
    at = {c: i for i, c in enumerate(columns)}
    known = sums[np.arange(len(columns)), np.arange(len(columns))]
    means = np.divide(known[:, 1], known[:, 0], out=np.zeros(len(columns)), where=known[:, 0] > 0)
    rows = float(patterns.total(lambda _, m: m[:1, 0], 1)[0])
    chosen = {}
    for t in targets:
        i = at[t]
        absent = rows - known[i, 0]
        if absent <= 0:
            continue
        chosen[t] = []
        for c in predictors:
            j = at[c]
            if c == t:
                continue
            n, si, sj, sii, sjj, sij, lone, lone_sum = sums[i, j]
            own_n, own_s, own_ss = known[j, 0], known[j, 1], known[j, 3]
            with_target = abs(_corr(n, si, sj, sii, sjj, sij))
            with_absence = abs(_corr(own_n, lone, own_s, lone, own_ss, lone_sum))
            if max(with_target, with_absence) >= mincor and lone / absent >= minpuc:
                chosen[t].append(c)
    return chosen, means


def predictor_screen(
    df: DataFrame, targets: Sequence[str], predictors: Sequence[str], mincor: float = 0.2, minpuc: float = 0.1
) -> tuple[dict[str, list[str]], dict[str, float]]:
    """Predictors worth using per target, and column means, from the sums of the patterns.

    A predictor is kept when it correlates with the target or with its being missing,
    and is known in enough of the rows where the target is missing.
    """
    patterns = _Patterns(df, list(dict.fromkeys([*targets, *predictors])))
    chosen, means = _choose(patterns, targets, predictors, mincor, minpuc)
    return chosen, dict(zip(patterns.columns, (means + patterns.centre).tolist()))


def impute_linear(
    df: DataFrame, targets: Sequence[str], predictors: Sequence[str], mincor: float = 0.2, minpuc: float = 0.1
) -> DataFrame:
    """Fill missing targets by linear prediction, one pass in the given order.

    A missing predictor starts at its mean and, once it has been a target, at its
    prediction. NaN is missing. Only sums and coefficients come to the driver.
    """
    patterns = _Patterns(df, list(dict.fromkeys([*targets, *predictors])))
    chosen, means = _choose(patterns, targets, predictors, mincor, minpuc)
    at = {c: i for i, c in enumerate(patterns.columns)}
    steps: list[tuple[int, list[int], np.ndarray]] = []
    for t, names in chosen.items():
        target, used = at[t], [at[c] for c in names]
        b = np.r_[means[target], np.zeros(len(used))]
        if used:
            take, size = [*used, target], len(used) + 2

            def moments_of(pattern: str, m: np.ndarray, take=take, size=size, done=tuple(steps)) -> np.ndarray:
                if pattern[take[-1]] == "1":
                    return np.zeros((size, size))
                rows = np.vstack([np.eye(1, len(m)), _filled(pattern, means, list(done))[take]])
                return rows @ m @ rows.T

            m = patterns.total(moments_of, size * size).reshape(size, size)
            if m[0, 0] > 0:
                mean = m[0, 1:] / m[0, 0]
                found = np.nan_to_num(solve_ols(m[1:, 1:] - np.outer(m[0, 1:], mean))[0])
                b = np.r_[mean[-1] - mean[:-1] @ found, found]
        steps.append((target, used, b))
    fills = [at[t] for t in chosen]

    def functions(batches):
        for batch in batches:
            names = batch.column("pattern").to_pylist()
            rows = [_filled(p, means, steps)[fills].tolist() for p in names]
            sizes = [int(c[0].as_py()) for c in batch.column("cross")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(rows, pa.list_(pa.list_(pa.float64()))), pa.array(sizes, pa.int64())],
                ["_pattern", "_fill", "_rows"],
            )

    known = patterns.table.mapInArrow(functions, "_pattern string, _fill array<array<double>>, _rows long")
    joined = attach_groups(df.withColumn("_pattern", patterns.missing), known, ["_pattern"], "_rows")
    new = {}
    for n, t in enumerate(chosen):
        guess = F.col("_fill")[n][0] + float(patterns.centre[at[t]])
        for i, x in enumerate(patterns.known):
            guess = guess + F.col("_fill")[n][i + 1] * x
        own = F.nullif(F.col(f"`{t}`").cast("double"), F.lit(float("nan")))
        new[t] = F.coalesce(own, guess)
    kept = [new[c].alias(c) if c in new else F.col(f"`{c}`").cast("double").alias(c) if c in targets else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept)
