"""Additive model with penalised B-splines.

Smooths are cubic B-splines on equal knots with a second-difference penalty; the
two-dimensional one is a tensor product. Everything is fitted on sums of products of the
model columns, so the data are read once however many penalties are tried. These sums
come in one of two ways. With ``bins``, each smooth's column is rounded to a grid; counts of
pairs of grid points and sums per grid point are plain aggregates, and the basis is applied
to these tables alone, so no row ever gets a basis and no Python sees a row. Without, tasks
turn batches into model columns and sum their products.

The test of a smooth takes its fitted values on the data, through the root of the block's
products, and the covariance of these; the inverse of the covariance is cut to the rank of
the effective degrees of freedom, since penalised directions would inflate it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotmark.models.linear import _names
from plotmark.models.moments import batch_products, pack_products, prepare
from plotmark.models.numeric import f_pvalue, t_pvalue, unpack
from plotmark.operators.skew import attach_groups

DEGREE = 3
GRID = np.linspace(-4, 6, 11)

FIELDS = [
    ("term", T.StringType()),
    ("kind", T.StringType()),
    ("coef", T.DoubleType()),
    ("se", T.DoubleType()),
    ("p", T.DoubleType()),
    ("edf", T.DoubleType()),
    ("penalty", T.DoubleType()),
    ("n", T.LongType()),
    ("r2", T.DoubleType()),
    ("reason", T.StringType()),
]
CURVE_FIELDS = [
    ("term", T.StringType()),
    ("x", T.DoubleType()),
    ("x2", T.DoubleType()),
    ("fit", T.DoubleType()),
    ("se", T.DoubleType()),
    ("lo", T.DoubleType()),
    ("hi", T.DoubleType()),
]
# Half the width of a band of 95 %, in standard errors.
BAND = 1.959963984540054


def spline_basis(x: np.ndarray, lo: float, hi: float, size: int) -> np.ndarray:
    """Cubic B-spline basis with ``size`` columns on equal knots over [lo, hi]."""
    pieces = size - DEGREE
    step = (hi - lo) / pieces or 1.0
    z = np.clip((x - lo) / step, 0, pieces)
    knots = np.arange(-DEGREE, pieces + DEGREE + 1, dtype=float)
    piece = np.minimum(np.floor(z), pieces - 1)
    basis = (piece[:, None] == knots[None, :-1]).astype(float)
    for d in range(1, DEGREE + 1):
        rise = (z[:, None] - knots[None, : -d - 1]) / d
        fall = (knots[None, d + 1 :] - z[:, None]) / d
        basis = rise * basis[:, :-1] + fall * basis[:, 1:]
    return basis


def _ends(work: DataFrame, b: list[str], columns: list[str]) -> DataFrame:
    ends = [e for c in columns for e in (F.min(c).alias(f"_l_{c}"), F.max(c).alias(f"_h_{c}"))]
    return work.groupBy(*b).agg(F.count("*").alias("_size"), *ends)


def _unit_range(work: DataFrame, b: list[str], columns: list[str], ends: DataFrame) -> DataFrame:
    """Columns moved to [0, 1] over each group's range; a constant column becomes 0."""
    if not columns:
        return work
    ranged = attach_groups(work, ends, b, "_size", "inner")
    moved = {
        c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_l_{c}"), F.col(f"_h_{c}") - F.col(f"_l_{c}")), F.lit(0.0))
        for c in columns
    }
    return ranged.withColumns(moved).select(*work.columns)


def _roughness(size: int) -> np.ndarray:
    d = np.diff(np.eye(size), n=2, axis=0)
    return d.T @ d


@dataclass(frozen=True)
class _Term:
    """A smooth: its name, columns, place among the model columns, size per column and penalty."""

    name: str
    columns: tuple[str, ...]
    start: int
    size: int
    rough: np.ndarray

    @property
    def width(self) -> int:
        return self.size ** len(self.columns)

    def basis(self, z: Sequence[np.ndarray]) -> np.ndarray:
        """Basis at points given by one array of [0, 1] per column."""
        parts = [spline_basis(c, 0.0, 1.0, self.size) for c in z]
        if len(parts) == 1:
            return parts[0]
        return (parts[0][:, :, None] * parts[1][:, None, :]).reshape(len(parts[0]), -1)

    def grid(self, points: int) -> list[np.ndarray]:
        """All points of an equal grid, the last column running fastest."""
        line = np.linspace(0, 1, points)
        return [c.ravel() for c in np.meshgrid(*[line] * len(self.columns), indexing="ij")]


def _terms(first: int, smooths: list[str], smooths2d: Sequence[tuple[str, str]], size: int, size2d: int) -> list[_Term]:
    out, start = [], first
    for c in smooths:
        out.append(_Term(f"s({c})", (c,), start, size, _roughness(size)))
        start += size
    eye, rough = np.eye(size2d), _roughness(size2d)
    for c, d in smooths2d:
        out.append(_Term(f"s({c},{d})", (c, d), start, size2d, np.kron(rough, eye) + np.kron(eye, rough)))
        start += size2d**2
    return out


class _Model:
    """Sums of products of the model columns, a row per fitted group."""

    def __init__(self, df, y, linear, smooths, smooths2d, by, size, size2d, bins, bins2d):
        self.by, self.linear = _names(by), list(linear)
        smooths = list(smooths)
        self.terms = _terms(1 + len(self.linear), smooths, smooths2d, size, size2d)
        self.width = 2 + len(self.linear) + sum(t.width for t in self.terms)
        shaped = list(dict.fromkeys(c for t in self.terms for c in t.columns))
        columns = [*self.linear, *shaped, y]
        work, self.b, _, _, v = prepare(df, columns, self.by, (), (), write=bins is not None)
        self.name = dict(zip(columns, v))
        self.shaped = shaped
        self.ends = _ends(work, self.b, [self.name[c] for c in shaped])
        unit = _unit_range(work, self.b, [self.name[c] for c in shaped], self.ends)
        # The response around its mean keeps its sum of squares well conditioned.
        centre = work.agg(F.avg(self.name[y]).alias("c")).scalar()
        moved = unit.withColumn(self.name[y], F.col(self.name[y]) - centre)
        if bins is None:
            self.cross = self._row_products(moved, columns, v)
        else:
            self.cross = self._bin_products(moved, y, bins, bins2d)

    def _row_products(self, moved: DataFrame, columns: list[str], v: list[str]) -> DataFrame:
        at = {c: i for i, c in enumerate(columns)}
        linear, terms = self.linear, self.terms

        def expand(x: np.ndarray) -> np.ndarray:
            parts = [np.ones((len(x), 1)), x[:, [at[c] for c in linear]]]
            parts += [t.basis([x[:, at[c]] for c in t.columns]) for t in terms]
            return np.hstack([*parts, x[:, [len(columns) - 1]]])

        return pack_products(batch_products(moved, self.b, v, expand=expand, width=self.width), self.b)

    def _bin_products(self, moved: DataFrame, y: str, bins: int, bins2d: int) -> DataFrame:
        """Products from tables of bins. A row adds one to a cell of each pair of smooths, its numbers to a
        bin of each smooth, and its products of numbers; the cells' number is bounded by the bins, not by rows."""
        b, name, terms, width = self.b, self.name, self.terms, self.width
        points = [bins if len(t.columns) == 1 else bins2d for t in terms]

        def cell(t: _Term, k: int) -> str:
            one = [f"CAST(floor({name[c]} * {k - 1} + 0.5D) AS INT)" for c in t.columns]
            return " + ".join([*[f"{c} * {k}" for c in one[:-1]], one[-1]])

        # (cell, number, first model column) of each part: the intercept, numbers, smooths, the response.
        parts = [("0", "1.0D", 0)] + [("0", name[c], 1 + i) for i, c in enumerate(self.linear)]
        parts += [(cell(t, k), "1.0D", t.start) for t, k in zip(terms, points)] + [("0", name[y], width - 1)]
        places = [start for _, _, start in parts]
        cells = [F.expr(c).alias(f"c{i}") for i, (c, _, _) in enumerate(parts)]
        numbers = [F.expr(s).alias(f"s{i}") for i, (_, s, _) in enumerate(parts)]
        pairs = [
            f"named_struct('i', {i}, 'j', {j}, 'p', c{i}, 'q', c{j}, 's', s{i} * s{j})"
            for i in range(len(parts)) for j in range(i, len(parts))
        ]
        listed = moved.select(*b, *cells, *numbers).select(*b, F.expr(f"inline(array({', '.join(pairs)}))"))
        table = listed.groupBy(*b, "i", "j", "p", "q").agg(F.sum("s").alias("s"))
        keys = [moved.schema[k] for k in b]
        shape = {1 + len(self.linear) + g: (t, k) for g, (t, k) in enumerate(zip(terms, points))}

        def bases(part: int) -> np.ndarray:
            if part not in shape:
                return np.ones((1, 1))
            term, k = shape[part]
            return term.basis(term.grid(k))

        def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            i, j = int(key[-2]), int(key[-1])
            left, right = bases(i), bases(j)
            counts = np.zeros((len(left), len(right)))
            np.add.at(counts, (frame["p"].to_numpy(), frame["q"].to_numpy()), frame["s"].to_numpy())
            return pd.DataFrame([{**dict(zip([*b, "i", "j"], key)), "s": (left.T @ counts @ right).ravel().tolist()}])

        entry = [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        blocks = table.groupBy(*b, "i", "j").applyInPandas(block, T.StructType([*keys, *entry, T.StructField("s", T.ArrayType(T.DoubleType()))]))

        def assemble(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            m = np.zeros((width, width))
            ends = [*places[1:], width]
            for i, j, s in zip(frame["i"], frame["j"], frame["s"]):
                rows, cols = slice(places[i], ends[i]), slice(places[j], ends[j])
                m[rows, cols] = np.asarray(s).reshape(ends[i] - places[i], ends[j] - places[j])
            return pd.DataFrame([{**dict(zip(b, key)), "cross": m[np.triu_indices(width)].tolist()}])

        return blocks.groupBy(*b).applyInPandas(assemble, T.StructType([*keys, T.StructField("cross", T.ArrayType(T.DoubleType()))]))

    def rows(self, table: DataFrame, fields: list, found: Callable[[dict, np.ndarray], list[dict]]) -> DataFrame:
        """Rows that ``found`` makes of each group's sums, under the names of ``by``."""
        b, by, width = self.b, self.by, self.width
        schema = T.StructType(
            [T.StructField(n, table.schema[k].dataType) for k, n in zip(b, by)] + [T.StructField(*f) for f in fields]
        )
        arrow = to_arrow_schema(schema)

        def run(batches):
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    keys = {n: r[k] for k, n in zip(b, by)}
                    rows += [keys | row for row in found(r, unpack(np.asarray(r["cross"], float), width))]
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in schema.names} for row in rows], schema=arrow)

        return table.mapInArrow(run, schema)


def additive_ols(
    df: DataFrame,
    y: str,
    linear: Sequence[str],
    smooths: Sequence[str],
    smooths2d: Sequence[tuple[str, str]] = (),
    by: Sequence[str] | str | None = None,
    size: int = 10,
    size2d: int = 5,
    bins: int | None = None,
    bins2d: int = 20,
    penalty: float | None = None,
) -> DataFrame:
    """Linear coefficients, and effective degrees of freedom and p-values of the smooths, per ``by`` group.

    The knots of a smooth span the group's own range, so a group's fit does not depend on
    the other groups. With ``bins``, columns of smooths are rounded to that many points of
    this range (``bins2d`` in each direction of a two-dimensional one). ``penalty`` fixes the
    weight of all penalties in place of cross-validation; 0 leaves them out. Rows with a missing value are left out.
    """
    model = _Model(df, y, linear, smooths, smooths2d, by, size, size2d, bins, bins2d)
    linear, terms = model.linear, model.terms
    return model.rows(model.cross, FIELDS, lambda r, m: _table(_Fit(m, terms, penalty), linear, terms))


def additive_curves(
    df: DataFrame,
    y: str,
    linear: Sequence[str],
    smooths: Sequence[str],
    smooths2d: Sequence[tuple[str, str]] = (),
    by: Sequence[str] | str | None = None,
    size: int = 10,
    size2d: int = 5,
    bins: int | None = None,
    bins2d: int = 20,
    penalty: float | None = None,
    points: int = 21,
) -> DataFrame:
    """The smooths of ``additive_ols`` at ``points`` equal steps of each column's range, with bands of 95 %.

    A curve is centred: its mean over the rows is 0. Groups with too few rows have none.
    """
    model = _Model(df, y, linear, smooths, smooths2d, by, size, size2d, bins, bins2d)
    terms, name = model.terms, model.name
    table = model.cross.join(model.ends.drop("_size"), model.b) if terms else model.cross

    def found(r: dict, m: np.ndarray) -> list[dict]:
        fit = _Fit(m, terms, penalty)
        if not fit.usable:
            return []
        out = []
        for t in terms:
            z = t.grid(points)
            low, high = ([r[f"_{e}_{name[c]}"] for c in t.columns] for e in "lh")
            at = [lo + u * (hi - lo) for u, lo, hi in zip(z, low, high)]
            value, se = fit.curve(t, t.basis(z))
            for k in range(len(value)):
                edges = {"lo": value[k] - BAND * se[k], "hi": value[k] + BAND * se[k]}
                second = float(at[1][k]) if len(at) > 1 else None
                out.append({"term": t.name, "x": float(at[0][k]), "x2": second, "fit": value[k], "se": se[k], **edges})
        return out

    return model.rows(table, CURVE_FIELDS, found)


class _Fit:
    """A penalised fit on sums of products, whose last column is the response and first the intercept."""

    def __init__(self, m: np.ndarray, terms: list[_Term], penalty: float | None):
        self.m, self.n = m, int(round(m[0, 0]))
        self.centred = m - np.outer(m[0], m[0]) / m[0, 0]
        xx, xy, self.yy = self.centred[1:-1, 1:-1], self.centred[1:-1, -1], self.centred[-1, -1]
        k = len(xx)
        self.scale = np.sqrt(np.where(np.diag(xx) > 1e-12 * max(np.max(np.diag(xx), initial=0), 1e-300), np.diag(xx), 1.0))
        self.xx, xy = xx / np.outer(self.scale, self.scale), xy / self.scale
        penalties = []
        for t in terms:
            s = self.slots(t)
            p = np.zeros((k, k))
            p[s, s] = t.rough / np.outer(self.scale[s], self.scale[s])
            penalties.append(p * np.trace(self.xx[s, s]) / max(np.trace(p[s, s]), 1e-300))
        ridge = 1e-8 * np.eye(k)

        def solve(weights: np.ndarray):
            inv = np.linalg.pinv(self.xx + ridge + sum((w * p for w, p in zip(weights, penalties)), np.zeros((k, k))))
            b = inv @ xy
            used = np.diag(inv @ self.xx)
            rss = self.yy - 2 * b @ xy + b @ self.xx @ b
            left = self.n - 1 - used.sum()
            return (self.n * rss / left**2 if left > 0 else np.inf), inv, b, used, rss, left

        if penalty is None:
            logs = np.zeros(len(terms))
            for _ in range(2):
                for i in range(len(terms)):
                    scores = [solve(10.0 ** np.where(np.arange(len(logs)) == i, g, logs))[0] for g in GRID]
                    logs[i] = GRID[int(np.argmin(scores))]
            self.weights = 10.0**logs
        else:
            self.weights = np.full(len(terms), float(penalty))
        _, self.inv, self.b, self.used, self.rss, self.left = solve(self.weights)
        # Under a fixed penalty the estimate's own covariance makes the test exact; under a chosen one
        # the wider posterior covariance allows for the choice.
        self.tested = self.inv if penalty is None else self.inv @ self.xx @ self.inv
        self.usable = self.left > 0 and self.yy > 0

    @staticmethod
    def slots(t: _Term) -> slice:
        return slice(t.start - 1, t.start - 1 + t.width)

    def smooth_p(self, t: _Term) -> float | None:
        """Wald test that the smooth is 0 at every row, on as many directions as it has effective degrees."""
        s = self.slots(t)
        d, u = np.linalg.eigh(self.xx[s, s])
        root = np.sqrt(np.maximum(d, 0.0))[:, None] * u.T
        value = root @ self.b[s]
        spread, turn = np.linalg.eigh(root @ self.tested[s, s] @ root.T)
        hat = self.inv @ self.xx
        degrees = 2 * np.trace(hat[s, s]) - np.trace((hat @ hat)[s, s])
        seen = int(np.sum(spread > 1e-9 * max(spread[-1], 1e-300)))
        rank = min(max(int(round(degrees)), 1), seen)
        if not rank or not self.rss > 0 or spread[-1] <= 1e-12:
            return None
        stat = np.sum((turn[:, -rank:].T @ value) ** 2 / spread[-rank:]) / (self.rss / self.left)
        return f_pvalue(float(stat) / rank, rank, self.left)

    def curve(self, t: _Term, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, columns = self.slots(t), slice(t.start, t.start + t.width)
        around = (basis - self.m[0, columns] / self.m[0, 0]) / self.scale[s]
        spread = np.einsum("ij,jk,ik->i", around, self.inv[s, s], around)
        return around @ self.b[s], np.sqrt(np.maximum(spread, 0) * max(self.rss, 0.0) / self.left)


def _table(fit: _Fit, linear: list[str], terms: list[_Term]) -> list[dict]:
    shared = {"n": fit.n, "r2": 1 - fit.rss / fit.yy if fit.yy > 0 else None}
    if not fit.usable:
        return [{"term": t, "kind": "linear", "reason": "too few rows", **shared} for t in linear]
    se = np.sqrt(fit.rss / fit.left * np.diag(fit.inv)[: len(linear)]) / fit.scale[: len(linear)]
    out = []
    for i, t in enumerate(linear):
        if not fit.centred[1 + i, 1 + i] > 1e-12:
            out.append({"term": t, "kind": "linear", "reason": "constant", **shared})
            continue
        coef = fit.b[i] / fit.scale[i]
        out.append({"term": t, "kind": "linear", "coef": coef, "se": se[i], "p": t_pvalue(coef / se[i], fit.left), **shared})
    for t, weight in zip(terms, fit.weights):
        edf = float(fit.used[fit.slots(t)].sum())
        out.append({"term": t.name, "kind": "smooth", "p": fit.smooth_p(t), "edf": edf, "penalty": float(weight), **shared})
    return out
