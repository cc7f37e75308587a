"""Sensitivity of a coefficient to unobserved selection.

The proportional-selection bound follows E. Oster, "Unobservable selection and
coefficient stability" (2019), for a true effect of ``target``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotmark.models.linear import _names
from plotmark.models.moments import moments
from plotmark.models.numeric import independent, inverse, unpack

FIELDS = ["beta_short", "r2_short", "beta_long", "r2_long", "rmax", "delta"]


def oster_delta(
    df: DataFrame,
    y: str,
    treat: str,
    controls: Sequence[str],
    m_controls: Sequence[str] = (),
    absorb: Sequence[str] | str | None = None,
    by: Sequence[str] | str | None = None,
    rmax_mult: float = 1.3,
    rmax: float | None = None,
    target: float = 0.0,
) -> DataFrame:
    """Selection on unobservables, relative to ``controls``, that would move the effect to ``target``.

    ``m_controls`` stand in both regressions. All fits come from one set of moments.
    """
    by, controls, m_controls = _names(by), list(controls), list(m_controls)
    stats = moments(df, [treat, *m_controls, *controls, y], by, _names(absorb))
    keys = [c for c in stats.columns if c.startswith("_b")]
    k, m = len(controls) + len(m_controls) + 2, len(m_controls)
    schema = T.StructType(
        [T.StructField(n, stats.schema[c].dataType) for c, n in zip(keys, by)]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(f, T.DoubleType()) for f in FIELDS]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = _bound(unpack(np.asarray(r["cross"], float), k), m, r["n"], rmax_mult, rmax, target)
                rows.append({n: r[c] for c, n in zip(keys, by)} | {"n": r["n"]} | found)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return stats.mapInArrow(run, schema)


def _residual(cross: np.ndarray, on: list[int]) -> np.ndarray:
    """Cross-products after regressing every column on the columns ``on``."""
    on = [on[i] for i in independent(cross[np.ix_(on, on)])] if on else []
    if not on:
        return cross
    return cross - cross[:, on] @ inverse(cross[np.ix_(on, on)]) @ cross[on]


def _bound(cross: np.ndarray, m: int, n: int, mult: float, rmax: float | None, target: float) -> dict:
    k = len(cross)
    y, tss = k - 1, cross[-1, -1]
    short = _residual(cross, list(range(1, m + 1)))
    long = _residual(cross, list(range(1, k - 1)))

    def fit(c: np.ndarray) -> tuple[float, float]:
        b = c[0, y] / c[0, 0]
        return b, 1 - (c[y, y] - b * c[0, y]) / tss

    if not (short[0, 0] > 0 and long[0, 0] > 0 and tss > 0):
        return {f: None for f in FIELDS}
    (b0, r0), (b1, r1) = fit(short), fit(long)
    top = mult * r1 if rmax is None else rmax
    var_y, var_x, var_left = tss / n, short[0, 0] / n, long[0, 0] / n
    gap, move = b1 - target, b0 - b1
    explained, unexplained = (r1 - r0) * var_y, (top - r1) * var_y
    shared = 2 * gap**2 * var_left * move * var_x, gap**3 * (var_left * var_x - var_left**2)
    numerator = gap * explained * var_left + gap * var_x * var_left * move**2 + shared[0] + shared[1]
    denominator = (
        unexplained * move * var_x + gap * unexplained * (var_x - var_left) + shared[0] / 2 + shared[1]
    )
    delta = numerator / denominator if denominator else None
    return {"beta_short": b0, "r2_short": r0, "beta_long": b1, "r2_long": r1, "rmax": top, "delta": delta}
