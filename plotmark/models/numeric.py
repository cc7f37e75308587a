"""Small dense linear algebra and t probabilities, applied to matrices of sums."""

from __future__ import annotations

import math

import numpy as np

COLLINEAR = 1e-9


def unpack(upper: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle, row by row."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = upper
    return m + np.triu(m, 1).T


def independent(a: np.ndarray) -> list[int]:
    """Columns of a cross-product matrix that no earlier kept column explains."""
    d = np.diag(a)
    kept: list[int] = []
    for j in range(len(a)):
        if not d[j] > 0:
            continue
        if kept:
            s = np.sqrt(d[kept])
            inner = a[np.ix_(kept, kept)] / np.outer(s, s)
            r = a[kept, j] / (s * math.sqrt(d[j]))
            left = 1 - r @ np.linalg.lstsq(inner, r, rcond=None)[0]
        else:
            left = 1.0
        if left > COLLINEAR:
            kept.append(j)
    return kept


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix after scaling its diagonal to one."""
    s = np.sqrt(np.diag(a))
    return np.linalg.inv(a / np.outer(s, s)) / np.outer(s, s)


def solve_ols(cross: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, float, float]:
    """Coefficients from centred cross-products whose last column is the response.

    Returns coefficients (nan where dropped), kept columns, the inverse over the kept
    columns, the residual and the total sum of squares.
    """
    p = len(cross) - 1
    b = np.full(p, np.nan)
    kept = independent(cross[:p, :p])
    inv = inverse(cross[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    if kept:
        b[kept] = inv @ cross[kept, p]
    tss = float(cross[p, p])
    rss = tss - float(np.nansum(b * cross[:p, p]))
    return b, kept, inv, max(rss, 0.0), tss


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if not (df > 0) or t != t:
        return float("nan")
    return _beta_share(df / 2, 0.5, df / (df + t * t))


def f_pvalue(f: float, df1: float, df2: float) -> float:
    """Upper p-value of an F statistic."""
    if not (df1 > 0 and df2 > 0) or f != f:
        return float("nan")
    return _beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * max(f, 0.0)))
