"""H4: moment / Gram aggregates.

Linear models here (OLS, PCA, PLS, DMD with control) need only means and
centred cross-products.  They come from two aggregate passes (means, then
centred products, which keeps the sums well conditioned); only the d x d
result reaches the driver, where the small dense algebra runs in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F


@dataclass
class Moments:
    cols: list[str]
    n: int
    mean: np.ndarray  # (d,)
    cross: np.ndarray  # (d, d): sum over rows of (x - mean)(x - mean)^T

    def cov(self, ddof: int = 0) -> np.ndarray:
        return self.cross / max(self.n - ddof, 1)

    def std(self, ddof: int = 0) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cross) / max(self.n - ddof, 1), 0, None))


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def moments(df: DataFrame, cols: Sequence[str], fill_null: float | None = None) -> Moments:
    """Row count, means and centred cross-products of ``cols`` (rows with a NULL are skipped
    unless ``fill_null`` replaces NULLs)."""
    cols = list(cols)
    if fill_null is None:
        base = df.select(*[F.col(_q(c)).cast("double").alias(f"_m{i}") for i, c in enumerate(cols)]).dropna()
    else:
        base = df.select(*[F.coalesce(F.col(_q(c)).cast("double"), F.lit(float(fill_null))).alias(f"_m{i}")
                           for i, c in enumerate(cols)])
    d = len(cols)
    first = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_m{i}").alias(f"a{i}") for i in range(d)]).collect()[0]
    n = int(first["n"])
    mean = np.array([first[f"a{i}"] if first[f"a{i}"] is not None else 0.0 for i in range(d)], dtype=float)
    if n == 0:
        return Moments(cols, 0, mean, np.zeros((d, d)))
    cen = [(F.col(f"_m{i}") - F.lit(float(mean[i]))) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    second = base.agg(*[F.sum(cen[i] * cen[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    cross = np.zeros((d, d))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = second[f"c{i}_{j}"]
    return Moments(cols, n, mean, cross)


def ols_from_moments(m: Moments, x_idx: Sequence[int], y_idx: int) -> tuple[float, np.ndarray]:
    """Least squares with intercept; minimum-norm solution when X is rank deficient."""
    sxx = m.cross[np.ix_(x_idx, x_idx)]
    sxy = m.cross[np.ix_(x_idx, [y_idx])][:, 0]
    beta = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    intercept = float(m.mean[y_idx] - m.mean[list(x_idx)] @ beta)
    return intercept, beta


def linear_expr(cols: Sequence[str], coef: Sequence[float], intercept: float = 0.0, fill_null: float | None = None):
    """intercept + sum(coef_i * col_i) as one column expression."""
    expr = F.lit(float(intercept))
    for c, b in zip(cols, coef):
        x = F.col(_q(c)).cast("double")
        if fill_null is not None:
            x = F.coalesce(x, F.lit(float(fill_null)))
        expr = expr + x * F.lit(float(b))
    return expr
