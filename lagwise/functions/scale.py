"""Min-max and standard scaling with their inverses; G7-G13: process features.

Scaling parameters are one aggregate (two numbers per column, collected: the
size is bounded by the column count) and enter the plan as literals.  A
constant column maps to 0 under min-max scaling and keeps scale 1 under
standard scaling, as the reference's scalers do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

ScaleParams = dict[str, tuple[float, float]]


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def min_max_params(df: DataFrame, cols: Sequence[str]) -> ScaleParams:
    one = df.agg(*[F.min(F.col(_q(c)).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(_q(c)).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (one[f"a{i}"], one[f"b{i}"]) for i, c in enumerate(cols)}


def standard_params(df: DataFrame, cols: Sequence[str]) -> ScaleParams:
    one = df.agg(*[F.avg(F.col(_q(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(_q(c)).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        s = one[f"s{i}"]
        out[c] = (one[f"m{i}"], s if s else 1.0)
    return out


def min_max_expr(c: str, lo: float | None, hi: float | None):
    x = F.col(_q(c)).cast("double")
    if lo is None or hi is None or hi == lo:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(lo)) / F.lit(hi - lo)


def min_max_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                  params: ScaleParams | None = None) -> tuple[DataFrame, ScaleParams]:
    """G1: scale ``cols`` to [0, 1] in place; parameters from ``fit_on`` (default: the whole frame)."""
    params = params or min_max_params(fit_on if fit_on is not None else df, cols)
    exprs = [min_max_expr(c, *params[c]).alias(c) if c in params else F.col(_q(c)) for c in df.columns]
    return df.select(*exprs), params


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                   params: ScaleParams | None = None) -> tuple[DataFrame, ScaleParams]:
    """(x - mean) / population std in place; a constant column keeps scale 1."""
    params = params or standard_params(fit_on if fit_on is not None else df, cols)
    exprs = [((F.col(_q(c)).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c)
             if c in params else F.col(_q(c)) for c in df.columns]
    return df.select(*exprs), params


def inverse_min_max(col, lo: float, hi: float):
    """Back to the original scale."""
    c = F.col(_q(col)) if isinstance(col, str) else col
    return c * F.lit(hi - lo) + F.lit(lo)


def inverse_standard(col, mean: float, std: float):
    """Back to the original scale of one standardised column."""
    c = F.col(_q(col)) if isinstance(col, str) else col
    return c * F.lit(std) + F.lit(mean)


def inverse_scale(df: DataFrame, cols: Sequence[str], params: Mapping[str, tuple[float, float]],
                  kind: str = "minmax") -> DataFrame:
    inv = inverse_min_max if kind == "minmax" else inverse_standard
    return df.select(*[inv(c, *params[c]).alias(c) if c in cols else F.col(_q(c)) for c in df.columns])


# The process column names and the engineered columns of the feature step.
TOP_T, TOP_P = "top Temperature", "top Pressure"
TRAY6_T, BOTTOM_T1, BOTTOM_T2 = "6th tray Temperature", "bottom Temperature 1", "bottom Temperature 2"
REFLUX, FLOW_NEXT = "reflux flow", "flow to next process"
ENGINEERED = ["PT", "dT", "dT2", "Refux Ratio", "Log_top_T", "reflux_times_Ttray6", "T_all_avg"]


def process_features(df: DataFrame, scale: bool = True) -> tuple[DataFrame, list[str]]:
    """Engineered process features, then min-max scaling of those seven columns only."""
    c = lambda n: F.col(_q(n)).cast("double")
    ratio = F.try_divide(c(REFLUX), c(FLOW_NEXT) + 1)
    out = df.select(
        "*",
        (c(TOP_P) * c(TOP_T)).alias("PT"),
        F.try_divide(c(TOP_T), c(TRAY6_T) + 1).alias("dT"),
        F.try_divide(c(TOP_T), c(BOTTOM_T1) + 1).alias("dT2"),
        ratio.alias("Refux Ratio"),
        F.log1p(F.lit(1.0) + c(TOP_T)).alias("Log_top_T"),
        (F.log1p(ratio) * c(TRAY6_T)).alias("reflux_times_Ttray6"),
        ((c(TOP_T) + c(TRAY6_T) + c(BOTTOM_T1) + c(BOTTOM_T2)) / 4).alias("T_all_avg"),
    )
    if scale:
        out, _ = min_max_scale(out, ENGINEERED)
    return out, list(ENGINEERED)
