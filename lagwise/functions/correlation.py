"""Correlation matrices and lag correlation (Pearson, Spearman, Kendall tau-b).

Correlations work on a long frame of valid pairs ``(group..., x, y)`` (rows
where both sides are non-NULL, so ranks are recomputed for each lag the way a
pairwise-complete correlation does it).

Spearman at lags of one series without NULLs needs no long frame: lag k drops
the last k rows of a feature and the first k of the target, so each column is
ranked once, the ranks at a lag follow by counting the few dropped values below
and equal, and the products are summed over buckets of consecutive rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.halo import lag_sql, over_halo, q
from ..operators.index import ROW_IDX
from ..session import stored
from ..sources.io import numeric_columns
from .lagmoments import over_buckets
from .rank import average_rank

METHODS = ("pearson", "spearman", "kendall")


def _clean(c):
    """NaN (zero variance) -> NULL."""
    return F.when(~F.isnan(c), c)


def safe_corr(x, y):
    """Pearson correlation that is NULL (not an error) for a zero-variance side.

    Spark's ``corr`` divides by zero on a constant column, which ANSI mode
    turns into an error; cov / sqrt(var * var) with ``try_divide`` is the same
    value and NULL there.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)  # pairwise-complete rows only
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.sqrt(F.var_pop(xs) * F.var_pop(ys)))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _features(df: DataFrame, target: str, features, keys, idx) -> list[str]:
    if features is None:
        features = [c for c in numeric_columns(df, exclude=[idx, *keys]) if c != target]
    return [c for c in features if c != target]


def lag_pairs(df: DataFrame, target: str, max_lags: int, features: Sequence[str] | None = None,
              keys: Sequence[str] = (), idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """Long valid pairs (variable, lag, x = feature shifted by lag, y = target), lags 0..max_lags-1."""
    feats = _features(df, target, features, keys, idx)
    lags = list(range(int(max_lags)))

    def build(fr, w):
        return fr.selectExpr("_hb", "_hh", f"CAST({q(target)} AS DOUBLE) AS y",
                             *[f"CAST({lag_sql(f, k, keys, idx)} AS DOUBLE) AS _x{i}_{k}"
                               for i, f in enumerate(feats) for k in lags])

    out = over_halo(df, build, before=max(lags, default=0), idx=idx, bucket_rows=bucket_rows)
    items = ", ".join(f"named_struct('variable', {_lit(f)}, 'lag', {k}, 'x', _x{i}_{k})"
                      for i, f in enumerate(feats) for k in lags)
    return (out.selectExpr("y", f"explode(array({items})) AS _p")
            .selectExpr("_p.variable", "_p.lag", "_p.x", "y")
            .filter("x IS NOT NULL AND y IS NOT NULL"))


def pearson_long(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*group).agg(_clean(safe_corr("x", "y")).alias("corr"))


def spearman_long(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pearson on average ranks, ranks taken inside each group."""
    group = list(group)
    # both sides ranked in one pass over a stacked (group, side, value) frame
    sides = (pairs.select(*group, F.lit(0).alias("_side"), F.col("x").alias("_v"))
             .unionByName(pairs.select(*group, F.lit(1).alias("_side"), F.col("y").alias("_v"))))
    ranks = average_rank(sides, "_v", [*group, "_side"], out="_r")
    rx = ranks.filter(F.col("_side") == 0).select(*group, F.col("_v").alias("x"), F.col("_r").alias("rx"))
    ry = ranks.filter(F.col("_side") == 1).select(*group, F.col("_v").alias("y"), F.col("_r").alias("ry"))
    ranked = pairs.join(rx, [*group, "x"]).join(ry, [*group, "y"])
    return ranked.groupBy(*group).agg(_clean(safe_corr("rx", "ry")).alias("corr"))


def _is_whole_series(df: DataFrame, cols: Sequence[str], idx: str) -> bool:
    """Whether the index runs from 0 without gaps and no column holds a NULL or NaN."""
    bad = F.lit(False)
    for c in cols:
        x = F.col(q(c)).cast("double")
        bad = bad | x.isNull() | F.isnan(x)
    one = df.agg(F.count(F.lit(1)).alias("n"), F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.count_if(bad).alias("bad")).collect()[0]
    return bool(one["n"]) and one["lo"] == 0 and one["hi"] == one["n"] - 1 and one["bad"] == 0


def column_ranks(df: DataFrame, cols: Sequence[str], idx: str = ROW_IDX) -> DataFrame:
    """(idx, r0, r1, ...): average rank of each column's values over all rows, ranked once per column; stored."""
    items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(q(c)).cast("double").alias("v")) for i, c in enumerate(cols)])
    long = df.select(F.col(idx).alias("i"), F.explode(items).alias("s")).select("i", "s.c", "s.v")
    ranked = long.join(average_rank(long, "v", ["c"], out="r"), ["c", "v"])
    wide = ranked.groupBy(F.col("i").alias(idx)).agg(*[F.max(F.when(F.col("c") == i, F.col("r"))).alias(f"r{i}") for i in range(len(cols))])
    return stored(wide, "column-ranks")


def spearman_lags(df: DataFrame, target: str, max_lags: int, feats: Sequence[str], idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """(variable, lag, corr) of a whole series without NULLs (see ``_is_whole_series``), NULL where a side is constant."""
    cols, lags = [*feats, target], int(max_lags)
    ranks = column_ranks(df, cols, idx)
    names = [f"r{i}" for i in range(len(cols))]
    n = int(ranks.agg(F.max(idx)).collect()[0][0]) + 1
    edge = ranks.filter((F.col(idx) < lags - 1) | (F.col(idx) > n - lags)).collect()  # 2 * max_lags rows at most
    at = {r[idx]: r for r in edge}
    # the ranks that lag k leaves out, in order: the last k of a feature, the first k of the target
    cut = {(c, k): np.sort([at[i][name] for i in (range(k) if c == len(feats) else range(n - k, n))])
           for c, name in enumerate(names) for k in range(min(lags, n))}

    def centred(rank: np.ndarray, c: int, k: int) -> np.ndarray:
        gone = cut[(c, k)]
        below = (np.searchsorted(gone, rank, "left") + np.searchsorted(gone, rank, "right")) / 2.0  # an equal value counts half
        return rank - below - (n - k + 1) / 2.0

    def job(rows: np.ndarray, x: np.ndarray, home: int) -> pd.DataFrame:
        out = []
        for k in range(min(lags, n)):
            m = min(home, len(x) - k)  # home rows with a target k rows on
            if m <= 0:
                continue
            y = centred(x[k:k + m, -1], len(feats), k)
            for c in range(len(feats)):
                v = centred(x[:m, c], c, k)
                out.append((c, k, float(v @ v), float(y @ y), float(v @ y)))
        return pd.DataFrame(out, columns=["c", "lag", "xx", "yy", "xy"])

    sums = over_buckets(ranks, names, lags, job, "c int, lag int, xx double, yy double, xy double", idx, bucket_rows)
    name = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("c") + 1)
    total = sums.groupBy("c", "lag").agg(*[F.sum(s).alias(s) for s in ("xx", "yy", "xy")])
    return total.select(name.alias("variable"), "lag", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))


def kendall_long(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    from .kendall import kendall_tau_b
    return kendall_tau_b(pairs, group)


def lag_correlation(df: DataFrame, target: str, max_lags: int = 24, method: str = "pearson",
                    features: Sequence[str] | None = None, keys: Sequence[str] = (), idx: str = ROW_IDX,
                    bucket_rows: int | None = None) -> DataFrame:
    """(variable, lag, corr) of each feature shifted by lag 0..max_lags-1 against the target."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    feats = _features(df, target, features, keys, idx)
    if method == "spearman" and not keys and feats and int(max_lags) > 0 and _is_whole_series(df, [*feats, target], idx):
        res = spearman_lags(df, target, max_lags, feats, idx, bucket_rows)
    else:
        pairs = lag_pairs(df, target, max_lags, feats, keys, idx, bucket_rows)
        fn = {"pearson": pearson_long, "spearman": spearman_long, "kendall": kendall_long}[method]
        res = fn(pairs, ["variable", "lag"])
    # (variable, lag) with no valid pair still gets a row, with NULL corr
    grid = df.sparkSession.createDataFrame([(f, k) for f in feats for k in range(int(max_lags))],
                                           "variable string, lag int")
    return grid.join(res, ["variable", "lag"], "left")


def best_lags(lag_corr: DataFrame) -> DataFrame:
    """Per variable the lag of largest |corr|, lowest lag on ties; NULL when no corr exists."""
    order = F.struct(F.col("corr").isNull(), -F.abs(F.col("corr")), F.col("lag"))
    return lag_corr.groupBy("variable").agg(
        F.min_by(F.when(F.col("corr").isNotNull(), F.col("lag")), order).alias("best_lag"),
        F.min_by(F.col("corr"), order).alias("corr"))


def best_lags_dict(lag_corr: DataFrame) -> dict[str, int | None]:
    """Best lags as a driver dict (one entry per variable: bounded by the column count)."""
    return {r["variable"]: r["best_lag"] for r in best_lags(lag_corr).collect()}


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson",
                       exclude: Sequence[str] = (ROW_IDX,)) -> DataFrame:
    """long (var1, var2, corr) over all ordered pairs, pairwise-complete rows."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=exclude)
    if method == "pearson":
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        one = df.agg(*[safe_corr(F.col(f"`{cols[i]}`").cast("double"), F.col(f"`{cols[j]}`").cast("double")).alias(f"c{i}_{j}")
                       for i, j in pairs])
        items = []
        for i, j in pairs:
            v = _clean(F.col(f"c{i}_{j}"))
            items.append(F.struct(F.lit(cols[i]).alias("var1"), F.lit(cols[j]).alias("var2"), v.alias("corr")))
            if i != j:
                items.append(F.struct(F.lit(cols[j]).alias("var1"), F.lit(cols[i]).alias("var2"), v.alias("corr")))
        return one.select(F.explode(F.array(*items)).alias("_r")).select("_r.*")
    pair_list = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    items = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                      F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
             for a, b in pair_list]
    long = (df.select(F.explode(F.array(*items)).alias("_p")).select("_p.*")
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    fn = spearman_long if method == "spearman" else kendall_long
    res = fn(long, ["var1", "var2"])
    mirror = res.filter(F.col("var1") != F.col("var2")).select(
        F.col("var2").alias("var1"), F.col("var1").alias("var2"), "corr")
    return res.unionByName(mirror)


def lag_optimised_tables(df: DataFrame, target: str, max_lags: int = 24, methods: Sequence[str] = METHODS,
                         keys: Sequence[str] = (), idx: str = ROW_IDX) -> dict[str, DataFrame]:
    """D5 per correlation method: each variable shifted by its own best lag under that method."""
    from ..operators.lag import best_lag_table
    out = {}
    for m in methods:
        best = best_lags_dict(lag_correlation(df, target, max_lags, m, keys=keys, idx=idx))
        out[m] = best_lag_table(df, target, best, keys=keys, idx=idx)
    return out


def write_lag_optimised(df: DataFrame, target: str, path: str, max_lags: int = 24,
                        methods: Sequence[str] = METHODS, keys: Sequence[str] = (), idx: str = ROW_IDX) -> list[str]:
    """A4: one CSV dataset per correlation method under ``path/<method>``, rows in index order; returns the paths written."""
    from ..sources.io import write_panel
    paths = []
    for m, table in lag_optimised_tables(df, target, max_lags, methods, keys, idx).items():
        p = f"{path.rstrip('/')}/{m}"
        write_panel(table, p, order_by=idx, leave_out=[idx])
        paths.append(p)
    return paths
