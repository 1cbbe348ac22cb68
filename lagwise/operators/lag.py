"""Supervised lag tables over an indexed frame.

Every function takes a frame carrying the dense ``row_idx`` of
``with_row_index`` and returns ``row_idx`` plus the lag columns; all lags of
one call are computed in one halo-window pass.  ``keys`` names the series key
columns when the index was built with ``partition_by``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .halo import lag_sql, over_halo, q
from .index import ROW_IDX


def _value_cols(df: DataFrame, drop: Sequence[str], keys: Sequence[str], idx: str) -> list[str]:
    skip = set(drop) | set(keys) | {idx}
    return [c for c in df.columns if c not in skip]


def _finish(df: DataFrame, cols: list[str], idx: str, keys: Sequence[str] = (), dropna: bool = True) -> DataFrame:
    """Index, series keys, then the lag columns; rows with a NULL lag column dropped."""
    out = df.selectExpr(q(idx), *[q(k) for k in keys], *[q(c) for c in cols])
    return out.dropna(how="any", subset=cols) if dropna else out


def lag_table(df: DataFrame, lag: int, target: str, drop: Sequence[str] = (), target_lags: int = 0,
              mode: str = "app", keys: Sequence[str] = (), idx: str = ROW_IDX,
              bucket_rows: int | None = None) -> DataFrame:
    """D1 (``mode='app'``) / D2 (``mode='notebook'``).

    app: every non-dropped column shifted by ``lag`` and named ``{c}_lag{lag}``
    (also for lag 0), the shifted target removed, the current target kept, then
    ``{target}_lag1..n`` for ``target_lags = n``; rows with any NULL dropped.
    notebook: lag 0 returns the frame unchanged; otherwise as app without
    autoregressive columns, and a drop column that does not exist is an error.
    """
    lag = int(lag)
    if mode == "notebook":
        missing = [c for c in drop if c not in df.columns]
        if missing:
            raise KeyError(f"columns to drop not found: {missing}")
        if lag == 0:
            return df
        target_lags = 0
    elif mode != "app":
        raise ValueError("mode is 'app' or 'notebook'")
    cols = _value_cols(df, drop, keys, idx)
    preds = [c for c in cols if c != target]
    span = max(lag, int(target_lags))

    def build(fr, w):
        exprs = [f"{lag_sql(c, lag, keys, idx)} AS {q(c + '_lag' + str(lag))}" for c in preds]
        exprs.append(q(target))
        exprs += [f"{lag_sql(target, i, keys, idx)} AS {q(target + '_lag' + str(i))}"
                  for i in range(1, int(target_lags) + 1)]
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh", *exprs)

    out = over_halo(df, build, before=span, idx=idx, bucket_rows=bucket_rows)
    names = [f"{c}_lag{lag}" for c in preds] + [target] + [f"{target}_lag{i}" for i in range(1, int(target_lags) + 1)]
    # with target_lags >= lag the autoregressive column may repeat a name; keep the first
    seen, uniq = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            uniq.append(n)
    return _finish(out, uniq, idx, keys)


def multi_lag_table(df: DataFrame, predictors: Sequence[str], targets: Sequence[str], input_lags: int = 0,
                    target_lags: int = 0, keys: Sequence[str] = (), idx: str = ROW_IDX,
                    bucket_rows: int | None = None) -> DataFrame:
    """D3: targets, predictors, predictor lags 1..input_lags, target lags 1..target_lags; NULL rows dropped."""
    predictors, targets = list(predictors), list(targets)
    span = max(int(input_lags), int(target_lags), 0)

    def build(fr, w):
        exprs = [q(t) for t in targets] + [q(p) for p in predictors]
        for i in range(1, int(input_lags) + 1):
            exprs += [f"{lag_sql(p, i, keys, idx)} AS {q(p + '_lag' + str(i))}" for p in predictors]
        for i in range(1, int(target_lags) + 1):
            exprs += [f"{lag_sql(t, i, keys, idx)} AS {q(t + '_lag' + str(i))}" for t in targets]
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh", *exprs)

    out = over_halo(df, build, before=span, idx=idx, bucket_rows=bucket_rows)
    names = (targets + predictors
             + [f"{p}_lag{i}" for i in range(1, int(input_lags) + 1) for p in predictors]
             + [f"{t}_lag{i}" for i in range(1, int(target_lags) + 1) for t in targets])
    return _finish(out, names, idx, keys)


def lag_table_multi_target(df: DataFrame, lag: int, predictors: Sequence[str], targets: Sequence[str],
                           keys: Sequence[str] = (), idx: str = ROW_IDX,
                           bucket_rows: int | None = None) -> DataFrame:
    """Lag 0 -> projection (no NULL drop); else predictors shifted by ``lag`` plus current targets."""
    predictors, targets = list(predictors), list(targets)
    if int(lag) == 0:
        return df.selectExpr(q(idx), *[q(k) for k in keys], *[q(c) for c in predictors + targets])

    def build(fr, w):
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh",
                             *[f"{lag_sql(p, lag, keys, idx)} AS {q(p + '_lag' + str(lag))}" for p in predictors],
                             *[q(t) for t in targets])

    out = over_halo(df, build, before=int(lag), idx=idx, bucket_rows=bucket_rows)
    return _finish(out, [f"{p}_lag{lag}" for p in predictors] + targets, idx, keys)


def best_lag_table(df: DataFrame, target: str, best_lags: Mapping[str, int | None], keys: Sequence[str] = (),
                   idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """Target first, then each variable shifted by its own lag as ``{var}_lag{k}``.

    A variable whose best lag is NULL (constant or all-NULL column) is left out.
    """
    chosen = [(v, int(k)) for v, k in best_lags.items() if k is not None and v != target]
    span = max([k for _, k in chosen], default=0)

    def build(fr, w):
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh", q(target),
                             *[f"{lag_sql(v, k, keys, idx)} AS {q(v + '_lag' + str(k))}" for v, k in chosen])

    out = over_halo(df, build, before=span, idx=idx, bucket_rows=bucket_rows)
    return _finish(out, [target] + [f"{v}_lag{k}" for v, k in chosen], idx, keys)


def single_lag_tables(df: DataFrame, target: str, lags: Sequence[int], predictors: Sequence[str] | None = None,
                      keys: Sequence[str] = (), idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """For each chosen lag, target plus all predictors shifted by that lag, NULL rows dropped.

    Long form with a ``lag`` column (predictor columns keep their names) so all
    lags come from one window pass and can be written partitioned by ``lag``.
    """
    lags = sorted({int(k) for k in lags})
    if predictors is None:
        predictors = [c for c in _value_cols(df, (), keys, idx) if c != target]
    predictors = list(predictors)

    def build(fr, w):
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh", q(target),
                             *[f"{lag_sql(p, k, keys, idx)} AS _l{k}_{j}" for k in lags for j, p in enumerate(predictors)])

    out = over_halo(df, build, before=max(lags, default=0), idx=idx, bucket_rows=bucket_rows)
    per_lag = ", ".join("named_struct('lag', " + str(k) + ", "
                        + ", ".join(f"'_v{j}', _l{k}_{j}" for j in range(len(predictors))) + ")" for k in lags)
    out = (out.selectExpr(q(idx), *[q(k) for k in keys], q(target), f"explode(array({per_lag})) AS _s")
           .selectExpr("_s.lag", q(idx), *[q(k) for k in keys], q(target),
                       *[f"_s._v{j} AS {q(p)}" for j, p in enumerate(predictors)]))
    return out.dropna(how="any", subset=[target] + predictors)
