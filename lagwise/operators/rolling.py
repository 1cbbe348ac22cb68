"""Rolling statistics, sequence windows, decoder inputs, Hankel snapshots.

All frames run on the halo buckets of ``halo.over_halo``: backward frames
(rolling) copy the tail of the previous bucket, forward frames (sequences,
snapshots) the head of the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .halo import lag_sql, over_halo, q, win_sql
from .index import ROW_IDX


def _same_key_sql(keys: Sequence[str], offset: int, idx: str) -> str:
    """SQL text: the row ``offset`` positions away (negative = earlier) has the same key."""
    if not keys or offset == 0:
        return "TRUE"
    ks = "struct(" + ", ".join(q(k) for k in keys) + ")"
    fn = f"lag({ks}, {-offset})" if offset < 0 else f"lead({ks}, {offset})"
    return f"({fn} {win_sql(idx)} <=> {ks})"


def rolling_stats(df: DataFrame, col: str, window: int, keys: Sequence[str] = (), idx: str = ROW_IDX,
                  bucket_rows: int | None = None, mean_col: str = "roll_mean", std_col: str = "roll_std") -> DataFrame:
    """Mean and sample std (ddof 1) of the last ``window`` rows including the current one.

    NULL until a full window of non-NULL values exists (and, keyed, inside one key).
    """
    w = int(window)
    frame = f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW"
    full = f"count({q(col)}) {win_sql(idx, frame)} = {w} AND {_same_key_sql(keys, -(w - 1), idx)}"

    def build(fr, _w):
        keep = [q(c) for c in fr.columns if c not in ("_hb", "_hh")]
        return fr.selectExpr(*keep, "_hb", "_hh",
                             f"CASE WHEN {full} THEN avg({q(col)}) {win_sql(idx, frame)} END AS {q(mean_col)}",
                             f"CASE WHEN {full} THEN stddev_samp({q(col)}) {win_sql(idx, frame)} END AS {q(std_col)}")

    return over_halo(df, build, before=w - 1, idx=idx, bucket_rows=bucket_rows)


def sequence_windows(df: DataFrame, inputs: Sequence[str], targets: Sequence[str], n_in: int, n_out: int,
                     keys: Sequence[str] = (), idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """One row per sample i: ``x`` = inputs of rows [i, i+n_in), ``y`` = targets of rows [i+n_in, i+n_in+n_out).

    ``x`` is array<array<double>> (n_in x inputs), ``y`` (n_out x targets); only
    full samples are kept, so there are n - n_in - n_out + 1 per series.
    """
    n_in, n_out = int(n_in), int(n_out)
    xin = "array(" + ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in inputs) + ")"
    yout = "array(" + ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in targets) + ")"
    fx = f"ROWS BETWEEN CURRENT ROW AND {n_in - 1} FOLLOWING"
    fy = f"ROWS BETWEEN {n_in} FOLLOWING AND {n_in + n_out - 1} FOLLOWING"
    same = _same_key_sql(keys, n_in + n_out - 1, idx)

    def build(fr, _w):
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh",
                             f"collect_list({xin}) {win_sql(idx, fx)} AS x",
                             f"collect_list({yout}) {win_sql(idx, fy)} AS y",
                             f"{same} AS _ok")

    out = over_halo(df, build, after=n_in + n_out - 1, idx=idx, bucket_rows=bucket_rows)
    return (out.filter(f"_ok AND size(x) = {n_in} AND size(y) = {n_out}")
            .select(idx, *keys, "x", "y"))


def decoder_inputs(seq: DataFrame, y_col: str = "y", out: str = "decoder_in") -> DataFrame:
    """The target sequence shifted right by one step, first step all zeros (teacher forcing)."""
    y = F.col(y_col)
    zeros = F.array_repeat(F.lit(0.0), F.size(F.element_at(y, 1)))
    return seq.withColumn(out, F.concat(F.array(zeros), F.slice(y, 1, F.size(y) - 1)))


def hankel_snapshots(df: DataFrame, measured: Sequence[str], controls: Sequence[str], window: int,
                     keys: Sequence[str] = (), idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """Snapshot i (i in [0, n - window)): ``x`` = measured rows i..i+w-1 flattened time-major,
    ``x_next`` the same one row later, ``u`` = controls at row i+w-1."""
    w = int(window)
    arr = "array(" + ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in measured) + ")"
    ctl = "array(" + ", ".join(f"CAST({q(c)} AS DOUBLE)" for c in controls) + ")"
    fx = f"ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING"
    fn = f"ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING"
    same = _same_key_sql(keys, w, idx)

    def build(fr, _w):
        return fr.selectExpr(q(idx), *[q(k) for k in keys], "_hb", "_hh",
                             f"flatten(collect_list({arr}) {win_sql(idx, fx)}) AS x",
                             f"flatten(collect_list({arr}) {win_sql(idx, fn)}) AS x_next",
                             f"lead({ctl}, {w - 1}) {win_sql(idx)} AS u",
                             f"{same} AS _ok")

    out = over_halo(df, build, after=w, idx=idx, bucket_rows=bucket_rows)
    m = len(measured)
    return (out.filter(f"_ok AND size(x_next) = {w * m}")
            .select(idx, *keys, "x", "x_next", "u"))


def lag_value_sql(c: str, k: int, keys: Sequence[str] = (), idx: str = ROW_IDX) -> str:
    return lag_sql(c, k, keys, idx)
