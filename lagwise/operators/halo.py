"""H2: windows over a dense row index without a single-partition window.

Rows are cut into buckets of ``B`` consecutive indices.  A row within
``before`` positions of the end of its bucket is copied into the next bucket
(history for backward frames: lag, rolling), a row within ``after`` positions
of the start is copied into the previous bucket (future for forward frames:
sequences, Hankel snapshots).  ``B >= max(before, after)`` keeps it to one
neighbour.  The window is ``partitionBy(bucket).orderBy(row_idx)``; only the
home copies are kept afterwards, so results equal one global window while
every task holds at most ``B + before + after`` rows.

Keyed series are contiguous in the index (see ``with_row_index``); a frame
value is kept only when the key ``k`` rows away equals the current key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .index import ROW_IDX, keep_rows, row_count

_BUCKET = "_hb"
_HOME = "_hh"
MIN_BUCKET_ROWS = 4096
MAX_BUCKET_ROWS = 1 << 20


def bucket_rows_for(df: DataFrame, span: int, idx: str = ROW_IDX) -> int:
    """Bucket size: enough buckets for every core, bounded task size."""
    n = row_count(df, idx)
    par = max(1, df.sparkSession.sparkContext.defaultParallelism)
    b = -(-n // (4 * par)) if n else MIN_BUCKET_ROWS
    b = max(MIN_BUCKET_ROWS, min(MAX_BUCKET_ROWS, b))
    return max(b, 4 * span, 1)


def over_halo(df: DataFrame, build: Callable[[DataFrame, "Window"], DataFrame], before: int = 0,
              after: int = 0, idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """Apply ``build(framed_df, window)`` on halo buckets; return home rows only.

    ``build`` adds window columns with ``.over(window)``; it must keep all rows.
    """
    before, after = int(before), int(after)
    span = max(before, after, 1)
    B = int(bucket_rows) if bucket_rows else bucket_rows_for(df, span, idx)
    if B < span:
        raise ValueError(f"bucket_rows {B} smaller than the frame span {span}")
    b = F.floor(F.col(idx) / F.lit(B)).cast("long")
    pos = F.col(idx) - b * F.lit(B)
    targets = F.array_compact(F.array(
        b,
        F.when(pos >= F.lit(B - before), b + 1) if before > 0 else F.lit(None).cast("long"),
        F.when((pos < F.lit(after)) & (b > 0), b - 1) if after > 0 else F.lit(None).cast("long"),
    ))
    framed = df.withColumn(_HOME, b).withColumn(_BUCKET, F.explode(targets))
    w = Window.partitionBy(_BUCKET).orderBy(idx)
    out = build(framed, w)
    out = out.filter(F.col(_BUCKET) == F.col(_HOME)).drop(_BUCKET, _HOME)
    return keep_rows(df, out)


def q(name: str) -> str:
    """Back-quote a column name for SQL text (names may hold spaces)."""
    return "`" + name.replace("`", "``") + "`"


def win_sql(idx: str = ROW_IDX, frame: str = "") -> str:
    """The halo window as SQL text; building expressions as text keeps wide selects to one call."""
    return f"OVER (PARTITION BY {_BUCKET} ORDER BY {q(idx)}{(' ' + frame) if frame else ''})"


def lag_sql(c: str, k: int, keys: Sequence[str] = (), idx: str = ROW_IDX) -> str:
    """SQL text of ``lag_col``: value ``k`` rows earlier (negative k: later), NULL across a key change."""
    if k == 0:
        return q(c)
    fn = f"lag({q(c)}, {k})" if k > 0 else f"lead({q(c)}, {-k})"
    v = f"{fn} {win_sql(idx)}"
    if not keys:
        return v
    ks = "struct(" + ", ".join(q(x) for x in keys) + ")"
    other = (f"lag({ks}, {k})" if k > 0 else f"lead({ks}, {-k})") + " " + win_sql(idx)
    return f"CASE WHEN {other} <=> {ks} THEN {v} END"


def key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def same_key(keys: Sequence[str], offset: int, w) -> Column | None:
    """True when the row ``offset`` positions away (negative = earlier) has the same key."""
    if not keys or offset == 0:
        return None
    ks = key_struct(keys)
    other = F.lag(ks, -offset).over(w) if offset < 0 else F.lead(ks, offset).over(w)
    return other.eqNullSafe(ks)


def lag_col(c: str | Column, k: int, w, keys: Sequence[str] = ()) -> Column:
    """Value ``k`` rows earlier in the series (NULL before the start, or across a key change)."""
    col = F.col(c) if isinstance(c, str) else c
    if k == 0:
        return col
    v = F.lag(col, k).over(w) if k > 0 else F.lead(col, -k).over(w)
    guard = same_key(keys, -k, w)
    return v if guard is None else F.when(guard, v)
