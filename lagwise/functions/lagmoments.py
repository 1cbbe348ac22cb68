"""Gram matrix of sliding windows over an indexed series, from lagged cross-moments.

The Gram matrix of all windows of ``width`` rows is block-Toeplitz up to its edges: moving both offsets by one row changes a
sum only by the products that leave at the first window and enter behind the last.  So only the products of a row with
the ``width`` rows from it on are summed over the data (on halo buckets, in numpy), and the rest follows from the
``2 * width`` edge rows.  No window is ever stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..operators.halo import bucket_rows_for, q
from ..operators.index import ROW_IDX
from ..session import ship_package


def over_buckets(df: DataFrame, cols: Sequence[str], after: int, job: Callable[[np.ndarray, np.ndarray, int], pd.DataFrame], schema: str, idx: str = ROW_IDX, bucket_rows: int | None = None) -> DataFrame:
    """``job(rows, values, home)`` per bucket of consecutive rows: the row numbers and values (one column per name) of the bucket's
    ``home`` rows and of up to ``after`` rows that follow them."""
    ship_package(df.sparkSession)
    size = max(int(bucket_rows) if bucket_rows else bucket_rows_for(df, after, idx), after, 1)
    bucket = F.floor(F.col(idx) / F.lit(size)).cast("long")
    before = F.when((F.col(idx) - bucket * F.lit(size) < F.lit(after)) & (bucket > 0), bucket - 1)
    framed = df.select(F.col(idx).cast("long").alias("_i"), *[F.col(q(c)).cast("double").alias(f"_v{k}") for k, c in enumerate(cols)],
                       F.explode(F.array_compact(F.array(bucket, before))).alias("_b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        rows = pdf["_i"].to_numpy()
        home = int(np.searchsorted(rows, (int(pdf["_b"].iloc[0]) + 1) * size))
        return job(rows, np.column_stack([pdf[f"_v{k}"].to_numpy(dtype=float) for k in range(len(cols))]), home)

    return framed.groupBy("_b").applyInPandas(run, schema)


def window_gram(df: DataFrame, cols: Sequence[str], width: int, start: int, stop: int, idx: str = ROW_IDX, bucket_rows: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(Gram, sums, windows) of the windows that begin at rows ``start`` <= t < ``stop``; place ``i * len(cols) + a`` stands for
    column ``a`` at row ``t + i``, i < ``width``.  Rows up to ``stop + width - 2`` must exist and hold no null."""
    c, width, start, stop = len(cols), int(width), int(start), int(stop)

    def job(rows: np.ndarray, x: np.ndarray, home: int) -> pd.DataFrame:
        lo, hi = np.searchsorted(rows[:home], [start, stop])
        x, m = x[lo:], hi - lo
        if m <= 0:
            return pd.DataFrame({"vals": [np.zeros(width * c * c + c + 1)]})
        bad = np.isnan(x[:m + width - 1]).sum() + max(m + width - 1 - len(x), 0)
        x = np.vstack([np.nan_to_num(x), np.zeros((width, c))])
        parts = [(x[:m].T @ x[k:k + m]).ravel() for k in range(width)]
        return pd.DataFrame({"vals": [np.concatenate([*parts, x[:m].sum(axis=0), [bad]])]})

    sums = over_buckets(df.filter((F.col(idx) >= start) & (F.col(idx) < stop + width - 1)), cols, width, job, "vals array<double>", idx, bucket_rows or bucket_rows_for(df, width, idx))
    found = sums.select(array_to_vector("vals").alias("v")).agg(Summarizer.metrics("sum").summary(F.col("v")).alias("s")).collect()[0]["s"]
    total = found["sum"].toArray() if found is not None and stop > start else np.zeros(width * c * c + c + 1)
    if total[-1]:
        raise ValueError("the windows reach rows that are missing or hold nulls")
    lagged, first = total[:width * c * c].reshape(width, c, c), total[width * c * c:-1]
    r = F.col(idx)
    edge = df.filter(((r >= start) & (r < start + width)) | ((r >= stop) & (r < stop + width))).select(idx, *[F.col(q(x)).cast("double") for x in cols]).collect()
    at = {row[0]: np.array(row[1:], dtype=float) for row in edge}  # at most 2 * width rows
    leave = np.array([at.get(start + i, np.zeros(c)) for i in range(width - 1)]).reshape(width - 1, c)
    enter = np.array([at.get(stop + i, np.zeros(c)) for i in range(width - 1)]).reshape(width - 1, c)
    gram = np.zeros((width, c, width, c))
    gram[0] = lagged.transpose(1, 0, 2)
    gram[:, :, 0, :] = lagged.transpose(0, 2, 1)
    means = np.zeros((width, c))
    means[0] = first
    for i in range(width - 1):
        moved = np.einsum("a,jb->ajb", enter[i], enter) - np.einsum("a,jb->ajb", leave[i], leave)
        gram[i + 1, :, 1:, :] = gram[i, :, :-1, :] + moved
        means[i + 1] = means[i] + enter[i] - leave[i]
    out = gram.reshape(width * c, width * c)
    return out, means.ravel(), max(stop - start, 0)

