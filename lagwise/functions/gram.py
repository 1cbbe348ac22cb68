"""H4: Gram sums of wide row sets, as per-partition numpy blocks that Spark adds up.

A *job* names feature columns, a label and, if wanted, a feature map.  Every partition adds up Z'Z and the column sums of
Z = [features, label] for each job and row group in numpy; the sums travel as blocks of matrix rows and are added with
``groupBy(job, group, block)``.  Only results of model size reach the driver.  Raw columns are shifted by their mean, so
that the centred products stay well conditioned; several jobs share a pass as long as their matrices fit ``PASS_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..session import map_arrow

BLOCK_ROWS = 64  #: matrix rows of a block
PASS_BYTES = 64 << 20  #: matrices that a task may hold


@dataclass
class GramSum:
    """Count, sums and products of rows shifted by ``shift``; the label is the last column."""

    n: float
    sums: np.ndarray
    products: np.ndarray
    shift: np.ndarray

    def __add__(self, other: GramSum) -> GramSum:
        return GramSum(self.n + other.n, self.sums + other.sums, self.products + other.products, self.shift)

    def __sub__(self, other: GramSum) -> GramSum:
        return GramSum(self.n - other.n, self.sums - other.sums, self.products - other.products, self.shift)

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.sums / max(self.n, 1)

    @property
    def cross(self) -> np.ndarray:
        """Centred cross-products."""
        return self.products - np.outer(self.sums, self.sums) / max(self.n, 1)

    def errors(self, weights: np.ndarray, intercept: float) -> tuple[float, float]:
        """(R^2, RMSE) of ``intercept + weights . features`` on these rows; a constant label scores 1 when met, else 0."""
        if self.n <= 0:
            return float("nan"), float("nan")
        a = np.append(-weights, 1.0)
        off = intercept - a @ self.shift
        sse = max(float(a @ self.products @ a - 2 * off * (a @ self.sums) + self.n * off * off), 0.0)
        sst = float(self.cross[-1, -1])
        r2 = 1.0 - sse / sst if sst > 0 else float(sse == 0)
        return r2, float(np.sqrt(sse / self.n))


@dataclass
class GramJob:
    features: list[str]
    label: str
    map: Callable[[np.ndarray], np.ndarray] | None = None  #: rows of features -> rows of mapped features
    width: int | None = None  #: mapped features


def _size(job: GramJob) -> int:
    return (job.width or len(job.features)) + 1


def gram_sums(df: DataFrame, jobs: Sequence[GramJob], group: str | None = None, n_groups: int = 1) -> list[list[GramSum]]:
    """For each job a ``GramSum`` of every row group 0..``n_groups``-1 (int column ``group``; rows of other groups are left out).

    Rows in which a feature or the label of a job is null or not a number are left out of that job."""
    names = list(dict.fromkeys(c for j in jobs for c in (*j.features, j.label)))
    q = lambda c: F.col("`" + c.replace("`", "``") + "`").cast("double")
    code = F.col(group).cast("int") if group else F.lit(0)
    base = df.select(code.alias("g"), *[q(c).alias(f"c{i}") for i, c in enumerate(names)])
    means = base.agg(*[F.avg(F.when(~F.isnan(f"c{i}"), F.col(f"c{i}"))).alias(f"c{i}") for i in range(len(names))]).collect()[0]
    mean = {c: float(means[f"c{i}"] or 0.0) for i, c in enumerate(names)}
    at = {c: i for i, c in enumerate(names)}
    shifts = [np.array([*([0.0] * (_size(j) - 1) if j.map else [mean[c] for c in j.features]), mean[j.label]]) for j in jobs]
    plans = [([at[c] for c in j.features], at[j.label], j.map, shift, _size(j)) for j, shift in zip(jobs, shifts)]
    out = [[GramSum(0.0, np.zeros(_size(j)), np.zeros((_size(j), _size(j))), shift) for _ in range(n_groups)] for j, shift in zip(jobs, shifts)]
    lo = 0
    while lo < len(jobs):  # as many jobs as fit into a pass
        hi, held = lo, 0
        while hi < len(jobs) and (hi == lo or held + 8 * n_groups * _size(jobs[hi]) ** 2 <= PASS_BYTES):
            held += 8 * n_groups * _size(jobs[hi]) ** 2
            hi += 1
        _one_pass(base, {k: plans[k] for k in range(lo, hi)}, n_groups, out)
        lo = hi
    return out


def _one_pass(base: DataFrame, plans: dict, n_groups: int, out: list[list[GramSum]]) -> None:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
            for k, (features, label, mapped, shift, size) in plans.items():
                z = np.column_stack([columns[i] for i in (*features, label)])
                whole = ~np.isnan(z).any(axis=1) & (codes >= 0) & (codes < n_groups)
                z, groups = z[whole], codes[whole]
                if mapped is not None:
                    z = np.column_stack([mapped(z[:, :-1]), z[:, -1]])
                z = np.column_stack([np.ones(len(z)), z - shift])
                for g in np.unique(groups).tolist():
                    mine = z[groups == g]
                    total = sums.setdefault((k, g), np.zeros((size + 1, size + 1)))
                    total += mine.T @ mine
        rows = [(k, g, b, m[b:b + BLOCK_ROWS].ravel()) for (k, g), m in sums.items() for b in range(0, len(m), BLOCK_ROWS)]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
                                         names=["job", "grp", "block", "vals"])

    blocks = map_arrow(base, job, "job int, grp int, block int, vals array<double>")
    added = blocks.groupBy("job", "grp", "block").agg(Summarizer.metrics("sum").summary(array_to_vector("vals")).alias("s"))
    for r in added.select("job", "grp", "block", "s.sum").collect():
        total = out[r["job"]][r["grp"]]
        rows = r["sum"].toArray().reshape(-1, len(total.sums) + 1)
        for i, row in enumerate(rows, r["block"]):
            if i == 0:
                total.n, total.sums = float(row[0]), row[1:].copy()
            else:
                total.products[i - 1] = row[1:]
