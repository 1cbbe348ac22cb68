"""Descriptive statistics and chart data.

Exact percentiles (linear interpolation between order statistics, the rule of
``describe`` and of the anomaly thresholds) come from a distributed radix
selection.  A double becomes a signed 64-bit key of the same order; a pass
counts the values under each next 16 bits of the key, for all columns and open
order statistics at once, and at most four passes fix every bit.  One path
serves every size: the driver sees one row per order statistic and pass, and a
value repeated by a third of all rows is one bin.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.index import ROW_IDX
from ..session import map_arrow
from ..sources.io import numeric_columns

_DIGIT = 16  # bits of the key that one pass settles; a group of bins has at most 2**16 rows


def _sort_keys(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the order of the doubles (no NaN; -0.0 counts as 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _key_value(key: int) -> float:
    """The double whose key is ``key``."""
    bits = key ^ 0x7FFFFFFFFFFFFFFF if key < 0 else key
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def _bins(values: DataFrame, heads: Sequence[Sequence[int]], level: int) -> DataFrame:
    """(c, head, n, lo, hi): values of column ``c`` by the leading bits of their keys up to and with digit ``level``,
    their number and least and largest key.  ``heads``: per column, the leading bits up to the digit before to look at.
    """
    shift = 64 - _DIGIT * (level + 1)
    open_heads = [np.array(sorted(h), dtype=np.int64) for h in heads]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for c, mine in enumerate(open_heads):
                if not len(mine):
                    continue
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                keys = np.sort(_sort_keys(x[~np.isnan(x)]))
                if level:
                    above = keys >> np.int64(shift + _DIGIT)
                    keys = keys[mine[np.minimum(np.searchsorted(mine, above), len(mine) - 1)] == above]
                if not len(keys):
                    continue
                head = keys >> np.int64(shift)
                first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
                end = np.append(first[1:], len(head))
                parts.append((np.full(len(first), c, dtype=np.int32), head[first], (end - first).astype(np.int64), keys[first], keys[end - 1]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*parts)], names=["c", "head", "n", "lo", "hi"])

    return (map_arrow(values, job, "c int, head long, n long, lo long, hi long").groupBy("c", "head")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def _order_stats(df: DataFrame, wanted: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of the non-NULL, non-NaN values of several columns: {(col, rank): value}.

    A (column, rank) holds the leading key bits that are settled and its rank among the values with these bits.  A bin is
    settled at once when it holds one distinct value, or when the rank is its first or last.
    """
    cols = list(wanted)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    out: dict[tuple[str, int], float] = {}
    todo = {(i, r): (0, r) for i, c in enumerate(cols) for r in wanted[c]}  # (column, rank) -> (head, rank inside)
    for level in range(64 // _DIGIT):
        if not todo:
            break
        heads = [{head for (c, _), (head, _) in todo.items() if c == i} for i in range(len(cols))]
        above = F.shiftright("head", _DIGIT) if level else F.lit(0).cast("long")
        bins = _bins(values, heads, level).withColumn("above", above)
        upto = Window.partitionBy("c", "above").orderBy("head").rowsBetween(Window.unboundedPreceding, 0)  # 2**16 rows at most
        asked = df.sparkSession.createDataFrame([(c, r, head, k) for (c, r), (head, k) in todo.items()], "c int, r long, above long, k long")
        found = (bins.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(asked), ["c", "above"])
                 .filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
                 .select("c", "r", "head", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n", "lo", "hi").collect())
        todo = {}
        for row in found:
            if row["k"] == 0 or row["lo"] == row["hi"]:
                out[(cols[row["c"]], row["r"])] = _key_value(row["lo"])
            elif row["k"] == row["n"] - 1:
                out[(cols[row["c"]], row["r"])] = _key_value(row["hi"])
            else:
                todo[(row["c"], row["r"])] = (row["head"], row["k"])
    return out


def exact_percentiles_many(df: DataFrame, probs: Mapping[str, Sequence[float]],
                           counts: Mapping[str, int] | None = None) -> dict[str, list[float | None]]:
    """Percentiles with linear interpolation (numpy's default) of several columns, computed distributively."""
    cols = list(probs)
    if counts is None:
        xs = [F.col(f"`{c}`").cast("double") for c in cols]
        one = df.agg(*[F.count(F.when(~F.isnan(x), x)).alias(f"n{i}") for i, x in enumerate(xs)]).collect()[0]
        counts = {c: int(one[f"n{i}"]) for i, c in enumerate(cols)}
    wanted = {}
    for c in cols:
        n = counts[c]
        need = set()
        for p in probs[c]:
            h = (n - 1) * float(p)
            need |= {math.floor(h), math.ceil(h)}
        if n > 0:
            wanted[c] = sorted(need)
    vals = _order_stats(df, wanted) if wanted else {}
    res = {}
    for c in cols:
        n = counts[c]
        row = []
        for p in probs[c]:
            if n == 0:
                row.append(None)
                continue
            h = (n - 1) * float(p)
            lo, hi = math.floor(h), math.ceil(h)
            row.append(vals[(c, lo)] + (h - lo) * (vals[(c, hi)] - vals[(c, lo)]))
        res[c] = row
    return res


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float], n: int | None = None) -> list[float | None]:
    """Percentiles of one column (see ``exact_percentiles_many``)."""
    return exact_percentiles_many(df, {col: probs}, None if n is None else {col: n})[col]


def table_info(df: DataFrame) -> DataFrame:
    """(position, variable, dtype, non_null, rows) in one aggregate."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    items = [F.struct(F.lit(i).cast("int").alias("position"), F.lit(c).alias("variable"),
                      F.lit(types[c]).alias("dtype"), F.col(f"_c{i}").alias("non_null"))
             for i, c in enumerate(cols)]
    return one.select("_rows", F.explode(F.array(*items)).alias("_s")).select(
        "_s.position", "_s.variable", "_s.dtype", "_s.non_null", F.col("_rows").alias("rows"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = (ROW_IDX,)) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max per numeric column; NaN counts as missing."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=exclude)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs).collect()[0]
    counts = {c: int(one[f"n{i}"]) for i, c in enumerate(cols)}
    qs = exact_percentiles_many(df, {c: [0.25, 0.5, 0.75] for c in cols}, counts)
    rows = []
    for i, c in enumerate(cols):
        s = one[f"s{i}"]
        q = qs[c]
        rows.append((c, counts[c], one[f"m{i}"], None if s is None or (isinstance(s, float) and math.isnan(s)) else s,
                     one[f"lo{i}"], q[0], q[1], q[2], one[f"hi{i}"]))
    schema = ("variable string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return df.sparkSession.createDataFrame(rows, schema)


def zscore(df: DataFrame, col: str, out: str = "z") -> DataFrame:
    """(x - mean) / population std; NULL when the std is 0 (constant column).

    The two moments come from one aggregate and enter the plan as literals.
    """
    x = F.col(col).cast("double")
    m = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd")).collect()[0]
    if m["sd"] is None or m["sd"] == 0 or math.isnan(m["sd"]):
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (x - F.lit(m["mu"])) / F.lit(m["sd"]))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """equal-width bins over [min, max], last bin closed; every bin listed."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).collect()[0]
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    schema = "bin int, lo double, hi double, count long"
    if lo is None:
        return spark.createDataFrame([], schema)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.createDataFrame([(i, lo + i * width, lo + (i + 1) * width if i < bins - 1 else hi)
                                   for i in range(bins)], "bin int, lo double, hi double")
    return (edges.join(counts, "bin", "left")
            .select("bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density, Scott bandwidth (n^-1/5 * std, ddof 1), on ``grid`` points.

    Each row adds its kernel at every grid point: posexplode over a fixed-size
    grid, then a grouped sum with map-side combining.
    """
    x = F.col(col).cast("double")
    s = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"),
               F.max(x).alias("hi")).collect()[0]
    n, sd = s["n"], s["sd"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0 or (isinstance(sd, float) and math.isnan(sd)):
        return spark.createDataFrame([], "point int, x double, density double")
    h = sd * n ** (-1.0 / 5.0)
    lo, hi = s["lo"] - cut * h, s["hi"] + cut * h
    step = (hi - lo) / (grid - 1)
    pts = F.array(*[F.lit(lo + i * step) for i in range(grid)])
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    contrib = (df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
               .select(F.posexplode(F.transform(pts, lambda g: F.exp(-((g - F.col("_x")) ** 2) / F.lit(2 * h * h))))
                       .alias("point", "k")))
    return (contrib.groupBy("point").agg((F.sum("k") * F.lit(norm)).alias("density"))
            .select(F.col("point").cast("int").alias("point"), (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"),
                    "density"))


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """overall min and max of several columns (identity line of actual vs predicted)."""
    xs = [F.col(c).cast("double") for c in cols]
    return df.agg(F.least(*[F.min(x) for x in xs]).alias("lo"), F.greatest(*[F.max(x) for x in xs]).alias("hi"))


def trend(df: DataFrame, cols: Sequence[str] | None = None, points: int = 500, idx: str = ROW_IDX,
          n: int | None = None) -> DataFrame:
    """each numeric column over the index, cut into ``points`` index buckets: min/avg/max."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[idx])
    if n is None:
        from ..operators.index import row_count
        n = row_count(df, idx)
    width = max(1, math.ceil(n / points))
    bucket = F.floor(F.col(idx) / F.lit(width)).cast("long")
    items = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]
    long = df.select(bucket.alias("point"), F.explode(F.array(*items)).alias("_s")).select("point", "_s.*")
    return long.groupBy("variable", "point").agg(
        (F.min(F.col("point")) * F.lit(width)).alias("start_idx"),
        F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def hash_sample(df: DataFrame, fraction: float, seed: int = 42, key: str = ROW_IDX) -> DataFrame:
    """Deterministic Bernoulli sample by an arithmetic hash of the row key (same rows on every run)."""
    from .split import hash_uniform
    return df.filter(hash_uniform(key, seed, "sample") < F.lit(float(fraction)))


def scatter_sample(df: DataFrame, cols: Sequence[str], max_points: int = 5000, seed: int = 42,
                   key: str = ROW_IDX, color: str | None = None, n: int | None = None) -> DataFrame:
    """bounded hash sample of a projection for scatter plots (a sampling operator)."""
    if n is None:
        n = df.count()
    frac = 1.0 if n <= max_points else max_points / n
    keep = [key, *cols] + ([color] if color and color not in cols else [])
    return hash_sample(df.select(*keep), frac, seed, key)


def pair_plot_data(df: DataFrame, cols: Sequence[str] | None = None, max_points: int = 2000, bins: int = 20,
                   max_columns: int = 15, key: str = ROW_IDX):
    """scatter sample of all numeric columns and one histogram per column; skipped above 15 columns."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[key])
    if len(cols) > max_columns or len(cols) < 2:
        return None, None
    hists = None
    for c in cols:
        h = histogram(df, c, bins).withColumn("variable", F.lit(c))
        hists = h if hists is None else hists.unionByName(h)
    return scatter_sample(df, cols, max_points, key=key), hists


def last_row(df: DataFrame, idx: str = ROW_IDX) -> DataFrame:
    """The row with the largest index (one aggregate, no sort)."""
    cols = [c for c in df.columns if c != idx]
    rec = F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.col(idx)).alias("_r")
    return df.agg(F.max(idx).alias(idx), rec).select(idx, *[F.col(f"_r.`{c}`").alias(c) for c in cols])
