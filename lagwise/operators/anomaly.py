"""H-1..H-11: an ensemble of seven anomaly detectors with voting and a cleaned output.

Every detector reads the lag table of ``lag_table(df, lag, target)`` (numeric
columns only) and returns ``(row_idx, <Flag>)`` with a 0/1 integer flag.

* z-score and rolling statistics are column / window expressions;
* PCA reconstruction, PLS and OLS residuals come from one moment aggregate
  (d x d on the driver) and score rows with JVM expressions;
* isolation forest: a hash sample of ``max_samples`` rows per tree, trees
  grown per group with ``applyInPandas``, then every row scored in Arrow
  batches against the broadcast trees;
* local outlier factor: exact k nearest neighbours without all pairs -- rows
  are cut into slabs along one coordinate, each slab finds its local
  neighbours, and a row visits another slab only when that slab lies within
  its current k-distance bound; LOF then follows by joins and aggregates.

Thresholds are exact percentiles computed distributively.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.linalg import linear_expr, moments
from ..functions.stats import exact_percentiles
from ..session import durable, ship_package
from .index import ROW_IDX, row_count, with_row_index
from .lag import lag_table
from .rolling import rolling_stats

# Detector keys, their flag column names and the default parameters.
METHOD_FLAGS = {
    "zscore": "Zscore",
    "rolling": "RollingStats",
    "iso_forest": "IsolationForest",
    "lof": "LOF",
    "pca": "PCA_Recon",
    "pls": "PLS_Residual",
    "lin_reg": "LinReg_Residual",
}
DEFAULT_PARAMS = {
    "z_threshold": 3.0,
    "rolling_window": 20,
    "iso_contamination": 0.01,
    "lof_neighbors": 20,
    "lof_contamination": 0.01,
    "pca_components": 0.95,
    "recon_error_percentile": 99,
}

BLOCK = 1 << 18  # coordinate differences (2 MB) that the local outlier factor computes at once


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _flag(cond, name: str):
    return F.coalesce(cond, F.lit(False)).cast("int").alias(name)


def _numeric(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ex]


# ---------------------------------------------------------------- H-1, H-2

def zscore_flag(lt: DataFrame, target: str, threshold: float = 3.0):
    """H-1 as a column: |z| > threshold on the target (population std); a constant target flags nothing."""
    y = F.coalesce(F.col(_q(target)).cast("double"), F.lit(0.0))
    m = lt.agg(F.avg(y).alias("mu"), F.stddev_pop(y).alias("sd")).collect()[0]
    if not m["sd"]:
        return F.lit(0).alias("Zscore")
    z = (y - F.lit(m["mu"])) / F.lit(m["sd"])
    return _flag(F.abs(z) > F.lit(float(threshold)), "Zscore")


def detect_zscore(lt: DataFrame, target: str, threshold: float = 3.0, idx: str = ROW_IDX) -> DataFrame:
    """H-1: (row_idx, Zscore)."""
    return lt.select(idx, zscore_flag(lt, target, threshold))


def detect_rolling(lt: DataFrame, target: str, window: int = 20, threshold: float = 3.0,
                   idx: str = ROW_IDX, keys: Sequence[str] = ()) -> DataFrame:
    """H-2: target outside mean +- threshold * std of its rolling window (incomplete window -> 0).

    The window runs over the rows of the lag table in order, so the table is
    re-indexed densely first (rows dropped for NULLs leave no gaps).
    """
    y = F.coalesce(F.col(_q(target)).cast("double"), F.lit(0.0))
    base = with_row_index(lt.select(idx, *keys, y.alias("_y")), idx, name="_pos")
    r = rolling_stats(base, "_y", int(window), keys=keys, idx="_pos")
    t = F.lit(float(threshold))
    cond = (F.col("_y") > F.col("roll_mean") + t * F.col("roll_std")) | \
           (F.col("_y") < F.col("roll_mean") - t * F.col("roll_std"))
    return r.select(idx, _flag(cond, "RollingStats"))


# ---------------------------------------------------------------- H-5, H-6, H-7

def _threshold(scored: DataFrame, col: str, pct: float) -> float | None:
    return exact_percentiles(scored, col, [float(pct) / 100.0])[0]


def _scaled_sql(cols: Sequence[str], mean: np.ndarray, std: np.ndarray) -> list[str]:
    return [f"((coalesce(CAST({_q(c)} AS DOUBLE), 0D) - ({float(mean[i])!r}D)) / ({float(std[i])!r}D))"
            for i, c in enumerate(cols)]


def pca_model(lt: DataFrame, cols: Sequence[str], n_components: float | int = 0.95):
    """Standardise (ddof 0, constant column scale 1) and keep components by count or variance fraction."""
    m = moments(lt, cols, fill_null=0.0)
    std = m.std(ddof=0)
    std[std == 0] = 1.0
    corr = m.cov(ddof=0) / np.outer(std, std)
    evals, evecs = np.linalg.eigh(corr)
    order = np.argsort(evals)[::-1]
    evals, evecs = np.clip(evals[order], 0, None), evecs[:, order]
    if isinstance(n_components, float) and 0 < n_components < 1:
        ratio = np.cumsum(evals) / evals.sum() if evals.sum() > 0 else np.ones_like(evals)
        k = int(np.searchsorted(ratio, n_components, side="right") + 1)
    else:
        k = int(n_components)
    k = max(1, min(k, len(cols)))
    return m.mean, std, evecs[:, :k], evals


def pca_error_sql(lt: DataFrame, cols: Sequence[str], n_components: float | int = 0.95) -> str:
    """SQL text of the mean squared reconstruction error of a standardised row (repeated parts are
    shared by Spark's subexpression elimination)."""
    mean, std, v, _ = pca_model(lt, cols, n_components)
    xs = _scaled_sql(cols, mean, std)
    k = v.shape[1]
    z = ["(" + " + ".join(f"({xs[i]}) * ({float(v[i, j])!r}D)" for i in range(len(cols))) + ")" for j in range(k)]
    rec = [" + ".join(f"{z[j]} * ({float(v[i, j])!r}D)" for j in range(k)) for i in range(len(cols))]
    err = " + ".join(f"pow({xs[i]} - ({rec[i]}), 2)" for i in range(len(cols)))
    return f"(({err}) / {len(cols)}D)"


def pca_reconstruction_error(lt: DataFrame, cols: Sequence[str], n_components: float | int = 0.95,
                             idx: str = ROW_IDX, out: str = "recon_error") -> DataFrame:
    return lt.selectExpr(_q(idx), f"{pca_error_sql(lt, cols, n_components)} AS {_q(out)}")


def _thresholded(lt: DataFrame, expr, pct: float, name: str):
    """Flag column ``expr > percentile(expr)`` (the percentile over the rows of ``lt``)."""
    thr = _threshold(lt.select(expr.alias("_e")), "_e", pct)
    return _flag(expr > F.lit(thr), name)


def pca_flag(lt: DataFrame, cols: Sequence[str], n_components: float | int = 0.95, percentile: float = 99):
    return _thresholded(lt, F.expr(pca_error_sql(lt, cols, n_components)), percentile, "PCA_Recon")


def detect_pca(lt: DataFrame, cols: Sequence[str], n_components: float | int = 0.95, percentile: float = 99,
               idx: str = ROW_IDX) -> DataFrame:
    """H-5: mean squared reconstruction error of standardised rows above the percentile."""
    return lt.select(idx, pca_flag(lt, cols, n_components, percentile))


def pls1_coefficients(lt: DataFrame, xcols: Sequence[str], target: str, n_components: int | None = None):
    """PLS1 (X and y standardised with ddof 1) from X'X and X'y only; returns (intercept, coef) on raw scale."""
    xcols = list(xcols)
    m = moments(lt, xcols + [target], fill_null=0.0)
    d = len(xcols)
    sd = m.std(ddof=1)
    sd[sd == 0] = 1.0
    sx, sy = sd[:d], sd[d]
    S = m.cross[:d, :d] / np.outer(sx, sx)
    s = m.cross[:d, d] / (sx * sy)
    a_max = min(5, d) if n_components is None else int(n_components)
    R, P, Qs = [], [], []
    for _ in range(a_max):
        norm = np.linalg.norm(s)
        if norm == 0:
            break
        w = s / norm
        r = w.copy()
        for rj, pj in zip(R, P):
            r = r - (pj @ w) * rj
        tt = float(r @ S @ r)
        if tt <= 0:
            break
        p = S @ r / tt
        qa = float(s @ r) / tt
        s = s - p * qa * tt
        R.append(r)
        P.append(p)
        Qs.append(qa)
    b_std = np.sum([r * qa for r, qa in zip(R, Qs)], axis=0) if R else np.zeros(d)
    coef = b_std * sy / sx
    intercept = float(m.mean[d] - m.mean[:d] @ coef)
    return intercept, coef


def _residual(lt: DataFrame, xcols, target, b0, b):
    return F.abs(F.coalesce(F.col(_q(target)).cast("double"), F.lit(0.0)) - linear_expr(xcols, b, b0, fill_null=0.0))


def pls_flag(lt: DataFrame, xcols: Sequence[str], target: str, percentile: float = 99):
    b0, b = pls1_coefficients(lt, xcols, target)
    return _thresholded(lt, _residual(lt, xcols, target, b0, b), percentile, "PLS_Residual")


def detect_pls(lt: DataFrame, xcols: Sequence[str], target: str, percentile: float = 99,
               idx: str = ROW_IDX) -> DataFrame:
    """H-6: |y - PLS1 prediction| above the percentile, min(5, d) components."""
    return lt.select(idx, pls_flag(lt, xcols, target, percentile))


def ols_coefficients(lt: DataFrame, xcols: Sequence[str], target: str):
    from ..functions.linalg import ols_from_moments
    m = moments(lt, list(xcols) + [target], fill_null=0.0)
    d = len(xcols)
    return ols_from_moments(m, list(range(d)), d)


def linreg_flag(lt: DataFrame, xcols: Sequence[str], target: str, percentile: float = 99):
    b0, b = ols_coefficients(lt, xcols, target)
    return _thresholded(lt, _residual(lt, xcols, target, b0, b), percentile, "LinReg_Residual")


def detect_linreg(lt: DataFrame, xcols: Sequence[str], target: str, percentile: float = 99,
                  idx: str = ROW_IDX) -> DataFrame:
    """H-7: |y - OLS prediction| above the percentile."""
    return lt.select(idx, linreg_flag(lt, xcols, target, percentile))


# ---------------------------------------------------------------- H-3 isolation forest

def _avg_path(n):
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(rows, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
        if depth >= max_depth or len(rows) <= 1:
            return i
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[i], thr[i] = f, t
        left[i] = node(rows[mask], depth + 1)
        right[i] = node(rows[~mask], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size)


def isolation_forest_scores(lt: DataFrame, cols: Sequence[str], n_trees: int = 100, max_samples: int = 256,
                            seed: int = 42, idx: str = ROW_IDX, out: str = "iso_score") -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(psi)) of every row (higher = more anomalous)."""
    cols = list(cols)
    ship_package(lt.sparkSession)
    n = lt.count()
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    p = min(1.0, 3.0 * psi / max(n, 1))
    pre = min(1.0, p * n_trees)
    vec = F.array(*[F.coalesce(F.col(_q(c)).cast("double"), F.lit(0.0)) for c in cols])

    def unit(*cols_):
        return F.pmod(F.xxhash64(*cols_), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))

    # a row joins tree t with probability p: one hash pre-selects rows with probability min(1, p * trees),
    # a second hash per tree keeps them with probability p / pre; per tree the psi smallest hashes are kept
    cand = (lt.filter(unit(F.col(idx), F.lit(seed), F.lit(-1)) < F.lit(pre))
            .select(idx, vec.alias("v"))
            .select(idx, "v", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
            .withColumn("_u", unit(F.col(idx), F.col("tree"), F.lit(seed)))
            .filter(F.col("_u") < F.lit(p / pre)))
    d = len(cols)
    schema = "tree int, node int, feat int, thr double, left int, right int, size long"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", idx]).head(psi)
        t = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, d))
        fe, th, le, ri, si = _grow_tree(x, np.random.default_rng(seed * 1000003 + t), max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(fe)), "feat": fe, "thr": th,
                             "left": le, "right": ri, "size": si})

    nodes = cand.groupBy("tree").applyInPandas(build, schema).toPandas()  # <= trees x 2^(depth+1) rows
    trees = []
    for t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        trees.append(tuple(g[c].to_numpy() for c in ("feat", "thr", "left", "right", "size")))
    bc = lt.sparkSession.sparkContext.broadcast(trees)
    c_psi = float(_avg_path(np.array([psi]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, d))
        total = np.zeros(len(x))
        for fe, th, le, ri, si in bc.value:
            nodeix = np.zeros(len(x), dtype=int)
            depth = np.zeros(len(x))
            for _ in range(max_depth + 1):
                f = fe[nodeix]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[np.arange(len(x)), np.where(inner, f, 0)] < th[nodeix]
                nxt = np.where(go_left, le[nodeix], ri[nodeix])
                nodeix = np.where(inner, nxt, nodeix)
                depth = depth + inner
            total += depth + _avg_path(si[nodeix])
        return pd.Series(np.power(2.0, -(total / max(len(bc.value), 1)) / c_psi))

    return lt.select(idx, score(vec).alias(out))


def detect_iforest(lt: DataFrame, cols: Sequence[str], contamination: float = 0.01, seed: int = 42,
                   idx: str = ROW_IDX) -> DataFrame:
    """H-3: rows whose score is in the top ``contamination`` share (the -score percentile rule)."""
    s = durable(isolation_forest_scores(lt, cols, seed=seed, idx=idx).withColumn("_neg", -F.col("iso_score")))
    thr = _threshold(s, "_neg", 100.0 * float(contamination))
    return s.select(idx, _flag(F.col("_neg") < F.lit(thr), "IsolationForest"))


# ---------------------------------------------------------------- H-4 local outlier factor

def _topk(dist: np.ndarray, keys: np.ndarray, k: int):
    """Per row of ``dist`` the k smallest (distance, key) pairs, ties by key.

    Partition to the k-th distance, then sort only the candidates at or below it.
    """
    n, h = dist.shape
    if h <= k:
        order = np.lexsort((np.broadcast_to(keys, dist.shape), dist), axis=1)
        return np.take_along_axis(dist, order, axis=1), keys[order]
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
    r, c = np.nonzero(dist <= kth)
    d, kk = dist[r, c], keys[c]
    o = np.lexsort((kk, d, r))
    r, d, kk = r[o], d[o], kk[o]
    pos = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
    sel = pos < k
    return d[sel].reshape(n, k), kk[sel].reshape(n, k)


def _nearest(keys: np.ndarray, x: np.ndarray, home_keys: np.ndarray, home: np.ndarray, k: int, own: bool = False) -> pd.DataFrame:
    """The ``k`` nearest home points of each point, ``BLOCK`` coordinate differences at a time; ``own``: the points are the home points."""
    outs = []
    step = max(1, BLOCK // max(home.size, 1))
    for s0 in range(0, len(keys), step):
        dist = np.sqrt(((x[s0:s0 + step, None, :] - home[None, :, :]) ** 2).sum(axis=2))
        if own:
            rows_ = np.arange(dist.shape[0])
            dist[rows_, s0 + rows_] = np.inf  # not its own neighbour
        dd, nn = _topk(dist, home_keys, k)
        outs.append(pd.DataFrame({"_k": np.repeat(keys[s0:s0 + step], k), "nbr": nn.ravel(), "dist": dd.ravel()}))
    return pd.concat(outs, ignore_index=True)


def knn_exact(lt: DataFrame, cols: Sequence[str], k: int, key: str = ROW_IDX, slab_rows: int = 2048) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded, ties by key): (key, nbr, dist)."""
    ship_package(lt.sparkSession)
    cols = list(cols)
    # slabs are cut along the widest coordinate: distances do not depend on column order, and a
    # wide axis keeps each row's k-distance bound inside few slabs
    var = lt.agg(*[F.var_pop(F.coalesce(F.col(_q(c)).cast("double"), F.lit(0.0))).alias(f"v{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    lead = max(range(len(cols)), key=lambda i: var[f"v{i}"] or 0.0)
    cols = [cols[lead]] + [c for i, c in enumerate(cols) if i != lead]
    vec = F.array(*[F.coalesce(F.col(_q(c)).cast("double"), F.lit(0.0)) for c in cols])
    pts = lt.select(F.col(key).alias("_k"), vec.alias("v")).withColumn("_x0", F.col("v")[0])
    ix = with_row_index(pts, ["_x0", "_k"], name="_si")
    # slab rows grow with n so the slab-bounds table stays small (<= 200k slabs)
    S = max(int(slab_rows), 4 * k, -(-row_count(ix, "_si") // 200_000))
    slabbed = ix.withColumn("slab", F.floor(F.col("_si") / F.lit(S)).cast("long")).drop("_si")
    bounds = slabbed.groupBy("slab").agg(F.min("_x0").alias("lo"), F.max("_x0").alias("hi")).orderBy("slab").collect()
    b_slab = np.array([r["slab"] for r in bounds])
    b_lo = np.array([r["lo"] for r in bounds])
    b_hi = np.array([r["hi"] for r in bounds])
    nb_schema = "_k long, nbr long, dist double"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["_k"].to_numpy()
        x = np.stack(pdf["v"].to_numpy())
        kk = min(k, len(keys) - 1)
        if kk <= 0:
            return pd.DataFrame({"_k": [], "nbr": [], "dist": []})
        return _nearest(keys, x, keys, x, kk, own=True)

    own = durable(slabbed.groupBy("slab").applyInPandas(local, nb_schema))
    # bound on the k-distance of each row from its own slab (infinite when the slab is too small)
    w = Window.partitionBy("_k").orderBy("dist", "nbr")
    kth = (own.withColumn("_r", F.row_number().over(w)).groupBy("_k")
           .agg(F.max("_r").alias("_cnt"), F.max("dist").alias("_kd")))
    bound = F.when(F.col("_cnt") >= k, F.col("_kd")).otherwise(F.lit(float("inf")))
    withb = slabbed.join(kth, "_k", "left").withColumn("_b", F.coalesce(bound, F.lit(float("inf"))))
    bc = lt.sparkSession.sparkContext.broadcast((b_slab, b_lo, b_hi))

    # slabs are consecutive ranges of x0, so the slabs within a bound form one index range
    @F.pandas_udf("long")
    def first_slab(x0: pd.Series, b: pd.Series) -> pd.Series:
        sl, lo, hi = bc.value
        return pd.Series(sl[np.minimum(np.searchsorted(hi, x0.to_numpy() - b.to_numpy(), "left"), len(sl) - 1)])

    @F.pandas_udf("long")
    def last_slab(x0: pd.Series, b: pd.Series) -> pd.Series:
        sl, lo, hi = bc.value
        return pd.Series(sl[np.maximum(np.searchsorted(lo, x0.to_numpy() + b.to_numpy(), "right") - 1, 0)])

    rng = withb.select("_k", "v", "slab", first_slab("_x0", "_b").alias("_a"), last_slab("_x0", "_b").alias("_z"))
    visitors = (rng.select("_k", "v", "slab", F.explode(
                    F.when(F.col("_a") <= F.col("_z"), F.sequence("_a", "_z"))
                    .otherwise(F.array().cast("array<long>"))).alias("_to"))
                .filter(F.col("_to") != F.col("slab"))
                .select("_k", "v", F.col("_to").alias("slab"), F.lit(1).alias("_role")))
    homes = slabbed.select("_k", "v", "slab").withColumn("_role", F.lit(0))

    def remote(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf[pdf["_role"] == 0]
        vis = pdf[pdf["_role"] == 1]
        if len(home) == 0 or len(vis) == 0:
            return pd.DataFrame({"_k": [], "nbr": [], "dist": []})
        hk = home["_k"].to_numpy()
        hx = np.stack(home["v"].to_numpy())
        vk = vis["_k"].to_numpy()
        vx = np.stack(vis["v"].to_numpy())
        return _nearest(vk, vx, hk, hx, min(k, len(hk)))

    far = homes.unionByName(visitors).groupBy("slab").applyInPandas(remote, nb_schema)
    allnb = own.unionByName(far)
    ranked = allnb.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    return ranked.withColumnRenamed("_k", key)


def lof_scores(lt: DataFrame, cols: Sequence[str], k: int = 20, key: str = ROW_IDX) -> DataFrame:
    """(key, lof_score) with the reachability-distance definition; lrd = 1 / (mean reach + 1e-10)."""
    n = lt.count()
    k = int(min(k, max(n - 1, 1)))
    nb = durable(knn_exact(lt, cols, k, key))
    kdist = nb.groupBy(key).agg(F.max("dist").alias("_kdist"))
    reach = (nb.join(kdist.withColumnRenamed(key, "nbr").withColumnRenamed("_kdist", "_nk"), "nbr")
             .withColumn("_reach", F.greatest(F.col("dist"), F.col("_nk"))))
    lrd = reach.groupBy(key).agg((F.lit(1.0) / (F.avg("_reach") + F.lit(1e-10))).alias("_lrd"))
    ratio = (nb.join(lrd.withColumnRenamed(key, "nbr").withColumnRenamed("_lrd", "_nlrd"), "nbr")
             .groupBy(key).agg(F.avg("_nlrd").alias("_mn")))
    return ratio.join(lrd, key).select(key, (F.col("_mn") / F.col("_lrd")).alias("lof_score"))


def detect_lof(lt: DataFrame, cols: Sequence[str], k: int = 20, contamination: float = 0.01,
               idx: str = ROW_IDX, with_score: bool = False) -> DataFrame:
    """H-4: rows whose -LOF is below the ``contamination`` percentile of -LOF (optionally with the score)."""
    s = durable(lof_scores(lt, cols, k, idx).withColumn("_neg", -F.col("lof_score")))
    thr = _threshold(s, "_neg", 100.0 * float(contamination))
    return s.select(idx, *(["lof_score"] if with_score else []), _flag(F.col("_neg") < F.lit(thr), "LOF"))


# ---------------------------------------------------------------- H-8..H-11

def anomaly_lag_table(df: DataFrame, target: str, lag: int = 0, keys: Sequence[str] = (),
                      idx: str = ROW_IDX) -> DataFrame:
    """The detectors' input: numeric columns lagged by ``lag`` plus the current target."""
    numeric = [idx, *keys] + _numeric(df, [idx, *keys])
    return lag_table(df.select(*[_q(c) for c in dict.fromkeys(numeric)]), lag, target, keys=keys, idx=idx)


def detect_anomalies(df: DataFrame, target: str, lag: int = 0, methods: Sequence[str] = ("zscore", "rolling"),
                     params: Mapping[str, float] | None = None, keys: Sequence[str] = (),
                     idx: str = ROW_IDX) -> DataFrame | None:
    """H-8: one row per lag-table row: each selected method's flag and ``votes`` = their sum.

    Returns None when no method is selected (H-11).
    """
    methods = [m for m in methods if m in METHOD_FLAGS]
    if not methods:
        return None
    prm = dict(DEFAULT_PARAMS)
    prm.update(params or {})
    lt = durable(anomaly_lag_table(df, target, lag, keys, idx))
    allc = [c for c in lt.columns if c not in (idx, *keys)]
    xcols = [c for c in allc if c != target]
    pct = prm["recon_error_percentile"]
    # detectors that are row expressions become columns of one projection (no join) ...
    columns = {
        "zscore": lambda: zscore_flag(lt, target, prm["z_threshold"]),
        "pca": lambda: pca_flag(lt, allc, prm["pca_components"], pct),
        "pls": lambda: pls_flag(lt, xcols, target, pct),
        "lin_reg": lambda: linreg_flag(lt, xcols, target, pct),
    }
    # ... the window / model / neighbour detectors are joined on the index
    joined = {
        "rolling": lambda: detect_rolling(lt, target, int(prm["rolling_window"]), prm["z_threshold"], idx, keys),
        "iso_forest": lambda: detect_iforest(lt, allc, prm["iso_contamination"], idx=idx),
        "lof": lambda: detect_lof(lt, allc, int(prm["lof_neighbors"]), prm["lof_contamination"], idx),
    }
    out = lt.select(idx, *[columns[m]() for m in methods if m in columns])
    for m in methods:
        if m in joined:
            out = out.join(joined[m](), idx, "left")
    flags = [METHOD_FLAGS[m] for m in methods]
    out = out.select(idx, *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in flags])
    votes = F.lit(0)
    for f in flags:
        votes = votes + F.col(f)
    return out.withColumn("votes", votes.cast("int"))


def default_vote_threshold(methods: Sequence[str]) -> int:
    return min(2, len([m for m in methods if m in METHOD_FLAGS]))


def flagged(votes: DataFrame, threshold: int) -> DataFrame:
    """Rows with votes >= threshold, most votes first."""
    return votes.filter(F.col("votes") >= int(threshold)).orderBy(F.desc("votes"), ROW_IDX)


def drop_anomalies(df: DataFrame, votes: DataFrame, threshold: int, idx: str = ROW_IDX) -> DataFrame:
    """H-9/C2: the original rows without the flagged ones (rows lost to the lag are kept)."""
    bad = votes.filter(F.col("votes") >= int(threshold)).select(idx)
    return df.join(bad, idx, "left_anti")


def flagged_points(df: DataFrame, votes: DataFrame, target: str, threshold: int, idx: str = ROW_IDX) -> DataFrame:
    """H-10/C3: long (method, row_idx, value) of the original target at each method's flags and 'Combined'."""
    flags = [c for c in votes.columns if c not in (idx, "votes")]
    items = [F.struct(F.lit(f).alias("method"), F.col(f).alias("_f")) for f in flags]
    items.append(F.struct(F.lit("Combined").alias("method"),
                          (F.col("votes") >= int(threshold)).cast("int").alias("_f")))
    long = (votes.select(idx, F.explode(F.array(*items)).alias("_s"))
            .filter(F.col("_s._f") == 1).select(idx, F.col("_s.method").alias("method")))
    return long.join(df.select(idx, F.col(_q(target)).alias("value")), idx, "inner")
