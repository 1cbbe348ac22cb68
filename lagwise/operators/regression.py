"""Lag sweeps, multi-target models, grid search, evaluation data.

A model builder is a zero-argument callable returning a ``ModelSpec``; a spec
fits on a DataFrame of feature columns and returns a fitted model whose
``transform`` adds ``prediction``.  Tree ensembles are Spark ML estimators;
linear regression, principal components, random Fourier features and random
hidden layers are solved from Gram sums (``moment_models``), all lags, folds
and grid points of a sweep from the same passes.

All lags of a sweep come from one halo-window pass, written once as Parquet to
the checkpoint folder; every fit then reads its own columns only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import regression as mlr, classification as mlc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.lagmoments import over_buckets, window_gram
from ..functions.metrics import classification_metrics, r2_expr, rmse_expr
from ..functions.split import hash_uniform, split
from ..session import checkpoint_dir, durable, stored
from ..sources.io import numeric_columns
from .halo import lag_sql, over_halo, q
from .index import ROW_IDX, keep_rows, row_count
from .lag import multi_lag_table
from .moment_models import FLOOR, LinearSpec, MomentSpec, PCRSpec, RandomHiddenSpec, RFFSpec, fit_moments, fold_column, grid_points, search_moments

_FEATURES = "_features"
_NUMBER_ARRAYS = {f"array<{t}>" for t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
MAX_TREE_DEPTH = 15  # "unlimited" depth of the reference's forests, bounded for node memory
SPARK_TREE_DEPTH = 30  # the deepest tree that Spark ML grows
FIT_ROWS = 50_000  # training rows of a partition, at least
KEPT_NODES = 50_000  # tree nodes of a sweep's model that stays in the driver's memory
MAX_FITS = 2_000  # tree fits of one grid search


def _strip(params: Mapping, prefixes=("svr__", "mlp__", "pca__", "regressor__")) -> dict:
    out = {}
    for k, v in params.items():
        for p in prefixes:
            if k.startswith(p):
                k = k[len(p):]
        out[k] = v
    return out


# ---------------------------------------------------------------- fitted models

@dataclass
class Fitted:
    features: list[str]
    model: object = None            # Spark ML model (trees, linear)
    features_sql: str | None = None     # SQL of the mapped features as one array
    importances: dict | None = None
    coefficients: dict | None = None
    intercept: float | None = None
    kind: str = "regressor"

    weights: np.ndarray | None = None   # of the mapped features of a model solved from Gram sums
    ranked: bool = True                 # whether its coefficients rank the variables
    saved: tuple | None = None          # class and path of a model in the shared folder

    def put_away(self, df: DataFrame) -> None:
        """Move a model of many tree nodes to the shared folder of ``df``'s session; it is read back when it is used."""
        if self.model is None or getattr(self.model, "totalNumNodes", 0) <= KEPT_NODES:
            return
        path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/sweep-model-{uuid.uuid4().hex}"
        self.model.write().save(path)
        self.saved, self.model = (type(self.model), path), None

    def transform(self, df: DataFrame) -> DataFrame:
        model = self.model if self.saved is None else self.saved[0].load(self.saved[1])
        if model is None and self.features_sql:  # weights on mapped features
            total = F.aggregate(F.zip_with(F.expr(self.features_sql), F.lit([float(w) for w in self.weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
            return df.withColumn("prediction", total + F.lit(float(self.intercept)))
        if model is None:  # a linear model: one column expression
            e = F.lit(float(self.intercept or 0.0))
            for c in self.features:
                e = e + F.col(q(c)).cast("double") * F.lit(float(self.coefficients[c]))
            return df.withColumn("prediction", e)
        out = model.transform(_assemble(df, self.features)).drop(_FEATURES)
        drop = [c for c in ("rawPrediction", "probability") if c in out.columns and c not in df.columns]
        return out.drop(*drop)


@dataclass
class ModelSpec:
    name: str
    params: dict = field(default_factory=dict)
    kind: str = "regressor"

    def with_params(self, **params) -> "ModelSpec":
        p = dict(self.params)
        p.update(_strip(params))
        return type(self)(self.name, p, self.kind)

    KEYS = {
        "random_forest": ("n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "random_state", "n_jobs"),
        "random_forest_classifier": ("n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "random_state", "n_jobs"),
        "gbt": ("n_estimators", "learning_rate", "max_depth", "random_state"),
        "boosted_sampled": ("n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree", "random_state", "n_jobs"),
    }

    def __post_init__(self):
        unknown = sorted(set(self.params) - set(self.KEYS.get(self.name, ())))
        if unknown:
            raise ValueError(f"{self.name} has no parameters {unknown}; it has {list(self.KEYS.get(self.name, ()))}")

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> Fitted:
        raise NotImplementedError


def _arrays(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c, kind in df.select(*[q(c) for c in cols]).dtypes if kind.startswith("array")]


def _assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` as one vector; an array column gives all its values."""
    cols = list(cols)
    arrays = set(_arrays(df, cols))
    if not arrays:
        return VectorAssembler(inputCols=cols, outputCol=_FEATURES, handleInvalid="keep").transform(df)
    parts = [F.col(q(c)).cast("array<double>") if c in arrays
             else F.array(F.coalesce(F.col(q(c)).cast("double"), F.lit(float("nan")))) for c in cols]
    return df.withColumn(_FEATURES, array_to_vector(F.concat(*parts)))


def _importances(df: DataFrame, features: Sequence[str], values: Sequence[float]) -> dict:
    """Importance by feature; an array's values count one by one, as ``name[i]``."""
    arrays = _arrays(df, features)
    widths = df.select(*[F.size(q(c)).alias(c) for c in arrays]).first().asDict() if arrays else {}
    names = [n for c in features for n in ([f"{c}[{i}]" for i in range(widths[c])] if c in widths else [c])]
    return dict(zip(names, values))


def _least_rows(p: Mapping) -> int:
    """Spark ML bounds a leaf's rows, not a split's: a node of fewer than ``min_samples_split`` rows cannot have two leaves of
    half as many, so half of it is the nearest bound; ``min_samples_leaf`` is the same bound in both."""
    return max(1, int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)) // 2)


class SparkMLSpec(ModelSpec):
    """Tree ensembles from Spark ML, parameters named as in the reference's grids."""

    def estimator(self, label: str):
        p = self.params
        seed = int(p.get("random_state", 42))
        depth = p.get("max_depth", None)
        if depth and int(depth) > SPARK_TREE_DEPTH:
            raise ValueError(f"max_depth={depth} is above {SPARK_TREE_DEPTH}, the deepest tree that Spark ML grows")
        if self.name == "random_forest":
            return mlr.RandomForestRegressor(
                featuresCol=_FEATURES, labelCol=label, numTrees=int(p.get("n_estimators", 100)),
                maxDepth=int(depth) if depth else MAX_TREE_DEPTH, featureSubsetStrategy="all",
                minInstancesPerNode=_least_rows(p), seed=seed, maxBins=64,
                maxMemoryInMB=1024, cacheNodeIds=True)
        if self.name == "random_forest_classifier":
            return mlc.RandomForestClassifier(
                featuresCol=_FEATURES, labelCol=label, numTrees=int(p.get("n_estimators", 100)),
                maxDepth=int(depth) if depth else MAX_TREE_DEPTH, featureSubsetStrategy="sqrt", seed=seed,
                minInstancesPerNode=_least_rows(p), cacheNodeIds=True)
        if self.name == "gbt":
            return mlr.GBTRegressor(featuresCol=_FEATURES, labelCol=label, maxIter=int(p.get("n_estimators", 100)),
                                    stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(depth or 3), seed=seed)
        if self.name == "boosted_sampled":
            return mlr.GBTRegressor(featuresCol=_FEATURES, labelCol=label, maxIter=int(p.get("n_estimators", 100)),
                                    stepSize=float(p.get("learning_rate", 0.3)), maxDepth=int(depth or 6),
                                    subsamplingRate=float(p.get("subsample", 1.0)),
                                    featureSubsetStrategy=str(float(p.get("colsample_bytree", 1.0))), seed=seed)
        raise ValueError(self.name)

    def fit(self, df, features, label):
        features = list(features)
        model = self.estimator(label).fit(_assemble(df, features))
        fitted = Fitted(features, model, kind=self.kind)
        fitted.importances = _importances(df, features, model.featureImportances.toArray().tolist())
        return fitted


class builders:
    """Zero-argument model builders."""

    @staticmethod
    def random_forest(**p) -> ModelSpec:
        return SparkMLSpec("random_forest", p)

    @staticmethod
    def random_forest_classifier(**p) -> ModelSpec:
        return SparkMLSpec("random_forest_classifier", p, kind="classifier")

    @staticmethod
    def gbt(**p) -> ModelSpec:
        return SparkMLSpec("gbt", p)

    @staticmethod
    def boosted_sampled(**p) -> ModelSpec:
        return SparkMLSpec("boosted_sampled", p)

    @staticmethod
    def linear(**p) -> ModelSpec:
        return LinearSpec("linear", p)

    @staticmethod
    def pcr(**p) -> ModelSpec:
        return PCRSpec("pcr", _strip(p))

    @staticmethod
    def rff(**p) -> ModelSpec:
        return RFFSpec("rff", _strip(p))

    @staticmethod
    def random_hidden(**p) -> ModelSpec:
        return RandomHiddenSpec("random_hidden", _strip(p))


# ---------------------------------------------------------------- evaluation helpers

def _metrics_by_part(pred: DataFrame, label: str) -> dict:
    """Train/test R^2 and RMSE in one aggregate grouped by the split flag."""
    rows = pred.groupBy("is_test").agg(r2_expr(label).alias("r2"), rmse_expr(label).alias("rmse")).collect()
    out = {}
    for r in rows:
        part = "test" if r["is_test"] else "train"
        out[f"{part}_r2"], out[f"{part}_rmse"] = r["r2"], r["rmse"]
    return out


def cv_score(spec: ModelSpec, train: DataFrame, features, label, folds: int = 3, seed: int = 42,
             idx: str = ROW_IDX) -> float:
    """Mean held-out R^2 (accuracy for classifiers) over ``folds`` hash folds."""
    fold = F.floor(hash_uniform(idx, seed + 1) * folds).cast("int")
    tr = train.withColumn("_fold", fold)
    scores = []
    for f in range(folds):
        fitted = spec.fit(tr.filter(F.col("_fold") != f), features, label)
        held = fitted.transform(tr.filter(F.col("_fold") == f))
        if spec.kind == "classifier":
            scores.append(held.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).collect()[0][0])
        else:
            scores.append(held.agg(r2_expr(label)).collect()[0][0])
    return float(np.mean(scores))


def _compact(df: DataFrame, rows: int) -> DataFrame:
    """No more partitions than the rows ask for: a tree level is one job, and its cost on few rows is that of its tasks."""
    return df.coalesce(max(1, -(-int(rows) // FIT_ROWS)))


def grid_search(builder: Callable[[], ModelSpec], grid: Mapping[str, Sequence], train: DataFrame, features,
                label: str, folds: int = 3, seed: int = 42, parallelism: int = 8, idx: str = ROW_IDX, max_fits: int = MAX_FITS):
    """Exhaustive search, ``folds``-fold CV; returns (best params, best spec to refit on train).

    Models solved from Gram sums need one or two passes for the whole grid.  Trees are fitted once per point and fold, on one
    prepared table with the columns of this search only; more than ``max_fits`` fits are refused before the first one.
    Unknown parameters are refused."""
    base = builder()
    points = grid_points(grid)
    if isinstance(base, MomentSpec):
        part = F.floor(hash_uniform(idx, seed + 1) * folds).cast("int")
        best = search_moments(base, grid, [(list(features), label)], train.withColumn("_part", part), folds)[0][0]
        return best, base.with_params(**best)
    specs = [base.with_params(**c) for c in points]
    if len(points) * folds > max_fits:
        raise ValueError(f"{len(points)} grid points x {folds} folds are more than max_fits={max_fits} fits")
    train = stored(train, "grid-train")
    train = _compact(train, train.count()).cache()
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            scores = list(ex.map(lambda s: cv_score(s, train, features, label, folds, seed, idx), specs))
    finally:
        train.unpersist()
    best = int(np.argmax(scores))
    return points[best], specs[best]


@dataclass
class SweepResult:
    results: DataFrame
    best_lag: int
    best_model: Fitted
    models: dict


def all_lags_frame(df: DataFrame, target: str | Sequence[str], max_lag: int, drop: Sequence[str] = (), target_lags: int = 0,
                   keys: Sequence[str] = (), idx: str = ROW_IDX) -> tuple[DataFrame, list[str]]:
    """Every predictor shifted by 0..max_lag plus target lags 1..target_lags, one window pass, checkpointed."""
    targets = [target] if isinstance(target, str) else list(target)
    skip = set(drop) | set(keys) | {idx, *targets}
    # a timestamp or text column is no model input; an array of numbers is one whole
    inputs = set(numeric_columns(df)) | {c for c, kind in df.dtypes if kind in _NUMBER_ARRAYS}
    preds = [c for c in df.columns if c in inputs and c not in skip]
    span = max(int(max_lag), int(target_lags))

    def build(fr, _w):
        return fr.selectExpr(q(idx), "_hb", "_hh", *[q(t) for t in targets],
                             *[f"{lag_sql(c, k, keys, idx)} AS {q(f'{c}_lag{k}')}"
                               for k in range(int(max_lag) + 1) for c in preds],
                             *[f"{lag_sql(t, i, keys, idx)} AS {q(f'{t}_lag{i}')}"
                               for t in targets for i in range(1, int(target_lags) + 1)])

    out = over_halo(df, build, before=span, idx=idx)
    # predictor lag columns may share a name with a target lag column when the target is also dropped
    return keep_rows(df, stored(out.select(*dict.fromkeys(out.columns)), "lag-sweep")), preds


def _moment_sweep(wide: DataFrame, colsets: Mapping[int, list[str]], target: str, spec, grid, test_size: float, seed: int, folds: int, idx: str):
    """Models solved from Gram sums, every lag and grid point from the same passes: ({lag: Fitted}, result rows)."""
    folds = int(folds) if grid else 1
    lags = sorted(colsets)
    parted = wide.withColumn("_part", fold_column(test_size, seed, folds, idx))
    if grid:
        found = search_moments(spec, grid, [(colsets[k], target) for k in lags], parted, folds)
    else:
        found = [(None, None, fitted, *errors) for fitted, errors in fit_moments([(spec, colsets[k], target) for k in lags], parted, 2)]
    models = {k: f[2] for k, f in zip(lags, found)}
    number = lambda x: None if x is None or math.isnan(x) else float(x)
    rows = [(k, str(point) if point else None, *(number(e) for e in (train[0], test[0], train[1], test[1])), score) for k, (point, score, _, train, test) in zip(lags, found)]
    return models, rows


def lag_sweep(df: DataFrame, target: str, builder: Callable[[], ModelSpec], max_lag: int = 23,
              test_size: float = 0.3, grid: Mapping | None = None, drop: Sequence[str] = (), target_lags: int = 0,
              seed: int = 42, folds: int = 3, keys: Sequence[str] = (), idx: str = ROW_IDX,
              parallelism: int = 8) -> SweepResult:
    """For lag 0..max_lag: lag table -> split -> fit (or grid search) -> train/test metrics.

    With a grid the results also hold ``cv_score``, the mean held-out score of the chosen point.  Models solved from Gram
    sums take all lags together; trees are fitted lag by lag, ``parallelism`` fits at a time."""
    wide, preds = all_lags_frame(df, target, max_lag, drop, target_lags, keys, idx)
    spark = df.sparkSession
    rows, models = [], {}
    spec0 = builder()
    kind = spec0.kind
    colsets = {lag: list(dict.fromkeys([f"{c}_lag{lag}" for c in preds]
                                       + [f"{target}_lag{i}" for i in range(1, int(target_lags) + 1)]))
               for lag in range(int(max_lag) + 1)}
    arrays = _arrays(wide, colsets[0])
    if arrays and isinstance(spec0, MomentSpec):
        raise ValueError(f"{spec0.name} takes numeric columns, not the arrays {arrays}")
    if isinstance(spec0, MomentSpec):
        models, rows = _moment_sweep(wide, colsets, target, spec0, grid, test_size, seed, folds, idx)
    n_rows = row_count(df, idx)

    def one_lag(lag):
        cols = colsets[lag]
        t = _compact(wide.select(idx, *[q(c) for c in cols], q(target)).dropna(), n_rows)
        t = split(t, test_size, seed, stratify=target if kind == "classifier" else None, key=idx)
        train = t.filter(~F.col("is_test"))
        params = None
        if grid:
            params, spec = grid_search(builder, grid, train, cols, target, folds, seed, parallelism, idx)
        else:
            spec = builder()
        fitted = spec.fit(train, cols, target)
        pred = fitted.transform(t)
        if kind == "classifier":
            tr = pred.filter(~F.col("is_test")).agg(
                F.avg((F.col(target) == F.col("prediction")).cast("double"))).collect()[0][0]
            cm = classification_metrics(pred.filter(F.col("is_test")), target).collect()[0]
            row = (lag, str(params) if params else None, float(tr), float(cm["accuracy"]),
                   float(cm["precision"]), float(cm["recall"]), float(cm["f1"]))
        else:
            m = _metrics_by_part(pred, target)
            row = (lag, str(params) if params else None, m.get("train_r2"), m.get("test_r2"),
                   m.get("train_rmse"), m.get("test_rmse"), None)
        fitted.put_away(df)
        return lag, fitted, row

    if not rows:
        # lags are independent fits: run them as concurrent Spark jobs (a grid search runs its own pool)
        workers = 1 if grid else max(1, int(parallelism))
        with ThreadPoolExecutor(max_workers=workers) as ex:
            for lag, fitted, row in ex.map(one_lag, range(int(max_lag) + 1)):
                models[lag] = fitted
                rows.append(row)
    if kind == "classifier":
        schema = ("lag int, params string, train_accuracy double, test_accuracy double, precision double, "
                  "recall double, f1 double")
        key = 3
    else:
        schema = "lag int, params string, train_r2 double, test_r2 double, train_rmse double, test_rmse double, cv_score double"
        key = 3
    best = max(rows, key=lambda r: (r[key] if r[key] is not None else -math.inf, -r[0]))
    results = spark.createDataFrame(rows, schema).orderBy(F.desc(schema.split(", ")[key].split()[0]))
    if kind != "classifier" and not (grid and isinstance(spec0, MomentSpec)):
        results = results.drop("cv_score")
    return SweepResult(results, best[0], models[best[0]], models)


def lag_metric_curves(results: DataFrame) -> DataFrame:
    """Metrics by lag with the best-R^2 and best-RMSE lags marked (two values, used as literals)."""
    best = results.agg(F.max_by("lag", "test_r2").alias("r2"), F.min_by("lag", "test_rmse").alias("rmse")).collect()[0]
    return (results.select("lag", "train_r2", "test_r2", "train_rmse", "test_rmse",
                           (F.col("lag") == F.lit(best["r2"])).alias("best_r2"),
                           (F.col("lag") == F.lit(best["rmse"])).alias("best_rmse"))
            .orderBy("lag"))


def fit_multi_target(df: DataFrame, predictors: Sequence[str], targets: Sequence[str],
                     builder: Callable[[], ModelSpec], input_lags: int = 1, target_lags: int = 1,
                     test_size: float = 0.3, grid: Mapping | None = None, seed: int = 42, folds: int = 3,
                     keys: Sequence[str] = (), idx: str = ROW_IDX, parallelism: int = 4):
    """I4: D3 table -> split -> one model per target -> per-target metrics and their means.

    Returns (metrics DataFrame, {target: Fitted}, feature columns, the split lag table).
    """
    t = multi_lag_table(df, predictors, targets, input_lags, target_lags, keys, idx)
    feats = [c for c in t.columns if c not in (idx, *keys, *targets)]
    t = stored(split(t, test_size, seed, key=idx), "multi-target")
    schema = "target string, train_r2 double, test_r2 double, train_rmse double, test_rmse double"
    if isinstance(builder(), MomentSpec):
        models, found = _moment_cases(t, [(feats, tg) for tg in targets], builder(), grid, test_size, seed, folds, idx)
        rows = [(tg, *row[1:]) for tg, row in zip(targets, found)]
        rows += [("mean", *[float(np.mean([r[i] for r in rows])) for i in range(1, 5)])] if rows else []
        return df.sparkSession.createDataFrame(rows, schema), dict(zip(targets, models)), feats, t
    train = t.filter(~F.col("is_test"))

    def one_target(tg):
        spec = grid_search(builder, grid, train, feats, tg, folds, seed, parallelism, idx)[1] if grid else builder()
        fitted = spec.fit(train, feats, tg)
        m = _metrics_by_part(fitted.transform(t), tg)
        return tg, fitted, (tg, m.get("train_r2"), m.get("test_r2"), m.get("train_rmse"), m.get("test_rmse"))

    models, rows = {}, []
    # targets are independent fits: concurrent Spark jobs (a grid search runs its own pool)
    with ThreadPoolExecutor(max_workers=1 if grid else max(1, int(parallelism))) as ex:
        for tg, fitted, row in ex.map(one_target, list(targets)):
            models[tg] = fitted
            rows.append(row)
    if rows:
        rows.append(("mean", *[float(np.mean([r[i] for r in rows])) for i in range(1, 5)]))
    return df.sparkSession.createDataFrame(rows, schema), models, feats, t


def _moment_cases(df: DataFrame, cases, spec, grid, test_size: float, seed: int, folds: int, idx: str):
    """Models solved from Gram sums for (features, label) cases: ([Fitted], [(params, train R2, test R2, train RMSE, test RMSE)])."""
    folds = int(folds) if grid else 1
    parted = df.withColumn("_part", fold_column(test_size, seed, folds, idx))
    if grid:
        found = search_moments(spec, grid, cases, parted, folds)
    else:
        found = [(None, None, fitted, *errors) for fitted, errors in fit_moments([(spec, list(f), y) for f, y in cases], parted, 2)]
    return [f[2] for f in found], [(str(p) if p else None, train[0], test[0], train[1], test[1]) for p, _, _, train, test in found]


@dataclass
class MultiSweepResult:
    results: DataFrame              # lag, target (and ``mean``), params, train and test R^2 and RMSE
    best_lag: int                   # highest mean test R^2
    best_models: dict[str, Fitted]  # by target


def multi_lag_sweep(df: DataFrame, predictors: Sequence[str], targets: Sequence[str],
                    builder: Callable[[], ModelSpec], max_lag: int = 23, test_size: float = 0.3, grid: Mapping | None = None,
                    drop: Sequence[str] = (), seed: int = 42, folds: int = 3, keys: Sequence[str] = (), idx: str = ROW_IDX,
                    parallelism: int = 8) -> MultiSweepResult:
    """For each lag, D4 table and one model per target; per-target and mean metrics, the best lag and its models.

    All lags come from one window pass; models solved from Gram sums take all lags and targets together."""
    predictors, targets = [c for c in predictors if c not in set(drop)], list(targets)
    wide, _ = all_lags_frame(df.select(idx, *dict.fromkeys([*keys, *predictors, *targets])), targets, max_lag, (), 0, keys, idx)
    cases = [(lag, [f"{c}_lag{lag}" for c in predictors], tg) for lag in range(int(max_lag) + 1) for tg in targets]
    if isinstance(builder(), MomentSpec):
        models, rows = _moment_cases(wide, [(f, tg) for _, f, tg in cases], builder(), grid, test_size, seed, folds, idx)
    else:
        n_rows = row_count(df, idx)

        def one(case):
            _, feats, tg = case
            t = split(_compact(wide.select(idx, *[q(c) for c in feats], q(tg)).dropna(), n_rows), test_size, seed, key=idx)
            train = t.filter(~F.col("is_test"))
            params, spec = grid_search(builder, grid, train, feats, tg, folds, seed, parallelism, idx) if grid else (None, builder())
            fitted = spec.fit(train, feats, tg)
            m = _metrics_by_part(fitted.transform(t), tg)
            return fitted, (str(params) if params else None, m.get("train_r2"), m.get("test_r2"), m.get("train_rmse"), m.get("test_rmse"))
        with ThreadPoolExecutor(max_workers=1 if grid else max(1, int(parallelism))) as ex:
            models, rows = zip(*ex.map(one, cases))
    out, best = [], (-math.inf, 0)
    for lag in range(int(max_lag) + 1):
        mine = rows[lag * len(targets):(lag + 1) * len(targets)]
        out += [(lag, tg, *row) for tg, row in zip(targets, mine)]
        mean = [float(np.mean([row[i] for row in mine])) for i in range(1, 5)]
        out.append((lag, "mean", None, *mean))
        best = max(best, (mean[1], -lag))
    best_lag = -best[1]
    results = df.sparkSession.createDataFrame(out, "lag int, target string, params string, train_r2 double, test_r2 double, train_rmse double, test_rmse double")
    return MultiSweepResult(results, best_lag, dict(zip(targets, models[best_lag * len(targets):(best_lag + 1) * len(targets)])))


def evaluate_multi_regression(models: Mapping[str, Fitted], table: DataFrame, idx: str = ROW_IDX, bins: int = 20,
                              test_size: float = 0.3, seed: int = 42):
    """I8: ``evaluate_regression`` for every target of a multi-target model."""
    return {t: evaluate_regression(m, table, t, idx, bins, test_size, seed) for t, m in models.items()}


def evaluate_regression(fitted: Fitted, table: DataFrame, target: str, idx: str = ROW_IDX, bins: int = 20,
                        test_size: float = 0.3, seed: int = 42):
    """Predictions over all rows (F24, ``series``, with the split flag); over the test rows alone residuals (F25), residual
    histogram (F18), density (F19) and identity-line range (F20); importances (I9/I11)."""
    from ..functions import stats as st
    pred = fitted.transform(table).withColumn("residual", F.col(target) - F.col("prediction"))
    series = pred.select(idx, F.col(target).alias("actual"), "prediction", "residual", (hash_uniform(idx, seed) < F.lit(float(test_size))).alias("is_test"))
    held = series.filter("is_test")
    return {
        "series": series,
        "residuals": held.select(idx, "prediction", "residual"),
        "histogram": st.histogram(held, "residual", bins),
        "density": st.kde(held, "residual"),
        "range": st.minmax(held, ["actual", "prediction"]),
        "importance": importance(fitted, table.sparkSession),
    }


def importance(fitted: Fitted, spark) -> DataFrame | None:
    """Tree importances, or linear coefficients by |value|; none for re-aimed specs (as for PCR)."""
    if fitted.importances is not None:
        rows = sorted(fitted.importances.items(), key=lambda kv: -kv[1])
        return spark.createDataFrame(rows, "variable string, importance double")
    if fitted.coefficients is not None and fitted.ranked:
        rows = sorted(fitted.coefficients.items(), key=lambda kv: -abs(kv[1]))
        return spark.createDataFrame(rows, "variable string, coefficient double")
    return None


def ols_summary(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """OLS with constant on all rows: coefficient, standard error, t, p-value; sorted by |coef|."""
    features = list(features)
    data = _assemble(df.select(*[F.col(q(c)).cast("double").alias(c) for c in features],
                               F.col(q(target)).cast("double").alias(target)).dropna(), features)
    model = mlr.LinearRegression(featuresCol=_FEATURES, labelCol=target, regParam=0.0, solver="normal").fit(data)
    s = model.summary
    names = features + ["const"]
    coefs = model.coefficients.toArray().tolist() + [float(model.intercept)]
    rows = list(zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues))
    rows.sort(key=lambda r: -abs(r[1]))
    return df.sparkSession.createDataFrame(rows, "variable string, coefficient double, std_err double, "
                                                 "t_value double, p_value double")


def forecast_horizon(df: DataFrame, inputs: Sequence[str], target: str, n_in: int = 24, n_out: int = 12,
                     builder: Callable[[], ModelSpec] = builders.linear, train_ratio: float = 0.7,
                     idx: str = ROW_IDX):
    """I20 (re-aimed sequence models): n_in past rows of the inputs -> the next n_out target values.

    Min-max scaling on all rows, chronological split, windows inside each part,
    one regressor per horizon step (linear ones all from one Gram matrix of lagged moments); R^2 / RMSE over samples x steps on the
    original scale.  Returns (metrics DataFrame, test predictions long form).
    """
    from ..functions.scale import min_max_params, min_max_expr
    from .rolling import sequence_windows
    inputs = list(inputs)
    cols = list(dict.fromkeys(inputs + [target]))
    params = min_max_params(df, cols)
    n = row_count(df, idx)
    cut = math.floor(n * float(train_ratio))
    lo, hi = params[target]
    span = (hi - lo) if hi is not None and lo is not None and hi != lo else 1.0
    if isinstance(builder(), LinearSpec):
        scaled = keep_rows(df, stored(df.select(idx, *[min_max_expr(c, *params[c]).alias(f"_s{i}") for i, c in enumerate(cols)]), "forecast-series"))
        preds = _forecast_linear(scaled, [cols.index(c) for c in inputs], cols.index(target), len(cols), n, cut, n_in, n_out, lo or 0.0, span, idx)
        return _forecast_metrics(df, preds), preds["test"]
    scaled = keep_rows(df, df.select(idx, *[min_max_expr(c, *params[c]).alias(c) for c in cols]))
    parts = {}
    for name, cond in (("train", F.col(idx) < cut), ("test", F.col(idx) >= cut)):
        seq = sequence_windows(scaled.filter(cond), inputs, [target], n_in, n_out, idx=idx)
        flat = seq.selectExpr(q(idx), *[f"x[{s}][{j}] AS _x{s}_{j}" for s in range(n_in) for j in range(len(inputs))],
                              *[f"y[{h}][0] AS _y{h}" for h in range(n_out)])
        parts[name] = durable(flat)
    feats = [f"_x{s}_{j}" for s in range(n_in) for j in range(len(inputs))]
    preds = {"train": None, "test": None}
    # one independent regressor per horizon step: concurrent Spark jobs, kept in step order
    with ThreadPoolExecutor(max_workers=4) as ex:
        fits = list(ex.map(lambda h: builder().fit(parts["train"], feats, f"_y{h}"), range(n_out)))
    for h, fitted in enumerate(fits):
        for name in ("train", "test"):
            p = fitted.transform(parts[name]).select(
                idx, F.lit(h).alias("step"),
                (F.col(f"_y{h}") * F.lit(span) + F.lit(lo or 0.0)).alias("actual"),
                (F.col("prediction") * F.lit(span) + F.lit(lo or 0.0)).alias("prediction"))
            preds[name] = p if preds[name] is None else preds[name].unionByName(p)
    return _forecast_metrics(df, preds), preds["test"]


def _forecast_metrics(df: DataFrame, preds: Mapping[str, DataFrame]) -> DataFrame:
    rows = []
    for name in ("train", "test"):
        r = preds[name].agg(r2_expr("actual"), rmse_expr("actual")).collect()[0]
        rows.append((name, r[0], r[1]))
    return df.sparkSession.createDataFrame(rows, "part string, r2 double, rmse double")


def _forecast_linear(scaled: DataFrame, inputs: list[int], target: int, width: int, n: int, cut: int, n_in: int, n_out: int, lo: float, span: float, idx: str) -> dict[str, DataFrame]:
    """Least squares for all horizon steps from the Gram matrix of the training windows (no window is stored), one factorisation
    for all steps; the predictions slide the weights over buckets of the series."""
    names, rows = [f"_s{i}" for i in range(width)], n_in + n_out
    gram, sums, windows = window_gram(scaled, names, rows, 0, max(cut - rows + 1, 0), idx)
    x = [i * width + a for i in range(n_in) for a in inputs]
    y = [(n_in + h) * width + target for h in range(n_out)]
    mean = sums / max(windows, 1)
    cross = gram - np.outer(sums, sums) / max(windows, 1)
    values, vectors = np.linalg.eigh(cross[np.ix_(x, x)])
    inverse = np.where(values > FLOOR * max(values[-1], 0.0), 1.0 / np.maximum(values, 1e-300), 0.0)
    weights = vectors @ (inverse[:, None] * (vectors.T @ cross[np.ix_(x, y)]))  # features x steps
    intercepts = mean[y] - mean[x] @ weights

    def predictions(first: int, last: int) -> DataFrame:
        def job(at: np.ndarray, values: np.ndarray, home: int) -> pd.DataFrame:
            m = max(int(np.searchsorted(at[:home], last - rows + 1)), 0)
            pred = np.zeros((m, n_out)) + intercepts
            for i in range(n_in):
                pred += values[i:i + m][:, inputs] @ weights[i * len(inputs):(i + 1) * len(inputs)]
            true = np.column_stack([values[n_in + h:n_in + h + m, target] for h in range(n_out)])
            return pd.DataFrame({idx: np.repeat(at[:m], n_out), "step": np.tile(np.arange(n_out, dtype="int32"), m),
                                 "actual": true.ravel() * span + lo, "prediction": pred.ravel() * span + lo})
        part = keep_rows(scaled, scaled.filter((F.col(idx) >= first) & (F.col(idx) < last)))
        return over_buckets(part, names, rows, job, f"{idx} long, step int, actual double, prediction double", idx)

    return {"train": predictions(0, cut), "test": predictions(cut, n)}
