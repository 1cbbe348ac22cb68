"""Regressors that are solved from Gram sums, so that grids, folds and lags share passes over the data.

Every model here is linear in some feature map: the raw columns (OLS, principal components) or a seeded random one
(Fourier features for the RBF kernel, random hidden layers in place of a back-propagated network).  With a ``GramSum`` per
fold, training on all folds but one is the total minus that fold, the held-out R^2 is a quadratic form of the fold's own
sum, and further grid points on the same map cost no pass at all.  Means and scales that a map needs come from the whole
training part; the output layer alone is solved anew per fold.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.gram import GramJob, GramSum, gram_sums
from ..functions.split import hash_uniform
from .halo import q
from .index import ROW_IDX

FLOOR = 1e-12  #: eigenvalues below this share of the largest count as zero


@dataclass
class FeatureMap:
    """Mapped features as a numpy function for the sums and as SQL for scoring; the raw columns if both are None."""

    apply: object = None
    sql: str | None = None  #: one array
    width: int | None = None


def _ridge(total: GramSum, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squares with ``penalty`` times the squared weights; minimum norm where singular."""
    cross, mean = total.cross, total.mean
    values, vectors = np.linalg.eigh(cross[:-1, :-1])
    most = values[-1] if len(values) else 0.0
    inverse = np.where(values > FLOOR * max(most, 0.0), 1.0 / np.maximum(values + penalty, 1e-300), 0.0)
    weights = vectors @ (inverse * (vectors.T @ cross[:-1, -1]))
    return weights, float(mean[-1] - weights @ mean[:-1])


@dataclass
class MomentSpec:
    """A model and its parameters; ``KEYS`` are the parameters it knows."""

    name: str
    params: dict = field(default_factory=dict)
    kind: str = "regressor"
    KEYS = ()

    def __post_init__(self):
        unknown = sorted(set(self.params) - set(self.KEYS))
        if unknown:
            raise ValueError(f"{self.name} has no parameters {unknown}; it has {list(self.KEYS)}")

    def with_params(self, **params) -> "MomentSpec":
        from .regression import _strip
        return type(self)(self.name, {**self.params, **_strip(params)}, self.kind)

    def map_key(self):
        """What the feature map depends on."""
        return None

    def feature_map(self, features: Sequence[str], base: GramSum) -> FeatureMap:
        return FeatureMap()

    def solve(self, total: GramSum) -> tuple[np.ndarray, float]:
        return _ridge(total, 0.0)

    def fit(self, df: DataFrame, features: Sequence[str], label: str):
        """The model fitted on all rows of ``df``."""
        return fit_moments([(self, list(features), label)], df.withColumn("_part", F.lit(0)), 1)[0][0]


class LinearSpec(MomentSpec):
    """Ordinary least squares with intercept."""

    KEYS = ("fit_intercept", "n_jobs")


class PCRSpec(MomentSpec):
    """Centred principal components (all, k of them, or a share of the variance), then linear regression."""

    KEYS = ("n_components",)

    def solve(self, total):
        cross, mean = total.cross, total.mean
        values, vectors = np.linalg.eigh(cross[:-1, :-1])
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        wanted = self.params.get("n_components")
        if wanted is None:
            k = len(values)
        elif isinstance(wanted, float) and 0 < wanted < 1:
            share = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones_like(values)
            k = int(np.searchsorted(share, wanted, side="right") + 1)
        else:
            k = int(wanted)
        k = max(1, min(k, len(values)))
        inverse = np.where(values[:k] > FLOOR * values[0], 1.0 / np.maximum(values[:k], 1e-300), 0.0)
        weights = vectors[:, :k] @ (inverse * (vectors[:, :k].T @ cross[:-1, -1]))
        return weights, float(mean[-1] - weights @ mean[:-1])


class RFFSpec(MomentSpec):
    """RBF-kernel regression re-aimed: random Fourier features (Rahimi and Recht), then least squares with the squared
    weights over ``C`` as penalty.  The squared loss has no insensitive tube and is solved directly, so ``epsilon`` and
    ``tol`` are accepted for grids written for a support vector machine and change nothing."""

    KEYS = ("C", "gamma", "kernel", "epsilon", "tol", "n_features", "random_state")

    def map_key(self):
        if self.params.get("kernel", "rbf") != "rbf":
            raise ValueError("kernel is 'rbf'")
        return self.params.get("gamma", "scale"), int(self.params.get("n_features", 200)), int(self.params.get("random_state", 42))

    def feature_map(self, features, base):
        gamma, width, seed = self.map_key()
        d = len(features)
        if gamma == "scale":  # 1 / (columns * variance of all entries of the matrix)
            mean, var = base.mean[:-1], np.diag(base.cross)[:-1] / max(base.n, 1)
            spread = float(np.mean(var + mean**2) - np.mean(mean) ** 2)
            gamma = 1.0 / (d * spread) if spread > 0 else 1.0
        elif gamma == "auto":
            gamma = 1.0 / d
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, math.sqrt(2.0 * float(gamma)), size=(d, width))
        b, scale = rng.uniform(0, 2 * math.pi, size=width), math.sqrt(2.0 / width)
        terms = lambda j: " + ".join(f"CAST({q(c)} AS DOUBLE) * ({float(w[i, j])!r}D)" for i, c in enumerate(features))
        sql = "array(" + ", ".join(f"{scale!r}D * cos({terms(j)} + {float(b[j])!r}D)" for j in range(width)) + ")"
        return FeatureMap(lambda x: scale * np.cos(x @ w + b), sql, width)

    def solve(self, total):
        return _ridge(total, 1.0 / max(float(self.params.get("C", 1.0)), 1e-12))


class RandomHiddenSpec(MomentSpec):
    """MLP re-aimed: standardised inputs, one or more seeded random hidden layers, least squares with ``alpha`` as penalty."""

    KEYS = ("hidden_layer_sizes", "activation", "alpha", "random_state", "max_iter")

    def map_key(self):
        sizes = self.params.get("hidden_layer_sizes", (100,))
        sizes = (sizes,) if isinstance(sizes, int) else tuple(sizes)
        act = self.params.get("activation", "relu")
        if act not in ("relu", "tanh"):
            raise ValueError("activation is 'relu' or 'tanh'")
        return sizes, act, int(self.params.get("random_state", 42))

    def feature_map(self, features, base):
        sizes, act, seed = self.map_key()
        rng = np.random.default_rng(seed)
        mean, std = base.mean[:-1], np.sqrt(np.clip(np.diag(base.cross)[:-1], 0, None) / max(base.n, 1))
        std[std == 0] = 1.0
        layers, before = [], len(features)
        for h in sizes:
            layers.append((rng.normal(0.0, 1.0 / math.sqrt(before), size=(before, h)), rng.normal(0.0, 0.1, size=h)))
            before = h

        def apply(x: np.ndarray) -> np.ndarray:
            x = (x - mean) / std
            for w, b in layers:
                x = x @ w + b
                x = np.maximum(x, 0.0) if act == "relu" else np.tanh(x)
            return x

        # each layer is one array column, so the text grows with the number of weights and not with the depth
        numbers = lambda v: "array(" + ", ".join(f"{float(x)!r}D" for x in v) + ")"
        sql = "array(" + ", ".join(f"((CAST({q(c)} AS DOUBLE) - ({float(mean[i])!r}D)) / ({float(std[i])!r}D))" for i, c in enumerate(features)) + ")"
        for w, b in layers:
            rows = "array(" + ", ".join(numbers(np.append(w[:, j], b[j])) for j in range(len(b))) + ")"
            z = f"aggregate(zip_with(_x, slice(_w, 1, {len(w)}), (p, r) -> p * r), element_at(_w, -1), (s, v) -> s + v)"
            out = f"greatest({z}, 0D)" if act == "relu" else f"tanh({z})"
            sql = f"element_at(transform(array({sql}), _x -> transform({rows}, _w -> {out})), 1)"
        return FeatureMap(apply, sql, before)

    def solve(self, total):
        return _ridge(total, float(self.params.get("alpha", 0.0001)))


def _fitted(spec: MomentSpec, features: list[str], fmap: FeatureMap, total: GramSum):
    from .regression import Fitted
    weights, intercept = spec.solve(total)
    if fmap.sql is None:
        # a principal-component model ranks no variables
        return Fitted(features, None, coefficients=dict(zip(features, weights.tolist())), intercept=intercept, weights=weights, ranked=isinstance(spec, LinearSpec))
    return Fitted(features, None, features_sql=fmap.sql, intercept=intercept, weights=weights)


def _sums(models: Sequence[tuple[MomentSpec, list[str], str]], df: DataFrame, n_groups: int, base: list[list[GramSum]] | None, use: Sequence[int]):
    """(feature maps, sums per group) of each model; models with one map and label share their sums."""
    if base is None:
        base = gram_sums(df, [GramJob(f, y) for _, f, y in models], "_part", n_groups)
    maps, keys, jobs = [], [], {}
    for (spec, features, label), parts in zip(models, base):
        train = sum((parts[g] for g in use[1:]), parts[use[0]])
        fmap = spec.feature_map(features, train)
        key = (type(spec).__name__, spec.map_key(), tuple(features), label)
        maps.append(fmap)
        keys.append(key)
        if fmap.apply is not None:
            jobs.setdefault(key, GramJob(features, label, fmap.apply, fmap.width))
    found = dict(zip(jobs, gram_sums(df, list(jobs.values()), "_part", n_groups))) if jobs else {}
    return maps, [found.get(k, b) for k, b in zip(keys, base)]


def fit_moments(models: Sequence[tuple[MomentSpec, list[str], str]], df: DataFrame, n_groups: int) -> list[tuple]:
    """(fitted on group 0, (R^2, RMSE) per group) of each model; ``_part`` holds the group, rows with nulls are left out."""
    maps, sums = _sums(models, df, n_groups, None, [0])
    out = []
    for (spec, features, _), fmap, parts in zip(models, maps, sums):
        fitted = _fitted(spec, features, fmap, parts[0])
        out.append((fitted, [p.errors(fitted.weights, fitted.intercept) for p in parts]))
    return out


def grid_points(grid: Mapping[str, Sequence] | None) -> list[dict]:
    """All combinations of a grid, the last key running fastest."""
    grid = grid or {}
    return [dict(zip(grid, v)) for v in itertools.product(*grid.values())]


def fold_column(test_size: float, seed: int, folds: int, idx: str = ROW_IDX):
    """0..folds-1 for training rows, ``folds`` for test rows."""
    fold = F.floor(hash_uniform(idx, seed + 1) * folds).cast("int")
    return F.when(hash_uniform(idx, seed) < F.lit(float(test_size)), F.lit(int(folds))).otherwise(fold)


def search_moments(spec: MomentSpec, grid: Mapping[str, Sequence] | None, cases: Sequence[tuple[list[str], str]], df: DataFrame, folds: int) -> list[tuple]:
    """For each case (features, label): (best point, its CV score, fitted on all training rows, train and test errors).

    ``_part`` holds the fold of a training row and ``folds`` for a test row.  One pass gives the raw sums of all cases; one
    more (or as many as ``PASS_BYTES`` asks for) the sums of all feature maps of the grid.  Of equal scores the first point wins.
    """
    points = grid_points(grid)
    specs = [spec.with_params(**p) for p in points]
    base = gram_sums(df, [GramJob(list(f), y) for f, y in cases], "_part", folds + 1)
    models = [(s, list(f), y) for f, y in cases for s in specs]
    maps, sums = _sums(models, df, folds + 1, [b for b in base for _ in specs], list(range(folds)))
    out = []
    for at in range(0, len(models), len(specs)):
        scores = []
        for k in range(at, at + len(specs)):
            total = sum(sums[k][1:folds], sums[k][0])
            held = []
            for part in sums[k][:folds]:
                weights, intercept = models[k][0].solve(total - part)
                held.append(part.errors(weights, intercept)[0])
            scores.append(float(np.mean(held)))
        best = int(np.argmax(scores))
        k = at + best
        total = sum(sums[k][1:folds], sums[k][0])
        fitted = _fitted(models[k][0], models[k][1], maps[k], total)
        out.append((points[best], scores[best], fitted, total.errors(fitted.weights, fitted.intercept), sums[k][folds].errors(fitted.weights, fitted.intercept)))
    return out
