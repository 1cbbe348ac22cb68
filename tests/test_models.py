"""Linear algebra against numpy on planted systems: DMD with control, PLS, OLS, PCA."""

import numpy as np
import pandas as pd
import pytest

from lagwise.operators import anomaly as an
from lagwise.operators.dmdc import fit_dmdc
from lagwise.operators.index import with_row_index


def test_dmdc_recovers_planted_system(spark):
    """x' = A x + B u with known A, B; window 1, full rank."""
    rng = np.random.default_rng(0)
    A = np.array([[0.9, 0.1], [-0.2, 0.8]])
    B = np.array([[0.5], [0.3]])
    n = 400
    x = np.zeros((n, 2))
    u = rng.normal(size=(n, 1))
    x[0] = [1.0, -1.0]
    for t in range(n - 1):
        x[t + 1] = A @ x[t] + B @ u[t]
    pdf = pd.DataFrame({"t": np.arange(n), "x1": x[:, 0], "x2": x[:, 1], "u": u[:, 0]})
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    model = fit_dmdc(df, ["x1", "x2"], ["u"], "x1", window=1, rank=3, train_ratio=0.7)
    # in standardised units: A_s = S^-1 A S, B_s = S^-1 B s_u
    sx = np.array([model.std["x1"], model.std["x2"]])
    A_raw = np.diag(sx) @ model.A @ np.diag(1 / sx)
    # standardising leaves a small constant offset the model has no intercept for (as in the reference)
    np.testing.assert_allclose(A_raw, A, atol=2e-3)
    sim = model.simulate(50).toPandas()
    assert len(sim) == 50
    assert np.corrcoef(sim["prediction"], sim["actual"])[0, 1] > 0.999
    one = model.one_step().toPandas()
    assert len(one) == n - 1
    np.testing.assert_allclose(one["prediction"], one["actual"], atol=5e-3)
    with pytest.raises(ValueError):
        fit_dmdc(df, ["x1"], [], "x1")
    with pytest.raises(ValueError):
        fit_dmdc(df, ["x1"], ["u"], "x2")
    with pytest.raises(ValueError):
        fit_dmdc(df, ["x1", "x2"], ["u"], "x1", window=1, rank=10)


def _frame(spark, n=300, d=4, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    y = X @ rng.normal(size=d) + 0.1 * rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(d)])
    pdf["y"] = y
    pdf["t"] = np.arange(n)
    return pdf, with_row_index(spark.createDataFrame(pdf), "t").drop("t")


def _nipals_pls1(X, y, k):
    Xs = (X - X.mean(0)) / X.std(0, ddof=1)
    ys = (y - y.mean()) / y.std(ddof=1)
    W, P, Q = [], [], []
    Xk, yk = Xs.copy(), ys.copy()
    for _ in range(k):
        w = Xk.T @ yk
        w /= np.linalg.norm(w)
        t = Xk @ w
        p = Xk.T @ t / (t @ t)
        q = yk @ t / (t @ t)
        Xk = Xk - np.outer(t, p)
        yk = yk - t * q
        W.append(w), P.append(p), Q.append(q)
    W, P = np.array(W).T, np.array(P).T
    R = W @ np.linalg.inv(P.T @ W)
    coef = R @ np.array(Q) * y.std(ddof=1) / X.std(0, ddof=1)
    return y.mean() - X.mean(0) @ coef, coef


def test_pls_and_ols_match_numpy(spark):
    pdf, df = _frame(spark)
    X, y = pdf[[f"x{i}" for i in range(4)]].values, pdf["y"].values
    b0, b = an.pls1_coefficients(df, [f"x{i}" for i in range(4)], "y", 3)
    e0, e = _nipals_pls1(X, y, 3)
    np.testing.assert_allclose(b, e, rtol=1e-8)
    assert abs(b0 - e0) < 1e-8
    o0, o = an.ols_coefficients(df, [f"x{i}" for i in range(4)], "y")
    ref = np.linalg.lstsq(np.c_[np.ones(len(X)), X], y, rcond=None)[0]
    np.testing.assert_allclose(np.r_[o0, o], ref, rtol=1e-8)


def test_pca_reconstruction_matches_numpy(spark):
    pdf, df = _frame(spark)
    cols = [f"x{i}" for i in range(4)] + ["y"]
    err = an.pca_reconstruction_error(df, cols, 2).orderBy("row_idx").toPandas()["recon_error"].values
    Z = (pdf[cols].values - pdf[cols].values.mean(0)) / pdf[cols].values.std(0)
    u, s, vt = np.linalg.svd(Z, full_matrices=False)
    rec = Z @ vt[:2].T @ vt[:2]
    np.testing.assert_allclose(err, ((Z - rec) ** 2).mean(1), atol=1e-9)


def test_votes_cleaned_and_flagged_partition(spark):
    """S3: planted spikes are flagged; cleaned + flagged = original."""
    rng = np.random.default_rng(3)
    n = 500
    v = np.sin(np.arange(n) / 20) + 0.05 * rng.normal(size=n)
    spikes = [60, 160, 260, 360, 460]
    v[spikes] += 8
    pdf = pd.DataFrame({"t": np.arange(n), "v": v, "w": rng.normal(size=n)})
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    votes = an.detect_anomalies(df, "v", 0, ["zscore", "rolling", "pca", "lin_reg", "iso_forest", "lof", "pls"])
    flagged = {r["row_idx"] for r in an.flagged(votes, 2).collect()}
    assert set(spikes) <= flagged
    cleaned = an.drop_anomalies(df, votes, 2)
    assert cleaned.count() + len(flagged) == n
    assert an.detect_anomalies(df, "v", 0, []) is None


def test_keyed_anomalies_stay_inside_keys(spark):
    """A rolling window never mixes two series: the first window-1 rows of each key get no rolling flag."""
    rng = np.random.default_rng(9)
    rows = [(k, t, float(rng.normal()) + (50.0 if (k == 1 and t == 30) else 0.0)) for k in range(3) for t in range(40)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    df = with_row_index(spark.createDataFrame(pdf), "t", partition_by="k").drop("t")
    votes = an.detect_anomalies(df, "v", 0, ["zscore", "rolling"], {"rolling_window": 10}, keys=["k"])
    got = votes.toPandas().sort_values("row_idx")
    assert len(got) == 120
    first = got[got["row_idx"] % 40 < 9]
    assert (first["RollingStats"] == 0).all()
    assert got.loc[got["row_idx"] == 70, "Zscore"].item() == 1


def test_degenerate_inputs_do_not_fail(spark):
    """Constant columns, heavy ties and NULLs run through every detector and correlation method."""
    from lagwise.functions.correlation import lag_correlation
    rng = np.random.default_rng(12)
    n = 120
    pdf = pd.DataFrame({"t": np.arange(n), "const": 2.0, "ties": rng.integers(0, 3, n).astype(float),
                        "x": rng.normal(size=n), "y": rng.normal(size=n)})
    pdf.loc[::17, "x"] = None
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    votes = an.detect_anomalies(df, "y", 1, list(an.METHOD_FLAGS))
    expected = pdf.drop(columns="t").shift(1).assign(y=pdf["y"]).dropna()  # rows lost to the lag or a NULL
    assert votes.count() == len(expected)
    flat = with_row_index(spark.createDataFrame(pdf.assign(y=1.0)), "t").drop("t")
    assert an.detect_anomalies(flat, "y", 0, ["zscore", "rolling", "pca", "lin_reg", "pls"]).count() == pdf["x"].notna().sum()
    for m in ("pearson", "spearman", "kendall"):
        got = {(r.variable, r.lag): r.corr for r in lag_correlation(df, "y", 3, m).collect()}
        assert got[("const", 0)] is None and got[("ties", 1)] is not None


def test_column_names_with_spaces(spark):
    """The reference's columns carry spaces ('top Temperature'); every operator must quote them."""
    from lagwise.functions.correlation import lag_correlation
    from lagwise.operators.lag import lag_table, multi_lag_table
    from lagwise.operators.rolling import rolling_stats
    from lagwise.operators import optimize as op
    from lagwise.operators.regression import lag_sweep, builders
    rng = np.random.default_rng(13)
    n = 150
    pdf = pd.DataFrame({"t": np.arange(n), "top Temperature": rng.uniform(0, 1, n),
                        "reflux flow": rng.uniform(0, 1, n), "C4 content": rng.uniform(0, 1, n)})
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    assert "top Temperature_lag2" in lag_table(df, 2, "C4 content").columns
    for m in ("pearson", "spearman", "kendall"):
        assert lag_correlation(df, "C4 content", 3, m).count() == 6
    assert rolling_stats(df, "C4 content", 5).filter("roll_mean IS NOT NULL").count() == n - 4
    assert an.detect_anomalies(df, "C4 content", 1, list(an.METHOD_FLAGS)).count() == n - 1
    assert fit_dmdc(df, ["C4 content", "top Temperature"], ["reflux flow"], "C4 content", 3, 4).one_step().count() == n - 3
    assert lag_sweep(df, "C4 content", builders.linear, max_lag=2).results.count() == 3
    t = multi_lag_table(df, ["top Temperature", "reflux flow"], ["C4 content"], 1, 1)
    preds = [c for c in t.columns if c not in ("row_idx", "C4 content")]
    model = {"C4 content": op.ExprModel(0.0, {"top Temperature": 1.0, "reflux flow": -1.0})}
    assert op.optimize_rows(model, t, preds, ["C4 content"], "C4 content", free_vars=["top Temperature"],
                            budget=8).count() == n - 1


def test_forecast_horizon_on_planted_ar_process(spark):
    """A strongly autocorrelated series is forecast well a few steps ahead; one row per part."""
    from lagwise.operators.regression import forecast_horizon, builders
    rng = np.random.default_rng(16)
    n = 400
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.95 * y[t - 1] + 0.1 * rng.normal()
    pdf = pd.DataFrame({"t": np.arange(n), "y": y})
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    metrics, preds = forecast_horizon(df, ["y"], "y", n_in=4, n_out=2, builder=builders.linear, train_ratio=0.7)
    m = {r["part"]: r for r in metrics.collect()}
    assert set(m) == {"train", "test"} and m["test"]["r2"] > 0.5
    assert preds.count() == 2 * (n - int(n * 0.7) - 4 - 2 + 1)


def test_lag_sweep_ignores_non_numeric_columns(spark):
    from pyspark.sql import functions as F
    from lagwise.operators.regression import lag_sweep, builders
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({"t": np.arange(80), "x": rng.normal(size=80), "y": rng.normal(size=80)})
    df = with_row_index(spark.createDataFrame(pdf), "t").withColumn("when", F.current_timestamp()) \
        .withColumn("tag", F.lit("a"))
    res = lag_sweep(df.drop("t"), "y", builders.linear, max_lag=1)
    assert res.results.count() == 2 and res.best_model.features[0] == f"x_lag{res.best_lag}"


def test_classifier_sweep_reads_every_value_of_an_array(spark):
    from lagwise.operators.regression import lag_sweep, builders
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 12))
    rows = [(i, v[i].tolist(), int(v[i, 11] > 0)) for i in range(300)]  # the class is in the last value alone
    df = spark.createDataFrame(rows, "row_idx long, embedding array<double>, label int")
    res = lag_sweep(df, "label", lambda: builders.random_forest_classifier(n_estimators=5, max_depth=3), max_lag=1)
    best = {r.lag: r.test_accuracy for r in res.results.collect()}
    assert res.best_lag == 0 and best[0] > 0.9
    assert max(res.best_model.importances, key=res.best_model.importances.get) == "embedding_lag0[11]"


def test_classifier_query_takes_whole_vectors_and_all_lags(spark, monkeypatch):
    from lagwise.plans import queries
    seen = {}

    def sweep(df, target, builder, **given):
        seen.update(width=df.selectExpr("max(size(embedding))").collect()[0][0], params=builder().params, given=given)
        return queries.rg.SweepResult(spark.range(1), 0, None, {})

    monkeypatch.setattr(queries.rg, "lag_sweep", sweep)
    queries.REGISTRY["lag_sweep_classifier"](spark, "/root/testdata/sf0.001")
    assert seen == {"width": 64, "params": {}, "given": {}}


def test_dmdc_simulations_cover_the_whole_test_part(spark):
    from lagwise.plans import queries as Q
    model = Q._dmdc(spark, "/root/testdata/sf0.001")
    assert (model.window, model.B.shape) == (50, (150, 2))
    later = model.n_samples - model.split_idx - 1
    sim = model.simulate(100, every=100).toPandas()
    assert sorted(sim.origin + sim.step) == list(range(model.split_idx + 1, model.n_samples))
    assert len(sim) == later
    assert len(model.simulate(100, origins=2, every=70).toPandas()) == 200
    assert Q.REGISTRY["dmdc_simulate"](spark, "/root/testdata/sf0.001").count() == later
    assert Q.REGISTRY["dmdc_metrics"](spark, "/root/testdata/sf0.001").collect()[0]["n"] == later
    assert Q.REGISTRY["dmdc_rolling_origin"](spark, "/root/testdata/sf0.001").agg({"steps": "sum"}).collect()[0][0] == later


def test_registered_sweeps_run_all_lags_with_default_trees(spark, monkeypatch):
    from lagwise.plans import queries as Q
    seen = {}

    def sweep(df, target, builder, max_lag=23, grid=None, **given):
        seen[name] = (max_lag, builder().params.get("n_estimators", 100), grid)
        return Q.rg.SweepResult(spark.createDataFrame([], "lag int, test_r2 double, test_rmse double"), 0, None, {})

    monkeypatch.setattr(Q.rg, "lag_sweep", sweep)
    monkeypatch.setattr(Q.rg, "lag_metric_curves", lambda results: results.selectExpr("lag", "true best_r2", "true best_rmse"))
    names = [f"lag_sweep_{k}" for k in ("rf", "gbt", "boosted", "pcr", "rff", "hidden", "linear_all")] + ["grid_search", "lag_metric_curves_all"]
    for name in names:
        Q.REGISTRY[name](spark, "/root/testdata/sf0.001")
    grid = {"hidden_layer_sizes": [(50,), (100,), (50, 50)], "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001]}
    assert seen == {name: (23, 100, grid if name == "grid_search" else None) for name in names}


def test_too_deep_trees_are_refused():
    from lagwise.operators.regression import builders
    for build in (builders.random_forest, builders.random_forest_classifier, builders.gbt):
        with pytest.raises(ValueError, match="max_depth=31"):
            build(max_depth=31).estimator("y")


def test_window_gram_equals_stored_windows(spark):
    from lagwise.functions.lagmoments import window_gram
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) + 5
    df = with_row_index(spark.createDataFrame(pd.DataFrame({"t": range(60), "a b": x[:, 0], "b": x[:, 1], "c": x[:, 2]})), "t").drop("t")
    for width, start, stop, size in ((1, 0, 60, 7), (4, 0, 50, 5), (4, 3, 57, 64), (6, 10, 11, 9), (5, 0, 0, 8)):
        gram, sums, n = window_gram(df, ["a b", "b", "c"], width, start, stop, bucket_rows=size)
        z = np.array([x[t:t + width].ravel() for t in range(start, stop)]).reshape(-1, 3 * width)
        assert n == len(z)
        np.testing.assert_allclose(gram, z.T @ z, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(sums, z.sum(axis=0), rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="missing"):
        window_gram(df, ["b"], 4, 0, 60)


def test_gram_sums_of_wide_frames(spark):
    """500 columns in one pass, groups, nulls, and a feature map."""
    from pyspark.sql import functions as F
    from lagwise.functions.gram import GramJob, gram_sums
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 501)) + 100
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(501)]).assign(g=np.arange(300) % 4)
    df = spark.createDataFrame(pdf).repartition(3)
    out = gram_sums(df, [GramJob([f"c{i}" for i in range(500)], "c500")], "g", 3)[0]
    for g in range(3):
        z = x[np.arange(300) % 4 == g]
        np.testing.assert_allclose(out[g].mean, z.mean(axis=0))
        np.testing.assert_allclose(out[g].cross, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), atol=1e-7)
    small = df.select("g", "c0", F.when(F.col("c0") > 100, F.col("c1")).alias("c1"))
    got = gram_sums(small, [GramJob(["c0"], "c1", lambda v: np.column_stack([v, v**2]), 2)])[0][0]
    keep = x[:, 0] > 100
    z = np.column_stack([x[keep, 0], x[keep, 0] ** 2, x[keep, 1]])
    assert got.n == keep.sum()
    np.testing.assert_allclose(got.cross, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-6)


def test_grid_from_fold_sums_equals_separate_fits(spark):
    """Scores, choice and errors from Gram sums equal fits on each fold's rows; the scored expression equals the sums' errors."""
    from pyspark.sql import functions as F
    from lagwise.functions.metrics import r2_expr, rmse_expr
    from lagwise.operators.moment_models import fold_column, search_moments
    from lagwise.operators.regression import builders
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = np.sin(x[:, 0]) + x[:, 1] * 0.5 + rng.normal(size=240) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"row_idx": range(240), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    parted = df.withColumn("_part", fold_column(0.3, 42, 3))
    cases = ((builders.pcr(), {"pca__n_components": [1, 2, 0.99, None]}),
             (builders.rff(n_features=20), {"svr__C": [0.01, 10], "svr__gamma": ["scale", "auto", 0.3], "svr__tol": [1e-3, 1e-4]}),
             (builders.random_hidden(), {"mlp__hidden_layer_sizes": [(8,), (6, 5)], "mlp__activation": ["relu", "tanh"], "mlp__alpha": [0.01]}))
    for spec, grid in cases:
        point, score, fitted, train, test = search_moments(spec, grid, [(["a", "b", "c"], "y")], parted, 3)[0]
        for part, want in (("_part < 3", train), ("_part = 3", test)):
            got = fitted.transform(parted.filter(part)).agg(r2_expr("y"), rmse_expr("y")).collect()[0]
            np.testing.assert_allclose(list(got), want, rtol=1e-7)
        if spec.name == "pcr":
            scores = []
            parts = np.array([r["_part"] for r in parted.orderBy("row_idx").select("_part").collect()])
            for k in (1, 2, 3, 3):
                held = []
                for f in range(3):
                    tr, te = (parts != f) & (parts < 3), parts == f
                    mu = x[tr].mean(axis=0)
                    v = np.linalg.svd(x[tr] - mu, full_matrices=False)[2][:k].T
                    design = np.column_stack([np.ones(tr.sum()), (x[tr] - mu) @ v])
                    w = np.linalg.lstsq(design, y[tr], rcond=None)[0]
                    err = y[te] - np.column_stack([np.ones(te.sum()), (x[te] - mu) @ v]) @ w
                    held.append(1 - (err**2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
                scores.append(np.mean(held))
            assert score == pytest.approx(max(scores)) and point["pca__n_components"] == [1, 2, 0.99, None][int(np.argmax(np.round(scores, 9)))]


def test_unknown_parameters_and_large_tree_grids_are_refused(spark):
    from lagwise.operators.regression import builders, grid_search
    for build in (builders.pcr, builders.rff, builders.random_hidden, builders.gbt, builders.random_forest, builders.linear):
        with pytest.raises(ValueError, match="nonsense"):
            build(nonsense=1)
        with pytest.raises(ValueError, match="nonsense"):
            build().with_params(nonsense=1)
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(9)], "row_idx long, x double, y double")
    with pytest.raises(ValueError, match="max_fits"):
        grid_search(builders.gbt, {"n_estimators": [1, 2], "max_depth": [1, 2]}, df, ["x"], "y", max_fits=11)
    best, spec = grid_search(lambda: builders.gbt(n_estimators=2), {"max_depth": [1, 2]}, df, ["x"], "y", folds=2)
    assert best["max_depth"] in (1, 2) and spec.params["max_depth"] == best["max_depth"]


def test_multi_lag_sweep_finds_the_planted_lag(spark):
    from lagwise.operators.regression import builders, multi_lag_sweep
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    y = np.roll(x, 2) + 0.01 * rng.normal(size=200)
    df = with_row_index(spark.createDataFrame(pd.DataFrame({"t": range(200), "x": x, "noise": rng.normal(size=200), "y": y, "z": -y})), "t").drop("t")
    for build, grid in ((builders.linear, None), (builders.pcr, {"n_components": [1, 2]}), (lambda: builders.gbt(n_estimators=5), None)):
        res = multi_lag_sweep(df, ["x", "noise"], ["y", "z"], build, max_lag=3, grid=grid, drop=["noise"])
        assert res.best_lag == 2 and set(res.best_models) == {"y", "z"} and res.best_models["y"].features == ["x_lag2"]
        assert res.results.count() == 12


def test_evaluation_holds_test_rows_only(spark):
    from pyspark.sql import functions as F
    from lagwise.functions.split import hash_uniform
    from lagwise.operators.regression import builders, evaluate_multi_regression
    df = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(60)], "row_idx long, x double, y double")
    models = {"y": builders.linear().fit(df, ["x"], "y")}
    out = evaluate_multi_regression(models, df)["y"]
    held = df.filter(hash_uniform("row_idx", 42) < 0.3).count()
    assert out["series"].count() == 60 and out["residuals"].count() == held
    assert out["histogram"].agg(F.sum("count")).collect()[0][0] == held


def test_sweep_keeps_large_forests_in_the_shared_folder(spark, monkeypatch):
    """A sweep leaves no forest of many nodes on the driver; the model read back predicts as the one that was kept."""
    from lagwise.operators import regression as rg
    rng = np.random.default_rng(8)
    df = with_row_index(spark.createDataFrame([(i, rng.normal(size=4).tolist(), int(rng.integers(0, 3))) for i in range(150)], "t long, x array<double>, y int"), "t").drop("t")

    def forest():
        return rg.builders.random_forest_classifier(n_estimators=3)

    assert forest().estimator("y").getCacheNodeIds()
    kept = rg.lag_sweep(df, "y", forest, max_lag=1)
    monkeypatch.setattr(rg, "KEPT_NODES", 10)
    away = rg.lag_sweep(df, "y", forest, max_lag=1)
    assert all(m.saved is None and m.model is not None for m in kept.models.values())
    assert all(m.saved is not None and m.model is None for m in away.models.values())
    assert away.results.collect() == kept.results.collect() and away.best_lag == kept.best_lag
    assert away.best_model.importances == kept.best_model.importances
    rows = df.select("row_idx", "y", *[df.x.alias(f"x_lag{k}") for k in (0, 1)])
    assert away.best_model.transform(rows).orderBy("row_idx").collect() == kept.best_model.transform(rows).orderBy("row_idx").collect()
