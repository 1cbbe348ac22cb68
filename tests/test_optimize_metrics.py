"""Optimiser, metrics and split properties on small frames."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lagwise.functions.metrics import classification_metrics, regression_metrics
from lagwise.functions.split import split, chrono_split
from lagwise.operators import optimize as op
from lagwise.operators.index import with_row_index


def _lagged(spark, n=50):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"row_idx": np.arange(n), "a": rng.uniform(0.2, 0.8, n), "b": rng.uniform(0.2, 0.8, n),
                        "a_lag1": rng.uniform(0, 1, n), "y": rng.uniform(0, 1, n)})
    pdf.loc[0, "a"] = 0.0  # an input at the box edge
    return spark.createDataFrame(pdf)


def test_optimizer_bounds_candidates_and_fixed(spark):
    df = _lagged(spark)
    model = {"y": op.ExprModel(0.0, {"a": 1.0, "b": -1.0, "a_lag1": 5.0})}
    res = op.optimize_rows(model, df, ["a", "b", "a_lag1"], ["y"], "y", "Maximize", 0.1, ["a", "b", "a_lag1"],
                           budget=64).toPandas().sort_values("row_idx")
    assert "opt_a_lag1" not in res.columns  # lagged predictors are always fixed (J2)
    for _, r in res.iterrows():
        for v in ("a", "b"):
            init = r[f"init_{v}"]
            lo, hi = max(0.0, init * 0.9), min(1.0, init * 1.1)
            if lo >= hi:
                lo, hi = max(0.0, init - 0.05), min(1.0, init + 0.05)
            assert lo - 1e-12 <= r[f"opt_{v}"] <= hi + 1e-12
        assert r["opt_pred_y"] >= r["init_pred_y"] - 1e-12  # the initial point is a candidate
    imp = op.improvement(spark.createDataFrame(res), "y", "Maximize").toPandas()
    assert (imp["improvement"] >= -1e-12).all()
    assert op.optimize_rows(model, df, ["a", "b"], ["y"], "y", free_vars=[]) is None


def test_optimizer_skips_rows_without_lag_data(spark):
    df = _lagged(spark)
    ids = spark.createDataFrame([(1,), (5,), (999,)], "row_idx long")
    model = {"y": op.ExprModel(0.0, {"a": 1.0})}
    res = op.optimize_rows(model, df, ["a", "b"], ["y"], "y", free_vars=["a"], row_ids=ids, budget=8)
    assert sorted(r.row_idx for r in res.collect()) == [1, 5]
    assert [r.row_idx for r in op.skipped_rows(ids, df).collect()] == [999]


def test_classification_metrics_zero_division(spark):
    """3 classes, class 2 never predicted -> its precision counts as 0."""
    pdf = pd.DataFrame({"label": [0, 0, 1, 1, 2, 2], "prediction": [0, 1, 1, 1, 0, 1]})
    m = classification_metrics(spark.createDataFrame(pdf)).collect()[0]
    # per class: P = (1/2, 2/4, 0), R = (1/2, 1, 0), F1 = (1/2, 2/3, 0), support 2 each
    assert abs(m["accuracy"] - 3 / 6) < 1e-12
    assert abs(m["precision"] - (0.5 + 0.5 + 0) / 3) < 1e-12
    assert abs(m["recall"] - (0.5 + 1 + 0) / 3) < 1e-12
    assert abs(m["f1"] - (0.5 + 2 / 3 + 0) / 3) < 1e-12


def test_r2_constant_truth(spark):
    df = spark.createDataFrame(pd.DataFrame({"label": [1.0, 1.0], "prediction": [1.0, 1.0]}))
    assert regression_metrics(df).collect()[0]["r2"] == 1.0
    df2 = spark.createDataFrame(pd.DataFrame({"label": [1.0, 1.0], "prediction": [1.0, 2.0]}))
    assert regression_metrics(df2).collect()[0]["r2"] == 0.0


def test_splits(spark):
    pdf = pd.DataFrame({"t": np.arange(1000), "c": np.arange(1000) % 3})
    df = with_row_index(spark.createDataFrame(pdf), "t")
    s = split(df, 0.3, 42).toPandas()
    assert 0.25 < s["is_test"].mean() < 0.35
    assert split(df, 0.3, 42).toPandas()["is_test"].tolist() == s["is_test"].tolist()  # deterministic
    st = split(df, 0.3, 42, stratify="c").toPandas()
    for _, g in st.groupby("c"):
        assert g["is_test"].sum() == round(len(g) * 0.3)
    train, test = chrono_split(df, 0.7)
    assert train.agg(F.max("row_idx")).collect()[0][0] == 699 and test.count() == 300


def test_state_table_has_all_inputs(spark):
    res = spark.createDataFrame([(3, 1.0, 2.0, 3.0, 4.0, 5.0)], "row_idx long, init_a double, opt_a double, init_pred_y double, opt_pred_y double, actual_y double")
    rows = spark.createDataFrame([(3, 1.0, 7.0, 8.0), (4, 0.0, 0.0, 0.0)], "row_idx long, a double, a_lag1 double, `b.c` double")
    got = op.state_table(res, ["y"], ["a"], rows=rows, fixed=["a_lag1", "b.c"])
    assert got.columns == ["row_idx", "state", "y", "a", "a_lag1", "b.c"]
    assert [tuple(r) for r in got.collect()] == [(3, "Actual", 5.0, 1.0, 7.0, 8.0), (3, "Initial", 3.0, 1.0, 7.0, 8.0), (3, "Optimized", 4.0, 2.0, 7.0, 8.0)]
    assert [tuple(r) for r in op.state_table(res, ["y"], ["a"]).collect()] == [(3, "Actual", 5.0, None), (3, "Initial", 3.0, 1.0), (3, "Optimized", 4.0, 2.0)]
