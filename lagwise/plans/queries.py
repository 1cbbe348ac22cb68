"""Registered queries: each runs one operator family over a whole test table.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose double
columns are rounded to a fixed number of decimals, the same rounding as the
matching SQL in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import correlation as corr
from ..functions import metrics as mt
from ..functions import scale as scl
from ..functions import split as spl
from ..functions import stats as st
from ..operators import anomaly as an
from ..operators import dmdc as dm
from ..operators import lag as lagops
from ..operators import optimize as op
from ..operators import regression as rg
from ..operators import rolling as roll
from ..operators.index import keep_rows, with_row_index
from ..session import checkpoint_dir
from ..sources import io as sio
from ..sources import panels

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6
P1_FEATURES = panels.P1_FEATURES
P1_TARGET = panels.P1_TARGET


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def round_half_away(c, digits: int = DIGITS):
    """round(x * 10^d) / 10^d on the binary value: the rounding the SQL oracle applies, so equal
    doubles round equally in both engines (rounding the decimal text of a double can differ at .5)."""
    m = float(10 ** digits)
    return F.round(c * F.lit(m), 0) / F.lit(m)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed daily panel without the timestamp column."""
    _session(spark)
    ix = with_row_index(panels.daily_panel(spark, sf_dir), "day")
    return keep_rows(ix, ix.drop("day"))


def p2(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    _session(spark)
    ev = panels.event_series(spark, sf_dir)
    if keyed:
        return with_row_index(ev, "event_id", partition_by="user_id")
    return with_row_index(ev, "event_id")


# ---------------------------------------------------------------- H1, D1-D6

@register("row_index")
def q_row_index(spark, sf_dir):
    _session(spark)
    li = panels.lineitem_rows(spark, sf_dir)
    return with_row_index(li, panels.P4_KEY).select("row_idx", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("lag_table")
def q_lag_table(spark, sf_dir):
    return lagops.lag_table(p1(spark, sf_dir), 3, P1_TARGET, target_lags=2)


@register("lag_table_notebook")
def q_lag_table_notebook(spark, sf_dir):
    return lagops.lag_table(p1(spark, sf_dir), 13, P1_TARGET, mode="notebook")


@register("multi_lag_table")
def q_multi_lag_table(spark, sf_dir):
    return lagops.multi_lag_table(p1(spark, sf_dir), ["qty", "disc", "tax"], ["revenue", "n"], 2, 1)


@register("lag_table_multi_target")
def q_lag_table_multi_target(spark, sf_dir):
    return lagops.lag_table_multi_target(p1(spark, sf_dir), 2, ["qty", "disc", "tax"], ["revenue", "price"])


@register("lag_table_keyed")
def q_lag_table_keyed(spark, sf_dir):
    ev = p2(spark, sf_dir, keyed=True).select("row_idx", "user_id", "value", "hour")
    return lagops.lag_table(ev, 2, "value", keys=["user_id"], target_lags=1)


@register("single_lag_tables")
def q_single_lag_tables(spark, sf_dir):
    return lagops.single_lag_tables(p1(spark, sf_dir), P1_TARGET, [0, 5, 13])


# ---------------------------------------------------------------- F3-F8

@register("lag_corr_pearson")
def q_lag_corr_pearson(spark, sf_dir):
    return rounded(corr.lag_correlation(p1(spark, sf_dir), P1_TARGET, 24, "pearson"))


@register("lag_corr_spearman")
def q_lag_corr_spearman(spark, sf_dir):
    return rounded(corr.lag_correlation(p1(spark, sf_dir), P1_TARGET, 24, "spearman"))


@register("best_lags")
def q_best_lags(spark, sf_dir):
    return rounded(corr.best_lags(corr.lag_correlation(p1(spark, sf_dir), P1_TARGET, 24, "pearson")))


@register("best_lag_table")
def q_best_lag_table(spark, sf_dir):
    """D5 in long form (row_idx, variable, lag, value, revenue): lag names vary with the data."""
    df = p1(spark, sf_dir)
    best = corr.best_lags_dict(corr.lag_correlation(df, P1_TARGET, 24, "pearson"))
    wide = lagops.best_lag_table(df, P1_TARGET, best)
    items = [F.struct(F.lit(v).alias("variable"), F.lit(int(k)).alias("lag"), F.col(f"{v}_lag{k}").alias("value"))
             for v, k in best.items() if k is not None]
    return (wide.select("row_idx", P1_TARGET, F.explode(F.array(*items)).alias("_s"))
            .select("row_idx", "_s.variable", "_s.lag", "_s.value", P1_TARGET))


@register("correlation_matrix")
def q_correlation_matrix(spark, sf_dir):
    return rounded(corr.correlation_matrix(p1(spark, sf_dir)))


@register("correlation_matrix_spearman")
def q_correlation_matrix_spearman(spark, sf_dir):
    return rounded(corr.correlation_matrix(p1(spark, sf_dir), method="spearman"))


# ---------------------------------------------------------------- D7-D10


def _seq(spark, sf_dir):
    return roll.sequence_windows(p1(spark, sf_dir), ["qty", "disc", "tax"], ["revenue"], 4, 2)


def _long_nested(df: DataFrame, col: str, part: str) -> DataFrame:
    return (df.select("row_idx", F.posexplode(col).alias("step", "_row"))
            .select("row_idx", F.lit(part).alias("part"), "step", F.posexplode("_row").alias("feature", "value")))


@register("rolling_stats")
def q_rolling_stats(spark, sf_dir):
    ev = p2(spark, sf_dir).select("row_idx", "value")
    return rounded(roll.rolling_stats(ev, "value", 20))


@register("rolling_stats_keyed")
def q_rolling_stats_keyed(spark, sf_dir):
    ev = p2(spark, sf_dir, keyed=True).select("row_idx", "user_id", "value")
    return rounded(roll.rolling_stats(ev, "value", 5, keys=["user_id"]))


@register("sequence_windows")
def q_sequence_windows(spark, sf_dir):
    s = _seq(spark, sf_dir)
    return _long_nested(s, "x", "x").unionByName(_long_nested(s, "y", "y"))


@register("decoder_inputs")
def q_decoder_inputs(spark, sf_dir):
    s = roll.decoder_inputs(_seq(spark, sf_dir))
    return _long_nested(s, "decoder_in", "decoder_in")


@register("hankel_snapshots")
def q_hankel_snapshots(spark, sf_dir):
    h = roll.hankel_snapshots(p1(spark, sf_dir), ["revenue", "qty"], ["disc"], 3)
    parts = [h.select("row_idx", F.lit(name).alias("part"), F.posexplode(name).alias("pos", "value"))
             for name in ("x", "x_next", "u")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- F1, F2, F9, F18-F23

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


@register("table_info")
def q_table_info(spark, sf_dir):
    return st.table_info(p1(spark, sf_dir))


@register("describe")
def q_describe(spark, sf_dir):
    return rounded(st.describe(p1(spark, sf_dir)))


@register("describe_lineitem")
def q_describe_lineitem(spark, sf_dir):
    """F2, F10 on a table of many rows with few distinct values (quantity) and with many (price)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(st.describe(li.select(*[F.col(c).cast("double").alias(c) for c in LINE_NUMBERS])))


@register("zscore")
def q_zscore(spark, sf_dir):
    return rounded(st.zscore(p2(spark, sf_dir).select("row_idx", "value"), "value"))


@register("histogram")
def q_histogram(spark, sf_dir):
    return rounded(st.histogram(p2(spark, sf_dir), "value", 20))


@register("kde")
def q_kde(spark, sf_dir):
    return rounded(st.kde(p2(spark, sf_dir), "value", grid=50))


@register("trend")
def q_trend(spark, sf_dir):
    return rounded(st.trend(p2(spark, sf_dir), ["value", "hour"], points=100))


@register("scatter_sample")
def q_scatter_sample(spark, sf_dir):
    ev = p2(spark, sf_dir)
    return st.scatter_sample(ev, ["value", "hour"], max_points=1000, color="user_id", n=ev.count())


@register("minmax")
def q_minmax(spark, sf_dir):
    return st.minmax(p1(spark, sf_dir), ["price", "revenue"])


# ---------------------------------------------------------------- G1-G13

@register("min_max_scale")
def q_min_max_scale(spark, sf_dir):
    return rounded(scl.min_max_scale(p1(spark, sf_dir), P1_FEATURES + [P1_TARGET])[0])


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    return rounded(scl.standard_scale(p1(spark, sf_dir), P1_FEATURES + [P1_TARGET])[0])


@register("inverse_scale")
def q_inverse_scale(spark, sf_dir):
    df = p1(spark, sf_dir)
    scaled, params = scl.min_max_scale(df, ["revenue", "qty"])
    return rounded(scl.inverse_scale(scaled, ["revenue", "qty"], params).select("row_idx", "revenue", "qty"), 4)


PROCESS_MAP = {"top Temperature": "qty", "top Pressure": "disc", "6th tray Temperature": "tax",
               "bottom Temperature 1": "n", "bottom Temperature 2": "price", "reflux flow": "revenue",
               "flow to next process": "price"}


@register("process_features")
def q_process_features(spark, sf_dir):
    df = p1(spark, sf_dir)
    named = df.select("row_idx", *[F.col(src).alias(dst) for dst, src in PROCESS_MAP.items()])
    out, cols = scl.process_features(named)
    return rounded(out.select("row_idx", *[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in cols]))


# ---------------------------------------------------------------- H5, G5, G6, B11

@register("split")
def q_split(spark, sf_dir):
    return spl.split(p1(spark, sf_dir), 0.3, 42).select("row_idx", "is_test")


@register("split_stratified")
def q_split_stratified(spark, sf_dir):
    _session(spark)
    e = panels.labelled_vectors(spark, sf_dir).select("vec_id", "label")
    return spl.split(e, 0.3, 42, stratify="label", key="vec_id").select("vec_id", "label", "is_test")


@register("chrono_split")
def q_chrono_split(spark, sf_dir):
    df = p1(spark, sf_dir)
    train, test = spl.chrono_split(df, 0.7)
    return (train.select("row_idx", F.lit(False).alias("is_test"))
            .unionByName(test.select("row_idx", F.lit(True).alias("is_test"))))


# ---------------------------------------------------------------- H-1..H-11


def _ev_frame(spark, sf_dir):
    return p2(spark, sf_dir).select("row_idx", "value", "hour")


def _ev_lag(spark, sf_dir):
    return an.anomaly_lag_table(_ev_frame(spark, sf_dir), "value", 1)


def _p5(spark, sf_dir):
    _session(spark)
    return with_row_index(panels.customer_points(spark, sf_dir), "c_custkey").drop("c_custkey")


@register("anomaly_zscore")
def q_anomaly_zscore(spark, sf_dir):
    return an.detect_zscore(_ev_lag(spark, sf_dir), "value", 3.0)


@register("anomaly_rolling")
def q_anomaly_rolling(spark, sf_dir):
    return an.detect_rolling(_ev_lag(spark, sf_dir), "value", 20, 3.0)


@register("anomaly_linreg")
def q_anomaly_linreg(spark, sf_dir):
    lt = an.anomaly_lag_table(p1(spark, sf_dir).select("row_idx", "price", "revenue"), "revenue", 1)
    return an.detect_linreg(lt, ["price_lag1"], "revenue", 99)


@register("anomaly_lof")
def q_anomaly_lof(spark, sf_dir):
    lt = an.anomaly_lag_table(_p5(spark, sf_dir), "c_acctbal", 0)
    cols = ["c_nationkey_lag0", "c_acctbal"]
    return rounded(an.detect_lof(lt, cols, 20, 0.01, with_score=True))


@register("anomaly_pca")
def q_anomaly_pca(spark, sf_dir):
    lt = an.anomaly_lag_table(p1(spark, sf_dir), P1_TARGET, 1)
    return an.detect_pca(lt, [c for c in lt.columns if c != "row_idx"], 0.95, 99)


@register("anomaly_pls")
def q_anomaly_pls(spark, sf_dir):
    lt = an.anomaly_lag_table(p1(spark, sf_dir), P1_TARGET, 1)
    return an.detect_pls(lt, [c for c in lt.columns if c not in ("row_idx", P1_TARGET)], P1_TARGET, 99)


@register("anomaly_iforest")
def q_anomaly_iforest(spark, sf_dir):
    lt = an.anomaly_lag_table(p1(spark, sf_dir), P1_TARGET, 1)
    return an.detect_iforest(lt, [c for c in lt.columns if c != "row_idx"], 0.01)


def _votes(spark, sf_dir):
    return an.detect_anomalies(_ev_frame(spark, sf_dir), "value", 1, ["zscore", "rolling"])


@register("anomaly_votes")
def q_anomaly_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@register("flagged")
def q_flagged(spark, sf_dir):
    return an.flagged(_votes(spark, sf_dir), 1)


@register("cleaned")
def q_cleaned(spark, sf_dir):
    return an.drop_anomalies(_ev_frame(spark, sf_dir), _votes(spark, sf_dir), 1)


@register("flagged_points")
def q_flagged_points(spark, sf_dir):
    return an.flagged_points(_ev_frame(spark, sf_dir), _votes(spark, sf_dir), "value", 1)


@register("anomaly_all_methods")
def q_anomaly_all_methods(spark, sf_dir):
    return an.detect_anomalies(p1(spark, sf_dir), P1_TARGET, 1, list(an.METHOD_FLAGS))


@register("lag_corr_kendall")
def q_lag_corr_kendall(spark, sf_dir):
    return rounded(corr.lag_correlation(p1(spark, sf_dir), P1_TARGET, 3, "kendall"))


@register("correlation_matrix_kendall")
def q_correlation_matrix_kendall(spark, sf_dir):
    return rounded(corr.correlation_matrix(p1(spark, sf_dir), ["qty", "disc", "n", "revenue"], method="kendall"))


@register("lag_corr_kendall_all")
def q_lag_corr_kendall_all(spark, sf_dir):
    """F6 over the whole range; the SQL of ``lag_corr_kendall`` is for lags 0..2."""
    return rounded(corr.lag_correlation(p1(spark, sf_dir), P1_TARGET, 24, "kendall"))


@register("correlation_matrix_kendall_all")
def q_correlation_matrix_kendall_all(spark, sf_dir):
    """F7 over all columns; the SQL of ``correlation_matrix_kendall`` is for four."""
    return rounded(corr.correlation_matrix(p1(spark, sf_dir), method="kendall"))


# ---------------------------------------------------------------- F13-F17, I1-I20


MODEL_FEATURES = ["qty", "disc", "tax", "n"]  # price nearly determines revenue (FIXTURES.md)


def _p1_model(spark, sf_dir):
    return p1(spark, sf_dir).select("row_idx", *MODEL_FEATURES, P1_TARGET)


@register("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    df = p1(spark, sf_dir).withColumn("prediction", F.col("price") * F.lit(0.95))
    return rounded(mt.regression_metrics(df, P1_TARGET, "prediction"))


@register("residuals")
def q_residuals(spark, sf_dir):
    df = p1(spark, sf_dir).withColumn("prediction", F.col("price") * F.lit(0.95))
    return rounded(mt.residuals(df, P1_TARGET, "prediction").select("row_idx", "residual"))


@register("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    e = panels.labelled_vectors(spark, sf_dir)
    pred = F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rounded(mt.classification_metrics(e.withColumn("prediction", pred), "label", "prediction"))


def _sweep(spark, sf_dir, builder, max_lag=23, grid=None, target_lags=0):
    res = rg.lag_sweep(_p1_model(spark, sf_dir), P1_TARGET, builder, max_lag=max_lag, grid=grid,
                       target_lags=target_lags)
    return rounded(res.results)


@register("lag_sweep_linear")
def q_lag_sweep_linear(spark, sf_dir):
    df = p1(spark, sf_dir).select("row_idx", "price", P1_TARGET)
    return rounded(rg.lag_sweep(df, P1_TARGET, rg.builders.linear, max_lag=5).results)


@register("lag_sweep_linear_all")
def q_lag_sweep_linear_all(spark, sf_dir):
    """I1 over lags 0..23; the SQL of ``lag_sweep_linear`` is for lags 0..5."""
    df = p1(spark, sf_dir).select("row_idx", "price", P1_TARGET)
    return rounded(rg.lag_sweep(df, P1_TARGET, rg.builders.linear).results)


@register("lag_sweep_rf")
def q_lag_sweep_rf(spark, sf_dir):
    return _sweep(spark, sf_dir, rg.builders.random_forest)


@register("lag_sweep_gbt")
def q_lag_sweep_gbt(spark, sf_dir):
    return _sweep(spark, sf_dir, rg.builders.gbt)


@register("lag_sweep_boosted")
def q_lag_sweep_boosted(spark, sf_dir):
    return _sweep(spark, sf_dir, lambda: rg.builders.boosted_sampled(subsample=0.8, colsample_bytree=0.8))


@register("lag_sweep_pcr")
def q_lag_sweep_pcr(spark, sf_dir):
    return _sweep(spark, sf_dir, lambda: rg.builders.pcr(n_components=0.95), target_lags=1)


@register("lag_sweep_rff")
def q_lag_sweep_rff(spark, sf_dir):
    return _sweep(spark, sf_dir, rg.builders.rff)


@register("lag_sweep_hidden")
def q_lag_sweep_hidden(spark, sf_dir):
    return _sweep(spark, sf_dir, rg.builders.random_hidden)


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """I5 with the reference's network grid: 12 points, 3 folds, lags 0..23."""
    return _sweep(spark, sf_dir, rg.builders.random_hidden,
                  grid={"hidden_layer_sizes": [(50,), (100,), (50, 50)], "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001]})


@register("grid_search_svr")
def q_grid_search_svr(spark, sf_dir):
    """I5 with the reference's support vector grid: 120 points, 3 folds, lags 0..23."""
    return _sweep(spark, sf_dir, rg.builders.rff,
                  grid={"svr__C": [0.1, 1, 10, 20], "svr__gamma": ["scale", "auto", 0.01, 0.1, 1], "svr__kernel": ["rbf"],
                        "svr__epsilon": [0.01, 0.1, 0.2], "svr__tol": [1e-3, 1e-4]})


@register("grid_search_pcr")
def q_grid_search_pcr(spark, sf_dir):
    """I5 with the reference's principal component grid, one predictor, lags 0..23."""
    df = p1(spark, sf_dir).select("row_idx", "price", P1_TARGET)
    return rounded(rg.lag_sweep(df, P1_TARGET, rg.builders.pcr, grid={"pca__n_components": [0.95, 0.99, 5, 10]}).results)


@register("lag_sweep_classifier")
def q_lag_sweep_classifier(spark, sf_dir):
    """Classifier branch (I2) on the whole labelled vectors ordered by vec_id, lags 0..23."""
    _session(spark)
    e = panels.labelled_vectors(spark, sf_dir)
    ix = with_row_index(e, "vec_id")
    res = rg.lag_sweep(keep_rows(ix, ix.drop("vec_id")), "label", rg.builders.random_forest_classifier)
    return rounded(res.results)


@register("lag_metric_curves")
def q_lag_metric_curves(spark, sf_dir):
    df = p1(spark, sf_dir).select("row_idx", "price", P1_TARGET)
    return rg.lag_metric_curves(rg.lag_sweep(df, P1_TARGET, rg.builders.linear, max_lag=5).results) \
        .select("lag", "best_r2", "best_rmse")


@register("lag_metric_curves_all")
def q_lag_metric_curves_all(spark, sf_dir):
    """I12 over lags 0..23; the SQL of ``lag_metric_curves`` is for lags 0..5."""
    df = p1(spark, sf_dir).select("row_idx", "price", P1_TARGET)
    return rg.lag_metric_curves(rg.lag_sweep(df, P1_TARGET, rg.builders.linear).results) \
        .select("lag", "best_r2", "best_rmse")


@register("ols_coefficients")
def q_ols_coefficients(spark, sf_dir):
    df = p1(spark, sf_dir)
    return rounded(rg.ols_summary(df, P1_TARGET, ["price"]).select("variable", "coefficient", "std_err", "t_value"))


@register("ols_summary")
def q_ols_summary(spark, sf_dir):
    return rounded(rg.ols_summary(_p1_model(spark, sf_dir), P1_TARGET, MODEL_FEATURES))


@register("tree_importance")
def q_tree_importance(spark, sf_dir):
    res = rg.lag_sweep(_p1_model(spark, sf_dir), P1_TARGET, lambda: rg.builders.random_forest(n_estimators=30),
                       max_lag=1)
    return rounded(rg.importance(res.best_model, spark))


def _evaluated(spark, sf_dir):
    """I7 of the best lag's linear model on price: what the evaluation returns."""
    df = p1(spark, sf_dir).select("row_idx", "price", P1_TARGET)
    res = rg.lag_sweep(df, P1_TARGET, rg.builders.linear)
    return rg.evaluate_regression(res.best_model, lagops.lag_table(df, res.best_lag, P1_TARGET), P1_TARGET)


@register("evaluate_regression")
def q_evaluate_regression(spark, sf_dir):
    df = _p1_model(spark, sf_dir)
    res = rg.lag_sweep(df, P1_TARGET, rg.builders.linear)
    return rounded(rg.evaluate_regression(res.best_model, lagops.lag_table(df, res.best_lag, P1_TARGET), P1_TARGET)["histogram"])


@register("evaluate_series")
def q_evaluate_series(spark, sf_dir):
    """actual and predicted value of every row."""
    return rounded(_evaluated(spark, sf_dir)["series"], 3)


@register("evaluate_residuals")
def q_evaluate_residuals(spark, sf_dir):
    """F25 over the test rows."""
    return rounded(_evaluated(spark, sf_dir)["residuals"], 3)


@register("evaluate_range")
def q_evaluate_range(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir)["range"], 3)


@register("multi_target_metrics")
def q_multi_target_metrics(spark, sf_dir):
    res, _, _, _ = rg.fit_multi_target(p1(spark, sf_dir), ["qty", "disc", "tax"], ["revenue", "n"],
                                       rg.builders.linear, 1, 1)
    return rounded(res)


@register("multi_lag_sweep")
def q_multi_lag_sweep(spark, sf_dir):
    """I3 over lags 0..23."""
    return rounded(rg.multi_lag_sweep(p1(spark, sf_dir), ["qty", "disc", "tax"], ["revenue", "n"], rg.builders.linear).results)


@register("multi_lag_sweep_price")
def q_multi_lag_sweep_price(spark, sf_dir):
    """I3 with one predictor, lags 0..23: the case that SQL can check."""
    res = rg.multi_lag_sweep(p1(spark, sf_dir), ["price"], ["revenue", "n"], rg.builders.linear)
    return rounded(res.results.drop("params"))


@register("forecast_horizon")
def q_forecast_horizon(spark, sf_dir):
    metrics, _ = rg.forecast_horizon(p1(spark, sf_dir), ["qty", "disc", "tax", "revenue"], "revenue", 24, 12)
    return rounded(metrics)


# ---------------------------------------------------------------- I21-I24


def _dmdc(spark, sf_dir):
    return dm.fit_dmdc(p1(spark, sf_dir), ["revenue", "qty", "n"], ["disc", "tax"], "revenue")


@register("dmdc_one_step")
def q_dmdc_one_step(spark, sf_dir):
    return rounded(_dmdc(spark, sf_dir).one_step())


@register("dmdc_one_step_pair")
def q_dmdc_one_step_pair(spark, sf_dir):
    """I21/I24 with one measured column, one control and window 1: two unknowns, which SQL can solve."""
    return rounded(dm.fit_dmdc(p1(spark, sf_dir), ["revenue"], ["qty"], "revenue", window=1, rank=2).one_step())


@register("forecast_one_step")
def q_forecast_one_step(spark, sf_dir):
    """I20 with one row in and one step out: a straight line, which SQL can fit."""
    metrics, _ = rg.forecast_horizon(p1(spark, sf_dir), ["price"], "revenue", 1, 1)
    return rounded(metrics)


@register("dmdc_simulate")
def q_dmdc_simulate(spark, sf_dir):
    """I22 over the whole test part: an origin every 100 snapshots, 100 steps each."""
    return rounded(_dmdc(spark, sf_dir).simulate(100, every=100))


@register("dmdc_metrics")
def q_dmdc_metrics(spark, sf_dir):
    model = _dmdc(spark, sf_dir)
    return rounded(model.metrics(model.simulate(100, every=100)))


# ---------------------------------------------------------------- J1-J12


OPT_PREDICTORS = ["qty", "disc", "tax"]
OPT_TARGETS = ["revenue", "n"]
OPT_FREE = ["qty", "disc"]
# a fixed stand-in scorer per target, so the whole search can be replayed in SQL
FIXED_SCORER = {
    "revenue": op.ExprModel(0.1, {"qty": 0.6, "disc": -0.4, "tax": 0.2, "qty_lag1": 0.1, "revenue_lag1": 0.3}),
    "n": op.ExprModel(0.05, {"qty": 0.5, "disc": 0.25, "n_lag1": 0.2}),
}


def _opt_table(spark, sf_dir):
    """P1 scaled to [0, 1] (the optimiser's box assumes it), then the D3 table with one lag of each."""
    df = p1(spark, sf_dir)
    scaled, _ = scl.min_max_scale(df, P1_FEATURES + [P1_TARGET])
    return lagops.multi_lag_table(keep_rows(df, scaled), OPT_PREDICTORS, OPT_TARGETS, 1, 1)


def _opt_fixed(spark, sf_dir):
    t = _opt_table(spark, sf_dir)
    preds = [c for c in t.columns if c not in ("row_idx", *OPT_TARGETS)]
    res = op.optimize_rows(FIXED_SCORER, t, preds, OPT_TARGETS, "revenue", "Maximize", 0.05, OPT_FREE, budget=200)
    return op.with_actuals(res, t, OPT_TARGETS)


@register("optimize_rows")
def q_optimize_rows(spark, sf_dir):
    return rounded(_opt_fixed(spark, sf_dir).drop("actual_revenue", "actual_n"))


@register("improvement_summary")
def q_improvement_summary(spark, sf_dir):
    return rounded(op.improvement(_opt_fixed(spark, sf_dir), "revenue", "Maximize"))


@register("input_changes")
def q_input_changes(spark, sf_dir):
    return rounded(op.input_changes(_opt_fixed(spark, sf_dir), OPT_FREE))


@register("success_rate")
def q_success_rate(spark, sf_dir):
    return rounded(op.success_rate(op.improvement(_opt_fixed(spark, sf_dir), "revenue", "Maximize")))


@register("state_table")
def q_state_table(spark, sf_dir):
    return rounded(op.state_table(_opt_fixed(spark, sf_dir), OPT_TARGETS, OPT_FREE))


@register("state_table_inputs")
def q_state_table_inputs(spark, sf_dir):
    """J12/C5 with every input, the fixed ones too, in each of the three states."""
    t = _opt_table(spark, sf_dir)
    fixed = [c for c in t.columns if c not in ("row_idx", *OPT_TARGETS, *OPT_FREE)]
    return rounded(op.state_table(_opt_fixed(spark, sf_dir), OPT_TARGETS, OPT_FREE, rows=t, fixed=fixed))


@register("optimize_rows_model")
def q_optimize_rows_model(spark, sf_dir):
    """J4/J5 with fitted multi-target linear models, two generations."""
    df = p1(spark, sf_dir)
    scaled, _ = scl.min_max_scale(df, P1_FEATURES + [P1_TARGET])
    _, models, feats, t = rg.fit_multi_target(keep_rows(df, scaled), OPT_PREDICTORS, OPT_TARGETS,
                                              rg.builders.linear, 1, 1)
    res = op.optimize_rows(models, t, feats, OPT_TARGETS, "revenue", "Minimize", 0.05, OPT_FREE, budget=100,
                           generations=2, constraints=[{"name": "n", "min": 0.2, "max": 0.9, "weight": 2.0}])
    return rounded(op.with_actuals(res, t, OPT_TARGETS))


# ---------------------------------------------------------------- A1-A6


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """A3 + A1/A2: write the daily panel as CSV to the shared folder, read it back with type inference and
    datetime coercion; report the columns as read."""
    _session(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/lagwise-csv-{uuid.uuid4().hex}"
    daily = panels.daily_panel(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))
    sio.write_panel(daily, path)
    back = sio.read_panel(spark, path, "csv")
    return st.table_info(back).drop("position")


@register("csv_position")
def q_csv_position(spark, sf_dir):
    """A1 + A3: write the documents in id order as CSV (texts with quotes, commas and line breaks), read them back with
    their position; an empty text is missing."""
    _session(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/lagwise-csv-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    quoted = docs.withColumn("text", F.concat(F.lit('"\n,'), "text", F.lit(',\r\n""')))
    sio.write_panel(quoted, path, order_by="doc_id")
    back = sio.read_panel(spark, path, row_index="row_idx", coerce_dates=False)
    return back.select("row_idx", "doc_id", F.md5(F.encode("text", "utf-8")).alias("text_md5"), "lang", "source")


@register("csv_values")
def q_csv_values(spark, sf_dir):
    """A1-A3: write the daily panel as CSV in index order but without its index, days as month/day/year with a time; read
    it back: values, row order and timestamps."""
    _session(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/lagwise-csv-{uuid.uuid4().hex}"
    daily = with_row_index(panels.daily_panel(spark, sf_dir), "day").withColumn("day", F.date_format("day", "MM/dd/yyyy HH:mm"))
    sio.write_panel(daily, path, order_by="row_idx", leave_out=["row_idx"])
    back = sio.read_panel(spark, path, row_index="row_idx")
    return rounded(back.withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss")))


@register("improvement_histogram")
def q_improvement_histogram(spark, sf_dir):
    """Histogram of the optimised target's improvements, min(10, rows) bins."""
    return rounded(op.improvement_histogram(op.improvement(_opt_fixed(spark, sf_dir), "revenue", "Maximize")))


@register("skipped_rows")
def q_skipped_rows(spark, sf_dir):
    """Rows asked for (every panel row) that have no lag data, so the optimiser skips them."""
    df = p1(spark, sf_dir)
    return op.skipped_rows(df.select("row_idx"), _opt_table(spark, sf_dir))


@register("pair_plot_hist")
def q_pair_plot_hist(spark, sf_dir):
    """per-variable histograms of the pair-plot data (numeric columns <= 15)."""
    _, hists = st.pair_plot_data(p1(spark, sf_dir), P1_FEATURES + [P1_TARGET], bins=20)
    return rounded(hists)


@register("scatter_3d")
def q_scatter_3d(spark, sf_dir):
    """three axes and a colour column, bounded hash sample."""
    df = p1(spark, sf_dir)
    return st.scatter_sample(df, ["qty", "disc", "tax"], max_points=1000, color="revenue", n=df.count())


@register("preview")
def q_preview(spark, sf_dir):
    """The first five rows of the lag table in index order (the limit is the feature)."""
    return sio.preview(lagops.lag_table(p1(spark, sf_dir), 3, P1_TARGET), 5)


@register("lag_optimised_corr")
def q_lag_optimised_corr(spark, sf_dir):
    """D5 + F7: Pearson correlation matrix of the table where each variable has its own best lag."""
    df = p1(spark, sf_dir)
    best = corr.best_lags_dict(corr.lag_correlation(df, P1_TARGET, 24, "pearson"))
    return rounded(corr.correlation_matrix(lagops.best_lag_table(df, P1_TARGET, best)))


@register("lag_optimised_corr_spearman")
def q_lag_optimised_corr_spearman(spark, sf_dir):
    """D5 + F7: the best lags by Spearman, and the Spearman matrix of the table shifted by them."""
    df = p1(spark, sf_dir)
    table = corr.lag_optimised_tables(df, P1_TARGET, 24, ["spearman"])["spearman"]
    return rounded(corr.correlation_matrix(table, method="spearman"))


@register("last_row")
def q_last_row(spark, sf_dir):
    """The last row of the lag table (the optimiser's default initial point)."""
    return st.last_row(lagops.lag_table(p1(spark, sf_dir), 1, P1_TARGET))


@register("lag_corr_keyed")
def q_lag_corr_keyed(spark, sf_dir):
    """F4 on the keyed event series: lags never cross from one user's events to another's."""
    ev = p2(spark, sf_dir, keyed=True).select("row_idx", "user_id", "value", "hour")
    return rounded(corr.lag_correlation(ev, "value", 5, "pearson", features=["hour"], keys=["user_id"]))


@register("dmdc_rolling_origin")
def q_dmdc_rolling_origin(spark, sf_dir):
    """I22 as a rolling-origin job: origins 50 snapshots apart through the whole test part, 50 steps each, metrics per origin."""
    sim = _dmdc(spark, sf_dir).simulate(50, every=50)
    return rounded(sim.groupBy("origin").agg(mt.r2_expr("actual").alias("r2"), mt.rmse_expr("actual").alias("rmse"),
                                             F.count(F.lit(1)).alias("steps")))
