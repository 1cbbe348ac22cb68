"""Unit tests on small frames: index, halo windows, lags, ranks, Kendall, percentiles, linear algebra."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.functions import kendall as K
from lagwise.functions.correlation import correlation_matrix, lag_correlation, best_lags
from lagwise.functions.stats import exact_percentiles
from lagwise.functions import stats as ST
from lagwise.operators.index import with_row_index
from lagwise.operators.lag import lag_table, multi_lag_table
from lagwise.operators.rolling import rolling_stats, sequence_windows, hankel_snapshots


def _indexed(spark, pdf, order="t"):
    return with_row_index(spark.createDataFrame(pdf), order)


def test_row_index_dense_and_ordered(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": rng.permutation(5000), "v": rng.normal(size=5000)})
    df = with_row_index(spark.createDataFrame(pdf), "t", partitions=7)
    got = df.toPandas().sort_values("row_idx")
    assert got["row_idx"].tolist() == list(range(5000))
    assert got["t"].tolist() == sorted(pdf["t"])


def test_row_index_rejects_non_total_order(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": [1, 1, 2], "v": [1.0, 2.0, 3.0]}))
    with pytest.raises(ValueError):
        with_row_index(df, "t", validate=True)


def test_notebook_docstring_golden(spark):
    """A=[1,2,3,4], B=[10,20,30,40], y=[0,1,0,1], lag 1."""
    pdf = pd.DataFrame({"t": [0, 1, 2, 3], "A": [1, 2, 3, 4], "B": [10, 20, 30, 40], "y": [0, 1, 0, 1]})
    df = _indexed(spark, pdf).drop("t")
    out = lag_table(df, 1, "y", mode="notebook").orderBy("row_idx").toPandas()
    assert out[["A_lag1", "B_lag1", "y"]].values.tolist() == [[1, 10, 1], [2, 20, 0], [3, 30, 1]]
    same = lag_table(df, 0, "y", mode="notebook")
    assert same.count() == 4
    with pytest.raises(KeyError):
        lag_table(df, 1, "y", drop=["nope"], mode="notebook")


@pytest.mark.parametrize("bucket", [5, 7, 64, 100000])
def test_halo_buckets_equal_global_window(spark, bucket):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame({"t": np.arange(n), "a": rng.normal(size=n), "y": rng.normal(size=n)})
    df = _indexed(spark, pdf).drop("t")
    out = lag_table(df, 3, "y", target_lags=4, bucket_rows=max(bucket, 4)).orderBy("row_idx").toPandas()
    exp = pd.DataFrame({"a_lag3": pdf["a"].shift(3), "y": pdf["y"], **{f"y_lag{i}": pdf["y"].shift(i) for i in range(1, 5)}}).dropna()
    assert out["row_idx"].tolist() == exp.index.tolist()
    np.testing.assert_allclose(out[exp.columns].values, exp.values)
    r = rolling_stats(df, "y", 5, bucket_rows=max(bucket, 5)).orderBy("row_idx").toPandas()
    np.testing.assert_allclose(r["roll_mean"].values, pdf["y"].rolling(5).mean().values, equal_nan=True)
    np.testing.assert_allclose(r["roll_std"].values, pdf["y"].rolling(5).std().values, equal_nan=True)


def test_keyed_lags_do_not_cross_keys(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 2, 2, 3], "t": [0, 1, 2, 0, 1, 0], "v": [1.0, 2, 3, 4, 5, 6]})
    df = with_row_index(spark.createDataFrame(pdf), "t", partition_by="k")
    out = multi_lag_table(df, ["v"], [], input_lags=1, keys=["k"], bucket_rows=4).orderBy("row_idx").toPandas()
    assert out["v_lag1"].tolist() == [1.0, 2.0, 4.0]


def test_sequences_and_hankel(spark):
    n = 20
    pdf = pd.DataFrame({"t": np.arange(n), "a": np.arange(n) * 1.0, "u": np.arange(n) * 10.0})
    df = _indexed(spark, pdf).drop("t")
    s = sequence_windows(df, ["a"], ["u"], 4, 2, bucket_rows=6).orderBy("row_idx").toPandas()
    assert len(s) == n - 4 - 2 + 1
    assert [v[0] for v in s["x"].iloc[3]] == [3.0, 4.0, 5.0, 6.0]
    assert [v[0] for v in s["y"].iloc[3]] == [70.0, 80.0]
    h = hankel_snapshots(df, ["a"], ["u"], 3, bucket_rows=4).orderBy("row_idx").toPandas()
    assert len(h) == n - 3
    assert list(h["x"].iloc[5]) == [5.0, 6.0, 7.0] and list(h["x_next"].iloc[5]) == [6.0, 7.0, 8.0]
    assert list(h["u"].iloc[5]) == [70.0]


def test_spearman_with_ties_and_planted_lag(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=n + 5)
    y = np.roll(x, 5)[: n] + 0.01 * rng.normal(size=n)
    pdf = pd.DataFrame({"t": np.arange(n), "x": np.round(x[:n], 1), "y": y})
    df = _indexed(spark, pdf).drop("t")
    for method in ("pearson", "spearman", "kendall"):
        lc = lag_correlation(df, "y", 8, method)
        best = best_lags(lc).collect()[0]
        assert best["best_lag"] == 5, method
    got = {r["lag"]: r["corr"] for r in lag_correlation(df, "y", 3, "spearman").collect()}
    for k in range(3):
        pair = pd.DataFrame({"x": pdf["x"].shift(k), "y": pdf["y"]}).dropna()
        exp = pair["x"].rank().corr(pair["y"].rank())
        assert abs(got[k] - exp) < 1e-12


def _tau_b(x, y):
    n = len(x)
    num = dx = dy = 0
    for i in range(n):
        for j in range(i + 1, n):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            num += a * b
            dx += a != 0
            dy += b != 0
    return num / np.sqrt(dx * dy)


def test_kendall_blocks_and_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "_MIN_BLOCK", 7)
    monkeypatch.setattr(K, "_MAX_BLOCKS", 1000)
    monkeypatch.setattr(K, "_Q", 4)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        x = rng.integers(0, 12, 90).astype(float)
        y = (x * (g - 1) + rng.integers(0, 6, 90)).astype(float)
        rows += [(g, a, b) for a, b in zip(x, y)]
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    out = {r["g"]: r["corr"] for r in K.kendall_tau_b(spark.createDataFrame(pdf), ["g"]).collect()}
    for g in range(3):
        sub = pdf[pdf.g == g]
        assert abs(out[g] - _tau_b(sub.x.values, sub.y.values)) < 1e-12


def test_kendall_tasks_do_not_grow_with_a_group(spark, monkeypatch):
    """One hot y value with many distinct x: blocks and nodes keep their size, over several levels."""
    monkeypatch.setattr(K, "_MIN_BLOCK", 5)
    monkeypatch.setattr(K, "_Q", 3)
    seen = []

    def recorded(df, group, blocks, across=K._across_blocks):
        seen.append((blocks, df.groupBy("block").count().agg({"count": "max"}).collect()[0][0]))
        return across(df, group, blocks)

    monkeypatch.setattr(K, "_across_blocks", recorded)
    rng = np.random.default_rng(9)
    x = rng.permutation(240).astype(float)
    y = np.where(rng.random(240) < 0.6, 3.0, rng.integers(0, 30, 240))
    pdf = pd.DataFrame({"g": 1, "x": x, "y": y})
    out = K.kendall_tau_b(spark.createDataFrame(pdf), ["g"]).collect()[0]["corr"]
    assert abs(out - _tau_b(x, y)) < 1e-12
    assert seen == [(48, 5)]


def test_kendall_queries_run_all_lags_and_columns(spark):
    from lagwise.plans import queries as Q
    lags = Q.REGISTRY["lag_corr_kendall_all"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.variable, r.lag) for r in lags} == {(v, k) for v in Q.P1_FEATURES for k in range(24)}
    cells = Q.REGISTRY["correlation_matrix_kendall_all"](spark, "/root/testdata/sf0.001").collect()
    assert {r.var1 for r in cells} == {*Q.P1_FEATURES, Q.P1_TARGET} and len(cells) == 36


def test_weighted_inversions():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 64, 257):
        y = rng.integers(0, 7, n).astype(float)
        w = rng.integers(1, 5, n).astype(float)
        brute = sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if y[i] > y[j])
        assert abs(K.weighted_inversions(y, w) - brute) < 1e-9


def test_exact_percentiles_radix(spark):
    rng = np.random.default_rng(6)
    near = 1.0 + np.arange(2000) * np.finfo(float).eps  # differ in the last bits only
    cols = {"hot": np.concatenate([rng.normal(size=3000), np.full(3000, 0.25)]), "near": rng.permutation(np.tile(near, 3)),
            "wide": np.concatenate([rng.normal(size=5990) * 10.0 ** rng.integers(-300, 300, 5990), [-np.inf, np.inf, -0.0, 0.0] * 2, [5e-324] * 2]),
            "flat": np.full(6000, -3.5), "a `b`.c": rng.integers(-4, 4, 6000).astype(float)}
    df = spark.createDataFrame(pd.DataFrame({c.replace("`", ""): v for c, v in cols.items()})).repartition(9)
    ranks = [0, 1, 17, 1499, 3000, 3001, 4500, 5997, 5998, 5999]
    got = ST._order_stats(df, {c.replace("`", ""): ranks for c in cols})
    for c, v in cols.items():
        assert [got[(c.replace("`", ""), r)] for r in ranks] == np.sort(v)[ranks].tolist()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    np.testing.assert_array_equal(exact_percentiles(df, "near", probs), [x for x in np.percentile(cols["near"], [p * 100 for p in probs])])


def test_exact_percentiles_missing_values(spark):
    df = spark.createDataFrame([(1.0, None, 3), (float("nan"), None, 1), (None, None, 2), (5.0, None, None)], "x double, y double, n int")
    assert ST.exact_percentiles_many(df, {"x": [0.5, 1.0], "y": [0.5], "n": [0.25]}) == {"x": [3.0, 5.0], "y": [None], "n": [1.5]}
    assert ST.exact_percentiles(df.limit(0), "x", [0.5]) == [None]
    row = {r["variable"]: r for r in ST.describe(df).collect()}
    assert (row["x"]["count"], row["x"]["mean"], row["x"]["p50"], row["x"]["max"]) == (2, 3.0, 3.0, 5.0)
    assert (row["y"]["count"], row["y"]["p50"]) == (0, None)


def test_correlation_matrix_pearson(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["c"] = pdf.a * 2 + pdf.b
    got = {(r.var1, r.var2): r.corr for r in correlation_matrix(spark.createDataFrame(pdf)).collect()}
    exp = pdf.corr()
    for (a, b), v in got.items():
        assert abs(v - exp.loc[a, b]) < 1e-12


def test_constant_column_has_no_best_lag(spark):
    """A constant column has no correlation at any lag: best lag NULL, left out of the lag-optimised table."""
    from lagwise.operators.lag import best_lag_table
    from lagwise.functions.correlation import best_lags_dict
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"t": np.arange(100), "c": 1.0, "x": rng.normal(size=100), "y": rng.normal(size=100)})
    df = _indexed(spark, pdf).drop("t")
    best = best_lags_dict(lag_correlation(df, "y", 4, "pearson"))
    assert best["c"] is None and best["x"] is not None
    assert "c_lag" not in " ".join(best_lag_table(df, "y", best).columns)


def test_multi_target_lag0_is_projection(spark):
    from lagwise.operators.lag import lag_table_multi_target, single_lag_tables
    pdf = pd.DataFrame({"t": [0, 1, 2, 3], "a": [1.0, None, 3.0, 4.0], "y": [1.0, 2.0, 3.0, 4.0]})
    df = _indexed(spark, pdf).drop("t")
    assert lag_table_multi_target(df, 0, ["a"], ["y"]).count() == 4  # lag 0: projection, no NULL drop
    assert lag_table_multi_target(df, 1, ["a"], ["y"]).count() == 2
    long = single_lag_tables(df, "y", [0, 2]).toPandas()
    assert sorted(long.groupby("lag").size().to_dict().items()) == [(0, 3), (2, 1)]


def test_pearson_matrix_pairwise_complete(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.normal(size=60), "b": rng.normal(size=60)})
    pdf.loc[::4, "a"] = np.nan
    pdf.loc[1::5, "b"] = np.nan
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double")
    got = {(r.var1, r.var2): r.corr for r in correlation_matrix(sdf).collect()}
    assert abs(got[("a", "b")] - pdf.corr().loc["a", "b"]) < 1e-12


def test_row_index_spreads_a_hot_leading_key(spark):
    """One leading key value holds a third of all rows: the range cut on the whole order tuple still splits it."""
    rng = np.random.default_rng(14)
    n = 30000
    k = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 50, n))
    pdf = pd.DataFrame({"k": k, "t": rng.permutation(n), "v": rng.normal(size=n)})
    df = with_row_index(spark.createDataFrame(pdf), ["k", "t"], partitions=12)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < n / 4  # the hot key alone would be n / 3 in one task
    got = df.toPandas().sort_values("row_idx")
    exp = pdf.sort_values(["k", "t"])
    assert got["row_idx"].tolist() == list(range(n)) and got["t"].tolist() == exp["t"].tolist()


def test_keyed_lags_with_hot_key_span_buckets(spark):
    rng = np.random.default_rng(15)
    n = 3000
    key = np.where(np.arange(n) < n // 3, 7, rng.integers(0, 20, n))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.normal(size=n)})
    df = with_row_index(spark.createDataFrame(pdf), "t", partition_by="k")
    out = multi_lag_table(df, ["v"], [], input_lags=3, keys=["k"], bucket_rows=64).toPandas()
    exp = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    for i in (1, 2, 3):
        exp[f"v_lag{i}"] = exp.groupby("k")["v"].shift(i)
    exp = exp.dropna().reset_index()
    got = out.sort_values("row_idx").reset_index(drop=True)
    assert got["row_idx"].tolist() == exp["index"].tolist()
    np.testing.assert_allclose(got[["v_lag1", "v_lag2", "v_lag3"]].values, exp[["v_lag1", "v_lag2", "v_lag3"]].values)


def test_row_index_refuses_ties_by_default(spark):
    rows = [(float(i % 50), None if i < 2 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, `b.c` long")
    assert with_row_index(df, ["a", "b.c"], partitions=5).count() == 400  # (0, NULL) and (1, NULL) differ
    for bad in (df.union(df.filter("a = 7").limit(1)), df.union(spark.createDataFrame([(0.0, None)], df.schema)),
                df.union(spark.createDataFrame([(float("nan"), 3), (float("nan"), 3)], df.schema))):
        with pytest.raises(ValueError, match="not total"):
            with_row_index(bad, ["a", "b.c"], partitions=5)
        assert sorted(r[0] for r in with_row_index(bad, ["a", "b.c"], validate=False).select("row_idx").collect()) == list(range(bad.count()))
    with pytest.raises(ValueError, match="not total"):  # equal rows in different Arrow batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        try:
            with_row_index(df.union(df.filter("a = 7").limit(1)), ["a", "b.c"])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert with_row_index(df.limit(0), "a").count() == 0
    nested = df.select(F.struct("a", "`b.c`").alias("s"))
    assert with_row_index(nested, "s").count() == 400


@pytest.mark.parametrize("n,lags,bucket", [(900, 24, 64), (40, 30, 32), (3, 6, 8), (1, 2, 8)])
def test_spearman_ranks_once_equal_pairwise_ranks(spark, n, lags, bucket):
    """Many ties, a hot value, a constant column and lags beyond the series, against ranking every lag's pairs anew."""
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"t": np.arange(n), "a b": rng.integers(0, 6, n), "hot": np.where(rng.random(n) < 0.4, 2.5, rng.normal(size=n)), "flat": 1.0, "y": rng.integers(0, 9, n) / 4})
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    got = {(r["variable"], r["lag"]): r["corr"] for r in lag_correlation(df, "y", lags, "spearman", bucket_rows=max(bucket, lags)).collect()}
    assert len(got) == 3 * lags
    for c in ("a b", "hot", "flat"):
        for k in range(lags):
            pair = pd.DataFrame({"x": pdf[c].shift(k), "y": pdf["y"]}).dropna().rank()
            want = pair["x"].corr(pair["y"]) if len(pair) > 1 and pair["x"].nunique() > 1 and pair["y"].nunique() > 1 else None
            assert (got[(c, k)] is None) if want is None else abs(got[(c, k)] - want) < 1e-12, (c, k)
