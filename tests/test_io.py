"""CSV scan -- NA tokens, type inference, all-or-nothing datetime coercion, spaces in names."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F, types as T

from lagwise.sources.csv_records import POSITION, read_records
from lagwise.sources.io import coerce_datetimes, read_panel, write_panel, nan_to_null
from lagwise.functions.scale import process_features, ENGINEERED


def test_csv_types_and_datetime_coercion(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text(
        "when,bad when,top Temperature,count,flag,label\n"
        "2024-01-01 00:00:00,2024-01-01,1.5,3,True,a\n"
        "2024-01-02 00:00:00,not a date,NA,4,False,b\n"
        "2024-01-03 00:00:00,2024-01-03,2.5,5,true,NULL\n")
    df = read_panel(spark, str(p))
    types = {f.name: f.dataType for f in df.schema.fields}
    assert isinstance(types["when"], T.TimestampType)
    assert isinstance(types["bad when"], T.StringType)
    assert isinstance(types["top Temperature"], T.DoubleType)
    assert isinstance(types["count"], T.LongType)
    assert isinstance(types["flag"], T.BooleanType)
    assert isinstance(types["label"], T.StringType)
    rows = df.orderBy("when").collect()
    assert rows[1]["top Temperature"] is None and rows[2]["label"] is None


def test_integral_looking_floats_stay_double(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("x\n1.0\n2.0\n")
    assert isinstance(read_panel(spark, str(p)).schema["x"].dataType, T.DoubleType)


def test_write_partitioned_and_nan(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "lag int, v double")
    assert nan_to_null(df).filter("v IS NULL").count() == 1
    write_panel(df, str(tmp_path / "out"), partition_by="lag")
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.name.startswith("lag=")) == ["lag=0", "lag=1"]


def test_process_features_golden(spark):
    row = {"top Temperature": 1.0, "top Pressure": 2.0, "6th tray Temperature": 3.0, "bottom Temperature 1": 4.0,
           "bottom Temperature 2": 5.0, "reflux flow": 6.0, "flow to next process": 1.0}
    df = spark.createDataFrame([row, {k: v * 2 for k, v in row.items()}])
    raw, cols = process_features(df, scale=False)
    r = raw.collect()[0]
    import math
    assert cols == ENGINEERED
    assert r["PT"] == 2.0 and r["dT"] == 0.25 and r["dT2"] == 0.2 and r["Refux Ratio"] == 3.0
    assert abs(r["Log_top_T"] - math.log(3.0)) < 1e-12
    assert abs(r["reflux_times_Ttray6"] - math.log1p(3.0) * 3.0) < 1e-12
    assert r["T_all_avg"] == (1 + 3 + 4 + 5) / 4
    scaled, _ = process_features(df)
    vals = scaled.select(*[f"`{c}`" for c in cols]).collect()
    assert all(v in (0.0, 1.0) for row_ in vals for v in row_)


def test_write_lag_optimised_per_method(spark, tmp_path):
    import numpy as np
    import pandas as pd
    from lagwise.functions.correlation import write_lag_optimised
    from lagwise.operators.index import with_row_index
    rng = np.random.default_rng(2)
    x = rng.normal(size=205)
    pdf = pd.DataFrame({"t": np.arange(200), "x": x[5:205], "y": x[:200]})  # y(t) = x(t-5)
    df = with_row_index(spark.createDataFrame(pdf), "t").drop("t")
    paths = write_lag_optimised(df, "y", str(tmp_path / "opt"), max_lags=8)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["pearson", "spearman", "kendall"]
    back = spark.read.option("header", True).csv(paths[0])
    assert back.columns == ["y", "x_lag5"] and back.count() == 195
    ordered = read_panel(spark, paths[0], row_index="at").orderBy("at").collect()
    np.testing.assert_allclose([r["y"] for r in ordered], pdf["y"].to_numpy()[5:], rtol=0, atol=0)


def _csv_rows(seed, n=300):
    rnd = random.Random(seed)
    pieces = ["a", 'b"', ",", "\n", "\r\n", " ", "é", '""', "x\n\ny", ""]
    return [["".join(rnd.choices(pieces, k=rnd.randint(0, 5))) or "z" for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("split,end", [(64, "\n"), (200, "\r\n"), (1 << 20, "\n")])
def test_quoted_line_breaks_parse_in_splits(spark, tmp_path, split, end):
    """Records of any split size equal the standard library's reading of the whole file, in its order."""
    rows = _csv_rows(split)
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end)
    w.writerow(["p q", "n.m", 'h"x'])
    w.writerows(rows)
    (tmp_path / "x.csv").write_text(out.getvalue(), newline="")
    confs = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        df = read_records(spark, str(tmp_path / "x.csv"))
    finally:  # a later action may cut the file elsewhere; the records must not change
        for k, v in before.items():
            spark.conf.set(k, v)
    assert df.columns == [*POSITION, "p q", "n.m", 'h"x']
    got = df.orderBy(*POSITION[:3]).collect()
    assert [r["_row"] for r in got] == list(range(len(rows)))
    assert [[x or "" for x in r[len(POSITION):]] for r in got] == list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:]


def test_csv_dialect(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text('\ufeff\n"a\nb";x;x;\r\n5" pipe;1;2;3;9\r\n\r\n"q;""r""";;7\n')
    df = read_panel(spark, str(p), sep=";", row_index="i").orderBy("i")
    assert df.columns == ["i", "a\nb", "x", "x.1", "Unnamed: 3"]
    assert [tuple(r) for r in df.collect()] == [(0, '5" pipe', 1.0, 2, 3.0), (1, 'q;"r"', None, 7, None)]
    (tmp_path / "open.csv").write_text('a,b\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="never closed"):
        read_panel(spark, str(tmp_path / "open.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_panel(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert read_panel(spark, str(tmp_path / "head.csv")).count() == 0
    two = tmp_path / "two"
    two.mkdir()
    (two / "1.csv").write_text("a,b\n1,2\n")
    (two / "2.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_panel(spark, str(two))
    (two / "2.csv").write_text("a,b\n3,4\n5,6")
    assert [tuple(r) for r in read_panel(spark, str(two), row_index="i").orderBy("i").collect()] == [(0, 1, 2), (1, 3, 4), (2, 5, 6)]


def test_ordered_write_and_partitions(spark, tmp_path):
    rows = [(i, f'v{i},"\n{i}', float(i) / 3) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, `a.b` string, v double").repartition(7)
    write_panel(df, str(tmp_path / "o"), order_by="i", leave_out=["i"])
    back = read_panel(spark, str(tmp_path / "o"), row_index="i").orderBy("i").collect()
    assert [tuple(r) for r in back] == rows
    write_panel(df.withColumn("lag", (F.col("i") % 3).cast("int")), str(tmp_path / "p"), partition_by="lag")
    assert sorted((r["i"], r["lag"]) for r in read_panel(spark, str(tmp_path / "p")).collect()) == [(i, i % 3) for i in range(500)]


def test_date_formats(spark):
    cols = {"iso": (["2024-01-02", "2024-01-03 04:05:06"], "2024-01-03 04:05:06"), "month": (["01/02/2024 10:00", "12/31/2024 9:05:07"], "2024-12-31 09:05:07"),
            "day": (["31/12/2024", "01/02/2024"], "2024-02-01 00:00:00"), "both": (["31/12/2024", "12/31/2024"], None), "pm": (["1/2/2024 3:04 PM", "1/2/2024 12:00 AM"], "2024-01-02 00:00:00"),
            "name": (["02-Jan-2024", "3-Feb-2024 10:00"], "2024-02-03 10:00:00"), "frac": (["2024/1/2 3:04:05.123", "2024/1/2 3:04:05.5"], "2024-01-02 03:04:05.500000"),
            "clock": (["12:30", "13:00"], None), "text": (["2024-01-02", "x"], None), "none": ([None, None], None), "a.b": ([None, "1.2.2024"], "2024-02-01 00:00:00")}
    df = spark.createDataFrame(list(zip(*[v for v, _ in cols.values()])), ", ".join(f"`{c}` string" for c in cols))
    out = coerce_datetimes(df)
    last = [r for r in out.collect()][1]
    for c, (_, want) in cols.items():
        assert isinstance(out.schema[c].dataType, T.StringType if want is None else T.TimestampType), c
        assert want is None or str(last[c]) == want
