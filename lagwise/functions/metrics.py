"""Regression and classification metrics as aggregates.

R^2 = 1 - SSE / SST with SST = n * var_pop(y) (a constant truth scores 1.0 when
predicted exactly, else 0.0), RMSE = sqrt(mean squared error).  Weighted
precision / recall / F1 weigh each class by its support; a class never
predicted has precision 0 (zero_division = 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def r2_expr(y: str = "label", p: str = "prediction") -> Column:
    sse = F.sum((F.col(y) - F.col(p)) ** 2)
    sst = F.count(F.col(y)) * F.var_pop(F.col(y))
    return (F.when(sst > 0, F.lit(1.0) - sse / sst)
            .otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))))


def rmse_expr(y: str = "label", p: str = "prediction") -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2))


def regression_metrics(df: DataFrame, y: str = "label", p: str = "prediction", by=None) -> DataFrame:
    """(r2, rmse, n) overall or per group ``by``."""
    aggs = [r2_expr(y, p).alias("r2"), rmse_expr(y, p).alias("rmse"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def residuals(df: DataFrame, y: str = "label", p: str = "prediction", out: str = "residual") -> DataFrame:
    """actual - predicted."""
    return df.withColumn(out, F.col(y) - F.col(p))


def classification_metrics(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (zero_division = 0)."""
    base = df.select(F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    support = base.groupBy(F.col("_y").alias("c")).agg(F.count(F.lit(1)).alias("support"))
    predicted = base.groupBy(F.col("_p").alias("c")).agg(F.count(F.lit(1)).alias("npred"))
    tp = base.filter(F.col("_y") == F.col("_p")).groupBy(F.col("_y").alias("c")).agg(F.count(F.lit(1)).alias("tp"))
    per = (support.join(predicted, "c", "full").join(tp, "c", "left")
           .fillna(0, subset=["support", "npred", "tp"]))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("_pr", prec).withColumn("_rc", rec).withColumn(
        "_f1", F.when(F.col("_pr") + F.col("_rc") > 0,
                      2 * F.col("_pr") * F.col("_rc") / (F.col("_pr") + F.col("_rc"))).otherwise(F.lit(0.0)))
    tot = F.sum("support")
    return per.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("_pr") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("_rc") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("_f1") * F.col("support")) / tot).alias("f1"))
