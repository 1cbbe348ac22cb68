"""Ordered panels derived from the shipped test tables.

The reference reads one CSV of sensor readings in time order.  The test tables
stand in for it (see FIXTURES.md): every panel here is a Spark aggregate or
projection of a whole table, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .io import nan_to_null

P1_FEATURES = ["qty", "price", "disc", "tax", "n"]
P1_TARGET = "revenue"
P4_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: str):
    return F.col(c).cast("decimal(18,2)")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ship day (order ``day``) -- qty, price, disc, tax, n, revenue.

    Sums run on exact decimals (the inputs carry two decimals), so the panel is
    the same to the last bit whatever the summation order of the engine.
    """
    li = table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1)).cast("double")
    return nan_to_null(li.groupBy(F.col("l_shipdate").alias("day")).agg(
        F.sum(_cents("l_quantity")).cast("double").alias("qty"),
        F.sum(_cents("l_extendedprice")).cast("double").alias("price"),
        (F.sum(_cents("l_discount")).cast("double") / n).alias("disc"),
        (F.sum(_cents("l_tax")).cast("double") / n).alias("tax"),
        n.alias("n"),
        F.sum(_cents("l_extendedprice") * (F.lit(1) - _cents("l_discount"))).cast("double").alias("revenue"),
    ))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with value and hour of day; order ``event_id`` (key ``user_id`` for P3)."""
    ev = table(spark, sf_dir, "events")
    return nan_to_null(ev.select("event_id", "user_id", "value",
                                 F.hour("ts").cast("double").alias("hour")))


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level lineitem series ordered by its five-column unique key."""
    li = table(spark, sf_dir, "lineitem")
    return nan_to_null(li.select(*P4_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: small point set (c_acctbal, c_nationkey) keyed by c_custkey."""
    c = table(spark, sf_dir, "customer")
    return nan_to_null(c.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors with an integer class label, keyed by vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")
