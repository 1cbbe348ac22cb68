"""H3: distributed running totals and average ranks.

``running_total`` gives every row the sum of a weight over the rows before it
in a total order, restricted to its group.  It range-partitions on
(group, order), so one large group is spread over many tasks; each partition
runs a bounded window, and the totals of earlier partitions come from a small
(partition x group) table.  ``average_rank`` applies it to the distinct values
of a column (ties weigh their count), so a value held by a third of all rows is
one row in that step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable


def running_total(df: DataFrame, order_by: Sequence[str], weight: str, group_by: Sequence[str] = (),
                  out: str = "_before") -> DataFrame:
    """Add ``out`` = sum of ``weight`` over earlier rows of the same group (0 for the first)."""
    group_by, order_by = list(group_by), list(order_by)
    keys = group_by + order_by
    ranged = durable(df.repartitionByRange(*[F.col(k) for k in keys])
                     .withColumn("_pid", F.spark_partition_id()))
    w_in = (Window.partitionBy("_pid", *group_by).orderBy(*order_by)
            .rowsBetween(Window.unboundedPreceding, -1))
    within = ranged.withColumn("_cum_in", F.coalesce(F.sum(weight).over(w_in), F.lit(0)))
    totals = ranged.groupBy("_pid", *group_by).agg(F.sum(weight).alias("_tot"))
    if group_by:
        # one row per (partition, group) a group spans: a group's rows <= partitions
        w_off = (Window.partitionBy(*group_by).orderBy("_pid")
                 .rowsBetween(Window.unboundedPreceding, -1))
        offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(w_off), F.lit(0))).drop("_tot")
        res = within.join(offsets, ["_pid", *group_by], "inner")
    else:
        # one group: one total per partition, bounded by the partition count
        rows, run = [], 0
        for r in totals.orderBy("_pid").collect():
            rows.append((int(r["_pid"]), run))
            run += r["_tot"]
        offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "_pid int, _off long")
        res = within.join(F.broadcast(offsets), ["_pid"], "inner")
    return res.withColumn(out, F.col("_off") + F.col("_cum_in")).drop("_pid", "_off", "_cum_in")


def average_rank(df: DataFrame, value: str, group_by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Distinct (group, value) with the average 1-based rank of ``value`` inside its group.

    NULL values are not ranked.  rank = (rows with a smaller value) + (ties + 1) / 2.
    """
    group_by = list(group_by)
    distinct = (df.filter(F.col(value).isNotNull())
                .groupBy(*group_by, value).agg(F.count(F.lit(1)).alias("_w")))
    ranked = running_total(distinct, [value], "_w", group_by)
    return ranked.select(*group_by, value,
                         (F.col("_before") + (F.col("_w") + 1) / 2.0).alias(out))
