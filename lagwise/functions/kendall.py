"""Kendall tau-b on Spark without gathering a group or pairing all rows.

tau_b = (n0 - n1 - n2 + n3 - 2 nd) / sqrt((n0 - n1) (n0 - n2)), with n0 the
pairs, n1 / n2 / n3 the pairs tied in x / y / both and nd the discordant pairs.
The tie terms are grouped counts.  ``nd`` is the number of inversions of y
when rows are sorted by (x, y): for lexicographically ordered rows a pair is
discordant exactly when the earlier y is larger.  Rows are compressed to
distinct (x, y) with a weight first, then

* a dense index over (group, x, y) cuts the rows into blocks of fixed size;
  inversions inside a block are counted per block by a vectorised merge
  (numpy, O(m log^2 m));
* pairs in different blocks are counted on levels: a node of level 1 holds
  ``Q`` neighbouring blocks, a node of level L holds ``Q`` nodes of level
  L - 1, and one node of the last level holds every row.  On each level a
  distinct y of a node is one row with the weights of the node's ``Q``
  children, and a distributed running total over y gives what the earlier
  children hold above it.

No task's share grows with a group: a block and a row of a node have a fixed
size, and rows of one hot y value meet only as ``Q`` sums a node.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.index import with_row_index
from ..session import durable, ship_package

_Q = 32            # children of a node
_MAX_BLOCKS = None  # a group has as many blocks as it needs
_MIN_BLOCK = 4096  # rows of a block


def weighted_inversions(y: np.ndarray, w: np.ndarray) -> float:
    """sum over i < j of w_i * w_j * [y_i > y_j] (sequence order = array order)."""
    n = len(y)
    if n < 2:
        return 0.0
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    big = int(rank.max()) + 1
    w = np.asarray(w, dtype=float)
    order = np.arange(n)
    total = 0.0
    s = 1
    pos = np.arange(n)
    while s < n:
        run = pos // s
        pair = run // 2
        left = (run % 2) == 0
        lo_idx = order[left]
        ro_idx = order[~left]
        if len(ro_idx):
            keys_l = pair[left] * big + rank[lo_idx]
            cw = np.concatenate([[0.0], np.cumsum(w[lo_idx])])
            pr = pair[~left]
            at = np.searchsorted(keys_l, pr * big + rank[ro_idx], side="right")
            end = np.searchsorted(keys_l, pr * big + big - 1, side="right")
            total += float(np.sum(w[ro_idx] * (cw[end] - cw[at])))
        order = order[np.lexsort((rank[order], pair))]
        s *= 2
    return total


def kendall_tau_b(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., corr) from valid pairs (group..., x, y)."""
    group = list(group)
    spark = pairs.sparkSession
    ship_package(spark)
    # distinct (x, y) with their weight, indexed over (group, x, y); the index step checkpoints it once and
    # every later step (tie sums, y-buckets, blocks) reads that
    counted = pairs.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ix = with_row_index(counted, [*group, "x", "y"], name="_pos")
    wts = ix

    # tie terms: n0, n1 (x ties), n2 (y ties), n3 (joint ties)
    def c2(c):
        return c * (c - 1) / 2.0

    tot = wts.groupBy(*group).agg(F.sum("w").alias("N"), F.sum(c2(F.col("w"))).alias("n3"))
    tx = wts.groupBy(*group, "x").agg(F.sum("w").alias("t")).groupBy(*group).agg(F.sum(c2(F.col("t"))).alias("n1"))
    ty = wts.groupBy(*group, "y").agg(F.sum("w").alias("t")).groupBy(*group).agg(F.sum(c2(F.col("t"))).alias("n2"))

    inv_schema = ", ".join([f"`{g}` {t}" for g, t in _types(pairs, group)] + ["inv double"])

    def within_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        out = pdf[group].iloc[:1].copy()
        out["inv"] = weighted_inversions(pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return out

    # blocks over the (group, x, y) order
    blk = ix.withColumn("block", F.floor(F.col("_pos") / F.lit(_MIN_BLOCK)).cast("long"))
    nd = blk.select(*group, "block", "_pos", "y", "w").groupBy(*group, "block").applyInPandas(within_block, inv_schema)
    blocks = (ix.agg(F.max("_pos")).collect()[0][0] or 0) // _MIN_BLOCK + 1
    if blocks > 1:
        nd = nd.unionByName(_across_blocks(blk, group, blocks))
    nd = nd.groupBy(*group).agg(F.sum("inv").alias("nd"))
    res = tot.join(tx, group).join(ty, group).join(nd, group, "left").fillna(0.0, subset=["nd"])
    n0 = F.col("N") * (F.col("N") - 1) / 2.0
    num = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2.0 * F.col("nd")
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return res.select(*group, F.when(den > 0, num / den).alias("corr"))


def _across_blocks(blk: DataFrame, group: list[str], blocks: int) -> DataFrame:
    """(group..., inv): inversions between rows of different blocks."""
    levels = 1
    while _Q ** levels < blocks:
        levels += 1
    one = blk.groupBy(*group, "block", "y").agg(F.sum("w").alias("w"))
    nodes = [F.struct(F.lit(k).alias("level"), F.floor(F.col("block") / F.lit(_Q ** k)).alias("node"),
                      (F.floor(F.col("block") / F.lit(_Q ** (k - 1))) % _Q).cast("int").alias("child"))
             for k in range(1, levels + 1)]
    key = [*group, "level", "node"]
    rows = (one.select(*group, "y", "w", F.explode(F.array(*nodes)).alias("_s")).select(*group, "y", "w", "_s.*")
            .groupBy(*key, "y").agg(*[F.sum(F.when(F.col("child") == c, F.col("w")).otherwise(0.0)).alias(f"c{c}")
                                      for c in range(_Q)]))
    # running totals over descending y: range partitions spread one large node over many tasks
    cols = [f"c{c}" for c in range(_Q)]
    ranged = durable(rows.repartitionByRange(*[F.col(k) for k in key], F.col("y").desc())
                     .withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy("_pid", *key).orderBy(F.col("y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.select("_pid", *key, *cols, *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"b{c}") for c in cols])
    # one row per (partition, node) that a node spans: a node's rows <= partitions
    totals = ranged.groupBy("_pid", *key).agg(*[F.sum(c).alias(c) for c in cols])
    earlier = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"o{c}") for c in cols])
    # a row of child c is below what the children before c hold at a larger y
    above, inv = F.lit(0.0), F.lit(0.0)
    for c in range(1, _Q):
        above = above + F.col(f"bc{c - 1}") + F.col(f"oc{c - 1}")
        inv = inv + F.col(f"c{c}") * above
    return here.join(offsets, ["_pid", *key]).select(*group, inv.alias("inv"))


def _types(df: DataFrame, cols: Sequence[str]):
    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(c, t[c]) for c in cols]
