"""The random streams behind splits, folds and the optimiser's candidates are independent."""

import numpy as np
from pyspark.sql import functions as F

from lagwise.functions.split import hash_uniform
from lagwise.operators.optimize import candidate_uniform


def test_split_flags_have_no_autocorrelation_and_folds_are_even(spark):
    rows = spark.range(100_000).select(F.col("id"), hash_uniform("id", 42).alias("u"), hash_uniform("id", 43).alias("v")).toPandas().sort_values("id")
    flag = (rows.u.to_numpy() < 0.3) - 0.3
    assert max(abs(np.mean(flag[d:] * flag[:-d]) / 0.21) for d in range(1, 401)) < 0.02
    train = rows[rows.u >= 0.3]
    assert np.abs(np.bincount((train.v * 3).astype(int)) / len(train) - 1 / 3).max() < 0.01


def test_candidates_fill_the_box_and_generations_differ(spark):
    c = spark.range(20_000).select(*[candidate_uniform(F.lit(1), F.col("id"), j, 42, g).alias(f"u{j}{g}") for j in (0, 1) for g in (0, 1)]).toPandas()
    cells = set(zip((c.u00 * 20).astype(int), (c.u10 * 20).astype(int)))
    assert len(cells) >= 380
    assert not set(c.u00) & set(c.u01)
