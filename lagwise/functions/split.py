"""Deterministic train/test splits.

The random split draws a uniform number per row from the md5 of a stream name,
the seed and the row index (any SQL engine reproduces it).  A row is in the test part
when the number is below ``test_size``.  The stratified split ranks rows of a
class by that number through ``running_total`` (no per-class window on one
task) and puts the first ``round(test_size * class_rows)`` into test.  The
chronological split cuts the index at ``floor(n * train_ratio)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.index import ROW_IDX, row_count
from .rank import running_total


def text_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 48 bits of the md5 of the parts joined by ``:``.

    Not linear in any part, so numbers of neighbouring rows, seeds or streams are independent.  In SQL:
    ``('0x' || substr(md5(part || ':' || part), 1, 12))::BIGINT / 2^48``.
    """
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def hash_uniform(key: str = ROW_IDX, seed: int = 42, stream: str = "split") -> Column:
    """Uniform number in [0, 1) from the key; one independent stream for each name and seed."""
    return text_uniform(F.lit(stream), F.lit(int(seed)), F.col(key).cast("long"))


def split(df: DataFrame, test_size: float = 0.3, seed: int = 42, stratify: str | None = None,
          mode: str = "random", key: str = ROW_IDX, out: str = "is_test") -> DataFrame:
    """Add boolean ``out``: True for the test part.  ``mode``: 'random' or 'chronological'."""
    if mode == "chronological":
        n = row_count(df, key)
        cut = math.floor(n * (1.0 - float(test_size)))
        return df.withColumn(out, F.col(key) >= F.lit(cut))
    if mode != "random":
        raise ValueError("mode is 'random' or 'chronological'")
    u = hash_uniform(key, seed)
    if stratify is None:
        return df.withColumn(out, u < F.lit(float(test_size)))
    with_u = df.withColumn("_u", u)
    sizes = with_u.groupBy(stratify).agg(F.count(F.lit(1)).alias("_cn"))
    ranked = running_total(with_u.withColumn("_one", F.lit(1)), ["_u", key], "_one", [stratify])
    return (ranked.join(sizes, stratify)  # one row per class
            .withColumn(out, F.col("_before") < F.round(F.col("_cn") * F.lit(float(test_size))))
            .drop("_u", "_one", "_before", "_cn"))


def chrono_split(df: DataFrame, train_ratio: float, key: str = ROW_IDX, n: int | None = None):
    """(train, test) = rows before / from floor(n * train_ratio)."""
    n = row_count(df, key) if n is None else n
    cut = math.floor(n * float(train_ratio))
    return df.filter(F.col(key) < cut), df.filter(F.col(key) >= cut)
