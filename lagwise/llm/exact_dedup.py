"""Exact deduplication by progressive refinement: byte length, then prefix hash, then hash of the full content.

Each step looks only at rows that the step before could not tell apart:

1. lengths that occur more than once (a count per length; no content is hashed);
2. among rows of such lengths, (length, prefix hash) pairs that occur more than once;
3. among rows of such pairs, the SHA-256 of the whole text; equal (length, digest) is one group.

What survives a step reaches the next scan as a bit set of fixed size (``2**BITS`` bits in at most ``2**(BITS-6)``
rows), the only thing ever broadcast.  Two keys on one bit cost an extra hash, never a wrong group, because step 3
groups by the full digest.  Texts are never shuffled for the comparison: only keys and ids are, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

BITS = 22  #: log2 of the bit-set size: 65,536 rows of 64 bits
PREFIX_CHARS = 64  #: characters hashed in step 2


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def _bit_set(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): the set of hashed keys; at most 2**(BITS-6) rows whatever the input."""
    place = _place(F.col(key))
    return (keys.select(F.floor(place / 64).cast("int").alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("__bit"))
            .groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))


def _flag(df: DataFrame, key: str, bits: DataFrame, out: str) -> DataFrame:
    """Add boolean ``out``: the key's bit is set.  A broadcast join against the bounded bit set; no shuffle."""
    place = _place(F.col(key))
    return (df.withColumn("__word", F.floor(place / 64).cast("int"))
            .join(F.broadcast(bits), "__word", "left")
            .withColumn(out, F.coalesce(F.getbit("__bits", F.pmod(place, F.lit(64)).cast("int")), F.lit(0)) == 1)
            .drop("__word", "__bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept`` for every row, dropped ones too.

    Texts are equal when identical; a null text equals the empty one.  Of equal texts the row with the largest id
    stays; a null id counts as smaller than any other.  Rows that repeat both text and id share one decision.  An
    input column with the name of a result column is replaced.  An empty table gives an empty result.
    """
    rows = docs.drop(*[c for c in ("keep_id", "group_size", "kept") if c not in (id_col, text_col)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.withColumn("__len", F.octet_length(text)).withColumn("__pre", F.xxhash64("__len", F.substring(text, 1, PREFIX_CHARS)))
    lengths = rows.groupBy("__len").count().filter("count > 1")
    same_length = _flag(rows.select("__len", "__pre"), "__len", _bit_set(lengths, "__len"), "__maybe").filter("__maybe")
    prefixes = same_length.groupBy("__pre").count().filter("count > 1")
    marked = _flag(rows, "__pre", _bit_set(prefixes, "__pre"), "__maybe").withColumn("__full", F.when(F.col("__maybe"), F.sha2(text, 256)))
    groups = (marked.filter("__maybe").groupBy("__len", "__full")
              .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    groups = stored(groups, "exact-groups")  # read from files, so that Spark may split a hot group's rows in the join
    out = marked.join(groups, ["__len", "__full"], "left")
    return (out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")))
            .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
            .drop("__len", "__pre", "__maybe", "__full"))
