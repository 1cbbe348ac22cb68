"""H1: a dense, deterministic row index over an explicit total order.

The reference relies on the implicit position of rows in a file.  On Spark the
order has to be named.  ``with_row_index`` range-partitions on the whole order
tuple (Spark samples the tuple, so one hot leading value is split by the later
keys), sorts inside each partition and numbers rows with
``monotonically_increasing_id``.  The numbered rows are checkpointed so that
the partition cuts are fixed, then each partition gets the count of all rows in
earlier partitions through a broadcast join whose size is bounded by the
number of partitions.  No step moves the table to one task.

Rows of equal order keys share a range partition and stand side by side in it,
so the pass that counts the partitions also compares each row with the one
before it: an order that is not total is refused without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import durable, map_arrow

ROW_IDX = "row_idx"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row number
_MAX_OFFSET_ROWS = 1_000_000  # partitions; far above any real shuffle width


def _as_list(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns hold the same value; NULLs are the same, and so are NaNs."""
    out = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        out = pc.or_(out, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return np.asarray(out)


def _count_rows(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_pid, _n, _tie): rows of each partition, and the first row whose keys equal those of the row before it."""
    types = {f.name: f.dataType for f in numbered.schema.fields}
    flat = [F.to_json(F.struct(_q(k))) if isinstance(types[k], (T.StructType, T.ArrayType)) else _q(k) for k in keys]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            last = batch.slice(batch.num_rows - 1)
            rid = np.asarray(table.column(0).combine_chunks())
            part = rid >> _LOCAL_BITS
            same = part[1:] == part[:-1]
            for col in table.columns[1:]:
                if not same.any():
                    break
                col = col.combine_chunks()
                same &= _same(col.slice(1), col.slice(0, len(col) - 1))
            pids, counts = np.unique(part[len(rid) - batch.num_rows:], return_counts=True)
            ties = rid[1:][same]
            first = [int(t[0]) if len(t := ties[ties >> _LOCAL_BITS == p]) else None for p in pids]
            yield pa.RecordBatch.from_arrays([pa.array(pids), pa.array(counts.astype(np.int64)), pa.array(first, pa.int64())], names=["_pid", "_n", "_tie"])

    found = map_arrow(numbered.select("_rid", *[c.alias(f"k{i}") for i, c in enumerate(flat)]), job, "_pid long, _n long, _tie long")
    return found.groupBy("_pid").agg(F.sum("_n").alias("_n"), F.min("_tie").alias("_tie"))


def with_row_index(df: DataFrame, order_by: str | Sequence[str], partition_by: str | Sequence[str] = (),
                   name: str = ROW_IDX, validate: bool = True, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in (partition_by, order_by) order.

    With ``partition_by`` the series of one key are contiguous in the index, so
    ordered operators mask at key changes instead of windowing per key (a key
    holding a third of all rows still spreads over many tasks).

    An order that is not total (two rows with equal keys; NULLs are equal) raises
    ValueError.  ``validate=False`` accepts it: tied rows keep the order that the
    sort happened to give them.
    """
    keys = _as_list(partition_by) + _as_list(order_by)
    if not keys:
        raise ValueError("an explicit order_by is required: Spark rows have no implicit position")
    spark = df.sparkSession
    sort_cols = [_q(k).asc_nulls_first() for k in keys]
    if partitions:
        ranged = df.repartitionByRange(partitions, *sort_cols)
    else:
        ranged = df.repartitionByRange(*sort_cols)
    numbered = durable(ranged.sortWithinPartitions(*sort_cols)
                       .withColumn("_rid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_rid"), _LOCAL_BITS)
    if validate:
        counted = _count_rows(numbered, keys)
    else:
        counted = numbered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_tie", F.lit(None))
    counts = counted.orderBy("_pid").collect()
    if len(counts) > _MAX_OFFSET_ROWS:
        raise RuntimeError("too many partitions for the offset table")
    tie = next((r["_tie"] for r in counts if r["_tie"] is not None), None)
    if tie is not None:
        dup = numbered.filter(F.col("_rid") == tie).select(*[_q(k) for k in keys]).collect()[0]
        raise ValueError(f"order {keys} is not total: duplicate key {dup.asDict()}")
    offsets, running = [], 0
    for r in counts:
        offsets.append((int(r["_pid"]), running))
        running += int(r["_n"])
    offset_df = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    local = F.col("_rid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = (numbered.withColumn("_pid", pid)
           .join(F.broadcast(offset_df), "_pid", "inner")
           .withColumn(name, (F.col("_off") + local).cast("long"))
           .drop("_pid", "_off", "_rid"))
    out = out.select(name, *[_q(c) for c in out.columns if c != name])
    out._lagwise_rows = running  # known total, saves a count later
    return out


def row_count(df: DataFrame, name: str = ROW_IDX) -> int:
    """Rows of an indexed frame: remembered from indexing, else max(index)+1."""
    n = getattr(df, "_lagwise_rows", None)
    if n is not None:
        return int(n)
    r = df.agg(F.max(name).alias("m")).collect()[0]["m"]
    return 0 if r is None else int(r) + 1


def keep_rows(src: DataFrame, out: DataFrame) -> DataFrame:
    """Carry the remembered row count over to a frame with the same rows."""
    n = getattr(src, "_lagwise_rows", None)
    if n is not None:
        out._lagwise_rows = n
    return out
