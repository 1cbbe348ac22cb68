"""Training-order materialisation: fixed-length token sequences at pseudo-random global slots, in fixed-stride shards.

Texts become byte tokens: ids 0 to 254 are the bytes of UTF-8 (which never uses 255), ``END`` = 255 ends each text and
fills up the last sequence of a scan partition.  The texts of a partition are packed one after another and cut into
sequences of ``length`` ids.  Sequence number i goes to slot ``P(i)``, where P is a keyed Feistel permutation of
[0, total): a balanced Feistel network over the next even number of bits, walked along its cycle until it lands inside
the range.  So the order is a bijection without any sort, and the slot of a sequence needs only its number.

Sequence numbers are dense: partition totals come from byte lengths alone, as one light aggregate.  The second pass
checks its own totals against them.  Slots are range-partitioned: shard s holds slots [s * per_shard, (s + 1) *
per_shard), each sequence at byte (slot mod per_shard) * length, so any slot is read with one seek.  A task writes a
shard under a temporary name and then renames it; a shard that is there in full is left alone, so a broken run resumes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .store import map_arrow

END = 255
LENGTH = 2048  #: ids of a sequence, one byte each
PER_SHARD = 8192  #: sequences of a shard: 16 MB
ROUNDS = 6

_U = np.uint64


def feistel(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The keyed permutation of [0, total) applied to numbers."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = [tx.mix(np.array([(key * 1_000_003 + r) % (1 << 64)], dtype=_U))[0] for r in range(ROUNDS)]
    out = np.asarray(numbers).astype(_U)
    todo = np.arange(len(out))
    while len(todo):  # cycle-walking: fewer than four steps on average
        left, right = out[todo] >> _U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (tx.mix(right + k) & mask)
        out[todo] = left << _U(half) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def _sequences(docs: DataFrame, starts: dict[int, int], counts: dict[int, int], total: int, length: int, key: int) -> DataFrame:
    """(slot, id, at, record): packed sequences with the text each one starts in and the byte of that text."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, end = starts.get(part, 0), starts.get(part, 0) + counts.get(part, 0)

        def rows(data: np.ndarray, owner: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            n = len(data) // length
            if number + n > end:
                raise RuntimeError("the partition holds more sequences than were counted; read from stored files")
            slots = feistel(np.arange(number, number + n), total, key)
            number += n
            cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(length)), pa.py_buffer(np.ascontiguousarray(data))])
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(owner), pa.array(at), cells], names=["slot", "id", "at", "record"])

        held = np.zeros(0, dtype=np.uint8)  # not cut yet; and the text and byte that its first byte belongs to
        held_id, held_at = -1, 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, hi, data, offs in tx.chunks(batch.column(1), 4 << 20):
                # each text followed by END
                ends = offs[1:] + np.arange(1, hi - lo + 1)
                stream = np.full(ends[-1], END, dtype=np.uint8)
                place = np.ones(len(stream), dtype=bool)
                place[ends - 1] = False
                stream[place] = data
                whole = np.concatenate([held, stream])
                n = len(whole) // length
                cut = np.arange(n + 1, dtype=np.int64) * length - len(held)  # in the stream; negative: in what was held
                row = np.searchsorted(ends, cut, "right")
                begin = np.append(0, ends)
                inside = (cut >= 0) & (row < hi - lo)
                owner = np.where(inside, ids[lo:hi][np.minimum(row, hi - lo - 1)], held_id)
                at = np.where(inside, cut - begin[np.minimum(row, hi - lo)], held_at)
                if n:
                    yield rows(whole[:n * length], owner[:n], at[:n])
                    held_id, held_at = (int(owner[n]), int(at[n])) if inside[n] else (held_id, held_at)
                elif not len(held):
                    held_id, held_at = int(ids[lo]), 0
                held = whole[n * length:].copy()
                if not len(held):
                    held_id, held_at = -1, 0
        if len(held):
            yield rows(np.concatenate([held, np.full(length - len(held), END, dtype=np.uint8)]), np.array([held_id]), np.array([held_at]))
        if number != end:
            raise RuntimeError("the partition holds fewer sequences than were counted; read from stored files")
    return map_arrow(docs, job, "slot long, id long, at long, record binary")


def _written(rows: DataFrame, path: str, length: int, per_shard: int, total: int) -> DataFrame:
    """Write each partition's shards; rows come sorted by slot, whole shards in one partition."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        open_, out, name, temp = None, None, "", ""

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temp, name)

        for batch in batches:
            slots = np.asarray(batch.column("slot"))
            shards = slots // per_shard
            for s in np.unique(shards):
                mine = np.flatnonzero(shards == s)
                if s != open_:
                    close()
                    open_, out = s, None
                    name = f"{base}/shard-{s:08d}.bin"
                    want = (min(total, (int(s) + 1) * per_shard) - int(s) * per_shard) * length
                    if fs.get_file_info(name).size != want:
                        temp = f"{base}/.{uuid.uuid4().hex}"
                        out = fs.open_output_stream(temp)
                if out is not None:
                    out.write(b"".join(batch.column("record").take(pa.array(mine)).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(shards), pa.array((slots - shards * per_shard) * length), batch.column("id"), batch.column("at")],
                                             names=["slot", "shard", "offset", "id", "at"])
        close()
    return map_arrow(rows, job, "slot long, shard long, offset long, id long, at long")


def materialise_order(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20240229) -> DataFrame:
    """Write ``docs`` as shards under ``path`` and return (slot, shard, offset, id, at) per sequence: where it lies, the text
    in which it starts and at which byte.

    ``docs`` must be read straight from files, whose scan is the same each time (the totals are checked).  ``path``: a
    folder that all executors share.  A null text is empty; a null id is written as -1.  An empty table writes nothing.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one row per scan partition
    sizes = (rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("text") + 1).alias("n")).orderBy("part").collect())
    counts = {r["part"]: -(-r["n"] // length) for r in sizes}
    starts, total = {}, 0
    for part, n in counts.items():
        starts[part], total = total, total + n
    made = _sequences(rows, starts, counts, total, length, key)
    tasks = max(1, -(-total // per_shard))
    placed = made.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartition(tasks, "shard").sortWithinPartitions("slot")
    return _written(placed.select("slot", "record", "id", "at"), path, length, per_shard, total)


def read_slots(path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[bytes]:
    """The sequences at slots [first, first + count), in order, by seeking; a training loop resumes from any slot."""
    fs, base = pafs.FileSystem.from_uri(path)
    slot = first
    while slot < first + count:
        shard = slot // per_shard
        with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek((slot - shard * per_shard) * length)
            while slot < min(first + count, (shard + 1) * per_shard):
                yield f.read(length)
                slot += 1
