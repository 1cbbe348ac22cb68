"""Digests of encoded and decoded texts, computed where the ids are, so that long id lists never become strings in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import map_arrow

SLICE_BYTES = 1 << 20  #: text encoded at once; one longer text is encoded by itself
JOINED = 1 << 18  #: ids turned into decimals at once


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most ``limit`` bytes; a longer text is a part of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def ids_digest(ids: np.ndarray) -> str:
    """SHA-256 (lowercase hex) of the ids in decimal, joined by commas."""
    out = hashlib.sha256()
    for lo in range(0, len(ids), JOINED):
        part = pa.array(ids[lo:lo + JOINED]).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), ",")
        out.update(b"," * (lo > 0) + joined[0].as_buffer().to_pybytes())
    return out.hexdigest()


def ids_digests(ids: pa.ListArray) -> list[str]:
    """``ids_digest`` of each list; the decimals of up to ``JOINED`` ids are made at once."""
    offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    out, lo = [], 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + JOINED, "right")) - 1)
        if offsets[hi] - offsets[lo] > JOINED:
            out.append(ids_digest(flat[offsets[lo]:offsets[hi]]))
        else:
            part = pa.array(flat[offsets[lo]:offsets[hi]]).cast(pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets[lo:hi + 1] - offsets[lo], pa.int32()), part), ",")
            out += [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
        lo = hi
    return out


def id_digests(docs: DataFrame, load: Callable, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, n_tokens, ids_sha256, decoded_sha256) of each row: its text encoded, and the ids decoded, by the coder that ``load()`` gives.

    The coder has ``encode_lists(texts) -> list<int32>`` and ``decode_lists(ids) -> binary``.  A null text is empty; an
    empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*columns, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load()
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                ids = coder.encode_lists(part.column(part.num_columns - 1).to_pylist())
                decoded = coder.decode_lists(ids)
                offsets, digests = np.asarray(ids.offsets), ids_digests(ids)
                texts = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                                                 names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_arrow(docs.select(*columns, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")), job, schema)
