"""Byte-level helpers shared by the text operators: Arrow string columns as flat buffers, word spans and
Rabin-Karp (prefix polynomial) hashes of any span in O(1), all as numpy arrays without Python objects per word.

Arithmetic is modulo 2**64.  Byte values go through a seeded random table and every hash through a mixing step,
so span hashes behave like random 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  #: text handled at once; one longer document is still handled whole
KEPT_POWERS = (1 << 20) + 1  #: powers of a base that a worker keeps

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and xor-shift rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i < n, modulo 2**64; ``KEPT_POWERS`` of them stay between calls."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, KEPT_POWERS)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial sums of 64-bit values and the inverse powers that rebase a span to position 0."""
    p, inv = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * p[:-1], out=sums[1:])
    return sums, inv


def span_hash(sums: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the values at [start, end), equal for equal contents at any position."""
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(_U))


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) of a string column with their bytes and offsets, at most ``max_bytes`` at once where rows allow it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of bytes outside ``gap``) of each row: byte starts, byte ends, and the index of each row's first word (one more entry than rows)."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    inside = ~gap[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_sums(data: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over bytes; with ``fold_case`` A-Z hash like a-z."""
    return prefix_sums((_FOLDED if fold_case else _BYTE)[data], _BASE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    sums, inv = byte_sums(data, fold_case)
    return span_hash(sums, inv, starts, ends)


def sequence_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over word hashes, for the hash of any run of words."""
    return prefix_sums(hashes, _WORD_BASE)
