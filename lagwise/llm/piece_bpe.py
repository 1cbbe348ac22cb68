"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The texts of a slice become one flat array of characters (a space is written U+2581, and each text that is not empty gets
one in front).  No merge ever joins two neighbouring characters that stand next to each other in no piece, so the array is
cut there into words, and each different word is merged once.  A round takes, for every word at once, the least rank of
its neighbouring symbol pairs (a segmented minimum), merges that pair wherever it occurs in the word, from the left and
without overlaps, and compacts the array; words without a mergeable pair leave it.

One merge at a time, best score first and leftmost on ties, is what the library does.  A round does the same unless one of
several merges in a word makes a new pair that ranks before the round's own pair, or level with it (pieces of equal score
share a rank); such a word is merged again pair by pair with a heap.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ids import text_slices
from .store import map_arrow
from .text import mix, prefix_sums, span_hash

SPACE = "▁"
WORDS = 300_000  #: encoded words kept per Python worker; beyond, the store starts afresh
NONE = np.iinfo(np.int32).max  #: rank of a pair that is no piece
#: Piece types of the model file, and the surface of an unknown piece.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_SURFACE = " ⁇ "


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict, dict]:
    """Pieces (text, score, type) and the trainer's and normaliser's settings of a model file."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return pieces, trainer, normaliser


class PieceCoder:
    """Encoder and decoder for one model: BPE with byte fallback, identity normalisation and a space in front."""

    def __init__(self, path: str):
        pieces, trainer, normaliser = read_model(path)
        fits = (trainer.get(3) == 2, trainer.get(35, 0), not normaliser.get(2), normaliser.get(3, 1), not normaliser.get(4, 1), normaliser.get(5, 1),
                all(kind in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces))
        if not all(fits):
            raise ValueError("only BPE models with byte fallback, identity normalisation, a space in front and kept white space")
        normal = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = np.zeros(256, dtype=np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(text[3:-1], 16)] = i
        # symbols: pieces by their id, then characters that are part of a piece without being one
        symbols = dict(normal)
        for c in sorted({c for text in normal for c in text} - normal.keys()):
            symbols[c] = len(pieces) + len(symbols) - len(normal)
        self.n_pieces, self.width = len(pieces), len(pieces) + len(symbols) - len(normal)
        self.chars = sorted(c for c in symbols if len(c) == 1)
        self.symbol_of = np.array([-1, *(symbols[c] for c in self.chars)], dtype=np.int32)
        self.class_of = np.zeros(0x110000, dtype=np.int16)
        self.class_of[[ord(c) for c in self.chars]] = np.arange(1, len(self.chars) + 1)
        long = sorted(t for t in normal if len(t) > 1)
        ranks = np.unique([-pieces[normal[t]][1] for t in long], return_inverse=True)[1] if long else []
        number = {c: k + 1 for k, c in enumerate(self.chars)}
        self.joined = np.zeros((len(self.chars) + 1, len(self.chars) + 1), dtype=bool)
        pairs = []
        for rank, text in zip(ranks, long):
            for k in range(1, len(text)):
                self.joined[number[text[k - 1]], number[text[k]]] = True
                left, right = symbols.get(text[:k]), symbols.get(text[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.width + right, int(rank), symbols[text]))
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] or [NONE], dtype=np.int32)
        self.pair_made = np.array([p[2] for p in pairs] or [0], dtype=np.int32)
        surfaces = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), UNKNOWN: lambda t: UNKNOWN_SURFACE.encode(), CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:-1], 16)])}
        self.surface = [surfaces[kind](text) for text, _, kind in pieces]
        self.surface_bytes = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        self.surface_sizes = np.fromiter(map(len, self.surface), np.int64, len(pieces))
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.kind = np.array([kind for _, _, kind in pieces], dtype=np.int8)
        self.forget()

    def forget(self) -> None:
        """Drop all kept words."""
        self.number: dict[int, int] = {}
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of each pair; rank NONE where there is no such piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_ranks[at], NONE), self.pair_made[at]

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that begin at ``starts``, merged; returns them in word order, and each word's length."""
        n_words, original = len(starts), symbols.copy()
        lengths = np.diff(np.append(starts, len(symbols)))
        word, redo = np.repeat(np.arange(n_words), lengths), []
        out_word, out_symbols = [], []
        rank, made = np.full(len(symbols), NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._pair(symbols[inner], symbols[inner + 1])
        while len(symbols):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(word)))
            live = np.repeat(least < NONE, counts)
            if not live.all():
                out_word.append(word[~live])
                out_symbols.append(symbols[~live])
                counts, least = counts[least < NONE], least[least < NONE]
                word, symbols, rank, made = word[live], symbols[live], rank[live], made[live]
                if not len(symbols):
                    break
            own = np.repeat(least, counts)
            hit = np.flatnonzero(rank == own)
            # of hits in a row every second is taken, from the left
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(hit) > 1), np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            # a merge whose right neighbour merges too makes a pair with that neighbour's first symbol for a moment
            close = hit[np.flatnonzero(np.diff(hit) == 2)]
            close = close[word[close] == word[close + 2]]
            redo.append(word[close][self._pair(made[close], symbols[close + 2])[0] <= own[close]])
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            at, several, own = place[hit], np.bincount(word[hit], minlength=n_words) > 1, own[hit]
            word, symbols, rank, made = word[keep], symbols[keep], rank[keep], made[keep]
            for near, mine in ((at, own), (at - 1, own)):
                ok = (near >= 0) & (near + 1 < len(word))
                near, mine = near[ok], mine[ok]
                same = word[near] == word[near + 1]
                new, to = self._pair(symbols[near], symbols[near + 1])
                # the pair before a word's first symbol belongs to the word before it, and has no rank
                rank[near], made[near] = np.where(same, new, NONE), to
                redo.append(word[near][same & (new <= mine) & several[word[near]]])
            last = at[at + 1 == len(word)]
            rank[last] = NONE
        word = np.concatenate(out_word) if out_word else np.zeros(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        flat = np.concatenate(out_symbols)[order] if out_word else np.zeros(0, dtype=np.int32)
        sizes = np.bincount(word, minlength=n_words)
        wrong = np.unique(np.concatenate(redo)) if redo else np.zeros(0, dtype=np.int64)
        if len(wrong):
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for w in wrong.tolist():
                parts[w] = self.merge_one_by_one(original[starts[w]:starts[w] + lengths[w]])
                sizes[w] = len(parts[w])
            flat = np.concatenate(parts)
        return flat, sizes

    def merge_one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """One word merged pair by pair: least rank first, then leftmost."""
        text, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        table = self._table
        heap = [(table[pair][0], i, *pair) for i in range(n - 1) if (pair := (text[i], text[i + 1])) in table]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if text[i] != left or j >= n or text[j] != right:
                continue
            text[i], text[j], after[i] = table[left, right][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (pair := (text[a], text[after[a]])) in table:
                    heapq.heappush(heap, (table[pair][0], a, *pair))
        return np.array([t for t in text if t >= 0], dtype=np.int32)

    @property
    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, made); built when a word first needs it."""
        if not hasattr(self, "_pairs"):
            self._pairs = {divmod(int(k), self.width): (int(r), int(m)) for k, r, m in zip(self.pair_keys, self.pair_ranks, self.pair_made) if k >= 0}
        return self._pairs

    def _add_words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode words given as spans of ``codes`` and put them into the store."""
        lengths = ends - starts
        begins = np.cumsum(lengths) - lengths
        at = np.repeat(starts - begins, lengths) + np.arange(int(lengths.sum()))
        flat = codes[at]
        symbols = self.symbol_of[self.class_of[flat]]
        known = symbols >= 0  # a character of no piece is a word of its own
        merged, sizes = self.merge(np.where(known, symbols, self.n_pieces).astype(np.int32), begins)
        # characters that are no piece go out as their UTF-8 bytes
        owner = np.repeat(np.arange(len(starts)), sizes)
        bare = np.flatnonzero(~known[begins[owner]] | (merged >= self.n_pieces))
        if len(bare):
            many = np.ones(len(merged), dtype=np.int64)
            spelt = []
            for b in bare.tolist():
                c = chr(flat[begins[owner[b]]]) if not known[begins[owner[b]]] else self.chars[int(np.flatnonzero(self.symbol_of[1:] == merged[b])[0])]
                spelt.append(self.bytes[np.frombuffer(c.encode("utf-8", "surrogatepass"), dtype=np.uint8)])
                many[b] = len(spelt[-1])
            owner, wide = np.repeat(owner, many), np.repeat(merged, many)
            hole = np.zeros(len(merged), dtype=bool)
            hole[bare] = True
            wide[np.repeat(hole, many)] = np.concatenate(spelt)
            merged, sizes = wide, np.bincount(owner, minlength=len(starts))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.pool = np.concatenate([self.pool, merged.astype(np.int32)])

    def encode_lists(self, texts: list[str]) -> pa.ListArray:
        """Token ids of each text."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        ends_of_texts = np.cumsum(sizes)
        if not len(codes):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), pa.array([], pa.int32()))
        classes = self.class_of[codes]
        cut = np.append(True, ~self.joined[classes[:-1], classes[1:]])
        cut[(ends_of_texts - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        sums, inverse = prefix_sums(mix(codes.astype(np.uint64) + np.uint64(1)), 0xC2B2AE3D27D4EB4F)
        found, first, which = np.unique(span_hash(sums, inverse, starts, ends), return_index=True, return_inverse=True)
        if len(self.number) + len(found) > WORDS:
            self.forget()
        numbers = np.fromiter((self.number.get(h, -1) for h in found.tolist()), np.int64, len(found))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.starts) + np.arange(len(new))
            self._add_words(codes, starts[first[new]], ends[first[new]])
            self.number.update(zip(found[new].tolist(), numbers[new].tolist()))
        numbers = numbers[which]
        lengths = self.lengths[numbers]
        upto = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[numbers] - (upto - lengths), lengths) + np.arange(int(upto[-1]))]
        # a text's tokens end where its last word's do
        last = np.searchsorted(starts, ends_of_texts) - 1
        offsets = np.append(0, np.where(ends_of_texts > 0, upto[np.maximum(last, 0)], 0))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def encode(self, text: str) -> list[int]:
        return self.encode_lists([text])[0].as_py()

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, as UTF-8: U+2581 is a space, the one in front goes, bytes that are no UTF-8 become U+FFFD."""
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("a null has no piece")
        flat = np.asarray(flat)
        if len(flat) and not 0 <= flat.min() <= flat.max() < self.n_pieces:
            raise ValueError("an id has no piece")
        ends = np.cumsum(np.append(0, np.asarray(ids.value_lengths().fill_null(0)))).astype(np.int64)
        sizes = self.surface_sizes[flat]
        upto = np.append(0, np.cumsum(sizes))
        data = self.surface_bytes[np.repeat(self.surface_starts[flat] - upto[:-1], sizes) + np.arange(int(upto[-1]))].tobytes()
        odd = np.append(0, np.cumsum(self.kind[flat] != NORMAL))
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = data[upto[a]:upto[b]]
            out.append(self._odd_text(flat[a:b]) if odd[b] > odd[a] else text[text[:1] == b" ":])
        return pa.array(out, pa.binary())

    def _odd_text(self, ids: np.ndarray) -> bytes:
        """The text of ids among which are bytes, control or unknown pieces, run by run."""
        surface, kinds, out = [self.surface[i] for i in ids.tolist()], self.kind[ids], []
        borders = [0, *(np.flatnonzero((kinds[1:] == BYTE) != (kinds[:-1] == BYTE)) + 1).tolist(), len(ids)]
        begun = False  # whether a piece that could hold the space in front has been met
        for a, b in zip(borders[:-1], borders[1:]):
            if kinds[a] == BYTE:
                out.append(_repair(b"".join(surface[a:b])))
                begun = True
                continue
            for k in range(a, b) if not begun else ():
                if kinds[k] != CONTROL:
                    surface[k] = surface[k][1:] if kinds[k] == NORMAL and surface[k][:1] == b" " else surface[k]
                    begun = True
                    break
            out.append(b"".join(surface[a:b]))
        return b"".join(out)


def _repair(data: bytes) -> bytes:
    """UTF-8 with each byte that is part of no character replaced by U+FFFD."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    data[at:at + size].decode()
                    out.append(data[at:at + size])
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> PieceCoder:
    """The coder for a model file, once per Python worker."""
    return PieceCoder(path)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids (array<int>) of each whole text, without begin and end ids; a null or empty text has none.

    ``model``: path of the model file, readable on every worker.  A column named ``out`` is replaced; rows that repeat are
    encoded alike; an empty table gives an empty result.  Texts are encoded in slices of bounded size, a longer text by itself.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.array(F.lit(0)).alias(out)).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_pieces(model)
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], coder.encode_lists(part.column(part.num_columns - 1).to_pylist())], names=[*kept, out])
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    return map_arrow(rows, job, schema)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the decoded text of ``ids_col``; null ids give an empty text, an id without a piece raises.  A column named ``out`` is replaced."""
    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(out)).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], coder.decode_lists(part.column(part.num_columns - 1)).cast(pa.string())], names=[*kept, out])
    return map_arrow(rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("__ids")), job, schema)
