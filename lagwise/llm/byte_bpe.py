"""Byte-level BPE encoding and decoding with exact merges in linear time.

A piece's bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every
token in the piece at once.  Encoding starts with the longest token at each position and backtracks: a token may
follow another only if the two would stay as they are when their joined bytes are merged by rank; that compatibility
depends on the two tokens alone and is memoised.  A position that cannot be completed is never entered twice, so the
work per piece is linear.  The result is what merging the least rank first gives.

Pieces repeat, so encoded words are kept in a cache of bounded size.  With the standard pattern a text may be cut before
a space or line feed that stands alone between two other characters that are not white space: no match crosses that
point.  Other texts are cut by the pattern itself.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .ids import text_slices
from .store import map_arrow

CACHE = 100_000  #: words of a generation of the cache; two generations are kept per Python worker
FITS = 200_000  #: token pairs whose compatibility is remembered
#: Fixed value: the one pattern for which cutting before single white space is known to be safe.
SPACE_SAFE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairCoder:
    """Encoder and decoder for one table of ranks (token bytes -> id) and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.most = max(self.sizes.values(), default=0)
        self.beginnings: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cut = pattern == SPACE_SAFE
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built on first use: a worker that only decodes does not hold it."""
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in self.ranks.items():
            made.add_word(token.decode("latin-1"), i)
        made.make_automaton()
        return made

    @cached_property
    def by_id(self) -> pa.Array:
        """Token bytes at the position of their id; null where no token has that id."""
        return pa.array([self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)], pa.large_binary())

    def _merge(self, data: bytes) -> list[int]:
        """Plain lowest-rank-first merging; only used on the bytes of one token to find its two halves."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            data = self.tokens[token]
            made = self._merge(data) if len(data) > 1 else []
            self.halves[token] = (made[0], made[1]) if len(made) == 2 else None
        return self.halves[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: no merge across their border comes before the merges that made them.

        Walks down the halves at the border.  ``limit`` is the rank of the merge that currently holds the border's
        neighbours together; a pair that would merge earlier than that breaks the tokens up.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        a, b, limit, ok = left, right, 1 << 40, True
        while True:
            merged = self.ranks.get(self.tokens[a] + self.tokens[b])
            if merged is not None and merged < limit:
                ok = False
                break
            # undo the later of the two merges at the border
            if a > b:
                limit = a
                half = self._split(a)
                if half is None:
                    limit = b + 1
                    half = self._split(b)
                    if half is None:
                        break
                    b = half[0]
                else:
                    a = half[1]
            else:
                limit = b + 1
                half = self._split(b)
                if half is None:
                    limit = a
                    half = self._split(a)
                    if half is None:
                        break
                    a = half[1]
                else:
                    b = half[0]
        if len(self.fits) < FITS:
            self.fits[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, chars = len(piece), piece.decode("latin-1")
        sizes, fits = self.sizes, self.fits
        # longest tokens from the left, as the automaton finds them, up to the first two that do not fit together
        ids, at, before = [], 0, -1
        for _, token in self.automaton.iter_long(chars):
            if before >= 0:
                fit = fits.get((before, token))
                if not (fit if fit is not None else self._compatible(before, token)):
                    break
            ids.append(token)
            before = token
            at += sizes[token]
        else:
            return ids
        token = self._shorter(token)
        dead: set[int] = set()
        while True:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if not ids:
                        break
                    fit = fits.get((ids[-1], token))
                    if fit if fit is not None else self._compatible(ids[-1], token):
                        break
                token = self._shorter(token)
            if token >= 0:
                ids.append(token)
                if end == n:
                    return ids
                at, token = end, self._longest(piece, chars, end)
            else:
                dead.add(at)
                if not ids:
                    raise ValueError("the vocabulary lacks a single byte of the text")
                token = ids.pop()
                at -= sizes[token]
                token = self._shorter(token)

    def _longest(self, piece: bytes, chars: str, at: int) -> int:
        """The longest token at a position: as deep as the automaton's trie goes, then back to the last whole token."""
        end = at + self.automaton.longest_prefix(chars[at:at + self.most])
        while (known := self.ranks.get(piece[at:end])) is None:
            end -= 1
        return known

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        known = self.beginnings.get(token)
        if known is None:
            data = self.tokens[token]
            known = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
            self.beginnings[token] = known
        return known

    def _remember(self, key: str, stretch: str) -> bytes:
        """Encode a stretch match by match and keep it, if it is short, under ``key``."""
        known = self.older.get(key)
        if known is not None:
            return self._keep(key, known)
        ids: list[int] = []
        for piece in [stretch] if key.isascii() and key.isalpha() else self.pattern.findall(stretch):
            ids += self.encode_piece(piece.encode())
        return self._keep(key, array("i", ids).tobytes())

    def _keep(self, key: str, made: bytes) -> bytes:
        """Put an encoding into the cache; a full cache becomes the older generation, from which words in use come back."""
        if len(key) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[key] = made
        return made

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, each match of the pattern by itself."""
        cache = self.cache
        out = self._by_words(text) if self.cut else None
        if out is None:
            # a piece's key starts with "\r", which no key of a word does
            out = [cache.get("\r" + p) or self._remember_piece(p) for p in self.pattern.findall(text)]
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def _remember_piece(self, piece: str) -> bytes:
        key = "\r" + piece
        return self._keep(key, self.older.get(key) or array("i", self.encode_piece(piece.encode())).tobytes())

    def _by_words(self, text: str) -> list[bytes] | None:
        """The text cut before each space or line feed, encoded word by word; None unless each of them, and every other white
        space, stands alone between two characters that are none (then no match crosses a cut).

        Keys: a word stands for the word after a space, one that starts with a line feed for itself.  Only words that
        meet the condition are kept, so a word found in the cache needs no check.
        """
        words = text.replace("\n", " \n").split(" ")
        out = list(map(self.cache.get, words))
        out[0] = None
        if None in out:
            for i, made in enumerate(out):
                if made is None:
                    word = words[i]
                    if i and (made := self.older.get(word)) is not None:
                        out[i] = self._keep(word, made)
                        continue
                    if i and word.isascii() and word.isalpha():  # letters alone: one match
                        out[i] = self._keep(word, array("i", self.encode_piece(b" " + word.encode())).tobytes())
                        continue
                    if len(word.split()) != 1 or len(word.strip()) != len(word) - (word[0] == "\n"):
                        return None
                    if i:
                        out[i] = self._remember(word, word if word[0] == "\n" else " " + word)
                    else:
                        out[i] = self.cache.get("\r" + word) or self._remember("\r" + word, word)
        return out

    def encode_lists(self, texts: list[str]) -> pa.ListArray:
        """Token ids of each text."""
        ids = [self.encode(t) for t in texts]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids at once; a null list gives no bytes, an id without a token raises."""
        flat = ids.flatten()
        parts = self.by_id.take(flat)
        if parts.null_count:
            raise ValueError("an id has no token in the vocabulary")
        ends = np.cumsum(np.append(0, np.asarray(ids.value_lengths().fill_null(0))))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), parts), pa.scalar(b"", pa.large_binary())).cast(pa.binary())


@lru_cache(maxsize=2)
def load_coder(path: str, pattern: str) -> BytePairCoder:
    """The coder for a file of ranks (base64 token and id on each line), once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}
    return BytePairCoder(ranks, pattern)


def encode_bpe(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids (array<int>) of each whole text; a null text is empty and has none.

    ``vocabulary``: path of the file of ranks, readable on every worker.  A column named ``out`` is replaced.  Texts are
    encoded in slices of bounded size, a longer text by itself; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.array(F.lit(0)).alias(out)).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_coder(vocabulary, pattern)
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], coder.encode_lists(part.column(part.num_columns - 1).to_pylist())], names=[*kept, out])
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    return map_arrow(rows, job, schema)


def decode_bpe(rows: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the decoded bytes (binary) of ``ids_col``; null ids decode to no bytes.  A column named ``out`` is replaced."""
    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(b"").alias(out)).schema

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_coder(vocabulary, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], coder.decode_lists(part.column(part.num_columns - 1))], names=[*kept, out])
    return map_arrow(rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("__ids")), job, schema)
