"""Phrase collocation mining by SON partitioning (Savasere, Omiecinski and Navathe, 1995).

Texts are dealt into a fixed number of shards by a hash of the row.  If a phrase occurs ``support`` times among a language's
n words, it occurs at least support * n_shard / n times in some shard that holds n_shard of them; so mining each shard
completely at that local support, and taking the union, loses no frequent phrase.  A shard is as large as the corpus makes
it: it is mined by Spark, from counts that tasks make per slice of text, summed per shard and phrase.  Longer phrases are
mined after shorter ones: both phrases that are one word shorter must be locally frequent somewhere.

The candidates of one length reach the tasks that count the next as a bit set of at most ``2**MAX_BITS`` bits, the only
thing broadcast; a phrase that passes it by accident is counted and then dropped, so beyond that size the set only filters
less.  The last pass counts every candidate of the union globally by its own words, not by a hash.  Inside a slice and in
the shards, phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import ship_package
from .store import drop_stored, map_arrow, stored
from .text import byte_sums, chunks, prefix_sums, span_hash, spans

SHARDS = 4
SLICE_BYTES = 1_000_000  #: text counted at once in a task
MERGED = 1_500_000  #: counts that a task adds up before they leave it
LANG_BITS, SHARD_BITS = 8, 4  #: low bits of a local key: the language's hash, the shard
MAX_BITS = 27  #: log2 of the largest bit set (16 MB)
GROUP = 100_000  #: phrases ranked by one task, on average
_U = np.uint64
_WORD_BASE = 0xD1B54A32D192ED03
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _BREAKS.copy()
_GAPS[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Slice:
    """The words of a slice of texts: spans, hashes mixed with their language, and how many words follow in the same piece."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: list[str], shards: np.ndarray):
        self.data = _LOWER[data]
        self.starts, self.ends, first = spans(self.data, offs, _GAPS)
        n = len(self.starts)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        names, self.lang_of_row = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
        self.names = names.tolist()
        self.lang, self.shard = self.lang_of_row[row], shards[row].astype(np.int64)
        breaks = np.append(0, np.cumsum(_BREAKS[self.data]))
        broken = np.append((breaks[self.starts[1:]] > breaks[self.ends[:-1]]) | (row[1:] != row[:-1]), True) if n else np.zeros(0, dtype=bool)
        # words from here to the end of the piece
        end = np.flatnonzero(broken)
        self.left = end[np.searchsorted(end, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, dtype=np.int64)
        sums, inverse = byte_sums(self.data)
        words = span_hash(sums, inverse, self.starts, self.ends)
        self.sums, self.inverse = prefix_sums(words, _WORD_BASE)
        seeds = np.array([_seed(x) for x in self.names], dtype=_U)
        self.salt = seeds[self.lang] if n else np.zeros(0, dtype=_U)

    def phrases(self, size: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the phrases of ``size`` words that lie within a piece (of those that begin at ``at``)."""
        at = np.flatnonzero(self.left >= size) if at is None else at[self.left[at] >= size]
        return at, self.keys(size, at)

    def keys(self, size: int, at: np.ndarray) -> np.ndarray:
        return span_hash(self.sums, self.inverse, at, at + size) ^ self.salt[at]

    def texts(self, size: int, at: np.ndarray) -> pa.Array:
        """The phrases of ``size`` words that begin at ``at``, words joined by one space."""
        words = (at[:, None] + np.arange(size)).ravel()
        letters = self.ends[words] - self.starts[words]
        taken = letters + (np.arange(len(words)) % size < size - 1)
        upto = np.cumsum(taken) - taken
        data = self.data[np.repeat(self.starts[words] - upto, taken) + np.arange(int(taken.sum()))]
        data[(upto + letters)[taken > letters]] = 32
        offsets = np.append(upto[::size], len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))

    def languages(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(self.lang[at]))


def _seed(lang: str) -> int:
    """A 64-bit number for a language, the same in every task."""
    value = 0xCBF29CE484222325
    for byte in lang.encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


class _BitSet:
    """A set of keys that may hold more than it should, never less."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, max(len(words), 1).bit_length() + 5

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> _U(64 - self.bits)
        return ((self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1)).astype(bool)


def _bit_set(keys: DataFrame) -> _BitSet:
    """Bit set of the long column ``key``; 16 bits a key up to ``2**MAX_BITS`` bits, so at most ``2**(MAX_BITS-6)`` rows come to the driver."""
    bits = min(MAX_BITS, max(16, (16 * keys.count()).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    found = (keys.select(F.shiftright(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    words = np.zeros(1 << (bits - 6), dtype=_U)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(_U)
    return _BitSet(words)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        shards, langs = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        for lo, hi, data, offs in chunks(batch.column(0), SLICE_BYTES):
            yield _Slice(data, offs, langs[lo:hi], shards[lo:hi])


def _grouped(keys: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of each different key (with further small codes, folded in by multiplication)."""
    for code in codes:
        keys = keys + code.astype(_U) * _U(0x9E3779B97F4A7C15)
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return first, counts


def _words(rows: DataFrame) -> DataFrame:
    """(lang, shard, phrase, n): how often each word occurs (shard null), and how many words each shard holds (phrase null)."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            at, keys = s.phrases(1)
            first, counts = _grouped(keys)
            words = at[first]
            yield pa.RecordBatch.from_arrays([s.languages(words), pa.nulls(len(words), pa.int32()), s.texts(1, words), pa.array(counts, pa.int64())], names=["lang", "shard", "phrase", "n"])
            first, counts = _grouped(s.salt, s.shard)
            yield pa.RecordBatch.from_arrays([s.languages(first), pa.array(s.shard[first], pa.int32()), pa.nulls(len(first), pa.string()), pa.array(counts, pa.int64())], names=["lang", "shard", "phrase", "n"])
    return map_arrow(rows, job, "lang string, shard int, phrase string, n long").groupBy("lang", "shard", "phrase").agg(F.sum("n").alias("n"))


def _group(lang_hash, shard):
    """The low bits of a local key."""
    return lang_hash % (1 << LANG_BITS) << SHARD_BITS | shard


def _local(rows: DataFrame, size: int, shorter) -> DataFrame:
    """(key, n): counts per shard of the phrases of ``size`` words whose two shorter phrases are in the bit set.

    The low bits of a key are the shard and a hash of the language, the others a hash of the phrase; two phrases with one
    key can only make a candidate more.
    """
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[:len(keys)]
        return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(counts, first) if len(first) else counts, pa.int64())], names=["key", "n"])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for s in _slices(batches):
            at, keys = s.phrases(size - 1)
            good = np.zeros(len(s.left) + 1, dtype=bool)
            good[at[shorter.value.has(keys)]] = True
            at, keys = s.phrases(size, np.flatnonzero(good[:-1] & good[1:]))
            low = _group(s.salt[at].astype(np.int64) & (1 << LANG_BITS) - 1, s.shard[at]).astype(_U)
            keys, counts = np.unique(keys >> _U(LANG_BITS + SHARD_BITS) << _U(LANG_BITS + SHARD_BITS) | low, return_counts=True)
            parts.append((keys, counts.astype(np.int32)))
            held += len(keys)
            if held > MERGED:
                yield merged(parts)
                parts, held = [], 0
        if parts:
            yield merged(parts)
    return map_arrow(rows, job, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _needed(held: DataFrame, totals: DataFrame, support: int) -> list[int]:
    """For each value of a local key's low bits, the least count in its shard that a phrase of the support must reach in one of
    them; the least of the languages that share the bits."""
    each = held.join(totals.withColumnRenamed("n", "total"), "lang")
    least = F.ceil(F.lit(support) * F.col("n").cast("decimal(20,0)") / F.col("total")).cast("long")
    seed = F.pandas_udf(lambda langs: langs.map(lambda x: _seed(x) & (1 << LANG_BITS) - 1), "long")
    found = each.select(seed("lang").alias("hash"), "shard", least.alias("least")).groupBy("hash", "shard").agg(F.min("least").alias("least")).collect()
    out = [1] * (1 << LANG_BITS + SHARD_BITS)  # so many rows at most
    for r in found:
        out[_group(r["hash"], r["shard"])] = r["least"]
    return out


def _count(rows: DataFrame, sets) -> DataFrame:
    """(lang, size, phrase, n): exact counts of the phrases that are in the bit set of their size."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            for size, known in sets.value.items():
                at, keys = s.phrases(size)
                inside = known.has(keys)
                at, keys = at[inside], keys[inside]
                first, counts = _grouped(keys)
                at = at[first]
                yield pa.RecordBatch.from_arrays([s.languages(at), pa.array(np.full(len(at), size), pa.int32()), s.texts(size, at), pa.array(counts, pa.int64())], names=["lang", "size", "phrase", "n"])
    return map_arrow(rows, job, "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 30, longest: int = 4, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to ``longest`` words with at least ``support`` occurrences, and (lang, n) of all words.

    A-Z are lower-cased; texts are split into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces and
    tabs; a phrase lies within a piece and is written with single spaces.  A null text is empty, a null language ``und``.
    Rows that repeat count again; an empty table gives empty results; other columns are ignored.
    """
    if not 0 < shards <= 1 << SHARD_BITS:
        raise ValueError(f"shards: 1 to {1 << SHARD_BITS}")
    spark = docs.sparkSession
    ship_package(spark)
    text, lang = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und"))
    salt = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("bigint", "int")]
    rows = docs.select(text.alias("text"), F.pmod(F.xxhash64(text, *salt), F.lit(shards)).cast("int").alias("shard"), lang.alias("lang"))
    counted = stored(_words(rows).filter((F.col("n") >= support) | F.col("phrase").isNull()), "phrase-words")
    held = counted.filter("phrase is null")
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    needed = F.lit(_needed(held, totals, support))
    words = counted.filter("phrase is not null").select("lang", F.lit(1).alias("size"), "phrase", "n")
    shorter, sets = _bit_set(_word_keys(words)), {}
    for size in range(2, longest + 1):
        sent = spark.sparkContext.broadcast(shorter)
        low = F.col("key").bitwiseAND(F.lit((1 << LANG_BITS + SHARD_BITS) - 1)).cast("int")
        candidates = stored(_local(rows, size, sent).filter(F.col("n") >= F.get(needed, low)).select("key"), "phrase-candidates")
        shorter = sets[size] = _bit_set(candidates)
        drop_stored(candidates)
    longer = stored(_count(rows, spark.sparkContext.broadcast(sets)).filter(F.col("n") >= support), "phrase-counts")
    return words.unionByName(longer), totals


def _word_keys(words: DataFrame) -> DataFrame:
    """Keys of whole words, as the tasks that read texts make them."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offs in chunks(batch.column(0), SLICE_BYTES):
                s = _Slice(data, offs, langs[lo:hi], np.zeros(hi - lo, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(s.phrases(1)[1].view(np.int64))], names=["key"])
    return map_arrow(words.select("phrase", "lang"), job, "key long")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase with a >= ``support`` occurrences, cut after its first words into parts with l and r occurrences, scores
    floor(2000000 a / (l + r)); its lowest-scoring cut counts, of equal ones the one with the shorter first part.  A phrase
    is dropped if its words lie inside a longer frequent phrase with f occurrences and 100 f >= ``covered`` a.  Ranked by
    score, then a (both falling), then phrase in byte order.  All numbers are exact.  See ``frequent_phrases`` for words,
    nulls, repeats and empty tables.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, support, longest, shards)
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    parts = F.split("phrase", " ")
    candidates = phrases.filter("size > 1")
    part = lambda k, size: F.array_join(F.slice(parts, k, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "size", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = (cuts.join(counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(counts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    cuts = cuts.withColumn("exact", wide("a") * F.lit(2_000_000)).withColumn("both", wide("l") + wide("r")).withColumn("score", F.expr("exact div both"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # phrases inside each longer one, with its count
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda k: part(k, m)))))
    longer = candidates.filter("size > 2").select("lang", inside.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("cover"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("cover").isNull() | (wide("cover") * 100 < wide("a") * covered))
    best = kept.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return _ranked(stored(best, "phrase-scores"), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each language with their rank.  While there are more rows than one task should rank, they
    are first cut down to the best ``top`` of each of many hashed groups, which hold every row that can be ranked."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    left, before = rows.count(), None
    while left > max(GROUP, 4 * top) and left != before:
        part = F.pmod(F.xxhash64("phrase"), F.lit(-(-left // GROUP)))
        few = stored(rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank"), "phrase-scores")
        drop_stored(rows)
        rows, before, left = few, left, few.count()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
