"""N-gram Jaccard join by parity sketches and pigeonhole blocks.

A document's set holds its distinct word shingles.  Each shingle flips (XORs) one bit of a sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets.  Sets with Jaccard >= t and sizes a, b
differ in at most ``D = (1-t)/(1+t) * (a+b)`` elements.  The sketch of a size band is cut into ``D + agree + slack``
blocks of ``BLOCK_BITS`` bits (held sparsely: a block's key is the XOR of a 64-bit number for each set bit), so two
sets that link agree in at least ``agree + slack`` blocks.  ``agree`` grows with the band (``2 + D / 8``): a passage
that unlinked texts share fills a few blocks alone, so long texts must agree in more than a few.


* bands are so wide that partners lie in the same or the next band; a set is keyed in its own band and, where a
  partner may be in the next one, there too;
* empty blocks say nothing.  A set with at most ``slack`` of them has ``agree`` non-empty agreeing blocks with every partner;
  only sets with more empty blocks also emit those, so every link still meets in ``agree`` keys.  A pair with fewer
  common keys needs no look at the sets.

A set of n shingles that links with another lacks at most (1-t) * n of them there.  So one shingle in ``_mark_step`` is a
mark, and a set with more than (1-t) * n marks that no other set has links with nothing, however many texts share passages.
Marks are counted in Spark by set signature, combined a slice of texts at a time (copies count once), those of one set alone
fall away, and a Bloom filter of bounded size brings the repeated ones back to the documents, which then emit their sets and
keys once.  What a step shuffles is freed when its result is stored.

Work is bounded by keys, never by pairs of a group.  Keys are taken in ``KEY_PASSES`` passes, every key in one of them.  In each block group, members are verified against one centre per
round (first the member with the most repeated marks), components merge, and only groups that still span several
components go on; the last round tests whatever pairs are left between different components, pairs with ``agree``
common keys at least, after the size bound and the Hamming bounds of compact sketches.
Every link is verified on the exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx
from .components import connected_components
from .store import drop_stored, map_arrow, stored, text_batches

BLOCK_BITS = 4096
SKETCH_WORDS = 32  #: 64-bit words of the compact sketch of the Hamming bound
MARK_STEP = 4  #: one shingle in so many is a mark, at most
BLOOM_LOG2, BLOOM_MOST = 27, 29  #: bits of the Bloom filter of repeated marks: 16 MB, 64 MB at most, whatever the input
BLOOM_BITS = 8  #: bits for each repeated mark, as long as the filter may grow
FOLD_WORDS = 8
AGREE = 2  #: blocks that linked sets agree in, at least; one more for every ``AGREE_STEP`` elements they may differ in
AGREE_STEP = 8
STAR_ROUNDS = 2
COUNTED = 1 << 19  #: shingles of the distinct sets behind a partition of the key count; a set has fewer keys than shingles, but for short ones
SEEN = 10_000  #: sets that a task remembers, so that copies near each other count once
KEY_PASSES = 4  #: passes over the keys, each over the same share of them, so that a pass's shuffle takes a share of the disk

_U = np.uint64
_SALTS = (_U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25))  #: of the two sums of a signature
_BITS = tx.mix(np.arange(1, BLOCK_BITS + 1, dtype=_U))  #: the 64-bit number of each bit of a block


def size_bands(percent: int, largest: int) -> list[int]:
    """Lower ends of the size bands: partners at ``percent`` lie in the same or the next band."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(ends[-1] * 100 // percent + 1)
    return ends


def _blocks(hi: int, percent: int) -> tuple[int, int, int]:
    """(blocks, slack, agree) of the band whose largest size is ``hi``; no blocks where only equal sets link."""
    most = 2 * hi * (100 - percent) // (100 + percent)
    slack = 1 + most // 20
    agree = AGREE + most // AGREE_STEP
    return (most + agree + slack, slack, agree) if most else (0, 0, AGREE)


def _slice_keys(shingles: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block keys of the sets that lie one after the other in ``shingles``: in each set's own band, and in the next if a
    partner may be there.  Returned as (keys, how many of them are of each band of a set, that set, in how many of them a
    partner agrees at least)."""
    ends = np.array(size_bands(percent, int(sizes.max(initial=1))), dtype=np.int64)
    ends = np.append(ends, ends[-1] * 100 // percent + 1)
    own = np.searchsorted(ends, sizes, "right") - 1
    some = sizes > 0
    who = np.repeat(np.arange(len(sizes)), np.where(some, 1 + (sizes * 100 // percent >= ends[own + 1]), 0))
    band = own[who] + np.append(False, who[1:] == who[:-1])[:len(who)]
    facts = np.array([_blocks(int(ends[k + 1]) - 1, percent) for k in range(len(ends) - 1)], dtype=np.int64)
    n, slack, agree = facts[band].T
    # a set of a band without blocks has no keys there
    start = np.cumsum(sizes) - sizes
    length = np.where(n > 0, sizes[who], 0)
    job = np.repeat(np.arange(len(who)), length)
    at = np.arange(len(job)) + (start[who] - np.cumsum(length) + length)[job]
    h = tx.mix(shingles[at] + (band.astype(_U) * _U(0x9E3779B97F4A7C15))[job])
    base = np.cumsum(n) - n
    digest = np.zeros(int(n.sum()), dtype=_U)
    np.bitwise_xor.at(digest, base[job] + (h % n.astype(_U)[job]).astype(np.int64), _BITS[((h >> _U(40)) % _U(BLOCK_BITS)).astype(np.int64)])
    job = np.repeat(np.arange(len(who)), n)
    empty = digest == 0
    keep = ~empty | (np.bincount(job, empty, len(who)) > slack)[job]
    job, digest, at = job[keep], digest[keep], (np.arange(len(job)) - base[job])[keep]
    keys = tx.mix(digest + tx.mix((band * 1_000_003)[job].astype(_U) + at.astype(_U)))
    return keys, np.bincount(job, minlength=len(who)), who, agree


def _mark_step(percent: int) -> int:
    """One shingle in so many is a mark, a share that is well above the share in which a set may differ from a partner."""
    return max(1, min(MARK_STEP, 3 * 100 // (5 * max(1, 100 - percent))))


def _slice_marks(shingles: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The marks of sets, as ``_slice_keys`` has their keys: (marks, how many are of each set, that set, how many of them
    a set with a partner shares with other sets at least).

    A set of n shingles lacks n * (100 - percent) / 100 of them in a partner at most, wherever they are among its marks."""
    marked = tx.mix(shingles ^ _U(0xA0761D6478BD642F)) % _U(_mark_step(percent)) == 0
    who = np.arange(len(sizes))
    counts = np.bincount(np.repeat(who, sizes)[marked], minlength=len(sizes))
    return shingles[marked], counts, who, counts - sizes * (100 - percent) // 100


def _keys(shingles: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """The block keys of one set by band, and in how many of them a partner agrees at least."""
    keys, counts, _, agree = _slice_keys(shingles, np.array([len(shingles)]), percent)
    return list(zip(np.split(keys, np.cumsum(counts)[:-1]), agree.tolist()))


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The compact parity sketch as ``SKETCH_WORDS`` 64-bit words."""
    place = tx.mix(shingles ^ _U(0x5851F42D4C957F2D)) % _U(64 * SKETCH_WORDS)
    odd = (np.bincount(place.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sets(data: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; with fewer words than ``size`` the whole sequence as one."""
    starts, ends, first = tx.spans(data, offs)
    sums, inv = tx.sequence_sums(tx.word_hashes(data, starts, ends, fold_case=True))
    n = len(starts)
    full = tx.span_hash(sums, inv, np.arange(max(n - size + 1, 0)), np.arange(size, max(n + 1, size)))
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(full[a:b - size + 1])
        elif b > a:
            yield tx.span_hash(sums, inv, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, dtype=_U)


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over the set."""
    return _slice_signatures([shingles])[0]


def _slice_signatures(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """``_signature`` of each set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), 2), dtype=_U)
    if sizes.any():
        flat, lead = np.concatenate(sets), (np.cumsum(sizes) - sizes)[sizes > 0]
        for i, salt in enumerate(_SALTS):
            out[sizes > 0, i] = np.add.reduceat(tx.mix(flat ^ salt), lead)
    return list(map(tuple, out.view(np.int64).tolist()))


def _slice_sets(data: np.ndarray, offs: np.ndarray, size: int, seen: set) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The sets of a slice of texts that are not empty, and their signatures; without those in ``seen``, where they are put."""
    every = list(_sets(data, offs, size))
    sets, sigs = [], []
    for s, sig in zip(every, _slice_signatures(every)):
        if len(s) and sig not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(sig)
            sets.append(s)
            sigs.append(sig)
    return sets, sigs


def _signatures(base: DataFrame, size: int) -> DataFrame:
    """(id, n, sig, sig2) of every row."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offs in tx.chunks(batch.column(1)):
                sets = list(_sets(data, offs, size))
                out += [(len(s), *sig) for s, sig in zip(sets, _slice_signatures(sets))]
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             names=["id", "n", "sig", "sig2"])
    return map_arrow(base, job, "id long, n long, sig long, sig2 long")


def _key_rows(texts: DataFrame, size: int, percent: int, of=_slice_keys) -> DataFrame:
    """(key, x, y): the keys (or marks) of every set with the smallest and the largest signature that has the key, combined a
    slice of texts at a time."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, _, data, offs in tx.chunks(batch.column(0)):
                sets, sigs = _slice_sets(data, offs, size, seen)
                if not sets:
                    continue
                key, counts, who, _ = of(np.concatenate(sets), np.array([len(s) for s in sets]), percent)
                if len(key):
                    key, sig = key.view(np.int64), np.repeat(np.array([a for a, _ in sigs], dtype=np.int64)[who], counts)
                    order = np.argsort(key)
                    key, sig = key[order], sig[order]
                    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(key[lead]), pa.array(np.minimum.reduceat(sig, lead)), pa.array(np.maximum.reduceat(sig, lead))],
                                                     names=["key", "x", "y"])
    return map_arrow(texts, job, "key long, x long, y long")


def _repeated(texts: DataFrame, size: int, percent: int, shingles: int, of=_slice_keys) -> DataFrame:
    """(key) that several sets have; ``shingles``: of all distinct sets together, or how many of them are marks.

    Nearly every key is of one set, so they are dealt out as they are (a slice of texts is combined already) and counted in
    partitions whose number follows their rows: no task holds more than a small table of keys."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // COUNTED))
    return (_key_rows(texts, size, percent, of).repartition(parts, "key").groupBy("key").agg(F.min("x").alias("x"), F.max("y").alias("y"))
            .filter("x < y").select("key"))


def _bloom_places(keys: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = _U((1 << log2) - 1)
    keys = tx.mix(keys)
    return tuple((h & m).astype(np.int64) for h in (keys, keys >> _U(32), tx.mix(keys)))


def _bloom(repeated: DataFrame) -> np.ndarray:
    """Bit set of the (stored) repeated keys, ``BLOOM_BITS`` or more for each up to the largest size.  Its words reach the
    driver 2**(BLOOM_LOG2-6) at once at most; when it fills up, more documents are looked at again, none is lost."""
    log2 = min(BLOOM_MOST, max(BLOOM_LOG2, (repeated.count() * BLOOM_BITS).bit_length()))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bloom_places(np.asarray(batch.column(0)).view(_U), log2))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.left_shift(_U(1), (at & 63).astype(_U)).view(np.int64))],
                                             names=["word", "bits"])
    words = stored(map_arrow(repeated.select("key"), job, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")), "ngram-bloom")
    out = np.zeros(1 << (log2 - 6), dtype=_U)
    for lo in range(0, len(out), 1 << (BLOOM_LOG2 - 6)):
        some = words.filter((F.col("word") >= lo) & (F.col("word") < lo + (1 << (BLOOM_LOG2 - 6)))).toArrow()
        out[some.column("word").to_numpy()] = some.column("bits").to_numpy().view(_U)
    drop_stored(words)
    return out


def _in_bloom(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key may be in the Bloom filter."""
    hit = np.ones(len(keys), dtype=bool)
    for at in _bloom_places(keys, len(bits).bit_length() + 5):
        hit &= (bits[at >> 6] >> (at & 63).astype(_U)) & _U(1) == 1
    return hit


def _hit_sets(texts: DataFrame, size: int, percent: int, bloom) -> DataFrame:
    """(sig, sig2, n, need, shared, sketch, shingles, keys) for sets with enough marks in the Bloom filter; ``need``: in how
    many keys a partner of at most the own band's sizes agrees; ``shared``: the marks in the filter."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bloom.value, set()
        for batch in batches:
            for _, _, data, offs in tx.chunks(batch.column(0)):
                sets, sigs = _slice_sets(data, offs, size, seen)
                if not sets:
                    continue
                marks, counts, who, least = _slice_marks(np.concatenate(sets), np.array([len(s) for s in sets]), percent)
                shared = np.bincount(np.repeat(who, counts)[_in_bloom(marks, bits)], minlength=len(sets))
                chosen = np.flatnonzero(shared >= least).tolist()
                if not chosen:
                    continue
                keys, counts, who, agree = _slice_keys(np.concatenate([sets[i] for i in chosen]), np.array([len(sets[i]) for i in chosen]), percent)
                lead = np.searchsorted(who, np.arange(len(chosen) + 1))  # the own band of each set comes first
                ends = np.append(0, np.cumsum(counts))[lead]
                rows = [(*sigs[i], len(sets[i]), int(agree[lead[k]]), int(shared[i]), _sketch(sets[i]), sets[i].view(np.int64), np.unique(keys[ends[k]:ends[k + 1]]).view(np.int64))
                        for k, i in enumerate(chosen) if ends[k] < ends[k + 1]]
                if rows:
                    cols = list(zip(*rows))
                    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c))) for c in cols[5:]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], *lists],
                                                     names=["sig", "sig2", "n", "need", "shared", "sketch", "shingles", "keys"])
    return map_arrow(texts, job, "sig long, sig2 long, n long, need long, shared long, sketch array<long>, shingles array<long>, keys array<long>")


def _may_link(percent: int, sketch: str) -> Column:
    """Bounds that linked nodes a, b meet: their sizes, and the Hamming distance of their sketches."""
    if sketch == "fold":
        distance = sum(F.bit_count(F.col("a.fold")[i].bitwiseXOR(F.col("b.fold")[i])) for i in range(FOLD_WORDS))
    else:
        distance = F.aggregate(F.zip_with("a.sketch", "b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (small * 100 >= large * percent) & (distance * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of nodes whose sets have Jaccard >= percent / 100, on the exact sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(one, "a").join(two, "b")
            .filter(common * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b"))


def _sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that occur in pairs, and few others: only these are shuffled with their shingles."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
    bloom = sets.sparkSession.sparkContext.broadcast(_bloom(ends))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_bloom(np.asarray(batch.column(0)).view(_U), bloom.value)))
    return map_arrow(sets, job, "node long, shingles array<long>")


def _nearby(links: DataFrame) -> DataFrame:
    """(node, component): a provisional label, the smallest node within two links.  Nodes with one label are connected;
    the exact components are found once, at the end."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    far = both.join(near.select(F.col("node").alias("other"), F.col("m").alias("m2")), "other").groupBy("node").agg(F.min("m2").alias("component"))
    return far.join(near, "node").select("node", F.least("component", "m").alias("component"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) per document: documents link when the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``percent`` / 100, and ``component_id`` is the smallest id reachable by links.

    Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased.  With fewer words than ``size`` the
    whole sequence is the one shingle; a null text or one without words has an empty set and links with nothing.
    Rows with a null id are returned with a null component and link nothing.  Rows that repeat an id are judged each
    by itself; sets with the same smallest id count as one document.  Other input columns are ignored.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = base.filter("id is not null").select("text")
    with text_batches(spark):
        rows = stored(_signatures(base, size), "ngram-sets")
    # a node is one distinct set, named by its smallest document
    nodes = stored(rows.filter("n > 0 and id is not null").groupBy("sig", "sig2").agg(F.min("id").alias("node"), F.first("n").alias("n")), "ngram-nodes")
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    nodes = nodes.select("node", "sig", "sig2")
    with text_batches(spark):
        repeated = stored(_repeated(texts, size, percent, shingles // _mark_step(percent), _slice_marks), "ngram-repeated")
    bloom = spark.sparkContext.broadcast(_bloom(repeated))
    drop_stored(repeated)
    with text_batches(spark):
        hits = stored(_hit_sets(texts, size, percent, bloom).dropDuplicates(["sig", "sig2"]).join(nodes, ["sig", "sig2"]), "ngram-hits")
    sets = hits.select("node", "shingles")
    # the same sketch folded to fewer bits, a cheaper and weaker bound
    fold = F.array(*[reduce(Column.bitwiseXOR, [F.col("sketch")[j] for j in range(i, SKETCH_WORDS, FOLD_WORDS)]) for i in range(FOLD_WORDS)])
    slim = stored(hits.select("node", F.struct("node", "n", "need", fold.alias("fold")).alias("a")), "ngram-slim")
    slim_b = slim.select(F.col("node").alias("other"), F.col("a").alias("b"))
    facts = hits.select("node", F.struct("n", "sketch").alias("a"))
    facts_b = facts.select(F.col("node").alias("other"), F.col("a").alias("b"))
    links = None
    labels = None
    for turn in range(STAR_ROUNDS + 1):
        # the text that a family was copied from shares the most of its marks, so it is the first centre
        nodewise = hits.select("node", "keys", (-F.col("shared")).alias("rank"))
        if labels is not None:
            nodewise = nodewise.join(labels, "node", "left").withColumn("rank", F.xxhash64("node", F.lit(turn)))
        comp = F.col("node") if labels is None else F.coalesce("component", "node")
        parts, opened = [], []
        for part in range(KEY_PASSES):
            now = nodewise.select("node", "rank", comp.alias("comp"), F.explode(F.filter("keys", lambda k: F.pmod(k, F.lit(KEY_PASSES)) == part)).alias("key"))
            if turn < STAR_ROUNDS:  # one centre per key and round
                centre = (now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("node", "rank").alias("c"), F.min_by("comp", "rank").alias("c_comp"))
                          .filter("x < y").select("key", "c", "c_comp"))
                met = now.select("key", "node", "comp").join(centre, "key").filter("comp != c_comp and node != c")
                parts.append(stored(met.select(F.least("node", "c").alias("node"), F.greatest("node", "c").alias("other")).distinct(), "ngram-met"))
            else:  # the keys that still join different components
                open_keys = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
                opened.append(stored(now.select("key", "node", "comp").join(open_keys, "key"), "ngram-open"))
        if turn < STAR_ROUNDS:
            pairs = reduce(DataFrame.union, parts).distinct()
        else:  # whatever is left between different components
            now = reduce(DataFrame.union, opened)
            left = now.join(slim, "node").select("key", "comp", "a")
            right = now.select("key", F.col("node").alias("other"), F.col("comp").alias("comp2")).join(slim_b, "other").select("key", "comp2", "b")
            met = left.join(right, "key").filter((F.col("a.node") < F.col("b.node")) & (F.col("comp") != F.col("comp2")) & _may_link(percent, "fold"))
            pairs = (met.groupBy(F.col("a.node").alias("node"), F.col("b.node").alias("other"))
                     .agg(F.count(F.lit(1)).alias("common"), F.first(F.greatest("a.need", "b.need")).alias("need")).filter("common >= need"))
        pairs = pairs.join(facts, "node").join(facts_b, "other").filter(_may_link(percent, "sketch")).select(F.col("node").alias("a"), F.col("other").alias("b"))
        pairs = stored(pairs, "ngram-pairs")
        drop_stored(*parts, *opened)
        found = stored(_verify(pairs, _sets_of(pairs, sets), percent), "ngram-links")
        drop_stored(pairs)
        links = found if links is None else links.union(found)
        if turn < STAR_ROUNDS:
            labels = stored(_nearby(links), "ngram-labels")
    drop_stored(hits, slim)
    named = rows.join(nodes, ["sig", "sig2"], "left")
    if links is not None:
        named = named.join(connected_components(links), "node", "left")
    component = F.coalesce("component", "node") if links is not None else F.col("node")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.when(F.col("id").isNotNull(), F.coalesce(component, F.col("id"))).alias("component_id"))
