"""Substring deduplication: windows of ``window`` consecutive words that repeat across documents.

Every window gets a Rabin-Karp hash (prefix polynomial sums over word hashes).  Shipping one row per window would
shuffle more than the corpus, so windows are grouped exactly before the shuffle.  A window's *anchor* is the least
hash among its inner grams of ``GRAM`` words: it depends on the window's words alone, so equal windows always have
equal anchors.  A *run* is a maximal stretch of windows of one document that share the anchor (about 20 windows).

1. Runs with equal words form a class (a count with map-side combine); anchors seen in one document only are done,
   none of their windows can repeat.
2. Anchors with one class: every window of the run repeats in the class's smallest document.
3. Anchors with several classes: the window hashes of one run of each class are counted in Spark, keyed by
   (anchor, window hash), and the smallest document of each window goes back to the classes.
4. Per document, the repeated windows merge into maximal removal intervals, which are cut from the text.

Copies collapse into classes before any window is expanded, so a text held by a third of all documents costs its own
length once.  No pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .store import drop_stored, map_arrow, stored

GRAM = 8  #: words of the inner grams whose least hash is a window's anchor


def _sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every ``length`` consecutive values, by doubling."""
    least, span = values, 1
    while span * 2 <= length:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = length - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def _runs_of(data: np.ndarray, offs: np.ndarray, window: int):
    """Runs of a chunk of texts: row, first word in the chunk, number of windows, anchor, content hash; and the sums."""
    starts, ends, first = tx.spans(data, offs)
    n = len(starts)
    sums, inv = tx.sequence_sums(tx.word_hashes(data, starts, ends))
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, first, (sums, inv)
    gram = min(GRAM, window)
    at = np.arange(n - gram + 1)
    anchors = _sliding_min(tx.span_hash(sums, inv, at, at + gram), window - gram + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
    anchor = anchors[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(at)))
    start = at[lead]
    content = tx.span_hash(sums, inv, start, start + count + window - 1)
    return row[start], start, count, anchor[lead].view(np.int64), content.view(np.int64), first, (sums, inv)


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """(id, tid, start, n, anchor, content) for every run of every text."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tids = batch.column(0), batch.column(1)
            for lo, _, data, offs in tx.chunks(batch.column(2)):
                row, start, count, anchor, content, first, _sums = _runs_of(data, offs, window)
                if len(row):
                    take = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), tids.take(take), pa.array((start - first[row]).astype(np.int32)), pa.array(count.astype(np.int32)),
                         pa.array(anchor), pa.array(content)], names=["id", "tid", "start", "n", "anchor", "content"])
    return map_arrow(docs.select("id", "tid", "text"), job, "id long, tid long, start int, n int, anchor long, content long")


def _windows(reps: DataFrame, window: int) -> DataFrame:
    """(anchor, content, win, off) for every window of the listed runs; ``reps``: text and its runs (start, n, anchor, content)."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for lo, hi, data, offs in tx.chunks(batch.column(0)):
                starts, ends, first = tx.spans(data, offs)
                sums, inv = tx.sequence_sums(tx.word_hashes(data, starts, ends))
                part = lists.slice(lo, hi - lo)
                flat = part.flatten()
                if len(flat) == 0:
                    continue
                row = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                count = np.asarray(flat.field("n")).astype(np.int64)
                off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(np.asarray(flat.field("start")).astype(np.int64) + first[row], count) + off
                which = pa.array(np.repeat(np.arange(len(flat)), count))
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor").take(which), flat.field("content").take(which),
                     pa.array(tx.span_hash(sums, inv, at, at + window).view(np.int64)), pa.array(off.astype(np.int32))],
                    names=["anchor", "content", "win", "off"])
    return map_arrow(reps, job, "anchor long, content long, win long, off int")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Cut the covered words; ``docs``: id, text, cuts (windows to remove: first word and how many windows follow)."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, n_words, n_removed = batch.column(0), [], [], []
            for raw, cuts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = raw.split()
                gone = 0
                if cuts:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [c["start"] for c in cuts], 1)
                    np.add.at(edge, [c["start"] + c["n"] + window - 1 for c in cuts], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    n_words.append(len(words))
                    words = [w for w, k in zip(words, keep) if k]
                else:
                    n_words.append(len(words))
                n_removed.append(gone)
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["id", "kept_text", "n_words", "n_removed"])
    return map_arrow(docs, job, "id long, kept_text string, n_words long, n_removed long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, kept_text, n_words, n_removed) per document: words covered by a window of ``window`` consecutive words that
    also starts in a document with a smaller id are removed, the others joined by one space.

    Words are maximal runs of bytes other than space and 0x09-0x0D, unchanged.  A null text has no words; a text with
    fewer words than ``window`` loses nothing.  A window that repeats only inside one document, or only in rows of
    the same id, stays.  Rows with a null id are returned whole and remove nothing.  Rows that repeat an id are
    judged each by itself.  Other input columns are ignored.  An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = named.filter("id is not null").withColumn("tid", F.xxhash64("text"))
    runs = stored(_runs(base, window), "substring-runs")
    classes = runs.groupBy("anchor", "content").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_classes"), F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b")
    judged = classes.join(shared.select("anchor", "n_classes"), "anchor")
    hits = stored(runs.join(judged, ["anchor", "content"]), "substring-hits")
    drop_stored(runs)
    # one run of each class, of its smallest document, stands for the class
    reps = (hits.filter("n_classes > 1 and id = lo").dropDuplicates(["anchor", "content"])
            .groupBy("id", "tid").agg(F.collect_list(F.struct("start", "n", "anchor", "content")).alias("runs")))
    with_text = base.join(reps, ["id", "tid"]).select("text", "runs")
    low = hits.filter("n_classes > 1").groupBy("anchor", "content").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    windows = stored(_windows(with_text, window).join(low, ["anchor", "content"]), "substring-windows")
    least = windows.groupBy("anchor", "win").agg(F.min("lo").alias("least"))
    repeated = (windows.join(least, ["anchor", "win"]).filter("least < hi")
                .groupBy("anchor", "content").agg(F.collect_list(F.struct("off", "least")).alias("wins")))
    mixed = (hits.filter("n_classes > 1").join(repeated, ["anchor", "content"])
             .select("id", "tid", F.expr("transform(filter(wins, w -> w.least < id), w -> struct(start + w.off as start, 1 as n))").alias("cuts"))
             .filter("size(cuts) > 0"))
    whole = hits.filter("n_classes = 1 and lo < id").select("id", "tid", F.array(F.struct("start", "n")).alias("cuts"))
    cuts = stored(whole.union(mixed).groupBy("id", "tid").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "substring-cuts")
    drop_stored(hits, windows)
    none = F.lit(None).cast("array<struct<start:int,n:int>>")
    return _cut(base.join(cuts, ["id", "tid"], "left").select("id", "text", "cuts")
                .union(named.filter("id is null").select("id", "text", none.alias("cuts"))), window).withColumnRenamed("id", id_col)
