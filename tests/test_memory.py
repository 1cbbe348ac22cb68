"""Peak memory of the Python functions that run inside tasks, on rows made here."""

import tracemalloc

import numpy as np
import pandas as pd

from lagwise.operators import anomaly as an


def peak_mb(job):
    tracemalloc.start()
    try:
        out = job()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_nearest_holds_small_blocks():
    """A slab of 2,048 points, many of them equal: the same neighbours as a full sort, within 30 MB (nearly the whole slab at once took 96)."""
    rng = np.random.default_rng(4)
    x, keys = np.round(rng.normal(size=(2048, 2)), 1), rng.permutation(2048)
    got, mb = peak_mb(lambda: an._nearest(keys, x, keys, x, 20, own=True))
    assert mb < 30
    for i in (0, 1, 777, 2047):
        d = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((keys, d))[:20]
        mine = got[got["_k"] == keys[i]]
        assert mine["nbr"].tolist() == keys[best].tolist() and mine["dist"].tolist() == d[best].tolist()
    some, _ = peak_mb(lambda: an._nearest(keys[:3], x[:3] + 0.05, keys, x, 5))
    assert len(some) == 15 and some["_k"].tolist() == np.repeat(keys[:3], 5).tolist()


def test_toxicity_fit_holds_one_matrix():
    """2,000 texts of 1,024 chosen features: P and U are parts of one matrix of 33 MB, not copies beside it."""
    from lagwise.llm import toxicity
    rng, rows = np.random.default_rng(1), []
    for i in range(2000):
        y = i % 3 == 0
        ids = np.unique(np.concatenate([rng.integers(0, 1 << 20, 100), rng.integers(0, 1500, 200 if y else 2) * 7])).astype(np.int32)
        rows.append((0, y, 300, ids.tobytes(), np.ones(len(ids), np.int32).tobytes()))
    group = pd.DataFrame(rows, columns=["part", "positive", "words", "ids", "counts"])
    out, mb = peak_mb(lambda: toxicity._fit_group(group, 0.1))
    assert len(out) == 1025 and mb < 60
    again = toxicity._fit_group(group.sort_values("positive", kind="stable"), 0.1)
    assert np.allclose(out["present"], again["present"])


def test_id_digests_of_a_slice_at_once():
    import hashlib

    import pyarrow as pa

    from lagwise.llm import ids
    lists = [[], [1], list(range(70_000)), [], [5, 0, 49_999], list(range(200_000)), list(range(300_000)), [7], []]
    want = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in lists]
    made = pa.array([[9], *lists], pa.list_(pa.int32()))
    assert ids.ids_digests(made.slice(1)) == want
    assert ids.ids_digests(made.slice(1, 0)) == []


def test_ngram_keys_are_combined_by_slice_and_counted_in_small_partitions(spark):
    """Sets that differ in one word: one row per key and slice, the keys of several sets found whole, and texts and keys in small portions."""
    from collections import defaultdict

    import pyarrow as pa
    from pyspark.sql import functions as F

    from lagwise.llm import ngram_join as nj, store
    lines = [" ".join(f"w{g}-{j}" if j != 30 else f"x{i}" for j in range(60)) for g in range(3) for i in range(40)] + ["", "one two", "one two"]
    texts = spark.createDataFrame([(x,) for x in lines], "text string").coalesce(1)
    keys = [(r.key, r.x, r.y) for r in nj._key_rows(texts, 4, 85).collect()]
    assert len(keys) == len({k for k, _, _ in keys}) and all(x <= y for _, x, y in keys)
    sigs = defaultdict(set)
    raw = [x.encode() for x in dict.fromkeys(lines)]
    for s in nj._sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 4):
        for key in np.concatenate([k for k, _ in nj._keys(s, 85)]).view(np.int64) if len(s) else []:
            sigs[int(key)].add(nj._signature(s)[0])
    want = {k for k, v in sigs.items() if len(v) > 1}
    many = nj._repeated(texts, 4, 85, 20 * nj.COUNTED)
    assert want and {r.key for r in many.collect()} == want
    assert "hashpartitioning(key" in (plan := many._jdf.queryExecution().toString()) and ", 20)" in plan
    before = spark.conf.get(store.BATCH_ROWS)
    with store.text_batches(spark):
        sizes = spark.range(5000, numPartitions=1).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long")
        assert sizes.agg(F.max("n")).first()[0] <= store.TEXT_ROWS
    assert spark.conf.get(store.BATCH_ROWS) == before


def test_ngram_join_stores_only_sets_that_may_link(spark, monkeypatch):
    """Texts that begin with the same third share block keys; only those with near-copies are stored with their sets."""
    from lagwise.llm import ngram_join as nj
    rng = np.random.default_rng(3)
    words = [[f"c{j}" for j in range(int(n * 0.3))] + [f"w{i}-{j}" for j in range(n - int(n * 0.3))] for i, n in enumerate(rng.integers(900, 1500, 120).tolist())]
    for i in (0, 1, 2):
        words.append(words[i][:-50] + ["other"] + words[i][-49:])
    sizes, kept = {}, nj.stored

    def stored(df, name):
        out = kept(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(nj, "stored", stored)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nj.ngram_join(docs, size=5, percent=80).collect()}
    assert got == {i: i - 120 if i >= 120 else i for i in range(123)}
    assert sizes["ngram-nodes"] == 123 and sizes["ngram-hits"] == 6


def test_ngram_keys_and_marks_of_a_slice():
    """Keys and marks of a slice at once are those of each set alone, and partners miss no more marks than they may."""
    from lagwise.llm import ngram_join as nj
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 4, 5, 9, 40, 0, 333, 2000)]
    for percent in (50, 80, 85, 99, 100):
        keys, counts, who, agree = nj._slice_keys(np.concatenate(sets), np.array([len(s) for s in sets]), percent)
        alone = [(i, k, a) for i, s in enumerate(sets) if len(s) for k, a in nj._keys(s, percent)]
        parts = np.split(keys, np.cumsum(counts)[:-1])
        assert [(i, k.tolist(), a) for i, k, a in alone] == [(i, k.tolist(), a) for i, k, a in zip(who.tolist(), parts, agree.tolist())]
        whole = sets[-1]
        for lacks in (0, 2000 * (100 - percent) // 100):
            marks, _, _, least = nj._slice_marks(whole, np.array([2000]), percent)
            assert np.isin(marks, np.delete(whole, rng.permutation(2000)[:lacks])).sum() >= least[0]
    assert nj._slice_signatures(sets) == [nj._signature(s) for s in sets]
