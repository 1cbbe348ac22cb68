"""The pipeline against a brute-force version of each stage, on what its predecessor kept."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lagwise.llm import byte_bpe, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(20, 90)) for _ in range(150)]
    toxic = set(range(0, 150, 5))
    texts = [t + " slurx badword slurx" if i in toxic else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[1], texts[2]]  # exact copies
    texts += [texts[3] + " tail", texts[3] + " other", texts[4].replace("w", "W", 3), texts[6].rsplit(" ", 1)[0]]  # near copies
    texts += [None, "", "  ", "one two", "One  TWO", words(rng, 3000)]
    return [(i, t, "en", [None, "a", "b", "é"][i % 4], len(t or "")) for i, t in enumerate(texts)], toxic


def near(rows):
    """Ids that stay: the smallest of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert links
    return {i for i in comp if comp[i] == i}


def test_pipeline_stages(spark, tmp_path):
    rows, toxic = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(docs.collect())
    clean, exact, single, mixed, tokens = kept
    assert sorted(r.doc_id for r in clean) == [i for i, *_ in rows if i not in toxic]
    last = {}
    for r in clean:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    assert sorted(r.doc_id for r in single) == sorted(near(exact))

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in single}
    totals = Counter()
    for r in single:
        totals[r.source] += size[r.doc_id]
    target = mixing.source_targets(dict(totals), (3, 1, 2), Fraction(3, 2), 2)
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(size) and all(times[i] == 1 for i in size if size[i] == 0) and max(times.values()) <= 2
    for s in totals:
        mine = [r.doc_id for r in single if r.source == s]
        assert abs(sum(times[i] * size[i] for i in mine) - target[s]) <= max(size[i] for i in mine)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in single}

    coder = byte_bpe.load_coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    whole = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in mixed:
        ids = whole.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    assert sorted(tuple(r) for r in tokens) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_exact_stage_keeps_one_row_of_repeats(spark):
    """Wholly repeated rows, equal texts without ids, and a kept id shared by two texts."""
    rows = [(7, "a b", "en", "x", 3)] * 5 + [(6, "a b", "en", "x", 3)] + [(None, "c d", "en", s, 3) for s in ("y", "x")] + [(None, "e", "en", "x", 1)]
    rows += [(8, None, "en", "x", 0), (8, "", "en", "x", 0), (7, "f", "en", "x", 1), (7, "f", "en", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = corpus_pipeline.exact(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text or "") for r in out.collect())
    assert got == {(7, "a b"): 1, (None, "c d"): 1, (None, "e"): 1, (8, ""): 1, (7, "f"): 1}
