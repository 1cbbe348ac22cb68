"""Top-k search against brute force, over several norm buckets, groups, parts and chunks, with repeats and clashing columns."""

import math
import random

import numpy as np
import pytest

from lagwise.llm import topk_search


def brute(rows, k):
    ints = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, v in sorted({x for x in ints if x[0] % 20 == 0}):
        best = sorted((-dot(v, w), i) for i, w in ints if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "lengths", "few"])
def test_top_k_over_groups(spark, monkeypatch, kind):
    for name, value in (("GROUP", 100), ("HEAD", 30), ("QUERIES", 4), ("CHUNK", 16)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(3)
    n = 30 if kind == "few" else 600
    vectors = rng.normal(size=(n, 6))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if kind == "lengths":
        vectors *= np.exp(rng.normal(size=n) * 1.5)[:, None]
    rows = [(i if i % 7 else i - 1, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [rows[5]] * 25 + [(20, [1.0, 2.0]), (40, []), (41, [0.0] * 6), (60, [0.0] * 6), (None, [1.0] * 6), (80, None), (81, [None] * 6), (82, [math.inf] * 6)]
    random.Random(2).shuffle(rows)
    got = topk_search.top_k(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, g int").repartition(4), k=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)
