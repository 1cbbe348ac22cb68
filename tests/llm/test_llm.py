"""Corpus operators against brute force on small frames: nulls, empty and long texts, ties, repeats, clashing columns."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.llm import byte_bpe, components, exact_dedup, html_crf, mixing, ngram_join, store, substring_dedup, topk_search, toxicity, training_order, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base, passage = words(rng, 120), words(rng, 70)
    out = [base, base, base.replace("w1 ", "zz ", 1), base + " tail", passage + " " + words(rng, 30), words(rng, 30) + "\n" + passage, None, "", "  ", "one two", "One  TWO",
           words(rng, 4000), "the " * 300, "the " * 280 + "end", "é ñ x"]
    out += [words(rng, rng.randrange(1, 90)) for _ in range(25)]
    return [(i * 3, t, "en", [None, "a", "b", "é"][i % 4], 1) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_exact_dedup(spark, docs, rows):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs.withColumn("kept", F.lit("clash"))).collect()}
    for i, t, *_ in rows:
        same = [j for j, u, *_ in rows if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), max(same) == i)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    nulls = exact_dedup.exact_dedup(spark.createDataFrame([(None, "x"), (4, "x"), (None, "y")], "doc_id long, text string")).collect()
    assert sorted((r.text, r.kept) for r in nulls) == [("x", False), ("x", True), ("y", True)]


def test_substring_dedup(docs, rows):
    first, split = {}, {i: (t or "").encode().split() for i, t, *_ in rows}
    for i in sorted(split):
        for p in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][p:p + 50]), i)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, w in split.items():
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p:p + 50])] < i:
                keep[p:p + 50] = [False] * 50
        assert got[i].kept_text.encode() == b" ".join(x for x, k in zip(w, keep) if k)
        assert (got[i].n_words, got[i].n_removed) == (len(w), keep.count(False))
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, size=size, percent=percent).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_bands_hold_every_partner():
    ends = ngram_join.size_bands(85, 5000)
    band = lambda n: next(k for k in range(len(ends)) if ends[k + 1] > n)
    for a in range(1, 2000):
        assert band(a * 100 // 85) - band(a) <= 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 60) + (" slurx badword slurx" if i % 4 == 0 else "")) for i in range(240)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.labelled_model(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(240)) and got[900] == got[901] < 0.7
    none = toxicity.score_toxicity(docs, toxicity.labelled_model(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.0}


def test_nnpu_learns_from_positive_and_unlabelled():
    rng = np.random.default_rng(0)
    truth = rng.random(800) < 0.3
    x = rng.normal(size=(800, 3))
    x[truth, 0] += 4
    positive = truth & (np.arange(800) < 400)
    w, b = toxicity.train_nnpu(x, positive, truth[~positive].mean())
    hidden = ~positive
    assert (((x @ w + b) > 0)[hidden] == truth[hidden]).mean() > 0.9


@pytest.mark.parametrize("ids", ["none", "one", "whole rows"])
def test_mixing_rows_without_ids_of_their_own(spark, ids):
    """Null or repeated ids and wholly equal rows leave every source within one document of its target."""
    made = [(None if ids == "none" else 7, s, " ".join(f"{s}{0 if ids == 'whole rows' else i}w{j}" for j in range(10))) for s in "abc" for i in range(500)]
    df = spark.createDataFrame(made, "doc_id long, source string, text string")
    out = mixing.mix_sources(df).collect()
    assert len(out) == 1500
    for s in "abc":
        mine = [r for r in out if r["source"] == s]
        assert len(mine) == 500 and abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10 and all(r["taken"] in (0, 10, 20) for r in mine)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()), key=str)


def test_mixing(docs, rows):
    out = mixing.mix_sources(docs.withColumn("taken", F.lit("clash"))).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    got = out.collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.mix_sources(docs.repartition(7)).select(*out.columns).collect()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for s in (None, "a", "b", "é"):
        mine = [r for r in got if r.source == s]
        assert all(r.size == count(next(t for i, t, *_ in rows if i == r.doc_id)) and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_source_targets():
    got = mixing.source_targets({"b": 100, "a": 10, None: 50}, (3, 1, 2), Fraction(3, 2), 2)
    assert got == {"a": 20, None: 100, "b": 120}  # a and null stop at twice their size, b takes the rest of 240


def test_byte_bpe(docs, rows):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.load_coder(path, P.PATTERN)
    want = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for _, t, *_ in rows] + ["a" * 3000, " " * 500, "\n" * 300]
    texts += ["".join(rng.choice("ab cdé\n\t '’s1２  中ñthe ing .,!😀\x1c\x85") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert all(coder.encode(t).tolist() == want.encode_ordinary(t) for t in texts)
    out = byte_bpe.decode_bpe(byte_bpe.encode_bpe(docs.withColumn("ids", F.lit("clash")), path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in out.collect()} == {i: (t or "").encode() for i, t, *_ in rows}


def test_training_order(spark, docs, rows):
    path = store.shared_path(spark, "test-order")
    stored = store.stored(docs, "test-docs")
    got = training_order.materialise_order(stored, path, length=64, per_shard=10).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    record = list(training_order.read_slots(path, 0, len(got), 64, 10))
    text = {i: (t or "").encode() + b"\xff" for i, t, *_ in rows}
    for r in got:
        want = text[r.id][r.at:r.at + 64]
        assert record[r.slot][:len(want)] == want and (r.shard, r.offset) == (r.slot // 10, r.slot % 10 * 64)
    assert sum(x.count(b"\xff") for x in record) >= len(rows)
    again = training_order.materialise_order(stored, path, length=64, per_shard=10).collect()
    assert sorted(again) == sorted(got)
    for total in (1, 2, 3, 10, 1000):
        assert sorted(training_order.feistel(np.arange(total), total, 9)) == list(range(total))


def test_top_k(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 5)]) for i in range(300)]
    data += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, data[20][1]), (304, data[20][1]), (340, [0.0] * 6), (None, [1.0] * 6), (360, [])]
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:20]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = topk_search.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in got.collect()} == want
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    link = '<link href="{}" rel="canonical">'
    pages = [(1, "http://A.Example.com/en/x?q=1", "", "example.com/en/", "block"), (2, "https://www.example.com/en/x", "", "www.example.com/en/", "allow"),
             (3, "http://b.org/1", link.format("http://c.net/es/2"), None, "block"), (4, "https://b.org/2#f", link.format("http://b.org/1"), None, "block"),
             (5, "http://d.org/", link.format("http://c.net/es/9") + '<meta http-equiv="refresh" content="0; url=http://ok.com/">', None, "allow"),
             (6, None, None, None, "allow"), (7, "no url", "", None, "allow"), (8, "http://x.com", "", None, "allow"), (9, "http://c.net/es/2", "", "net/es/", "block")]
    df = spark.createDataFrame([(p[0], p[1], p[2], "clash") for p in pages], "page_id int, url string, html string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {p[0]: p[3:] for p in pages}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("url, head, verdict", [
    ("http://a.example.net/de/5", '<link rel="canonical" href="../fr/5">', "block"),  # relative to the folder
    ("http://a.example.net/fr2/5", '<link rel="canonical" href="post.html">', "allow"),
    ("http://q.net/page", '<meta http-equiv="refresh" content="0; url=?page=1">', "block"),  # relative to the query
    ("http://a.org/1", '<link rel="canonical" href="/go?to=http://c.net/es/2">', "allow"),  # "://" in a query is no scheme
    ("http://a.org/2", '<link rel="canonical" href="http://r.org/x?a=1&amp;b=2">', "block"),  # character references
    ("http://a.org/3", '<meta http-equiv="refresh" content="0;url=http://r.org/x?a=1&amp;b=2">', "block"),
    ("http://a.org/4", '<link rel="canonical" href="http://r.org/y?a=1&copy=2">', "block"),  # none without ";" before "="
    ("http://a.org/5", '<link rel="canonical" href="http://n.org/"><link rel="canonical" href="http://c.net/es/5">', "block"),  # every tag
    ("http://a.org/6", '<meta http-equiv=refresh content="0;url=http://n.org/"><meta http-equiv=refresh content="0;url=\'http://c.net/es/6\'">', "block"),
    ("http://a.org/7", '<base href="http://c.net/es/"><link href=7 rel="shortlink canonical">', "block"),
    ("http://a.org/8", '<link rel="canonical" href="mailto:x@c.net/es/8">', "allow"),
    ("http://a.org/9", '<link data-href="http://n.org/" title="a>b" rel=canonical href="//c.net/./x/../es/9">', "block"),
    ("http://a.org/10", '<!-- <link rel="canonical" href="http://c.net/es/1"> -->', "allow"),  # no tags: comments, scripts, text areas, titles
    ("http://a.org/11", '<script>var x = \'<link rel="canonical" href="http://c.net/es/1">\';</script>', "allow"),
    ("http://a.org/12", '<textarea><link rel="canonical" href="http://c.net/es/1"></textarea>', "allow"),
    ("http://a.org/13", '<title><link rel=canonical href=http://c.net/es/1></title><!--><link rel=canonical href=http://c.net/es/1>', "block"),
    ("http://a.org/14", "<link " + " ".join(f'data-{i}="{i}"' for i in range(400)) + ' rel="canonical" href="http://c.net/es/1">', "block"),
    ("http://a.org/15", "<link rel=x " * 20_000 + '<script><link rel=canonical href=http://c.net/es/1>', "block"),  # one long tag, then a link
    ("http://a.org/16", '<textarea>never closed <link rel="canonical" href="http://c.net/es/1">', "allow"),
])
def test_url_references(spark, url, head, verdict):
    """A reference joins its page to the class of the url that it stands for, and to no other."""
    rules = (("net", "/es/", "block"), ("net", "/fr/", "block"), ("block.org", "/", "block"))
    alias = '<link rel="canonical" href="http://block.org/">'
    pages = [(0, url, f"<head>{head}</head>"), (1, "http://q.net/page?page=1", alias), (2, "http://r.org/x?a=1&b=2", alias), (3, "http://r.org/y?a=1&copy=2", alias)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules).collect()}[0] == verdict


def test_url_relative_redirect(spark):
    df = spark.createDataFrame([(1, "http://a.net/de/5", "")], "page_id int, url string, html string")
    redirects = spark.createDataFrame([("http://a.net/de/5", "../fr/5"), ("http://a.net/de/5", None)], "url string, target string")
    assert url_filter.judge_urls(df, (("net", "/fr/", "block"),), redirects).collect()[0].verdict == "block"


def test_html(spark):
    page = ("<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href=/>Home</a><li><a>x</a></ul></nav><div class='ad'>Buy this now.</div>"
            "<article><h1>A head &amp; more</h1><p><b>First  block of\n text here.<br><p>Second &eacute; block of text here.</article><form><p>Sign up for news.</form>"
            "<section class=comments><p>I liked it a lot, thanks.</p></section><footer>&copy; me</footer>")
    model = html_crf.fit_html(spark.createDataFrame([], "page_id long, html string, main string"))
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_crf.extract_main(df, model).collect()}
    assert got == {1: "A head & more\nFirst block of text here.\nSecond é block of text here.", 2: "", 3: "", 4: ""}


def test_toxicity_sends_a_kept_text_once(spark):
    """Scores do not depend on whether the text stays in the result or what it is called; nulls, capitals outside ASCII, a replaced column."""
    texts = ["BAD Word ÉTÉ", "bad word été", None, "", "İSTANBUL ΣΟΦΟΣ", "nice " * 300] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = toxicity.fit_pu(docs, docs.filter("doc_id % 6 < 2").select("doc_id"), 0.3)
    one = toxicity.score_toxicity(docs, model)
    assert one._jdf.queryExecution().analyzed().toString().count("lower(") == 0
    got = {r.doc_id: r for r in one.collect()}
    assert [got[i].text for i in range(len(texts))] == texts
    assert got[0].score == got[1].score > got[5].score and got[2].score == got[3].score
    lowered = docs.withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(lowered, model).collect()} == {i: r.score for i, r in got.items()}
    replaced = toxicity.score_toxicity(docs.withColumnRenamed("text", "score"), model, text_col="score")
    assert {r.doc_id: r.score for r in replaced.collect()} == {i: r.score for i, r in got.items()}
