"""Phrase mining and conversation repair against brute force, SentencePiece coding against the library."""

import collections
import hashlib
import itertools
import random
import re

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lagwise.llm import collocation, conversation, ids, piece_bpe
from lagwise.llm.queries import PIECES

MODEL = public_tokenizers.path(PIECES)
ODD = ["", " ", "a", "  a  b ", "a\nb", "\n", "▁a", " ▁", "日本\t語", "<s>", "<0x0A>", "\x00x", "🤦🏽‍♂️ é é", " " * 37, "aaaaaaaaaaaaa " * 9, "-" * 1001, "é" * 50, "\U0010ffff a", "x" + " " * 8 + "y" + " " * 7 + "t"]


def brute_phrases(rows, support, top, covered=80):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang, lower = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    many = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in many.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in many.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("shards,group", [(1, 100_000), (4, 100_000), (4, 20)])
def test_collocations(spark, monkeypatch, shards, group):
    monkeypatch.setattr(collocation, "GROUP", group)
    rng = random.Random(5)
    some = ["The", "of", "cat", "É", "a-b", "x", "rain"]
    rows = [("".join(rng.choice(some) + rng.choice([" ", " ", "\t ", ". ", "\n", "\x0b", " "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [(None, "en"), ("", None), ("  .. ", "fr"), ("one two three " * 400, "en"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i // 2, t, g, "clash") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(5)
    got = collocation.mine_collocations(docs, support=6, top=15, shards=shards)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 6, 15)
    assert collocation.mine_collocations(docs.limit(0)).count() == 0


def brute_repair(rows):
    """Least (cost, letters, repaired rows) over all edits, with up to two insertions anywhere."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    options = []
    for (_, role, text), fault in zip(rows, faults):
        stay = 5 if fault == "truncated" else 0
        options.append([(2, "D", None)] + ([] if fault in ("blank", "duplicate") else [(stay, "K", (role, text)), (stay + 1, "R", ("user", text)), (stay + 1, "R", ("assistant", text))]))
    inserts = [[], *[[x] for x in ("user", "assistant")], ["user", "assistant"], ["assistant", "user"]]
    best = None
    for chosen in itertools.product(*options):
        for extra in inserts:
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), len(extra)):
                line = []
                for i in range(len(rows) + 1):
                    line += [(5, "I", (r, "")) for r, p in zip(extra, places) if p == i]
                    line += [chosen[i]] if i < len(rows) else []
                kept = [x[2] for x in line if x[2]]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
                    key = (sum(x[0] for x in line), "".join(x[1] for x in line))
                    if best is None or key < best[0]:
                        best = (key, kept)
    counts = collections.Counter(faults)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), *best[0]), best[1]


@pytest.mark.parametrize("block", [2, 256])
def test_conversation_repair(spark, block, monkeypatch):
    rng = random.Random(9)
    rows = {c: sorted(((rng.choice([None, 0, 1, 1, 2, 5, 9]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s2"]), rng.choice(["A.", "B!", "c", " ", "", "d? \n", "é."])) for _ in range(rng.randrange(1, 6))),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode())) for c in range(70)}
    for conv, group in rows.items():
        repair = conversation.Repair()
        with monkeypatch.context() as m:
            for name, value in (("BLOCK", block), ("_LOW", 5 ** block), ("_COST", 4 * 5 ** block)):
                m.setattr(conversation, name, value)
            state = conversation._Conversation()
            state.repair = repair
            seen = set()
            for turn, role, text in group:
                bare = text.strip(conversation.WHITE)
                state.add(turn, role, text, "blank" if not bare else None if bare[-1] in ".!?" else "truncated", (role, text) in seen)
                seen.add((role, text))
            want, kept = brute_repair(group)
            assert state.result() == (*want, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    table = spark.createDataFrame([(c if c else None, *r, "clash") for c, g in rows.items() for r in g], "conv_id long, turn long, role string, text string, audit string").repartition(4)
    out = conversation.repair_conversations(table)
    got = {r.conv_id or 0: tuple(r)[1:] for r in out.collect()}
    repaired = collections.defaultdict(list)
    for r in sorted(conversation.apply_repairs(table, out).collect(), key=lambda r: r.place):
        repaired[r.conv_id or 0].append((r.role, r.text))
    for conv, group in rows.items():
        want, kept = brute_repair(group)
        assert got[conv][:-1] == want and repaired[conv] == kept
        assert got[conv][-1] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    assert conversation.repair_conversations(table.limit(0)).count() == 0


def test_conversation_nulls_and_long(spark):
    rows = [(1, None, None, None), (1, 3, "user", "Hi."), (1, 4, "assistant", "Yes.")] + [(2, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(1200)] + [(3, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversation.repair_conversations(table).collect()}
    assert (got[1].blank, got[1].gaps, got[1].audit, got[1].cost) == (1, 0, "DKK", 2)
    assert (got[2].audit, got[2].illegal, got[2].cost) == ("K" * 1200, 0, 0)
    assert (got[3].audit, got[3].repaired_sha256) == ("D", hashlib.sha256().hexdigest())
    every = conversation.repair_all(table.filter("conv_id = 3"), table.select("conv_id"))
    assert sorted((r.conv_id, r.cost, r.audit) for r in every.collect()) == [(1, 0, ""), (2, 0, ""), (3, 2, "D")]


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.load_pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_library(pieces):
    coder, library = pieces
    rng = random.Random(1)
    alphabet = " abcdetshinorTHE.,▁-=é日\n0123"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(800)] + ["lorem ipsum " * 20_000]
    got = coder.encode_lists(texts)
    assert got.to_pylist() == library.encode(texts, num_threads=1)
    assert [x.as_py().decode() for x in coder.decode_lists(got)] == [library.decode(x) for x in got.to_pylist()]
    coder.forget()
    assert coder.encode_lists(texts[:50]).to_pylist() == library.encode(texts[:50], num_threads=1)
    strange = [[rng.choice([0, 1, 2, 233, 154, 168, 28705, 264, 259, 5, rng.randrange(32000)]) for _ in range(rng.randrange(9))] for _ in range(1000)]
    assert [x.as_py().decode() for x in coder.decode_lists(pa.array(strange, pa.list_(pa.int32())))] == [library.decode(x) for x in strange]
    with pytest.raises(ValueError):
        coder.decode_lists(pa.array([[32000]], pa.list_(pa.int32())))


def test_rounds_equal_single_merges(pieces):
    """Vocabularies in which a merge makes an earlier pair: rounds, then the heap, give what single merges give."""
    rng = random.Random(4)
    for _ in range(150):
        coder = object.__new__(piece_bpe.PieceCoder)
        texts = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(12)}
        number = {t: i for i, t in enumerate(["a", "b", *sorted(texts)])}
        rank = {t: rng.randrange(8) for t in texts}
        pairs = sorted((number[t[:k]] * 99 + number[t[k:]], rank[t], number[t]) for t in texts for k in range(1, len(t)) if t[:k] in number and t[k:] in number)
        if not pairs:
            continue
        np = piece_bpe.np
        coder.width = 99
        coder.pair_keys, coder.pair_ranks, coder.pair_made = (np.array(x) for x in zip(*pairs))
        words = [[rng.randrange(2) for _ in range(rng.randrange(1, 14))] for _ in range(20)]
        starts = np.cumsum([0, *map(len, words)])[:-1]
        flat, sizes = coder.merge(np.array([x for w in words for x in w], dtype=np.int32), starts)
        for w, part in zip(words, np.split(flat, np.cumsum(sizes)[:-1])):
            symbols = list(w)
            table = {(k // 99, k % 99): (r, m) for k, r, m in pairs}
            while found := [(*table[p], i) for i in range(len(symbols) - 1) if (p := (symbols[i], symbols[i + 1])) in table]:
                _, made, i = min(found, key=lambda x: (x[0], x[2]))
                symbols[i:i + 2] = [made]
            assert part.tolist() == symbols


def test_pieces_operator(spark, pieces):
    _, library = pieces
    rows = [(i // 2, t, "clash") for i, t in enumerate([None, *ODD, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = piece_bpe.encode_pieces(docs.withColumn("nth", F.monotonically_increasing_id()), MODEL)
    back = piece_bpe.decode_pieces(encoded, MODEL)
    for r in back.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    digests = ids.id_digests(docs, lambda: piece_bpe.load_pieces(MODEL)).collect()
    assert len(digests) == len(rows)
    want = {hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest() for _, t, _ in rows}
    assert {r.ids_sha256 for r in digests} == want
    assert piece_bpe.encode_pieces(docs.limit(0), MODEL).count() == 0
