"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Linear classifiers are trained in numpy from confirmed toxic texts (P) and unlabelled texts (U) with the risk

    R(g) = pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

where ``pi`` is the class prior and l the logistic loss; when the second part falls below zero the step goes against
it, so the toxic texts hidden in U do not pull the classifier down.  Features are hashed lower-cased words and word
beginnings of 4 to 7 bytes (slurs inflect), each with its presence and its rate in the text; a classifier keeps the
features that stand out in P.  Several classifiers, each with its own part of U, are trained as separate Spark groups
on a bounded, documented sample (``MAX_POSITIVE``, ``MAX_UNLABELLED``); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .ids import text_slices
from .store import map_arrow, map_groups

MAX_POSITIVE = 1500  #: toxic texts trained on, the same for each classifier
MAX_UNLABELLED = 2500  #: unlabelled texts of each classifier
CLASSIFIERS = 3
FEATURES = 1024  #: hashed features a classifier keeps
HASH_BITS = 20
PREFIXES = (4, 5, 6, 7)

_U = np.uint64
_GAP = np.ones(256, dtype=bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning, and the words of each row."""
    starts, ends, first = tx.spans(data, offs, _GAP)
    sums, inv = tx.byte_sums(data, fold_case=True)
    shift = _U(64 - HASH_BITS)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    rows, found = [row], [tx.span_hash(sums, inv, starts, ends) >> shift]
    for k in PREFIXES:
        longer = ends - starts > k
        s = starts[longer]
        rows.append(row[longer])
        found.append(tx.mix(tx.span_hash(sums, inv, s, s + k) + _U(1)) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), np.diff(first)


def _examples(texts: DataFrame) -> DataFrame:
    """(part, positive, words, ids, counts) per text; ids and counts are packed arrays."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, counts = [], [], []
            for lo, hi, data, offs in tx.chunks(batch.column(2)):
                row, found, n = _features(data, offs)
                key, count = np.unique(row << HASH_BITS | found, return_counts=True)
                edge = np.searchsorted(key >> HASH_BITS, np.arange(hi - lo + 1))
                words += n.tolist()
                ids += [(key[a:b] & ((1 << HASH_BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(edge, edge[1:])]
                counts += [count[a:b].astype(np.int32).tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["part", "positive", "words", "ids", "counts"])
    return map_arrow(texts, job, "part int, positive boolean, words long, ids binary, counts binary")


def train_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative PU risk, full-batch Adam steps."""
    n = int(positive.sum())
    p, u = (x[:n], x[n:]) if positive[:n].all() else (x[positive], x[~positive])  # no copies if P comes first
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def slope(rows: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean logistic loss of sign * g over rows and its gradient."""
        z = sign * (rows @ w[:-1] + w[-1])
        pull = -sign / (1 + np.exp(np.clip(z, -50, 50))) / len(rows)
        return np.logaddexp(0, -z).mean(), np.append(pull @ rows, pull.sum())

    for step in range(1, epochs + 1):
        _, gain = slope(p, 1.0)
        loss_u, grad_u = slope(u, -1.0)
        loss_p, grad_p = slope(p, -1.0)
        negative, grad_n = loss_u - prior * loss_p, grad_u - prior * grad_p
        grad = prior * gain + grad_n if negative >= 0 else -grad_n
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _values(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The rate of a feature in its text, on a logarithmic scale."""
    return np.log1p(100.0 * counts / np.maximum(words, 1)) / 2


def _fit_group(group: pd.DataFrame, prior: float) -> pd.DataFrame:
    """One classifier: choose features that stand out in P, train, return feature weights (feature -1: the bias)."""
    group = group.sort_values("positive", ascending=False, kind="stable")
    positive = group["positive"].to_numpy(dtype=bool)
    none = pd.DataFrame({"part": [], "feature": [], "present": [], "rate": []})
    if not positive.any() or positive.all():
        return none
    ids = [np.frombuffer(b, dtype=np.int32) for b in group["ids"]]
    counts = [np.frombuffer(b, dtype=np.int32) for b in group["counts"]]
    share = [np.bincount(np.concatenate([i for i, y in zip(ids, positive) if y == side] or [np.zeros(0, np.int32)]), minlength=1 << HASH_BITS)
             / max(1, (positive == side).sum()) for side in (True, False)]
    seen = np.flatnonzero(share[0] > share[1])  # no other feature stands out
    share = [s[seen] for s in share]
    spread = np.sqrt((share[0] * (1 - share[0]) + 1e-3) / positive.sum() + (share[1] * (1 - share[1]) + 1e-3) / (~positive).sum())
    z = (share[0] - share[1]) / spread
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = seen[chosen[z[chosen] > 2.5]]
    slot = np.full(1 << HASH_BITS, -1, dtype=np.int64)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((len(ids), 2 * len(chosen)))
    for r, (i, c, n) in enumerate(zip(ids, counts, group["words"])):
        at = slot[i]
        x[r, at[at >= 0]] = 1
        x[r, at[at >= 0] + len(chosen)] = _values(c[at >= 0], np.array(n))
    w, b = train_nnpu(x, positive, prior)
    return pd.DataFrame({"part": int(group["part"].iloc[0]), "feature": np.append(chosen, -1), "present": np.append(w[:len(chosen)], b),
                         "rate": np.append(w[len(chosen):], 0.0)})


@dataclass(frozen=True)
class PUModel:
    """Linear classifiers over hashed features; at most ``CLASSIFIERS * FEATURES`` weights."""

    features: np.ndarray  #: hashed features of any classifier
    present: np.ndarray  #: (classifiers, features) weight of a feature's presence
    rate: np.ndarray  #: (classifiers, features) weight of its rate
    bias: np.ndarray

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The mean probability over the classifiers for each row of a chunk of texts."""
        n, f = len(offs) - 1, len(self.features)
        if not len(self.bias):
            return np.zeros(n)
        slot = np.full(1 << HASH_BITS, -1, dtype=np.int64)
        slot[self.features] = np.arange(f)
        row, found, words = _features(data, offs)
        at = slot[found]
        key, count = np.unique(row[at >= 0] * f + at[at >= 0], return_counts=True)
        row, at = key // max(f, 1), key % max(f, 1)
        rate = _values(count, words[row])
        g = [b + np.bincount(row, p[at] + r[at] * rate, minlength=n) for p, r, b in zip(self.present, self.rate, self.bias)]
        return np.mean(1 / (1 + np.exp(-np.clip(g, -50, 50))), axis=0)


def fit_pu(docs: DataFrame, toxic_ids: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text") -> PUModel:
    """Train on confirmed toxic rows (``toxic_ids``: their ids) and unlabelled rows, both from ``docs``.

    A sample of at most ``MAX_POSITIVE`` toxic and ``CLASSIFIERS * MAX_UNLABELLED`` other rows is taken by the least hash
    of the id, so reruns agree.  Null ids take no part.  Without toxic or without unlabelled texts the model scores 0.
    """
    rank = F.xxhash64("id", F.lit("toxicity"))
    toxic = toxic_ids.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    toxic = toxic.orderBy(rank, "id").limit(MAX_POSITIVE)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).filter("id is not null")
    others = texts.select("id").distinct().orderBy(rank, "id").limit(CLASSIFIERS * MAX_UNLABELLED).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(CLASSIFIERS)).cast("int").alias("part"), F.lit(False).alias("positive"))
    each = toxic.select("id", F.explode(F.sequence(F.lit(0), F.lit(CLASSIFIERS - 1))).alias("part"), F.lit(True).alias("positive"))
    # broadcast: at most CLASSIFIERS * (MAX_POSITIVE + MAX_UNLABELLED) ids
    sample = texts.join(F.broadcast(others.union(each)), "id").select("part", "positive", "text")
    fitted = map_groups(_examples(sample).groupBy("part"), lambda g: _fit_group(g, prior), "part int, feature int, present double, rate double",
                        docs.sparkSession).toPandas().sort_values(["part", "feature"])
    features = np.unique(fitted.loc[fitted.feature >= 0, "feature"].to_numpy(dtype=np.int64))
    present, rate, bias = [], [], []
    for _, g in fitted.groupby("part"):
        bias.append(g.loc[g.feature < 0, "present"].iloc[0])
        own = g[g.feature >= 0]
        at = np.searchsorted(features, own.feature.to_numpy(dtype=np.int64))
        for out, name in ((present, "present"), (rate, "rate")):
            row = np.zeros(len(features))
            row[at] = own[name]
            out.append(row)
    return PUModel(features, np.array(present), np.array(rate), np.array(bias))


def score_toxicity(docs: DataFrame, model: PUModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, a score of 0 to 1 from each whole text; a null text scores like the empty one.

    A column named ``out`` is replaced; all other columns are kept as they are.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).schema
    # a text that is kept crosses to the workers once, and is lowered there in slices
    at = kept.index(text_col) if (text_col, "string") in docs.select(*kept).dtypes else len(kept)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, done = np.zeros(batch.num_rows), 0
            for part in text_slices(batch, at):
                lowered = pa.array([(t or "").lower() for t in part.column(at).to_pylist()], pa.large_string())
                for lo, hi, data, offs in tx.chunks(lowered):
                    scores[done + lo:done + hi] = model.scores(data, offs)
                done += part.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(scores)], names=[*kept, out])
    extra = [] if at < len(kept) else [F.col(f"`{text_col}`").cast("string").alias("__text")]
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in kept], *extra), job, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that labels are never learnt from: crc32 of the id as text, modulo 3, is 1.  False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_model(docs: DataFrame, labels: DataFrame) -> PUModel:
    """Train from the rows of ``labels`` (doc_id, toxic) outside the held-out fold; the class prior is the share of toxic
    ones among them.  Unlabelled texts come from outside that fold too."""
    train = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    share = train.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
    prior = min(0.5, max(0.01, share if share is not None else 0.1))
    return fit_pu(docs.filter(~held_out()), train.filter("toxic = 1").select("doc_id"), prior)
