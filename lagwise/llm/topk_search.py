"""Exact top-k inner-product search by norm-bucketed retrieval (LEMP; Teflioudi et al., 2015).

Candidates are put into buckets of similar length, and buckets in falling order of length into groups of about ``GROUP``
vectors (short buckets share a group, a long one has many).  The stated queries go against all candidates in blocks: a
task holds a part of the queries and a group, and visits the group's vectors in chunks of falling length.  A query's
running threshold, the k-th best score it has met, becomes a local cosine threshold for each chunk, threshold / (|q| *
longest).  Above 1 the chunk, and all shorter ones, are skipped; high local thresholds prune by coordinates: a candidate's
direction must lie within the feasible range around the query's on the query's largest coordinates; low ones prune by
length.  What is left is verified with exact integer products.

There are two rounds.  The first meets the longest vectors and gives every query its threshold; the second deals the
queries anew by the length that a candidate must have for them, so that a part of the queries only meets the groups that
are long enough for one of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship_package
from .store import stored

GROUP = 32_768  #: candidates of a group, on average at most
HEAD = 4096  #: longest candidates that the first round meets at least
QUERIES = 1024  #: queries of a part, on average at most
CHUNK = 2048  #: candidates compared at once
BUCKETS_PER_DOUBLING = 8  #: norm buckets: vectors of a bucket differ in length by less than 9 %
COORDINATE_FROM = 0.6  #: local cosine threshold from which coordinates prune better than length
FOCUS = 4  #: coordinates looked at
SLACK = 1e-9
_LEAST = np.iinfo(np.int64).min
_FOUND = "query_id long, qkey long, id long, score long, n int"


def _matrix(vectors) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for r, v in enumerate(vectors):
        out[r, :len(v)] = v
    return out


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def _inside(q: np.ndarray, norm_q: float, local: float, unit: np.ndarray) -> np.ndarray:
    """Candidates whose direction is within acos(``local``) of the query's on the query's largest coordinates."""
    # within acos(local) of the query's direction, so within that of the query's angle to each axis
    direction, width, keep = q / norm_q, np.arccos(min(1.0, local)), np.ones(len(unit), dtype=bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        angle = np.arccos(np.clip(direction[f], -1.0, 1.0))
        keep &= (unit[:, f] >= np.cos(min(np.pi, angle + width)) - 1e-7) & (unit[:, f] <= np.cos(max(0.0, angle - width)) + 1e-7)
    return keep


class _Best:
    """The k best (score, smaller id first) that each of some queries has met."""

    def __init__(self, n: int, k: int, theta: np.ndarray):
        self.k, self.theta = k, theta
        self.query, self.score, self.id, self.n = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Meet candidates, each ``n`` times, and raise the thresholds."""
        query, score, ids, n = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids), (self.n, n)))
        order = np.lexsort((ids, -score, query))
        query, score, ids, n = query[order], score[order], ids[order], n[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))[:len(query)]
        upto = np.cumsum(n) - n  # met before, from the query's best on
        before = upto - np.repeat(upto[first], np.diff(np.append(first, len(query))))
        keep = before < self.k
        kth = keep & (before + n >= self.k)
        self.theta[query[kth]] = np.maximum(self.theta[query[kth]], score[kth])
        self.query, self.score, self.id, self.n = query[keep], score[keep], ids[keep], n[keep]


def _search(q: pd.DataFrame, c: pd.DataFrame, k: int) -> _Best:
    """The k best candidates for each query (columns id, v, theta) among the candidates (id, v, n)."""
    q_rows, c_rows = _matrix(q["v"]), _matrix(c["v"])
    width = max(q_rows.shape[1], c_rows.shape[1])
    q_rows, c_rows = _padded(q_rows, width), _padded(c_rows, width)
    norm_q, norm_c, q_ids, c_ids, copies = _norms(q_rows), _norms(c_rows), q["id"].to_numpy(), c["id"].to_numpy(), c["n"].to_numpy().astype(np.int64)
    order = np.lexsort((c_ids, -norm_c))
    c_rows, norm_c, c_ids, copies = c_rows[order], norm_c[order], c_ids[order], copies[order]
    exact = int(np.abs(q_rows).max(initial=0)) * int(np.abs(c_rows).max(initial=0)) * max(width, 1) < 1 << 53
    kind = np.float64 if exact else np.int64  # products through doubles where no sum can leave their exact range
    q_rows = q_rows.astype(kind)
    best = _Best(len(q), k, q["theta"].to_numpy(dtype=np.float64).copy())
    for lo in range(0, len(c_rows), CHUNK):
        rows, ids, n = c_rows[lo:lo + CHUNK].astype(kind), c_ids[lo:lo + CHUNK], copies[lo:lo + CHUNK]
        reach = norm_q * norm_c[lo]
        some = np.flatnonzero((best.theta <= 0) | (best.theta <= reach * (1 + SLACK)))
        if not len(some):
            break
        local = np.where(best.theta[some] > 0, best.theta[some] / np.maximum(reach[some], 1e-300), 0.0)
        by_length, by_place = some[local < COORDINATE_FROM], some[local >= COORDINATE_FROM]
        for at in range(0, len(by_length), 256):
            mine = by_length[at:at + 256]
            # lengths fall, so the candidates that are long enough for one of them come first
            need = np.where(best.theta[mine] > 0, best.theta[mine] / np.maximum(norm_q[mine], 1e-300), 0.0).min()
            long = int(np.searchsorted(-norm_c[lo:lo + CHUNK], -need * (1 - SLACK), side="right"))
            scores = (q_rows[mine] @ rows[:long].T).astype(np.int64)
            scores[q_ids[mine][:, None] == ids[None, :long]] = _LEAST
            floor = best.theta[mine]
            if scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            a, b = np.nonzero((scores >= floor[:, None]) & (scores > _LEAST))
            best.add(mine[a], scores[a, b], ids[b], n[b])
        unit = rows / np.maximum(norm_c[lo:lo + CHUNK], 1e-300)[:, None] if len(by_place) else None
        for i, cosine in zip(by_place.tolist(), local[local >= COORDINATE_FROM].tolist()):
            b = np.flatnonzero(_inside(q_rows[i], norm_q[i], cosine, unit) & (ids != q_ids[i]))
            scores = (rows[b] @ q_rows[i]).astype(np.int64)
            good = scores >= best.theta[i]
            best.add(np.full(int(good.sum()), i), scores[good], ids[b][good], n[b][good])
    return best


def _bucket(norm: Column) -> Column:
    return F.floor(F.log2(norm + 1) * BUCKETS_PER_DOUBLING).cast("int")


def _groups(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(bucket, first group, number of groups) for buckets of falling length and their counts."""
    out, group, held = [], 0, 0
    for bucket, n in counts:
        if held and held + n > GROUP:
            group, held = group + 1, 0
        parts = -(-n // GROUP)
        out.append((bucket, group, parts))
        if parts > 1:
            group, held = group + parts, 0
        else:
            held += n
    return out


def _lookup(value: Column, table: dict[int, int], default: int) -> Column:
    """``table[value]``; the tables have an entry per norm bucket, 1024 at most."""
    if not table:
        return F.lit(default)
    keys = sorted(table)
    return F.coalesce(F.element_at(F.map_from_arrays(F.lit(keys), F.lit([table[x] for x in keys])), value), F.lit(default))


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest integer inner products of each query, ties to the smaller id.

    Components become floor(``scale`` * x), x as double.  Queries are the rows whose id is divisible by ``query_every``,
    candidates all rows but those with the query's id.  Vectors that are null or hold null or non-finite components, and
    rows with a null id, take no part; a vector shorter than another counts as filled with zeros.  Rows that repeat an
    id are separate candidates (rows that repeat id and vector are counted once and return up to ``k`` times); of queries
    that repeat an id and vector one is answered.  Components are exact while scaled values and products fit 64 bits.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    ident, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    usable = vectors.filter(ident.isNotNull() & vector.isNotNull()).filter(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    ints = usable.select(ident.cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = stored(ints.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
                  .withColumn("norm", norm).withColumn("bucket", _bucket(F.col("norm"))), "topk-vectors")
    counts = [(r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().orderBy(F.desc("bucket")).collect()]  # a row per norm bucket: at most 64 * 8 * 2
    placed = _groups(counts)
    first = {b: g for b, g, _ in placed}
    group = _lookup(F.col("bucket"), first, 0) + F.pmod(F.xxhash64("id", "v"), _lookup(F.col("bucket"), {b: p for b, _, p in placed}, 1)).cast("int")
    candidates = rows.withColumn("g", group)
    # the first groups, up to HEAD vectors
    met, head = 0, 0
    for (b, g, parts), (_, n) in zip(placed, counts):
        if met < HEAD:
            met, head = met + n // parts, g + 1
    last = max((g + p for _, g, p in placed), default=0)
    asked = rows.filter(F.pmod("id", F.lit(query_every)) == 0).select("id", "v", "norm", F.xxhash64("v").alias("qkey"))
    parts = max(1, -(-asked.count() // QUERIES))

    def begin(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q = q.assign(theta=-np.inf)
        best = _search(q, c, k) if len(c) else _Best(len(q), k, q["theta"].to_numpy().copy())
        found = pd.DataFrame({"i": best.query, "ids": best.id, "scores": best.score, "ns": best.n}).groupby("i").agg(list).reindex(range(len(q)))
        empty = [found[x].map(lambda y: y if isinstance(y, list) else []) for x in ("ids", "scores", "ns")]
        return pd.DataFrame({"id": q["id"].to_numpy(), "v": q["v"].to_numpy(), "norm": q["norm"].to_numpy(), "qkey": q["qkey"].to_numpy(), "theta": best.theta, "ids": empty[0], "scores": empty[1], "ns": empty[2]})

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    longest = candidates.filter(F.col("g") < head).select("id", "v", "n", every.alias("p"))
    first_round = asked.withColumn("p", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).groupBy("p").cogroup(longest.groupBy("p"))
    queries = stored(first_round.applyInPandas(begin, "id long, v array<long>, norm double, qkey long, theta double, ids array<long>, scores array<long>, ns array<long>"), "topk-queries")
    each = F.explode(F.arrays_zip("ids", "scores", "ns")).alias("x")
    found = queries.select(F.col("id").alias("query_id"), "qkey", each).select("query_id", "qkey", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"), F.col("x.ns").cast("int").alias("n"))
    if head < last:
        found = found.unionByName(_second_round(queries, candidates.filter(F.col("g") >= head), placed, head, last, k))
    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "id")
    repeated = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return repeated.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _second_round(queries: DataFrame, candidates: DataFrame, placed: list[tuple[int, int, int]], head: int, last: int, k: int) -> DataFrame:
    """What the queries find among the groups from ``head`` on.

    Queries are dealt by the bucket of the length that a candidate must have for them; a part of them meets the groups up to
    the last one that holds such a bucket, and a group goes to the parts that reach it.
    """
    need = F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.col("theta") / F.col("norm") * (1 - SLACK)).otherwise(F.lit(0.0))
    queries = queries.select("id", "v", "qkey", "theta", _bucket(need).alias("need"))
    counts = queries.groupBy("need").count().orderBy("need").collect()  # a row per norm bucket
    until = {r["need"]: max([g + p for b, g, p in placed if b >= r["need"]], default=0) for r in counts}  # groups met: those before this one
    base, n_parts, reached = {}, {}, []
    for r in counts:
        if until[r["need"]] > head:
            base[r["need"]], n_parts[r["need"]] = len(reached), -(-r["count"] // QUERIES)
            reached += [until[r["need"]]] * n_parts[r["need"]]
    asked = queries.withColumn("until", _lookup(F.col("need"), until, 0)).filter(F.col("until") > head)
    asked = asked.withColumn("p", _lookup(F.col("need"), base, 0) + F.pmod(F.xxhash64("id", "v"), _lookup(F.col("need"), n_parts, 1)).cast("int"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(head), F.col("until") - 1)))
    # needs rise with the parts, so a group goes to the first of them
    steps = sorted(set(reached))
    parts = F.lit(0)
    for u in steps:  # one step per norm bucket
        parts = F.when(F.col("g") < u, F.greatest(parts, F.lit(sum(x >= u for x in reached)))).otherwise(parts)
    offered = candidates.withColumn("parts", parts).filter("parts > 0").select("id", "v", "n", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        best = _search(q, c, k) if len(q) and len(c) else _Best(0, k, np.zeros(0))
        return pd.DataFrame({"query_id": q["id"].to_numpy()[best.query], "qkey": q["qkey"].to_numpy()[best.query], "id": best.id, "score": best.score, "n": best.n.astype(np.int32)})
    return asked.groupBy("p", "g").cogroup(offered.groupBy("p", "g")).applyInPandas(search, _FOUND)
