"""Mixing sources to target weights by pivotal dependent rounding.

Each source wants ``target`` words; a document of a source of ``total`` words gets ``target / total`` copies on average:
the whole part for sure, the fraction by rounding.  Two fractional documents of one source meet in a duel: words move
from one to the other, in a direction drawn so that each keeps its expectation, until one of them holds a whole copy or
none.  Word totals are kept exactly, so a source ends within one document of its target.

Duels form a distributed reduction tree.  Documents are hashed into blocks of about ``BLOCK`` (per source, by id, so
a hot source has many blocks); a block duels its documents from the largest to the
smallest, so that the one left over is small, and hands at most one fractional document up;
``FAN_IN`` blocks meet in the next level, until one document per source is left, which is rounded by chance.  Every
draw is a function of the seed and the ids, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .store import map_groups, stored

BLOCK = 2048  #: documents of a first-level block, on average
FAN_IN = 256  #: blocks that meet in a block of the next level
REPEATS = 4096  #: equal rows that one task writes out at once
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(totals: dict[str | None, int], weights: Sequence[int], share: Fraction, most: int) -> dict[str | None, Fraction]:
    """Target words of each source: ``share`` of all words by weight (in code point order, null last, repeating), at most
    ``most`` times the source's own; what is cut is shared again by weight among the others."""
    names = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_ = share * sum(totals.values()), list(names)
    out: dict[str | None, Fraction] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * totals[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = Fraction(most * totals[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in above]
    return out


def _draw(seed: int, *what) -> float:
    """A uniform number in [0, 1) from the seed and the names."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *what)).encode(), digest_size=7).digest(), "big") / 2.0**56


def _duels(group: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    """Duel a block's documents in order; ``p`` becomes 0 or 1 for all but at most one, and for that one too if ``last``."""
    group = group.sort_values(["size", "id", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    p, size = group["p"].tolist(), group["size"].tolist()
    ids = list(zip(group["id"].tolist(), group["row"].tolist()))
    held = None
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if held is None:
            held = j
            continue
        i, a, b = held, p[held] * size[held], p[j] * size[j]
        up = min(size[i] - a, b)  # words that can move from j to i until one is whole or empty
        down = min(a, size[j] - b)
        gain = _draw(seed, level, ids[i], ids[j]) * (up + down) < down
        move = up if gain else -down
        full_i, full_j = (size[i] - a <= b, b <= size[i] - a) if gain else (a <= size[j] - b, size[j] - b <= a)
        p[i] = (1.0 if gain else 0.0) if full_i else (a + move) / size[i]
        p[j] = (0.0 if gain else 1.0) if full_j else (b - move) / size[j]
        held = i if not full_i else (j if not full_j else None)
    if last and held is not None:
        p[held] = float(_draw(seed, "last", ids[held]) < p[held])
    return group.assign(p=p)


def _rounded(rows: DataFrame, largest: int, seed: int) -> DataFrame:
    """(source, id, row, up): 1 where the fraction ``p`` was rounded up.  ``rows``: source, id, row, size, p; ``largest``:
    rows of the largest source."""
    schema = "source string, id long, row long, size long, p double, block long"
    level, blocks, done = 0, max(1, -(-largest // BLOCK)), None
    now = rows.withColumn("block", F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(blocks)))

    def duels_of(level: int, last: bool):
        return lambda group: _duels(group, seed, level, last)

    while True:
        last = blocks == 1
        made = stored(map_groups(now.groupBy("source", "block"), duels_of(level, last), schema, rows.sparkSession), "mixing-level")
        settled = made.filter("p = 0 or p = 1").select("source", "id", "row", F.col("p").cast("int").alias("up"))
        done = settled if done is None else done.union(settled)
        if last:
            return done
        now = made.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
        level, blocks = level + 1, -(-blocks // FAN_IN)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2),
                share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size) for every row.

    Sizes are words of the whole text (a null text has none).  Sources are weighted in code point order, null last;
    see ``source_targets``.  A document of no words gets no copy beyond its source's whole part.  Rows that share an id, or
    have none, are rounded each by itself, told apart by a hash of their columns (maps left out).  Of n wholly equal rows,
    floor(n * fraction) get a copy more for sure and one duels for the rest, so reruns agree.  Input columns with the name
    of a result column are replaced.  An empty table gives an empty result.  The totals per source reach the driver: one
    number for each name that the mixture weighs.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))  # a null id counts as the least one
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in kept and "map<" not in f.dataType.simpleString()]
    # columns, not expressions of the join below, so that texts no result needs are left behind before its shuffle
    rows = rows.select("*", F.col(f"`{source_col}`").cast("string").alias("__source"), key.alias("__key"), F.xxhash64(*hashed).alias("__hash"))
    keys = stored(rows.select(F.col("__source").alias("source"), F.col("__key").alias("id"), F.col("__hash").alias("row"), "size"), "mixing-sizes")
    totals = {r["source"]: (r["total"], r["n"]) for r in keys.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    targets = source_targets({s: t for s, (t, _) in totals.items()}, weights, share, most)
    rates = [(s, total, float(targets[s]), int(rate := targets[s] / total if total else 0), float(rate - int(rate)) if total else 0.0) for s, (total, _) in totals.items()]
    plan = docs.sparkSession.createDataFrame(rates, "source string, source_size long, target double, whole long, part double")
    distinct = (keys.filter("size > 0").groupBy("source", "id", "row", "size").agg(F.count(F.lit(1)).alias("n"))
                .join(F.broadcast(plan.select(F.col("source").alias("s"), "part")), F.col("source").eqNullSafe(F.col("s"))).filter("part > 0")
                .withColumn("sure", F.floor(F.col("n") * F.col("part"))).withColumn("p", F.col("n") * F.col("part") - F.col("sure")).drop("s", "part"))
    up = _rounded(distinct.filter("p > 0").select("source", "id", "row", "size", "p"), max([n for _, n in totals.values()], default=1), seed)
    up = up.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("row").alias("r"), "up")
    more = (distinct.join(up, F.col("source").eqNullSafe(F.col("s")) & (F.col("id") == F.col("i")) & (F.col("row") == F.col("r")), "left")
            .select(F.col("source").alias("__s"), F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("n").alias("__n"),
                    (F.col("sure") + F.coalesce("up", F.lit(0))).alias("__more")))
    more = stored(more, "mixing-copies")
    placed = rows.join(F.broadcast(plan.withColumnRenamed("source", "__p")), F.col("__source").eqNullSafe(F.col("__p")))
    mine = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__row"))
    some = "__more > 0 and __more < __n"  # equal rows of which some get a copy more: written out from one of them

    def counted(frame: DataFrame, extra) -> DataFrame:
        return (frame.withColumn("copies", (F.col("whole") + extra).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
                .select(*[F.col(f"`{c}`") for c in kept], *made))

    out = counted(placed.join(more, mine, "left").filter(f"__n is null or not ({some})"), F.when(F.col("__more") > 0, 1).otherwise(0))
    mixed = more.filter(some)
    if mixed.limit(1).collect():
        width = F.lit(REPEATS)
        one = placed.join(mixed, mine).groupBy("__s", "__id", "__row").agg(F.max("__n").alias("__n"), F.max("__more").alias("__more"), F.first(F.struct("*")).alias("__of"))
        parts = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / width))).alias("__part")).repartition("__row", "__part")
        each = parts.select("__more", "__of", F.explode(F.sequence(F.col("__part") * width, F.least((F.col("__part") + 1) * width, "__n") - 1)).alias("__nth"))
        again = each.select(*[F.col(f"__of.`{c}`").alias(c) for c in (*kept, "size", "source_size", "target", "whole")], (F.col("__nth") < F.col("__more")).cast("int").alias("__extra"))
        out = out.unionByName(counted(again, F.col("__extra")))
    return out
