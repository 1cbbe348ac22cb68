"""Batch what-if optimisation of process inputs.

The reference runs a sequential optimiser per row with one single-row model
call per evaluation.  Here every selected row gets ``budget`` seeded
candidate input vectors at once (candidate 0 is the row's own inputs), all
candidates of all rows are scored by the fitted models in one batch
``transform``, and ``min_by`` keeps the best candidate of each row (a group
holds exactly ``budget`` rows).  Optional further generations shrink the box
around the incumbent.  Candidates come from an arithmetic hash of (row,
candidate, variable, seed), so a run is reproducible and SQL can replay it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import stats as st
from ..functions.split import text_uniform
from .halo import q
from .index import ROW_IDX


def candidate_uniform(row: Column, cand: Column, var: int, seed: int = 42, generation: int = 0) -> Column:
    """Uniform [0, 1) for (row, candidate, variable); one independent stream for each variable and generation."""
    return text_uniform(F.lit("search"), F.lit(int(seed)), F.lit(int(generation)), F.lit(int(var)), row.cast("long"), cand.cast("long"))


@dataclass
class ExprModel:
    """A fixed scorer: prediction = intercept + sum(coef * column) (a stand-in model, SQL-replayable)."""
    intercept: float
    coef: Mapping[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        e = F.lit(float(self.intercept))
        for c, b in self.coef.items():
            e = e + F.col(q(c)) * F.lit(float(b))
        return df.withColumn("prediction", e)


def free_and_fixed(predictors: Sequence[str], free_vars: Sequence[str]) -> tuple[list[str], list[str]]:
    """Every lagged predictor and every current predictor not chosen as free is fixed."""
    free = [p for p in predictors if "_lag" not in p and p in set(free_vars)]
    return free, [p for p in predictors if p not in free]


def bounds(v: Column, pct: float) -> tuple[Column, Column]:
    """+- pct of the value clamped to [0, 1]; an empty box becomes value +- 0.05 clamped."""
    lo = F.greatest(F.lit(0.0), v * F.lit(1.0 - pct))
    hi = F.least(F.lit(1.0), v * F.lit(1.0 + pct))
    empty = lo >= hi
    return (F.when(empty, F.greatest(F.lit(0.0), v - F.lit(0.05))).otherwise(lo),
            F.when(empty, F.least(F.lit(1.0), v + F.lit(0.05))).otherwise(hi))


def _score(df: DataFrame, models: Mapping[str, object], targets: Sequence[str], prefix: str) -> DataFrame:
    for t in targets:
        df = models[t].transform(df).withColumnRenamed("prediction", f"{prefix}{t}")
    return df


def optimize_rows(models: Mapping[str, object], lagged: DataFrame, predictors: Sequence[str], targets: Sequence[str],
                  target: str, goal: str = "Maximize", bounds_percent: float = 0.05, free_vars: Sequence[str] = (),
                  row_ids: DataFrame | Sequence[int] | None = None, constraints: Sequence[Mapping] | None = None,
                  budget: int = 200, seed: int = 42, generations: int = 1, shrink: float = 0.5,
                  idx: str = ROW_IDX) -> DataFrame | None:
    """Best inputs per row; None when no input is free.

    Output per row: ``init_<var>`` / ``opt_<var>`` for free inputs and
    ``init_pred_<t>`` / ``opt_pred_<t>`` for every target.
    """
    predictors, targets = list(predictors), list(targets)
    free, fixed = free_and_fixed(predictors, free_vars)
    if not free:
        return None
    rows = lagged
    if row_ids is not None:
        ids = row_ids if isinstance(row_ids, DataFrame) else lagged.sparkSession.createDataFrame(
            [(int(i),) for i in row_ids], f"{idx} long")
        rows = lagged.join(ids.select(idx).distinct(), idx, "left_semi")  # B10: ids without lag data are skipped
    sign = -1.0 if goal == "Maximize" else 1.0
    base = rows.select(idx, *[q(p) for p in predictors])
    for f in free:
        lo, hi = bounds(F.col(q(f)), float(bounds_percent))
        base = base.withColumn(f"_lo_{f}", lo).withColumn(f"_hi_{f}", hi).withColumn(f"_init_{f}", F.col(q(f)))
    best = None
    for g in range(int(generations)):
        cand = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(int(budget) - 1))).alias("_cand"))
        cand = cand.drop(*[c for c in cand.columns if c.startswith("_p_")])
        for j, f in enumerate(free):
            lo, hi = F.col(f"_lo_{f}"), F.col(f"_hi_{f}")
            u = candidate_uniform(F.col(idx), F.col("_cand"), j, seed, g)
            start = F.col(f"_init_{f}") if best is None else F.col(f"_inc_{f}")
            cand = cand.withColumn(f, F.when(F.col("_cand") == 0, start).otherwise(lo + u * (hi - lo)))
        scored = _score(cand, models, targets, "_p_")
        obj = F.lit(sign) * F.col(f"_p_{target}")
        for spec in constraints or []:
            if spec["name"] not in targets:
                continue
            v = F.col(f"_p_{spec['name']}")
            lo_c, hi_c = spec.get("min"), spec.get("max")
            pen = F.lit(0.0)
            if lo_c is not None:
                pen = pen + F.greatest(F.lit(float(lo_c)) - v, F.lit(0.0))
            if hi_c is not None:
                pen = pen + F.greatest(v - F.lit(float(hi_c)), F.lit(0.0))
            obj = obj + pen * F.lit(float(spec.get("weight", 1.0)))
        pick = F.struct(*[F.col(q(f)).alias(f) for f in free], *[F.col(f"_p_{t}").alias(t) for t in targets])
        win = scored.groupBy(idx).agg(F.min_by(pick, F.struct(obj, F.col("_cand"))).alias("_w"))
        best = win.select(idx, *[F.col(f"_w.`{f}`").alias(f"_inc_{f}") for f in free],
                          *[F.col(f"_w.`{t}`").alias(f"_pred_{t}") for t in targets])
        if g + 1 < int(generations):
            # next generation: a box shrunk around the incumbent (candidate 0), inside the original bounds
            base = base.drop(*[f"_inc_{f}" for f in free]).join(best.select(idx, *[f"_inc_{f}" for f in free]), idx)
            for f in free:
                half = (F.col(f"_hi_{f}") - F.col(f"_lo_{f}")) * F.lit(shrink / 2.0)
                # both ends from the same old box: in one step
                base = base.withColumns({f"_lo_{f}": F.greatest(F.col(f"_lo_{f}"), F.col(f"_inc_{f}") - half),
                                         f"_hi_{f}": F.least(F.col(f"_hi_{f}"), F.col(f"_inc_{f}") + half)})
    init = _score(rows.select(idx, *[q(p) for p in predictors]), models, targets, "init_pred_")
    out = init.join(best, idx).select(
        idx, *[F.col(q(f)).alias(f"init_{f}") for f in free], *[F.col(f"_inc_{f}").alias(f"opt_{f}") for f in free],
        *[F.col(f"init_pred_{t}") for t in targets], *[F.col(f"_pred_{t}").alias(f"opt_pred_{t}") for t in targets])
    return out


def with_actuals(result: DataFrame, actual: DataFrame, targets: Sequence[str], idx: str = ROW_IDX) -> DataFrame:
    """The actual target values of each optimised row."""
    return result.join(actual.select(idx, *[F.col(q(t)).alias(f"actual_{t}") for t in targets]), idx)


def skipped_rows(row_ids: DataFrame, lagged: DataFrame, idx: str = ROW_IDX) -> DataFrame:
    """Requested rows that have no lag data (the reference warns and skips them)."""
    return row_ids.select(idx).distinct().join(lagged.select(idx), idx, "left_anti")


def improvement(result: DataFrame, target: str, goal: str = "Maximize", idx: str = ROW_IDX) -> DataFrame:
    """Improvement and improvement % of the optimised target (0 % when the initial value is 0)."""
    init, opt = F.col(f"init_pred_{target}"), F.col(f"opt_pred_{target}")
    imp = (opt - init) if goal == "Maximize" else (init - opt)
    return result.select(idx, init.alias("initial"), opt.alias("optimized"), imp.alias("improvement"),
                         F.when(init != 0, imp / init * 100).otherwise(F.lit(0.0)).alias("improvement_pct"))


def input_changes(result: DataFrame, free: Sequence[str]) -> DataFrame:
    """Average % change of each free input over rows whose initial value is not 0."""
    items = [F.struct(F.lit(f).alias("variable"), F.col(f"init_{f}").alias("i"), F.col(f"opt_{f}").alias("o"))
             for f in free]
    long = result.select(F.explode(F.array(*items)).alias("_s")).select("_s.*")
    return long.groupBy("variable").agg(
        F.avg(F.when(F.col("i") != 0, (F.col("o") - F.col("i")) / F.col("i") * 100)).alias("avg_change_pct"))


def improvement_histogram(imp: DataFrame) -> DataFrame:
    """Histogram of improvements with min(10, rows) bins."""
    n = imp.count()
    return st.histogram(imp, "improvement", max(1, min(10, n)))


def success_rate(imp: DataFrame) -> DataFrame:
    """Share of rows with a positive improvement, in %."""
    return imp.agg(F.sum((F.col("improvement") > 0).cast("int")).alias("successful"),
                   F.count(F.lit(1)).alias("total"),
                   (F.avg((F.col("improvement") > 0).cast("double")) * 100).alias("success_rate"))


def state_table(result: DataFrame, targets: Sequence[str], free: Sequence[str], idx: str = ROW_IDX,
                rows: DataFrame | None = None, fixed: Sequence[str] = ()) -> DataFrame:
    """Initial / Optimized / Actual rows per optimised row, sorted by (row, state).

    With ``rows`` (the table that was optimised) every state has all its inputs: ``fixed`` ones as they are in the row, and
    the actual state the initial inputs.  Without it the actual state has no inputs.
    """
    whole = rows is not None
    if whole:
        result = result.join(rows.select(idx, *[F.col(q(f)).alias(f"_fix_{i}") for i, f in enumerate(fixed)]), idx)

    def part(state, tcols, icols):
        return F.struct(F.lit(state).alias("state"),
                        *[F.col(q(c)).alias(t) for t, c in zip(targets, tcols)],
                        *[(F.col(q(c)) if c else F.lit(None).cast("double")).alias(f) for f, c in zip(free, icols)],
                        *([F.col(f"_fix_{i}").alias(f) for i, f in enumerate(fixed)] if whole else []))
    initial = [f"init_{f}" for f in free]
    states = F.array(part("Initial", [f"init_pred_{t}" for t in targets], initial),
                     part("Optimized", [f"opt_pred_{t}" for t in targets], [f"opt_{f}" for f in free]),
                     part("Actual", [f"actual_{t}" for t in targets], initial if whole else [None for _ in free]))
    return result.select(idx, F.explode(states).alias("_s")).select(idx, "_s.*").orderBy(idx, "state")
