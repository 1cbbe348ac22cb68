"""DuckDB SQL equivalents of the registered queries (same names, same columns).

Views ``lineitem``, ``events``, ``customer``, ... are registered by the
checker.  Every double is rounded like ``queries.rounded``.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}
D = 6
FEATS = ["qty", "price", "disc", "tax", "n"]

P1 = """p1 AS (
  SELECT l_shipdate AS day,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS disc,
         CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS tax,
         CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE)
           AS revenue
  FROM lineitem GROUP BY l_shipdate),
i1 AS (SELECT row_number() OVER (ORDER BY day) - 1 AS row_idx, qty, price, disc, tax, n, revenue FROM p1)"""

P1_LONG = """l1 AS (SELECT row_idx, variable, x FROM i1 UNPIVOT (x FOR variable IN (qty, price, disc, tax, n)))"""

EV = """ev AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id, user_id, value,
                  CAST(hour(ts) AS DOUBLE) AS hour FROM events)"""
EVK = """evk AS (SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS row_idx, event_id, user_id, value,
                  CAST(hour(ts) AS DOUBLE) AS hour FROM events)"""


def r(expr: str, alias: str) -> str:
    """Pass-through values are bit-identical in both engines: no rounding."""
    return f"{expr} AS {alias}"


def lag(col: str, k: int, over: str = "ORDER BY row_idx") -> str:
    return f"lag({col}, {k}) OVER ({over})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _lagcorr(method_expr: str) -> str:
    return method_expr


# ---------------------------------------------------------------- H1, D1-D6

ORACLE["row_index"] = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS row_idx,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem"""


def _lag_table_sql() -> str:
    cols = [r(lag(f, 3), f"{f}_lag3") for f in FEATS]
    cols += [r("revenue", "revenue"), r(lag("revenue", 1), "revenue_lag1"), r(lag("revenue", 2), "revenue_lag2")]
    inner = ", ".join(["row_idx"] + cols)
    names = [f"{f}_lag3" for f in FEATS] + ["revenue", "revenue_lag1", "revenue_lag2"]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in names)
    return _with(P1) + f"SELECT * FROM (SELECT {inner} FROM i1) WHERE {cond}"


ORACLE["lag_table"] = _lag_table_sql()


def _notebook_sql() -> str:
    cols = [r(lag(f, 13), f"{f}_lag13") for f in FEATS] + [r("revenue", "revenue")]
    names = [f"{f}_lag13" for f in FEATS] + ["revenue"]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in names)
    return _with(P1) + f"SELECT * FROM (SELECT row_idx, {', '.join(cols)} FROM i1) WHERE {cond}"


ORACLE["lag_table_notebook"] = _notebook_sql()


def _multi_lag_sql() -> str:
    preds, targets = ["qty", "disc", "tax"], ["revenue", "n"]
    cols = [r(t, t) for t in targets] + [r(p, p) for p in preds]
    names = targets + preds
    for i in (1, 2):
        cols += [r(lag(p, i), f"{p}_lag{i}") for p in preds]
        names += [f"{p}_lag{i}" for p in preds]
    cols += [r(lag(t, 1), f"{t}_lag1") for t in targets]
    names += [f"{t}_lag1" for t in targets]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in names)
    return _with(P1) + f"SELECT * FROM (SELECT row_idx, {', '.join(cols)} FROM i1) WHERE {cond}"


ORACLE["multi_lag_table"] = _multi_lag_sql()


def _multi_target_sql() -> str:
    preds, targets = ["qty", "disc", "tax"], ["revenue", "price"]
    cols = [r(lag(p, 2), f"{p}_lag2") for p in preds] + [r(t, t) for t in targets]
    names = [f"{p}_lag2" for p in preds] + targets
    cond = " AND ".join(f"{c} IS NOT NULL" for c in names)
    return _with(P1) + f"SELECT * FROM (SELECT row_idx, {', '.join(cols)} FROM i1) WHERE {cond}"


ORACLE["lag_table_multi_target"] = _multi_target_sql()

ORACLE["lag_table_keyed"] = _with(EVK) + """
SELECT * FROM (
  SELECT row_idx, user_id,
         lag(hour, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS hour_lag2,
         value,
         lag(value, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS value_lag1
  FROM evk)
WHERE hour_lag2 IS NOT NULL AND value IS NOT NULL AND value_lag1 IS NOT NULL"""


def _single_lags_sql() -> str:
    parts = []
    for k in (0, 5, 13):
        cols = ", ".join(r(lag(f, k) if k else f, f) for f in FEATS)
        cond = " AND ".join(f"{f} IS NOT NULL" for f in FEATS + ["revenue"])
        parts.append(f"SELECT * FROM (SELECT {k} AS lag, row_idx, {r('revenue', 'revenue')}, {cols} FROM i1) WHERE {cond}")
    return _with(P1) + "\nUNION ALL\n".join(parts)


ORACLE["single_lag_tables"] = _single_lags_sql()

# ---------------------------------------------------------------- F3-F8

LAGCORR_PAIRS = """pairs AS (
  SELECT l.variable, g.lag, l.x, c.revenue AS y
  FROM i1 c JOIN (SELECT range AS lag FROM range(0, 24)) g ON TRUE
  JOIN l1 l ON l.row_idx = c.row_idx - g.lag
  WHERE l.x IS NOT NULL AND c.revenue IS NOT NULL)"""

ORACLE["lag_corr_pearson"] = _with(P1, P1_LONG, LAGCORR_PAIRS) + """
SELECT variable, CAST(lag AS INTEGER) AS lag, round(corr(x, y), 6) AS corr FROM pairs GROUP BY variable, lag"""

SPEARMAN_RANKED = """ranked AS (
  SELECT variable, lag,
         rank() OVER (PARTITION BY variable, lag ORDER BY x) + (count(*) OVER (PARTITION BY variable, lag, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY variable, lag ORDER BY y) + (count(*) OVER (PARTITION BY variable, lag, y) - 1) / 2.0 AS ry
  FROM pairs)"""

ORACLE["lag_corr_spearman"] = _with(P1, P1_LONG, LAGCORR_PAIRS, SPEARMAN_RANKED) + """
SELECT variable, CAST(lag AS INTEGER) AS lag, round(corr(rx, ry), 6) AS corr FROM ranked GROUP BY variable, lag"""

BEST = """lc AS (SELECT variable, CAST(lag AS INTEGER) AS lag, corr(x, y) AS corr FROM pairs GROUP BY variable, lag),
best AS (SELECT variable, arg_min(lag, (abs(corr) * -1, lag)) AS best_lag,
                arg_min(corr, (abs(corr) * -1, lag)) AS corr FROM lc WHERE corr IS NOT NULL GROUP BY variable)"""

ORACLE["best_lags"] = _with(P1, P1_LONG, LAGCORR_PAIRS, BEST) + """
SELECT variable, best_lag, round(corr, 6) AS corr FROM best"""

ORACLE["best_lag_table"] = _with(P1, P1_LONG, LAGCORR_PAIRS, BEST) + """,
mx AS (SELECT max(best_lag) AS m FROM best)
SELECT c.row_idx, b.variable, b.best_lag AS lag, l.x AS value, c.revenue
FROM i1 c JOIN best b ON TRUE JOIN l1 l ON l.variable = b.variable AND l.row_idx = c.row_idx - b.best_lag
WHERE c.row_idx >= (SELECT m FROM mx)"""


def _corr_matrix_sql() -> str:
    parts = []
    for a in FEATS + ["revenue"]:
        for b in FEATS + ["revenue"]:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr FROM i1")
    return _with(P1) + "\nUNION ALL\n".join(parts)


ORACLE["correlation_matrix"] = _corr_matrix_sql()


def _corr_matrix_spearman_sql() -> str:
    cols = FEATS + ["revenue"]
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols)
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr(r_{a}, r_{b}), 6) AS corr FROM rk")
    return _with(P1, f"rk AS (SELECT {ranks} FROM i1)") + "\nUNION ALL\n".join(parts)


ORACLE["correlation_matrix_spearman"] = _corr_matrix_spearman_sql()

# ---------------------------------------------------------------- D7-D10

ORACLE["rolling_stats"] = _with(EV) + """
SELECT row_idx, round(value, 6) AS value,
       CASE WHEN count(value) OVER w = 20 THEN round(avg(value) OVER w, 6) END AS roll_mean,
       CASE WHEN count(value) OVER w = 20 THEN round(stddev_samp(value) OVER w, 6) END AS roll_std
FROM ev WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""

ORACLE["rolling_stats_keyed"] = _with(EVK) + """
SELECT row_idx, user_id, round(value, 6) AS value,
       CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS roll_mean,
       CASE WHEN count(value) OVER w = 5 THEN round(stddev_samp(value) OVER w, 6) END AS roll_std
FROM evk WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""

SEQ = """nn AS (SELECT count(*) AS n FROM i1),
lx AS (SELECT row_idx, 0 AS feature, qty AS value FROM i1 UNION ALL SELECT row_idx, 1, disc FROM i1
       UNION ALL SELECT row_idx, 2, tax FROM i1),
ly AS (SELECT row_idx, 0 AS feature, revenue AS value FROM i1),
smp AS (SELECT row_idx FROM i1 WHERE row_idx <= (SELECT n FROM nn) - 6)"""

ORACLE["sequence_windows"] = _with(P1, SEQ) + """
SELECT s.row_idx, 'x' AS part, CAST(g.step AS INTEGER) AS step, CAST(l.feature AS INTEGER) AS feature,
       l.value AS value
FROM smp s JOIN (SELECT range AS step FROM range(0, 4)) g ON TRUE JOIN lx l ON l.row_idx = s.row_idx + g.step
UNION ALL
SELECT s.row_idx, 'y', CAST(g.step AS INTEGER), CAST(l.feature AS INTEGER), l.value
FROM smp s JOIN (SELECT range AS step FROM range(0, 2)) g ON TRUE JOIN ly l ON l.row_idx = s.row_idx + 4 + g.step"""

ORACLE["decoder_inputs"] = _with(P1, SEQ) + """
SELECT s.row_idx, 'decoder_in' AS part, CAST(0 AS INTEGER) AS step, CAST(0 AS INTEGER) AS feature,
       CAST(0 AS DOUBLE) AS value FROM smp s
UNION ALL
SELECT s.row_idx, 'decoder_in', CAST(g.step + 1 AS INTEGER), CAST(l.feature AS INTEGER), l.value
FROM smp s JOIN (SELECT range AS step FROM range(0, 1)) g ON TRUE JOIN ly l ON l.row_idx = s.row_idx + 4 + g.step"""

ORACLE["hankel_snapshots"] = _with(P1, """nn AS (SELECT count(*) AS n FROM i1),
lm AS (SELECT row_idx, 0 AS f, revenue AS value FROM i1 UNION ALL SELECT row_idx, 1, qty FROM i1),
hs AS (SELECT row_idx FROM i1 WHERE row_idx < (SELECT n FROM nn) - 3)""") + """
SELECT h.row_idx, 'x' AS part, CAST(g.t * 2 + l.f AS INTEGER) AS pos, l.value AS value
FROM hs h JOIN (SELECT range AS t FROM range(0, 3)) g ON TRUE JOIN lm l ON l.row_idx = h.row_idx + g.t
UNION ALL
SELECT h.row_idx, 'x_next', CAST(g.t * 2 + l.f AS INTEGER), l.value
FROM hs h JOIN (SELECT range AS t FROM range(0, 3)) g ON TRUE JOIN lm l ON l.row_idx = h.row_idx + 1 + g.t
UNION ALL
SELECT h.row_idx, 'u', CAST(0 AS INTEGER), c.disc FROM hs h JOIN i1 c ON c.row_idx = h.row_idx + 2"""

# ---------------------------------------------------------------- F1, F2, F9, F18-F23

ORACLE["table_info"] = _with(P1) + """
SELECT CAST(t.position AS INTEGER) AS position, t.variable, t.dtype, (SELECT count(*) FROM i1) AS non_null,
       (SELECT count(*) FROM i1) AS rows
FROM (VALUES (0, 'row_idx', 'bigint'), (1, 'qty', 'double'), (2, 'price', 'double'), (3, 'disc', 'double'),
             (4, 'tax', 'double'), (5, 'n', 'double'), (6, 'revenue', 'double')) t(position, variable, dtype)"""


def _describe_sql() -> str:
    parts = [f"""SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       round(max({c}), 6) AS max FROM i1""" for c in FEATS + ["revenue"]]
    return _with(P1) + "\nUNION ALL\n".join(parts)


ORACLE["describe"] = _describe_sql()

ORACLE["describe_lineitem"] = "\nUNION ALL\n".join(f"""SELECT '{c}' AS variable, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
       round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"))

ORACLE["zscore"] = _with(EV) + """
SELECT row_idx, round(value, 6) AS value,
       round((value - (SELECT avg(value) FROM ev)) / (SELECT stddev_pop(value) FROM ev), 6) AS z FROM ev"""

ORACLE["histogram"] = _with(EV, """w AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS width
       FROM ev),
b AS (SELECT CAST(least(floor((value - lo) / width), 19) AS INTEGER) AS bin, count(*) AS cnt
      FROM ev JOIN w ON TRUE GROUP BY 1)""") + """
SELECT CAST(g.bin AS INTEGER) AS bin, round(w.lo + g.bin * w.width, 6) AS lo,
       round(CASE WHEN g.bin < 19 THEN w.lo + (g.bin + 1) * w.width ELSE w.hi END, 6) AS hi,
       coalesce(b.cnt, 0) AS count
FROM (SELECT range AS bin FROM range(0, 20)) g JOIN w ON TRUE LEFT JOIN b ON b.bin = g.bin"""

ORACLE["kde"] = _with(EV, """ps AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
       FROM ev),
pr AS (SELECT n, sd * pow(n, -0.2) AS h, lo, hi FROM ps),
gp AS (SELECT range AS point, (lo - 3 * h) + range * (((hi + 3 * h) - (lo - 3 * h)) / 49) AS x, h, n
       FROM pr JOIN range(0, 50) ON TRUE)""") + """
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x,
       round(sum(exp(-pow(x - e.value, 2) / (2 * h * h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM gp JOIN ev e ON TRUE GROUP BY point, x, h, n"""

ORACLE["trend"] = _with(EV, """wd AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS w FROM ev),
lt AS (SELECT row_idx, variable, v FROM ev UNPIVOT (v FOR variable IN (value, hour)))""") + """
SELECT variable, CAST(floor(row_idx / w) AS BIGINT) AS point, CAST(floor(row_idx / w) * w AS BIGINT) AS start_idx,
       round(min(v), 6) AS min, round(avg(v), 6) AS mean, round(max(v), 6) AS max
FROM lt JOIN wd ON TRUE GROUP BY variable, point, start_idx"""

HASH_U = "(('0x' || substr(md5('split:42:' || row_idx), 1, 12))::BIGINT / 281474976710656.0)"
SAMPLE_U = HASH_U.replace("split:", "sample:")  # its own stream

ORACLE["scatter_sample"] = _with(EV) + f"""
SELECT row_idx, value, hour, user_id FROM ev
WHERE {SAMPLE_U} < least(1.0, 1000.0 / (SELECT count(*) FROM ev))"""

ORACLE["minmax"] = _with(P1) + """
SELECT least(min(price), min(revenue)) AS lo, greatest(max(price), max(revenue)) AS hi FROM i1"""

# ---------------------------------------------------------------- G1-G13


def _scale_sql(kind: str, d: int = D) -> str:
    cols = FEATS + ["revenue"]
    if kind == "minmax":
        ex = [f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), {d}) AS {c}" for c in cols]
    else:
        ex = [f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), {d}) AS {c}" for c in cols]
    return _with(P1) + f"SELECT row_idx, {', '.join(ex)} FROM i1"


ORACLE["min_max_scale"] = _scale_sql("minmax")
ORACLE["standard_scale"] = _scale_sql("standard")
ORACLE["inverse_scale"] = _with(P1) + """
SELECT row_idx, round(qty, 4) AS qty, round(revenue, 4) AS revenue FROM i1"""

ORACLE["process_features"] = _with(P1, """raw AS (
  SELECT row_idx, disc * qty AS PT, qty / (tax + 1) AS dT, qty / (n + 1) AS dT2, revenue / (price + 1) AS RR,
         ln(1 + (1 + qty)) AS Log_top_T, ln(1 + revenue / (price + 1)) * tax AS reflux_times_Ttray6,
         (qty + tax + n + price) / 4 AS T_all_avg
  FROM i1)""") + """
SELECT row_idx,
""" + ",\n".join(
    f"  round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {a}"
    for c, a in [("PT", "PT"), ("dT", "dT"), ("dT2", "dT2"), ("RR", "Refux_Ratio"), ("Log_top_T", "Log_top_T"),
                 ("reflux_times_Ttray6", "reflux_times_Ttray6"), ("T_all_avg", "T_all_avg")]) + "\nFROM raw"

# ---------------------------------------------------------------- H5, G5, G6, B11

ORACLE["split"] = _with(P1) + f"SELECT row_idx, {HASH_U} < CAST(0.3 AS DOUBLE) AS is_test FROM i1"

ORACLE["split_stratified"] = f"""
WITH e AS (SELECT vec_id, label, {HASH_U.replace('row_idx', 'vec_id')} AS u FROM embeddings)
SELECT vec_id, label,
       row_number() OVER (PARTITION BY label ORDER BY u, vec_id) - 1
         < round(count(*) OVER (PARTITION BY label) * CAST(0.3 AS DOUBLE)) AS is_test
FROM e"""

ORACLE["chrono_split"] = _with(P1) + """
SELECT row_idx, row_idx >= floor((SELECT count(*) FROM i1) * CAST(0.7 AS DOUBLE)) AS is_test FROM i1"""

# ---------------------------------------------------------------- H-1..H-11

EVL = """lt AS (SELECT * FROM (SELECT row_idx, lag(hour, 1) OVER (ORDER BY row_idx) AS hour_lag1, value FROM ev)
       WHERE hour_lag1 IS NOT NULL AND value IS NOT NULL)"""
ZS = """zs AS (SELECT row_idx, CAST(coalesce(abs((value - (SELECT avg(value) FROM lt)) / (SELECT stddev_pop(value) FROM lt))
                 > 3.0, FALSE) AS INTEGER) AS Zscore FROM lt)"""
RS = """rs AS (SELECT row_idx, CAST(coalesce(CASE WHEN count(value) OVER w = 20 THEN
                 value > avg(value) OVER w + 3.0 * stddev_samp(value) OVER w
                 OR value < avg(value) OVER w - 3.0 * stddev_samp(value) OVER w END, FALSE) AS INTEGER) AS RollingStats
       FROM lt WINDOW w AS (ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
VOTES = """vt AS (SELECT zs.row_idx, Zscore, RollingStats, CAST(Zscore + RollingStats AS INTEGER) AS votes
       FROM zs JOIN rs ON zs.row_idx = rs.row_idx)"""

ORACLE["anomaly_zscore"] = _with(EV, EVL, ZS) + "SELECT * FROM zs"
ORACLE["anomaly_rolling"] = _with(EV, EVL, RS) + "SELECT * FROM rs"
ORACLE["anomaly_votes"] = _with(EV, EVL, ZS, RS, VOTES) + "SELECT * FROM vt"
ORACLE["flagged"] = _with(EV, EVL, ZS, RS, VOTES) + "SELECT * FROM vt WHERE votes >= 1"
ORACLE["cleaned"] = _with(EV, EVL, ZS, RS, VOTES) + """
SELECT row_idx, value, hour FROM ev WHERE row_idx NOT IN (SELECT row_idx FROM vt WHERE votes >= 1)"""
ORACLE["flagged_points"] = _with(EV, EVL, ZS, RS, VOTES) + """,
lg AS (SELECT row_idx, 'Zscore' AS method FROM vt WHERE Zscore = 1
       UNION ALL SELECT row_idx, 'RollingStats' FROM vt WHERE RollingStats = 1
       UNION ALL SELECT row_idx, 'Combined' FROM vt WHERE votes >= 1)
SELECT lg.row_idx, lg.method, ev.value FROM lg JOIN ev ON ev.row_idx = lg.row_idx"""

ORACLE["anomaly_linreg"] = _with(P1, """lt AS (SELECT * FROM (SELECT row_idx, lag(price, 1) OVER (ORDER BY row_idx) AS x,
       revenue AS y FROM i1) WHERE x IS NOT NULL AND y IS NOT NULL),
cf AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM lt),
res AS (SELECT row_idx, abs(y - (a + b * x)) AS r FROM lt JOIN cf ON TRUE)""") + """
SELECT row_idx, CAST(r > (SELECT quantile_cont(r, 0.99) FROM res) AS INTEGER) AS LinReg_Residual FROM res"""

ORACLE["anomaly_lof"] = """
WITH pts AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, CAST(c_nationkey AS DOUBLE) AS x1,
                    c_acctbal AS x2 FROM customer),
d AS (SELECT a.row_idx AS p, b.row_idx AS o, sqrt(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)) AS dist
      FROM pts a JOIN pts b ON a.row_idx <> b.row_idx),
nb AS (SELECT p, o, dist FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY dist, o) AS rn FROM d)
       WHERE rn <= 20),
kd AS (SELECT p, max(dist) AS kdist FROM nb GROUP BY p),
rd AS (SELECT nb.p, greatest(nb.dist, kd.kdist) AS reach FROM nb JOIN kd ON kd.p = nb.o),
lrd AS (SELECT p, 1 / (avg(reach) + 1e-10) AS lrd FROM rd GROUP BY p),
lof AS (SELECT nb.p, avg(l2.lrd) / l1.lrd AS lof FROM nb JOIN lrd l2 ON l2.p = nb.o JOIN lrd l1 ON l1.p = nb.p
        GROUP BY nb.p, l1.lrd),
thr AS (SELECT quantile_cont(-lof, 0.01) AS t FROM lof)
SELECT p AS row_idx, round(lof, 6) AS lof_score, CAST(-lof < t AS INTEGER) AS LOF FROM lof JOIN thr ON TRUE"""

KENDALL_PAIRS = """kp AS (
  SELECT l.variable, g.lag, c.row_idx AS rid, l.x, c.revenue AS y
  FROM i1 c JOIN (SELECT range AS lag FROM range(0, 3)) g ON TRUE
  JOIN l1 l ON l.row_idx = c.row_idx - g.lag
  WHERE l.x IS NOT NULL AND c.revenue IS NOT NULL)"""

ORACLE["lag_corr_kendall"] = _with(P1, P1_LONG, KENDALL_PAIRS) + """
SELECT a.variable, CAST(a.lag AS INTEGER) AS lag,
       round(sum(sign(a.x - b.x) * sign(a.y - b.y))
             / sqrt(CAST(count(*) FILTER (WHERE a.x <> b.x) AS DOUBLE) * count(*) FILTER (WHERE a.y <> b.y)), 6) AS corr
FROM kp a JOIN kp b ON a.variable = b.variable AND a.lag = b.lag AND a.rid < b.rid
GROUP BY a.variable, a.lag"""


ORACLE["lag_corr_kendall_all"] = ORACLE["lag_corr_kendall"].replace("range(0, 3)", "range(0, 24)")


def _kendall_matrix_sql(cols=("qty", "disc", "n", "revenue")) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2,
  round(sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b}))
        / sqrt(CAST(count(*) FILTER (WHERE p.{a} <> q.{a}) AS DOUBLE) * count(*) FILTER (WHERE p.{b} <> q.{b})), 6) AS corr
FROM i1 p JOIN i1 q ON p.row_idx < q.row_idx""")
    return _with(P1) + "\nUNION ALL\n".join(parts)


ORACLE["correlation_matrix_kendall"] = _kendall_matrix_sql()
ORACLE["correlation_matrix_kendall_all"] = _kendall_matrix_sql(("qty", "price", "disc", "tax", "n", "revenue"))

# ---------------------------------------------------------------- F13-F17, I1-I20

ORACLE["regression_metrics"] = _with(P1) + """
SELECT round(1 - sum(pow(revenue - price * 0.95, 2)) / (count(revenue) * var_pop(revenue)), 6) AS r2,
       round(sqrt(avg(pow(revenue - price * 0.95, 2))), 6) AS rmse, count(*) AS n FROM i1"""

ORACLE["residuals"] = _with(P1) + "SELECT row_idx, round(revenue - price * 0.95, 6) AS residual FROM i1"

ORACLE["classification_metrics"] = """
WITH e AS (SELECT CAST(label AS DOUBLE) AS y,
                  CAST(CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS DOUBLE) AS p FROM embeddings),
cls AS (SELECT y AS c FROM e UNION SELECT p FROM e),
per AS (SELECT c, (SELECT count(*) FROM e WHERE y = c) AS support, (SELECT count(*) FROM e WHERE p = c) AS npred,
               (SELECT count(*) FROM e WHERE y = c AND p = c) AS tp FROM cls),
m AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
       round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM f"""


def _sweep_linear_sql(max_lag: int = 5) -> str:
    parts = []
    for k in range(max_lag + 1):
        x = f"lag(price, {k}) OVER (ORDER BY row_idx)" if k else "price"
        parts.append(f"""SELECT {k} AS lag, is_test, x, y FROM (
  SELECT row_idx, {x} AS x, revenue AS y, {HASH_U} < CAST(0.3 AS DOUBLE) AS is_test FROM i1)
  WHERE x IS NOT NULL AND y IS NOT NULL""")
    body = "\nUNION ALL\n".join(parts)
    return _with(P1, f"t AS ({body})", """cf AS (SELECT lag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
       FROM t WHERE NOT is_test GROUP BY lag),
pr AS (SELECT t.lag, t.is_test, t.y, cf.a + cf.b * t.x AS p FROM t JOIN cf ON cf.lag = t.lag),
mm AS (SELECT lag, is_test, 1 - sum(pow(y - p, 2)) / (count(y) * var_pop(y)) AS r2, sqrt(avg(pow(y - p, 2))) AS rmse
       FROM pr GROUP BY lag, is_test)""") + """
SELECT CAST(a.lag AS INTEGER) AS lag, CAST(NULL AS VARCHAR) AS params, round(a.r2, 6) AS train_r2,
       round(b.r2, 6) AS test_r2, round(a.rmse, 6) AS train_rmse, round(b.rmse, 6) AS test_rmse
FROM mm a JOIN mm b ON a.lag = b.lag AND NOT a.is_test AND b.is_test"""


def _grid_pcr_sql(max_lag: int = 23, folds: int = 3) -> str:
    """One predictor has one component, so every point of the grid is the same model: the first wins."""
    parts = []
    for k in range(max_lag + 1):
        x = f"lag(price, {k}) OVER (ORDER BY row_idx)" if k else "price"
        parts.append(f"""SELECT {k} AS lag, is_test, fold, x, y FROM (
  SELECT row_idx, {x} AS x, revenue AS y, {HASH_U} < CAST(0.3 AS DOUBLE) AS is_test, CAST(floor({HASH_U.replace("'split:42:'", "'split:43:'")} * {folds}) AS INTEGER) AS fold FROM i1)
  WHERE x IS NOT NULL AND y IS NOT NULL""")
    body = "\nUNION ALL\n".join(parts)
    return _with(P1, f"t AS ({body})", f"""cf AS (SELECT lag, f.range AS held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
       FROM t, range({folds} + 1) AS f WHERE NOT is_test AND fold <> f.range GROUP BY ALL),
cv AS (SELECT lag, avg(r2) AS score FROM (
       SELECT t.lag, t.fold, 1 - sum(pow(y - a - b * x, 2)) / (count(y) * var_pop(y)) AS r2
       FROM t JOIN cf ON cf.lag = t.lag AND cf.held = t.fold WHERE NOT is_test GROUP BY ALL) GROUP BY lag),
mm AS (SELECT t.lag, is_test, 1 - sum(pow(y - a - b * x, 2)) / (count(y) * var_pop(y)) AS r2, sqrt(avg(pow(y - a - b * x, 2))) AS rmse
       FROM t JOIN cf ON cf.lag = t.lag AND cf.held = {folds} GROUP BY ALL)""") + """
SELECT CAST(p.lag AS INTEGER) AS lag, '{''pca__n_components'': 0.95}' AS params, round(p.r2, 6) AS train_r2, round(q.r2, 6) AS test_r2,
       round(p.rmse, 6) AS train_rmse, round(q.rmse, 6) AS test_rmse, round(cv.score, 6) AS cv_score
FROM mm p JOIN mm q ON p.lag = q.lag AND NOT p.is_test AND q.is_test JOIN cv ON cv.lag = p.lag"""


def _multi_lag_price_sql(max_lag: int = 23) -> str:
    parts = []
    for k in range(max_lag + 1):
        x = f"lag(price, {k}) OVER (ORDER BY row_idx)" if k else "price"
        parts += [f"""SELECT {k} AS lag, '{y}' AS target, is_test, x, y FROM (
  SELECT row_idx, {x} AS x, CAST({y} AS DOUBLE) AS y, {HASH_U} < CAST(0.3 AS DOUBLE) AS is_test FROM i1) WHERE x IS NOT NULL""" for y in ("revenue", "n")]
    body = "\nUNION ALL\n".join(parts)
    return _with(P1, f"t AS ({body})", """cf AS (SELECT lag, target, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE NOT is_test GROUP BY ALL),
mm AS (SELECT t.lag, t.target, is_test, 1 - sum(pow(y - a - b * x, 2)) / (count(y) * var_pop(y)) AS r2, sqrt(avg(pow(y - a - b * x, 2))) AS rmse
       FROM t JOIN cf ON cf.lag = t.lag AND cf.target = t.target GROUP BY ALL),
w AS (SELECT p.lag, p.target, p.r2 AS a, q.r2 AS b, p.rmse AS c, q.rmse AS d FROM mm p JOIN mm q ON p.lag = q.lag AND p.target = q.target AND NOT p.is_test AND q.is_test),
e AS (SELECT * FROM w UNION ALL SELECT lag, 'mean', avg(a), avg(b), avg(c), avg(d) FROM w GROUP BY lag)""") + """
SELECT CAST(lag AS INTEGER) AS lag, target, round(a, 6) AS train_r2, round(b, 6) AS test_r2, round(c, 6) AS train_rmse, round(d, 6) AS test_rmse FROM e"""


ORACLE["multi_lag_sweep_price"] = _multi_lag_price_sql()

_BEST_LAG = f"""best AS (SELECT arg_max(lag, test_r2) AS lag FROM ({_sweep_linear_sql(23)}))"""


def _evaluated_sql() -> str:
    """The best lag's line, fitted on the training rows, on every row of the lag table."""
    return _with(P1, _BEST_LAG, f"""t AS (SELECT i1.row_idx, z.price AS x, i1.revenue AS y, {HASH_U.replace("row_idx", "i1.row_idx")} < CAST(0.3 AS DOUBLE) AS is_test
      FROM i1 JOIN best ON TRUE JOIN i1 z ON z.row_idx = i1.row_idx - best.lag),
cf AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE NOT is_test),
ev AS (SELECT row_idx, y AS actual, a + b * x AS prediction, y - a - b * x AS residual, is_test FROM t JOIN cf ON TRUE)""")


ORACLE["evaluate_series"] = _evaluated_sql() + "SELECT row_idx, round(actual, 3) AS actual, round(prediction, 3) AS prediction, round(residual, 3) AS residual, is_test FROM ev"
ORACLE["evaluate_residuals"] = _evaluated_sql() + "SELECT row_idx, round(prediction, 3) AS prediction, round(residual, 3) AS residual FROM ev WHERE is_test"
ORACLE["evaluate_range"] = _evaluated_sql() + "SELECT round(min(least(actual, prediction)), 3) AS lo, round(max(greatest(actual, prediction)), 3) AS hi FROM ev WHERE is_test"

_SCALED_PAIR = """m AS (SELECT avg(revenue) AS mr, stddev_pop(revenue) AS sr, avg(qty) AS mq, stddev_pop(qty) AS sq, count(*) AS n FROM i1),
z AS (SELECT row_idx, (revenue - mr) / sr AS x, (qty - mq) / sq AS u, lead((revenue - mr) / sr) OVER (ORDER BY row_idx) AS nx FROM i1 JOIN m ON TRUE)"""

ORACLE["dmdc_one_step_pair"] = _with(P1, _SCALED_PAIR, """g AS (SELECT sum(x * x) AS xx, sum(x * u) AS xu, sum(u * u) AS uu, sum(nx * x) AS nx, sum(nx * u) AS nu
      FROM z WHERE row_idx < (SELECT floor((n - 1) * 0.7) FROM m)),
k AS (SELECT (nx * uu - nu * xu) / (xx * uu - xu * xu) AS a, (nu * xx - nx * xu) / (xx * uu - xu * xu) AS b FROM g)""") + """
SELECT row_idx, round(nx * sr + mr, 6) AS actual, round((a * x + b * u) * sr + mr, 6) AS prediction FROM z, k, m WHERE nx IS NOT NULL"""

ORACLE["forecast_one_step"] = _with(P1, """m AS (SELECT min(price) AS lp, max(price) - min(price) AS wp, min(revenue) AS lr, max(revenue) - min(revenue) AS wr, floor(count(*) * 0.7) AS cut FROM i1),
z AS (SELECT row_idx, (price - lp) / wp AS x, (lead(revenue) OVER (ORDER BY row_idx) - lr) / wr AS y, row_idx >= cut AS test, cut FROM i1 JOIN m ON TRUE),
t AS (SELECT * FROM z WHERE y IS NOT NULL AND row_idx <> cut - 1),
cf AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE NOT test),
p AS (SELECT test, y * wr + lr AS y, (a + b * x) * wr + lr AS p FROM t, cf, m)""") + """
SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS part, round(1 - sum(pow(y - p, 2)) / (count(y) * var_pop(y)), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse FROM p GROUP BY test"""

ORACLE["lag_sweep_linear"] = _sweep_linear_sql(5)

ORACLE["grid_search_pcr"] = _grid_pcr_sql()

ORACLE["lag_sweep_linear_all"] = _sweep_linear_sql(23)


def _metric_curves_sql(max_lag: int = 5) -> str:
    return _sweep_linear_sql(max_lag).replace(
    "SELECT CAST(a.lag AS INTEGER) AS lag, CAST(NULL AS VARCHAR) AS params, round(a.r2, 6) AS train_r2,",
    ", sw AS (SELECT CAST(a.lag AS INTEGER) AS lag, CAST(NULL AS VARCHAR) AS params, a.r2 AS train_r2,").replace(
    """       round(b.r2, 6) AS test_r2, round(a.rmse, 6) AS train_rmse, round(b.rmse, 6) AS test_rmse
FROM mm a JOIN mm b ON a.lag = b.lag AND NOT a.is_test AND b.is_test""",
    """       b.r2 AS test_r2, a.rmse AS train_rmse, b.rmse AS test_rmse
FROM mm a JOIN mm b ON a.lag = b.lag AND NOT a.is_test AND b.is_test)
SELECT lag, lag = (SELECT arg_max(lag, test_r2) FROM sw) AS best_r2,
       lag = (SELECT arg_min(lag, test_rmse) FROM sw) AS best_rmse FROM sw""")


ORACLE["lag_metric_curves"] = _metric_curves_sql(5)
ORACLE["lag_metric_curves_all"] = _metric_curves_sql(23)

ORACLE["ols_coefficients"] = _with(P1, """s AS (SELECT regr_slope(revenue, price) AS b, regr_intercept(revenue, price) AS a,
              count(*) AS cnt, avg(price) AS mx, var_pop(price) * count(*) AS sxx FROM i1),
e AS (SELECT sum(pow(i1.revenue - (s.a + s.b * i1.price), 2)) / (s.cnt - 2) AS s2 FROM i1 JOIN s ON TRUE
      GROUP BY s.cnt)""") + """
SELECT 'price' AS variable, round(b, 6) AS coefficient, round(sqrt(s2 / sxx), 6) AS std_err,
       round(b / sqrt(s2 / sxx), 6) AS t_value FROM s JOIN e ON TRUE
UNION ALL
SELECT 'const', round(a, 6), round(sqrt(s2 * (1.0 / cnt + mx * mx / sxx)), 6),
       round(a / sqrt(s2 * (1.0 / cnt + mx * mx / sxx)), 6) FROM s JOIN e ON TRUE"""

# ---------------------------------------------------------------- J1-J12


def _cand_u(j: int) -> str:
    return f"(('0x' || substr(md5('search:42:0:{j}:' || row_idx || ':' || cand), 1, 12))::BIGINT / 281474976710656.0)"


def _bounds(v: str) -> str:
    lo = f"greatest(0.0, {v} * CAST(0.95 AS DOUBLE))"
    hi = f"least(1.0, {v} * CAST(1.05 AS DOUBLE))"
    return (f"CASE WHEN {lo} >= {hi} THEN greatest(0.0, {v} - CAST(0.05 AS DOUBLE)) ELSE {lo} END AS lo_{v}, "
            f"CASE WHEN {lo} >= {hi} THEN least(1.0, {v} + CAST(0.05 AS DOUBLE)) ELSE {hi} END AS hi_{v}")


def _scaled_p1() -> str:
    cols = FEATS + ["revenue"]
    return ("sc AS (SELECT row_idx, " + ", ".join(
        f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in cols) + " FROM i1)")


OPT_LT = """lt AS (SELECT * FROM (
  SELECT row_idx, revenue, n, qty, disc, tax,
         lag(qty, 1) OVER w AS qty_lag1, lag(disc, 1) OVER w AS disc_lag1, lag(tax, 1) OVER w AS tax_lag1,
         lag(revenue, 1) OVER w AS revenue_lag1, lag(n, 1) OVER w AS n_lag1
  FROM sc WINDOW w AS (ORDER BY row_idx)) WHERE qty_lag1 IS NOT NULL)"""

PRED_REV = "((((((0.1 + {q} * 0.6) + {d} * -0.4) + tax * 0.2) + qty_lag1 * 0.1) + revenue_lag1 * 0.3))"
PRED_N = "((((0.05 + {q} * 0.5) + {d} * 0.25) + n_lag1 * 0.2))"

OPT_BEST = f"""bd AS (SELECT *, {_bounds('qty')}, {_bounds('disc')} FROM lt),
cd AS (SELECT bd.*, g.cand,
              CASE WHEN g.cand = 0 THEN qty ELSE lo_qty + {_cand_u(0).replace('cand', 'g.cand')} * (hi_qty - lo_qty) END AS cq,
              CASE WHEN g.cand = 0 THEN disc ELSE lo_disc + {_cand_u(1).replace('cand', 'g.cand')} * (hi_disc - lo_disc) END AS cdd
       FROM bd JOIN (SELECT range AS cand FROM range(0, 200)) g ON TRUE),
ps AS (SELECT row_idx, cand, cq, cdd, {PRED_REV.format(q='cq', d='cdd')} AS pr, {PRED_N.format(q='cq', d='cdd')} AS pn
       FROM cd),
best AS (SELECT row_idx, arg_min(cq, (-1.0 * pr, cand)) AS opt_qty, arg_min(cdd, (-1.0 * pr, cand)) AS opt_disc,
                arg_min(pr, (-1.0 * pr, cand)) AS opt_pred_revenue, arg_min(pn, (-1.0 * pr, cand)) AS opt_pred_n
         FROM ps GROUP BY row_idx),
res AS (SELECT lt.row_idx, lt.qty AS init_qty, lt.disc AS init_disc, best.opt_qty, best.opt_disc,
               {PRED_REV.format(q='lt.qty', d='lt.disc')} AS init_pred_revenue,
               {PRED_N.format(q='lt.qty', d='lt.disc')} AS init_pred_n, best.opt_pred_revenue, best.opt_pred_n,
               lt.revenue AS actual_revenue, lt.n AS actual_n
        FROM lt JOIN best ON best.row_idx = lt.row_idx)"""

_OPT = _with(P1, _scaled_p1(), OPT_LT, OPT_BEST)

ORACLE["optimize_rows"] = _OPT + """
SELECT row_idx, round(init_qty, 6) AS init_qty, round(init_disc, 6) AS init_disc, round(opt_qty, 6) AS opt_qty,
       round(opt_disc, 6) AS opt_disc, round(init_pred_revenue, 6) AS init_pred_revenue,
       round(init_pred_n, 6) AS init_pred_n, round(opt_pred_revenue, 6) AS opt_pred_revenue,
       round(opt_pred_n, 6) AS opt_pred_n FROM res"""

IMP = """imp AS (SELECT row_idx, init_pred_revenue AS initial, opt_pred_revenue AS optimized,
              opt_pred_revenue - init_pred_revenue AS improvement,
              CASE WHEN init_pred_revenue <> 0 THEN (opt_pred_revenue - init_pred_revenue) / init_pred_revenue * 100
                   ELSE 0 END AS improvement_pct FROM res)"""

ORACLE["improvement_summary"] = _OPT + ",\n" + IMP + """
SELECT row_idx, round(initial, 6) AS initial, round(optimized, 6) AS optimized, round(improvement, 6) AS improvement,
       round(improvement_pct, 6) AS improvement_pct FROM imp"""

ORACLE["input_changes"] = _OPT + """
SELECT 'qty' AS variable, round(avg(CASE WHEN init_qty <> 0 THEN (opt_qty - init_qty) / init_qty * 100 END), 6)
       AS avg_change_pct FROM res
UNION ALL
SELECT 'disc', round(avg(CASE WHEN init_disc <> 0 THEN (opt_disc - init_disc) / init_disc * 100 END), 6) FROM res"""

ORACLE["success_rate"] = _OPT + ",\n" + IMP + """
SELECT CAST(sum(CAST(improvement > 0 AS INTEGER)) AS BIGINT) AS successful, count(*) AS total,
       round(avg(CAST(improvement > 0 AS DOUBLE)) * 100, 6) AS success_rate FROM imp"""

ORACLE["state_table"] = _OPT + """
SELECT row_idx, 'Initial' AS state, round(init_pred_revenue, 6) AS revenue, round(init_pred_n, 6) AS n,
       round(init_qty, 6) AS qty, round(init_disc, 6) AS disc FROM res
UNION ALL
SELECT row_idx, 'Optimized', round(opt_pred_revenue, 6), round(opt_pred_n, 6), round(opt_qty, 6), round(opt_disc, 6)
FROM res
UNION ALL
SELECT row_idx, 'Actual', round(actual_revenue, 6), round(actual_n, 6), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM res"""

_STATE_FIXED = ", ".join(f"round(lt.{c}, 6) AS {c}" for c in ("tax", "qty_lag1", "disc_lag1", "tax_lag1", "revenue_lag1", "n_lag1"))
ORACLE["state_table_inputs"] = _OPT + "\nUNION ALL\n".join(f"""
SELECT res.row_idx, '{state}' AS state, round({rev}, 6) AS revenue, round({n}, 6) AS n, round({qty}, 6) AS qty, round({disc}, 6) AS disc, {_STATE_FIXED}
FROM res JOIN lt ON lt.row_idx = res.row_idx""" for state, rev, n, qty, disc in (
    ("Initial", "init_pred_revenue", "init_pred_n", "init_qty", "init_disc"), ("Optimized", "opt_pred_revenue", "opt_pred_n", "opt_qty", "opt_disc"),
    ("Actual", "actual_revenue", "actual_n", "init_qty", "init_disc")))

ORACLE["csv_roundtrip"] = _with(P1) + """
SELECT t.variable, t.dtype, (SELECT count(*) FROM p1) AS non_null, (SELECT count(*) FROM p1) AS rows
FROM (VALUES ('day', 'timestamp'), ('qty', 'double'), ('price', 'double'), ('disc', 'double'), ('tax', 'double'),
             ('n', 'double'), ('revenue', 'double')) t(variable, dtype)"""

ORACLE["csv_position"] = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id, md5(chr(34) || chr(10) || ',' || text || ',' || chr(13) || chr(10) || chr(34) || chr(34)) AS text_md5,
       nullif(lang, '') AS lang, nullif(source, '') AS source
FROM documents"""

ORACLE["csv_values"] = _with(P1) + """
SELECT row_number() OVER (ORDER BY day) - 1 AS row_idx, strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS day, round(qty, 6) AS qty, round(price, 6) AS price,
       round(disc, 6) AS disc, round(tax, 6) AS tax, round(n, 6) AS n, round(revenue, 6) AS revenue
FROM p1"""

ORACLE["improvement_histogram"] = _OPT + ",\n" + IMP + """,
w AS (SELECT min(improvement) AS lo, max(improvement) AS hi, least(10, count(*)) AS nb FROM imp),
w2 AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi, nb
       FROM w),
w3 AS (SELECT lo, hi, nb, (hi - lo) / nb AS width FROM w2),
b AS (SELECT CAST(least(floor((improvement - lo) / width), nb - 1) AS INTEGER) AS bin, count(*) AS cnt
      FROM imp JOIN w3 ON TRUE GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(w3.lo + g.bin * w3.width, 6) AS lo,
       round(CASE WHEN g.bin < w3.nb - 1 THEN w3.lo + (g.bin + 1) * w3.width ELSE w3.hi END, 6) AS hi,
       coalesce(b.cnt, 0) AS count
FROM w3 JOIN (SELECT range AS bin FROM range(0, 10)) g ON g.bin < w3.nb LEFT JOIN b ON b.bin = g.bin"""

ORACLE["skipped_rows"] = _with(P1) + "SELECT row_idx FROM i1 WHERE row_idx < 1"


def _pair_hist_sql() -> str:
    parts = []
    for c in FEATS + ["revenue"]:
        parts.append(f"""SELECT '{c}' AS variable, CAST(g.bin AS INTEGER) AS bin, round(w.lo + g.bin * w.width, 6) AS lo,
       round(CASE WHEN g.bin < 19 THEN w.lo + (g.bin + 1) * w.width ELSE w.hi END, 6) AS hi,
       coalesce(b.cnt, 0) AS count
FROM (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 20 AS width FROM i1) w
JOIN (SELECT range AS bin FROM range(0, 20)) g ON TRUE
LEFT JOIN (SELECT CAST(least(floor(({c} - w0.lo) / w0.width), 19) AS INTEGER) AS bin, count(*) AS cnt
           FROM i1 JOIN (SELECT min({c}) AS lo, (max({c}) - min({c})) / 20 AS width FROM i1) w0 ON TRUE
           GROUP BY 1) b ON b.bin = g.bin""")
    return _with(P1) + "\nUNION ALL\n".join(parts)


ORACLE["pair_plot_hist"] = _pair_hist_sql()

ORACLE["scatter_3d"] = _with(P1) + f"""
SELECT row_idx, qty, disc, tax, revenue FROM i1 WHERE {SAMPLE_U} < least(1.0, 1000.0 / (SELECT count(*) FROM i1))"""

ORACLE["preview"] = _with(P1) + """
SELECT * FROM (SELECT row_idx, """ + ", ".join(f"{lag(f, 3)} AS {f}_lag3" for f in FEATS) + """, revenue FROM i1)
WHERE qty_lag3 IS NOT NULL ORDER BY row_idx LIMIT 5"""

ORACLE["lag_optimised_corr"] = _with(P1, P1_LONG, LAGCORR_PAIRS, BEST) + """,
mx AS (SELECT max(best_lag) AS m FROM best),
lo AS (SELECT c.row_idx, b.variable || '_lag' || CAST(b.best_lag AS VARCHAR) AS v, l.x AS value
       FROM i1 c JOIN best b ON TRUE JOIN l1 l ON l.variable = b.variable AND l.row_idx = c.row_idx - b.best_lag
       WHERE c.row_idx >= (SELECT m FROM mx)
       UNION ALL
       SELECT row_idx, 'revenue', revenue FROM i1 WHERE row_idx >= (SELECT m FROM mx))
SELECT a.v AS var1, b.v AS var2, round(corr(a.value, b.value), 6) AS corr
FROM lo a JOIN lo b ON a.row_idx = b.row_idx GROUP BY a.v, b.v"""

ORACLE["lag_optimised_corr_spearman"] = _with(P1, P1_LONG, LAGCORR_PAIRS, SPEARMAN_RANKED) + """,
lc AS (SELECT variable, CAST(lag AS INTEGER) AS lag, corr(rx, ry) AS corr FROM ranked GROUP BY variable, lag),
best AS (SELECT variable, arg_min(lag, (abs(corr) * -1, lag)) AS best_lag FROM lc WHERE corr IS NOT NULL GROUP BY variable),
mx AS (SELECT max(best_lag) AS m FROM best),
lo AS (SELECT c.row_idx, b.variable || '_lag' || CAST(b.best_lag AS VARCHAR) AS v, l.x AS value
       FROM i1 c JOIN best b ON TRUE JOIN l1 l ON l.variable = b.variable AND l.row_idx = c.row_idx - b.best_lag
       WHERE c.row_idx >= (SELECT m FROM mx)
       UNION ALL
       SELECT row_idx, 'revenue', revenue FROM i1 WHERE row_idx >= (SELECT m FROM mx)),
rk AS (SELECT row_idx, v, rank() OVER (PARTITION BY v ORDER BY value) + (count(*) OVER (PARTITION BY v, value) - 1) / 2.0 AS value FROM lo)
SELECT a.v AS var1, b.v AS var2, round(corr(a.value, b.value), 6) AS corr
FROM rk a JOIN rk b ON a.row_idx = b.row_idx GROUP BY a.v, b.v"""

ORACLE["last_row"] = _with(P1) + """
SELECT * FROM (SELECT row_idx, """ + ", ".join(f"{lag(f, 1)} AS {f}_lag1" for f in FEATS) + """, revenue FROM i1)
ORDER BY row_idx DESC LIMIT 1"""

ORACLE["lag_corr_keyed"] = _with(EVK) + """,
kp AS (SELECT 'hour' AS variable, g.lag,
              lag(e.hour, CAST(g.lag AS INTEGER)) OVER (PARTITION BY g.lag, e.user_id ORDER BY e.event_id) AS x,
              e.value AS y
       FROM evk e JOIN (SELECT range AS lag FROM range(0, 5)) g ON TRUE)
SELECT variable, CAST(lag AS INTEGER) AS lag, round(corr(x, y), 6) AS corr
FROM kp WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY variable, lag"""
