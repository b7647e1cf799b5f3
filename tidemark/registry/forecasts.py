"""Forecasting."""

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import trees as G
from tidemark.operators import regress, seasonal as M, series as S
from tidemark.plans import forecast as K, modules as X, scores as Z
from tidemark.registry import modules as _modules  # noqa: F401  (its SQL is reused below)
from tidemark.registry.base import DRIVER, MARKET, PRICE, SQL, VOLUME, W, longs, query, r, rounded
from tidemark.sources import tables as T
from tidemark.sources.store import landed


def _f(agg: str, c: str, n: int, need: int) -> str:
    f = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {f} >= {need} THEN {agg}({c}) OVER {f} END"


_FEATURES = f"""fj AS (SELECT p.*, v.value AS a, last_value(d.value IGNORE NULLS) OVER (PARTITION BY p.series_id ORDER BY p.ts ROWS UNBOUNDED PRECEDING) AS f FROM price p LEFT JOIN volume v ON v.ts = p.ts AND v.series_id='arrivals' LEFT JOIN driver d ON d.ts = p.ts),
 ft AS (SELECT series_id, ts, value AS price_lag_0, {', '.join(f'lag(value,{k}) OVER {W} AS price_lag_{k}' for k in fixed.PRICE_LAGS)}, {', '.join(f"{_f('avg','value',w,max(3,w//2))} AS price_mean_{w}" for w in fixed.FEATURE_WINDOWS)},
 {', '.join(f"{_f('stddev_samp','value',w,max(3,w//2))} AS price_sd_{w}" for w in fixed.FEATURE_WINDOWS)}, month(ts)::DOUBLE AS month, dayofyear(ts)::DOUBLE AS day_of_year, CASE WHEN month(ts) IN (2,3,4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_harvest,
 lag(a) OVER {W} AS arrivals_lag_1, {_f('avg','a',30,15)} AS arrivals_mean_30, lag(f) OVER {W} AS rate_lag_1, {_f('avg','f',30,30)} AS rate_mean_30 FROM fj)"""


def _features(spark, sf):
    return K.features(T.prices(spark, sf), T.arrivals(spark, sf), T.driver(spark, sf))


@query("features", f"WITH {PRICE}, {VOLUME}, {DRIVER}, {_FEATURES} SELECT series_id, ts, {', '.join(f'{r(c)} AS {c}' for c in K.FEATURES)} FROM ft")
def features(spark, sf):
    return rounded(_features(spark, sf))


@query("labels", f"WITH {PRICE} SELECT p.series_id, p.ts, {r('p.value')} AS price_lag_0, {r('t.value')} AS target FROM price p LEFT JOIN price t ON t.series_id = p.series_id AND t.ts = p.ts + 30")
def labels(spark, sf):
    return rounded(K.labelled(_features(spark, sf), T.prices(spark, sf), 30).select("series_id", "ts", "price_lag_0", "target"))


_ORIGINS = """sp AS (SELECT series_id, CAST(min(ts) + INTERVAL 36 MONTH AS DATE) AS e, CAST(max(ts) - 185 AS DATE) AS l FROM price GROUP BY 1),
 og AS (SELECT series_id, c AS cut, CAST(e + CAST(floor(c * date_diff('day', e, l) / 5.0) AS INTEGER) AS DATE) AS origin FROM sp, (SELECT unnest([0,1,2,3,4,5]) AS c) WHERE e < l),
 oh AS (SELECT og.*, h AS horizon, CAST(origin + h AS DATE) AS target_ts FROM og, (SELECT unnest([7,14,30,60,90,120,180]) AS h))"""


def _near(target: str, tol: int) -> str:
    return f"(SELECT value FROM price m WHERE m.series_id = oh.series_id AND abs(date_diff('day', {target}, m.ts)) <= {tol} ORDER BY abs(date_diff('day', {target}, m.ts)), m.ts LIMIT 1)"


@query("origins", f"WITH {PRICE}, {_ORIGINS} SELECT * FROM og")
def origins(spark, sf):
    return longs(K.origins(T.prices(spark, sf)))


_NAIVE = f"nv AS (SELECT series_id, cut, horizon, {_near('target_ts', 2)} AS actual, {_near('CAST(target_ts - 365 AS DATE)', 3)} AS pred FROM oh), nb AS (SELECT * FROM nv WHERE actual IS NOT NULL AND pred IS NOT NULL)"


def _naive(spark, sf):
    p = T.prices(spark, sf)
    points = K.with_horizons(K.origins(p))
    actual = S.nearest(points, p, "target_ts", 2, "actual").where("actual is not null").select("series_id", "cut", "horizon", "actual")
    pred = K.seasonal_naive(p, points).where("pred is not null").select("series_id", "cut", "horizon", "pred")
    return actual.join(pred, ["series_id", "cut", "horizon"]).withColumn("model", F.lit("seasonal_naive"))


@query("seasonal_naive", f"WITH {PRICE}, {_ORIGINS}, {_NAIVE} SELECT series_id, cut, horizon, {r('actual')} AS actual, {r('pred')} AS pred, 'seasonal_naive' AS model FROM nb")
def seasonal_naive(spark, sf):
    return rounded(longs(_naive(spark, sf)))


@query("naive_metrics", f"""WITH {PRICE}, {_ORIGINS}, {_NAIVE} SELECT series_id, 'seasonal_naive' AS model, horizon, {r('sqrt(avg(pow(actual-pred,2)))')} AS rmse, {r('avg(abs(actual-pred))')} AS mae, {r('avg(abs((actual-pred)/actual))*100')} AS mape,
 {r('avg(abs(actual-pred)/((abs(actual)+abs(pred))/2))*100')} AS smape, count(*) AS n FROM nb GROUP BY 1, 3""")
def naive_metrics(spark, sf):
    return rounded(longs(K.error_metrics(_naive(spark, sf))))


@query("empirical_interval", f"""WITH {PRICE}, {_ORIGINS}, {_NAIVE}, q AS (SELECT series_id, horizon, quantile_cont(actual-pred, 0.05) AS lo, quantile_cont(actual-pred, 0.95) AS hi, list(actual-pred) AS res, count(*) AS n FROM nb GROUP BY 1, 2),
 c AS (SELECT series_id, max(ts) AS o, arg_max(value, ts) AS current FROM price GROUP BY 1), oh2 AS (SELECT c.*, h AS horizon, CAST(o + h - 365 AS DATE) AS t FROM c, (SELECT unnest([7,14,30,60,90,120,180]) AS h)),
 p AS (SELECT oh.series_id, oh.horizon, oh.current, {_near('oh.t', 3)} AS point FROM oh2 oh)
 SELECT p.series_id, CAST(p.horizon AS BIGINT) AS horizon, 'seasonal_naive' AS model, {r('point')} AS point, {r('p.current')} AS current, {r('CASE WHEN n >= 3 THEN point+lo END')} AS lower, {r('CASE WHEN n >= 3 THEN point+hi END')} AS upper,
  {r('CASE WHEN n >= 5 THEN len(list_filter(res, lambda e: point+e > current))*100.0/n END')} AS bullish_pct, {r('CASE WHEN n >= 5 THEN 100-len(list_filter(res, lambda e: point+e > current))*100.0/n END')} AS bearish_pct, coalesce(n, 0) AS residuals_used
 FROM p LEFT JOIN q ON q.series_id = p.series_id AND q.horizon = p.horizon WHERE point IS NOT NULL""")
def empirical_interval(spark, sf):
    p = T.prices(spark, sf)
    now = K.seasonal_naive(p, K.with_horizons(K.present(p))).where("pred is not null")
    from tidemark.operators.stats import latest
    base = now.join(latest(p).select("series_id", F.col("latest").alias("current")), "series_id").select(
        "series_id", "horizon", F.lit("seasonal_naive").alias("model"), F.col("pred").alias("point"), "current")
    return rounded(longs(K.with_interval(base, K.residual_table(_naive(spark, sf)))))


_KW = "(PARTITION BY series_id, cut ORDER BY ts)"
_PRESENT = "tw AS (SELECT series_id, -1::BIGINT AS cut, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM price GROUP BY 1, 2, 3)"
_TRAIN = "tw AS (SELECT p.series_id, og.cut, CAST(date_trunc('week', p.ts) AS DATE) + 6 AS ts, avg(p.value) AS value FROM price p JOIN og ON og.series_id = p.series_id AND p.ts <= og.origin GROUP BY 1, 2, 3)"

# Smoothing over the weight grid for every (series_id, cut) of tw, up to the best triple in hb.
def _smooth(m: int) -> str:
    return f"""wn AS (SELECT *, row_number() OVER {_KW} AS rn, count(*) OVER (PARTITION BY series_id, cut) AS n FROM tw),
 fi AS (SELECT series_id, cut, max(n) AS n, avg(value) FILTER (rn <= {m}) AS l0, avg(value) FILTER (rn BETWEEN {m + 1} AND {2 * m}) AS l1, list(value ORDER BY rn) FILTER (rn <= {m}) AS f FROM wn WHERE n >= {2 * m} GROUP BY 1, 2),
 gr AS (SELECT a, b, g, row_number() OVER (ORDER BY a, b, g) AS gi FROM (SELECT unnest([0.05,0.1,0.2,0.35,0.5,0.8])::DOUBLE AS a), (SELECT unnest([0.0,0.02,0.1])::DOUBLE AS b), (SELECT unnest([0.0,0.05,0.2,0.4])::DOUBLE AS g)),
 hw AS (SELECT series_id, cut, gi, a, b, g, {m}::BIGINT AS t, l0 AS lev, (l1-l0)/{m} AS tre, list_transform(f, lambda x: x-l0) AS sea, 0.0::DOUBLE AS sse FROM fi, gr UNION ALL
  SELECT series_id, cut, gi, a, b, g, t+1, nl, tre+b*(nl-lev-tre), list_transform(sea, lambda s, i: CASE WHEN i = t%{m}+1 THEN past+g*(y-nl-past) ELSE s END), sse+pow(y-lev-tre-past, 2) FROM (
   SELECT q.*, lev+tre+a*(y-past-lev-tre) AS nl FROM (SELECT hw.*, wn.value AS y, sea[t%{m}+1] AS past FROM hw JOIN wn ON wn.series_id = hw.series_id AND wn.cut = hw.cut AND wn.rn = hw.t+1) q)),
 hb AS (SELECT hw.*, fi.n FROM hw JOIN fi USING (series_id, cut) WHERE hw.t = fi.n QUALIFY row_number() OVER (PARTITION BY series_id, cut ORDER BY sse, gi) = 1)"""


_SMOOTH = _smooth(52)

# Autoregression on changes at lags 1, 2, 4 for every (series_id, cut) of tw, iterated 27 steps in ap.
_AR = f"""ad AS (SELECT series_id, cut, ts, value, value - lag(value) OVER {_KW} AS d FROM tw), al AS (SELECT *, lag(d,1) OVER {_KW} AS x1, lag(d,2) OVER {_KW} AS x2, lag(d,3) OVER {_KW} AS x3, lag(d,4) OVER {_KW} AS x4 FROM ad),
 am AS (SELECT series_id, cut, count(*) AS n, avg(d) my, avg(x1) m1, avg(x2) m2, avg(x4) m3, var_pop(d)*count(*) yy, var_pop(x1)*count(*) a, covar_pop(x1,x2)*count(*) b, covar_pop(x1,x4)*count(*) c, var_pop(x2)*count(*) d, covar_pop(x2,x4)*count(*) e,
   var_pop(x4)*count(*) f, covar_pop(x1,d)*count(*) s1, covar_pop(x2,d)*count(*) s2, covar_pop(x4,d)*count(*) s3 FROM al WHERE x4 IS NOT NULL GROUP BY 1, 2),
 ai AS (SELECT *, a*d-b*b AS d2, a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS d3 FROM am WHERE n >= 30),
 ab AS (SELECT ai.*, t.* FROM ai, LATERAL (VALUES (1, s1/a, 0.0::DOUBLE, 0.0::DOUBLE), (2, (d*s1-b*s2)/d2, (a*s2-b*s1)/d2, 0.0::DOUBLE), (3, ((d*f-e*e)*s1+(c*e-b*f)*s2+(b*e-c*d)*s3)/d3, ((c*e-b*f)*s1+(a*f-c*c)*s2+(b*c-a*e)*s3)/d3,
   ((b*e-c*d)*s1+(b*c-a*e)*s2+(a*d-b*b)*s3)/d3)) AS t(p, b1, b2, b3)), ac AS (SELECT *, yy-b1*s1-b2*s2-b3*s3 AS sse FROM ab),
 af AS (SELECT *, n*ln(sse/n)+2*(p+1) AS aic, my-b1*m1-b2*m2-b3*m3 AS b0, sqrt(sse/(n-p-1)) AS sigma FROM ac QUALIFY row_number() OVER (PARTITION BY series_id, cut ORDER BY n*ln(sse/n)+2*(p+1), p) = 1),
 an AS (SELECT series_id, cut, arg_max(value, ts) AS lev, arg_max([x3, x2, x1, d], ts) AS ch FROM al GROUP BY 1, 2),
 ap AS (SELECT series_id, cut, 0::BIGINT AS step, lev AS pred, ch FROM an UNION ALL SELECT ap.series_id, ap.cut, step+1, pred + (b0+b1*ch[4]+b2*ch[3]+b3*ch[1]), [ch[2], ch[3], ch[4], b0+b1*ch[4]+b2*ch[3]+b3*ch[1]] FROM ap JOIN af ON af.series_id = ap.series_id AND af.cut = ap.cut WHERE step < 27)"""

_POINTS = f"""st AS (SELECT *, CASE horizon WHEN 7 THEN 1 WHEN 14 THEN 2 WHEN 30 THEN 4 WHEN 60 THEN 9 WHEN 90 THEN 13 WHEN 120 THEN 17 ELSE 26 END AS step FROM oh),
 pr AS (SELECT series_id, cut, horizon, 'seasonal_naive' AS model, pred FROM nv WHERE pred IS NOT NULL UNION ALL SELECT st.series_id, st.cut, horizon, 'holt_winters', lev+step*tre+sea[(n+step-1)%52+1] FROM st JOIN hb ON hb.series_id = st.series_id AND hb.cut = st.cut
  UNION ALL SELECT st.series_id, st.cut, horizon, 'autoregression', ap.pred FROM st JOIN ap ON ap.series_id = st.series_id AND ap.cut = st.cut AND ap.step = st.step),
 bt AS (SELECT oh.series_id, oh.cut, oh.horizon, oh.origin, oh.target_ts, pr.model, pr.pred, nv.actual FROM oh JOIN nv ON nv.series_id = oh.series_id AND nv.cut = oh.cut AND nv.horizon = oh.horizon JOIN pr ON pr.series_id = oh.series_id AND pr.cut = oh.cut AND pr.horizon = oh.horizon WHERE nv.actual IS NOT NULL),
 mt AS (SELECT series_id, model, CAST(horizon AS BIGINT) AS horizon, sqrt(avg(pow(actual-pred,2))) AS rmse, avg(abs(actual-pred)) AS mae, avg(abs((actual-pred)/actual))*100 AS mape, avg(abs(actual-pred)/((abs(actual)+abs(pred))/2))*100 AS smape, count(*) AS n FROM bt GROUP BY 1, 2, 3)"""


# Boosted trees for every row (series_id, cut, horizon, origin) of tm, up to their points in tp and the gain of their features in tg.
def _trees() -> str:
    """The rounds are written out: per depth one histogram over (model, node, feature, bin), its running sums, and the best split of each node."""
    steps, gains = [], []
    for k in range(G.ROUNDS):
        steps.append(f"v{k}_0 AS MATERIALIZED (SELECT i, m, train, y, pred, y - pred AS rest, m AS node FROM p{k})")
        for d in range(G.DEPTH):
            steps.append(f"""c{k}_{d} AS (SELECT node, f, b, sum(n) OVER u AS ln, sum(g) OVER u AS lg, sum(n) OVER (PARTITION BY node, f) AS an, sum(g) OVER (PARTITION BY node, f) AS ag FROM (SELECT node, f, b, count(*)::DOUBLE AS n, sum(rest) AS g
  FROM tb JOIN v{k}_{d} v USING (i) WHERE v.train GROUP BY 1, 2, 3) WINDOW u AS (PARTITION BY node, f ORDER BY b)),
 e{k}_{d} AS (SELECT *, lg*lg/(ln+{G.RIDGE}::DOUBLE) + (ag-lg)*(ag-lg)/((an-ln)+{G.RIDGE}::DOUBLE) - ag*ag/(an+{G.RIDGE}::DOUBLE) AS gain FROM c{k}_{d} WHERE ln >= {G.SMALLEST} AND an-ln >= {G.SMALLEST}),
 s{k}_{d} AS MATERIALIZED (SELECT node, f, b AS sb, gain FROM e{k}_{d} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1),
 v{k}_{d + 1} AS MATERIALIZED (SELECT v.i, v.m, v.train, v.y, v.pred, v.rest, 2*v.node + CASE WHEN tb.b > s.sb THEN 1 ELSE 0 END AS node FROM v{k}_{d} v LEFT JOIN s{k}_{d} s ON s.node = v.node LEFT JOIN tb ON tb.i = v.i AND tb.f = s.f)""")
            gains.append(f"SELECT node >> {d} AS m, f, gain FROM s{k}_{d}")
        v = f"v{k}_{G.DEPTH}"
        steps.append(f"""p{k + 1} AS MATERIALIZED (SELECT v.i, v.m, v.train, v.y, v.pred + coalesce(floor({G.RATE}::DOUBLE*l.g/(l.n+{G.RIDGE}::DOUBLE)), 0) AS pred FROM {v} v LEFT JOIN (SELECT node, sum(rest) AS g, count(*)::DOUBLE AS n FROM {v} WHERE train GROUP BY 1) l USING (node))""")
    return f"""tf AS MATERIALIZED (SELECT series_id, ts, [{', '.join(K.FEATURES)}]::DOUBLE[] AS x FROM ft WHERE {' AND '.join(f'{c} IS NOT NULL' for c in K.FEATURES)}),
 tn AS MATERIALIZED (SELECT tm.series_id, cut, horizon, origin, max(p.ts) AS newest FROM tm JOIN price p ON p.series_id = tm.series_id AND p.ts <= tm.origin GROUP BY ALL),
 t0 AS MATERIALIZED (SELECT f.series_id, cut, horizon, x, floor(p.value*{G.UNIT}::DOUBLE+0.5) AS y, true AS train FROM tn JOIN tf f ON f.series_id = tn.series_id JOIN price p ON p.series_id = f.series_id AND p.ts = f.ts + horizon::INTEGER WHERE f.ts + horizon::INTEGER <= origin
  UNION ALL SELECT f.series_id, cut, horizon, x, 0.0::DOUBLE, false FROM tn JOIN tf f ON f.series_id = tn.series_id AND f.ts = newest),
 tk AS MATERIALIZED (SELECT series_id, cut, horizon, count(*) FILTER (train) AS n, row_number() OVER () - 1 AS m FROM t0 GROUP BY 1, 2, 3 HAVING count(*) FILTER (train) >= {G.LEAST} AND count(*) FILTER (NOT train) = 1),
 tx AS MATERIALIZED (SELECT m, n, row_number() OVER () AS i, x, y, train FROM t0 JOIN tk USING (series_id, cut, horizon)),
 tb AS MATERIALIZED (SELECT i, f, CAST(least({G.BINS - 1}, below*{G.BINS}//n) AS INTEGER) AS b FROM (SELECT i, n, f, sum(CASE WHEN train THEN 1 ELSE 0 END) OVER (PARTITION BY m, f ORDER BY v) - sum(CASE WHEN train THEN 1 ELSE 0 END) OVER (PARTITION BY m, f, v) AS below
  FROM (SELECT i, m, n, train, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM tx))),
 p0 AS MATERIALIZED (SELECT i, m, train, y, floor(sum(CASE WHEN train THEN y END) OVER (PARTITION BY m) / n) AS pred FROM tx),
 {', '.join(steps)},
 tp AS (SELECT series_id, cut, horizon, pred/{G.UNIT}::DOUBLE AS pred, n FROM p{G.ROUNDS} JOIN tk USING (m) WHERE NOT train),
 tg AS (SELECT m, f, sum(gain) AS gain FROM ({' UNION ALL '.join(gains)}) GROUP BY 1, 2)"""


def _backtest(train: str, now: str = "") -> str:
    asked = f"tm AS (SELECT series_id, cut, horizon, origin FROM oh{now})"
    points = _POINTS.replace("),\n bt AS", " UNION ALL SELECT series_id, cut, horizon, 'boosted_trees', pred FROM tp),\n bt AS", 1)
    return f"WITH RECURSIVE {PRICE}, {_ORIGINS}, {_NAIVE}, {train}, {_SMOOTH}, {_AR}, {VOLUME}, {DRIVER}, {_FEATURES}, {asked}, {_trees()}, {points}"


_BACKTEST = _backtest(_TRAIN)
_TRAIN_AND_NOW = _TRAIN[:-1] + " UNION ALL SELECT series_id, -1, CAST(date_trunc('week', ts) AS DATE) + 6, avg(value) FROM price GROUP BY 1, 2, 3)"


def _contest(spark, sf):
    """The backtest with all four models."""
    p = landed(T.prices(spark, sf))
    return K.backtest(p, feature_rows=landed(K.features(p, T.arrivals(spark, sf), T.driver(spark, sf))))


@query("backtest_points", f"{_BACKTEST} SELECT series_id, CAST(cut AS BIGINT) AS cut, CAST(horizon AS BIGINT) AS horizon, origin, target_ts, model, {r('pred')} AS pred, {r('actual')} AS actual FROM bt")
def backtest_points(spark, sf):
    return rounded(longs(_contest(spark, sf)))


@query("backtest_metrics", f"{_BACKTEST} SELECT series_id, model, horizon, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('mape')} AS mape, {r('smape')} AS smape, n FROM mt")
def backtest_metrics(spark, sf):
    return rounded(longs(K.error_metrics(_contest(spark, sf))))


_SUPPLIERS = """price AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS value
 FROM lineitem GROUP BY 1, 2)"""


@query("backtest_suppliers", f"""WITH RECURSIVE {_SUPPLIERS}, {_ORIGINS}, {_NAIVE}, {_TRAIN}, {_SMOOTH}, {_AR}, {_POINTS}
 SELECT series_id, model, horizon, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('mape')} AS mape, {r('smape')} AS smape, n FROM mt""")
def backtest_suppliers(spark, sf):
    """The walk-forward backtest over every supplier's series at once."""
    return rounded(longs(K.error_metrics(K.backtest(landed(T.supplier_prices(spark, sf))))))


@query("select_best", f"""{_BACKTEST}, rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse, model) AS k FROM mt)
 SELECT a.series_id, a.horizon, a.model, {r('a.rmse')} AS rmse, {r('a.mape')} AS mape, a.n AS n_folds, b.model AS runner_up, {r('(b.rmse-a.rmse)/a.rmse*100')} AS gap_pct FROM rk a LEFT JOIN rk b ON b.series_id = a.series_id AND b.horizon = a.horizon AND b.k = 2 WHERE a.k = 1""")
def select_best(spark, sf):
    return rounded(longs(K.select_best(K.error_metrics(_contest(spark, sf)))))


_AND_NOW = " UNION ALL SELECT series_id, -1, h, max(ts) FROM price, (SELECT unnest([7,14,30,60,90,120,180]) AS h) GROUP BY 1, 3"
_FORECAST = f"""{_backtest(_TRAIN_AND_NOW, _AND_NOW)},
 rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse, model) AS k FROM mt), lt AS (SELECT series_id, max(ts) AS as_of, arg_max(value, ts) AS current FROM price GROUP BY 1),
 oh2 AS (SELECT lt.*, h AS horizon, CAST(as_of + h AS DATE) AS target_ts, CAST(as_of + h - 365 AS DATE) AS back, CASE h WHEN 7 THEN 1 WHEN 14 THEN 2 WHEN 30 THEN 4 WHEN 60 THEN 9 WHEN 90 THEN 13 WHEN 120 THEN 17 ELSE 26 END AS step FROM lt, (SELECT unnest([7,14,30,60,90,120,180]) AS h)),
 pw AS (SELECT oh.series_id, oh.horizon, 'seasonal_naive' AS model, {_near('oh.back', 3)} AS point FROM oh2 oh UNION ALL SELECT o.series_id, o.horizon, 'holt_winters', lev+step*tre+sea[(n+step-1)%52+1] FROM oh2 o JOIN hb ON hb.series_id = o.series_id AND hb.cut = -1
  UNION ALL SELECT o.series_id, o.horizon, 'autoregression', ap.pred FROM oh2 o JOIN ap ON ap.series_id = o.series_id AND ap.cut = -1 AND ap.step = o.step UNION ALL SELECT series_id, horizon, 'boosted_trees', pred FROM tp WHERE cut = -1),
 rs AS (SELECT series_id, model, horizon, quantile_cont(actual-pred, 0.05) AS lo, quantile_cont(actual-pred, 0.95) AS hi, list(actual-pred) AS res, count(*) AS n FROM bt GROUP BY 1, 2, 3),
 fc AS (SELECT rk.series_id, as_of, rk.horizon, target_ts, rk.model, point, current, rk.rmse, rk.mape, rk.n AS n_folds, lo, hi, res, rs.n AS m FROM rk JOIN oh2 ON oh2.series_id = rk.series_id AND oh2.horizon = rk.horizon JOIN pw ON pw.series_id = rk.series_id AND pw.horizon = rk.horizon AND pw.model = rk.model
  JOIN rs ON rs.series_id = rk.series_id AND rs.horizon = rk.horizon AND rs.model = rk.model WHERE k = 1 AND point IS NOT NULL)"""


@query("forecast", f"""{_FORECAST} SELECT series_id, as_of, horizon, target_ts, model, {r('point')} AS point, {r('current')} AS current, {r('rmse')} AS rmse, {r('mape')} AS mape, n_folds, {r('CASE WHEN m >= 3 THEN point+lo END')} AS lower, {r('CASE WHEN m >= 3 THEN point+hi END')} AS upper,
 {r('CASE WHEN m >= 5 THEN len(list_filter(res, lambda e: point+e > current))*100.0/m END')} AS bullish_pct, {r('CASE WHEN m >= 5 THEN 100-len(list_filter(res, lambda e: point+e > current))*100.0/m END')} AS bearish_pct, m AS residuals_used, {r('(point-current)/current*100')} AS change_pct,
 array_to_string(list_filter([CASE WHEN horizon >= 90 THEN horizon || ' days ahead: read the interval, not the point' END, CASE WHEN n_folds < 6 THEN 'only ' || n_folds || ' folds behind the error estimate' END, CASE WHEN mape > 10 THEN printf('past error of %.1f %% at this horizon', mape) END,
  CASE model WHEN 'seasonal_naive' THEN 'repeats last year and cannot react to a new shock' WHEN 'holt_winters' THEN 'horizon rounded to whole weeks, up to three days off' WHEN 'boosted_trees' THEN 'importances describe past patterns, not causes' ELSE 'models short memory only, no yearly season' END], lambda x: x IS NOT NULL), '; ') AS risks FROM fc""")
def forecast(spark, sf):
    p = landed(T.prices(spark, sf))
    out = K.forecast(p, feature_rows=landed(K.features(p, T.arrivals(spark, sf), T.driver(spark, sf))))
    return rounded(longs(out.withColumn("risks", F.array_join("risks", "; "))))


@query("holt_winters_grid", f"""WITH RECURSIVE {PRICE}, {_PRESENT}, {_SMOOTH} SELECT series_id, cut, h AS step, {r('lev+h*tre+sea[(n+h-1)%52+1]')} AS pred, {r('a')} AS alpha, {r('b')} AS beta, {r('g')} AS gamma, {r('sqrt(sse/(n-52))')} AS sigma
 FROM hb, (SELECT unnest(generate_series(1, 26)) AS h)""")
def holt_winters_grid(spark, sf):
    p = T.prices(spark, sf)
    return rounded(longs(K.holt_winters(K.training(p, K.present(p), "W"), 52, 26)))


@query("ar_ols", f"""WITH RECURSIVE {PRICE}, {_PRESENT}, {_AR} SELECT ap.series_id, ap.cut, step, {r('pred')} AS pred, ([1,2,4]::BIGINT[])[:p] AS lags_used, {r('aic')} AS aic, {r('sigma')} AS sigma FROM ap JOIN af USING (series_id, cut) WHERE step BETWEEN 1 AND 26""")
def ar_ols(spark, sf):
    p = T.prices(spark, sf)
    return rounded(longs(K.autoregression(K.training(p, K.present(p), "W"), 26)))


# Least squares in SQL: Gauss-Jordan steps over the moments of rows z = [x..., y...] by key; out has the coefficients cf[x][y].
def _solve(out: str, rows: str, keys: str, p: str) -> str:
    """CTEs up to ``out`` (keys, p, n, cf, G: moments of z) from ``rows`` (keys, z, p: how many of z are x)."""
    return f"""{out}_c AS (SELECT {keys}, {p} AS p, a, b, sum(z[a]*z[b]) AS s FROM {rows}, LATERAL (SELECT unnest(range(1, len(z)+1)) AS a), LATERAL (SELECT unnest(range(1, len(z)+1)) AS b) GROUP BY ALL),
 {out}_g AS MATERIALIZED (SELECT {keys}, p, list(r ORDER BY a) AS G FROM (SELECT {keys}, p, a, list(s ORDER BY b) AS r FROM {out}_c GROUP BY ALL) GROUP BY ALL),
 {out}_n AS (SELECT {keys}, {p} AS p, count(*) AS n FROM {rows} GROUP BY ALL),
 {out}_s AS (SELECT {keys}, p, 0::BIGINT AS j, G[:p] AS M FROM {out}_g UNION ALL SELECT {keys}, p, j+1, list_transform(M, lambda r, i: CASE WHEN i = j+1 THEN list_transform(r, lambda v: v/M[j+1][j+1]) ELSE list_transform(r, lambda v, c: v - r[j+1]*(M[j+1][c]/M[j+1][j+1])) END) FROM {out}_s WHERE j < p),
 {out} AS MATERIALIZED (SELECT s.*, G, n FROM (SELECT {keys}, p, list_transform(M, lambda r: r[p+1:]) AS cf FROM {out}_s WHERE j = p) s JOIN {out}_g USING ({keys}, p) JOIN {out}_n USING ({keys}, p))"""


def _vectors(names, cuts: str, source: str, steps: int) -> str:
    """Vector autoregression and error correction of a panel at the cuts (cut, origin), up to vq (model, cut, step, level)."""
    k = len(names)
    wide = ", ".join(f"max(value) FILTER (series_id = '{n}')" for n in names)
    zero = f"list_transform(range({k}), lambda i: 0.0::DOUBLE)"
    minus = "list_transform({0}, lambda v, i: v - {1}[i])"
    return f"""pl AS MATERIALIZED (SELECT ts, [{wide}] AS l FROM {source} WHERE value IS NOT NULL GROUP BY ts HAVING count(*) = {k}),
 pd AS (SELECT ts, l, lag(l) OVER (ORDER BY ts) AS l1 FROM pl), pe AS (SELECT ts, l, l1, CASE WHEN l1 IS NOT NULL THEN {minus.format("l", "l1")} END AS c FROM pd),
 pz AS MATERIALIZED (SELECT ts, l, l1, c, lag(c, 1) OVER (ORDER BY ts) AS c1, lag(c, 2) OVER (ORDER BY ts) AS c2 FROM pe),
 vl AS (SELECT cut, [1.0::DOUBLE] || l[2:] || l[:1] AS z, {k}::BIGINT AS p FROM pl, {cuts} WHERE ts <= origin), {_solve("li", "vl", "cut", "p")},
 vw AS (SELECT cut, [1.0::DOUBLE] || list_transform(cf[2:], lambda r: -r[1]) AS w, -cf[1][1] AS w0 FROM li),
 vz AS (SELECT 'vector_autoregression' AS model, cut, [1.0::DOUBLE] || c1 || c2 || c AS z, {1 + 2 * k}::BIGINT AS p FROM pz, {cuts} WHERE ts <= origin AND c2 IS NOT NULL
  UNION ALL SELECT 'error_correction', cut, [1.0::DOUBLE] || c1 || c2 || [list_inner_product(l1, w) + w0] || c, {2 + 2 * k}::BIGINT FROM pz, {cuts} JOIN vw USING (cut) WHERE ts <= origin AND c2 IS NOT NULL), {_solve("vs", "vz", "model, cut", "p")},
 vf AS (SELECT model, cut, cf, n, l, c, c1, w, w0 FROM vs JOIN {cuts} USING (cut) JOIN vw USING (cut) JOIN pz ON ts = origin WHERE n >= CASE model WHEN 'error_correction' THEN 60 ELSE 40 END),
 vq AS (SELECT model, cut, 0::BIGINT AS step, l AS level, c AS d1, c1 AS d2 FROM vf UNION ALL
  SELECT model, cut, step+1, list_transform(level, lambda v, i: v + d[i]), d, d1 FROM (SELECT q.*, list_transform(range(1, {k + 1}), lambda q_: list_sum(list_transform(x, lambda v, a: v*cf[a][q_]))) AS d
   FROM (SELECT vq.*, cf, [1.0::DOUBLE] || d1 || d2 || CASE vq.model WHEN 'error_correction' THEN [list_inner_product(level, w) + w0] ELSE [] END AS x FROM vq JOIN vf USING (model, cut) WHERE step < {steps}) q)),
 vm AS (SELECT model, cut, step, names.i, names.s AS series_id, level[names.i] AS pred FROM vq, (SELECT unnest([{", ".join(f"'{n}'" for n in names)}]) AS s, unnest(range(1, {k + 1})) AS i) names WHERE step > 0)"""


# Autoregression with drivers for every (series_id, cut) of dw (ts, value, u: drivers), up to its path in dp.
def _driven(steps: int) -> str:
    minus = "list_transform({0}, lambda v, i: v - {1}[i])"
    return f"""da AS (SELECT series_id, cut, ts, value, value - lag(value) OVER {_KW} AS d, u, lag(u) OVER {_KW} AS u1 FROM dw), db AS (SELECT * EXCLUDE (u, u1), CASE WHEN u1 IS NOT NULL THEN {minus.format("u", "u1")} END AS x FROM da),
 dc AS MATERIALIZED (SELECT *, lag(d,1) OVER {_KW} AS x1, lag(d,2) OVER {_KW} AS x2, lag(d,3) OVER {_KW} AS x3, lag(d,4) OVER {_KW} AS x4 FROM db),
 dz AS (SELECT series_id, cut, q, [1.0::DOUBLE] || [x1, x2, x4][:q] || x || [d] AS z, 1+q+len(x) AS p FROM dc, (SELECT unnest([1,2,3]::BIGINT[]) AS q) WHERE x4 IS NOT NULL), {_solve("ds", "dz", "series_id, cut, q", "p")},
 dk AS (SELECT *, greatest(G[p+1][p+1] - list_sum(list_transform(cf, lambda r, i: r[1]*G[i][p+1])), 1e-300) AS sse FROM ds WHERE n >= 30),
 df AS MATERIALIZED (SELECT *, n*ln(sse/n)+2*p AS aic, sqrt(sse/(n-p)) AS sigma FROM dk QUALIFY row_number() OVER (PARTITION BY series_id, cut ORDER BY n*ln(sse/n)+2*p, q) = 1),
 dn AS (SELECT series_id, cut, arg_max(value, ts) AS lev, arg_max([x3, x2, x1, d], ts) AS ch FROM dc GROUP BY 1, 2),
 dp AS (SELECT series_id, cut, 0::BIGINT AS step, lev AS pred, ch FROM dn UNION ALL SELECT series_id, cut, step+1, pred + v, [ch[2], ch[3], ch[4], v] FROM (
  SELECT dp.*, cf[1][1] + cf[2][1]*ch[4] + CASE WHEN q > 1 THEN cf[3][1]*ch[3] ELSE 0 END + CASE WHEN q > 2 THEN cf[4][1]*ch[1] ELSE 0 END AS v FROM dp JOIN df USING (series_id, cut) WHERE step < {steps}))"""


# Nested lag sets up to the season for every (series_id, cut) of tw, up to their AIC in of and the path of the best in op.
def _seasonal(m: int, steps: int) -> str:
    return f"""oa AS (SELECT series_id, cut, ts, value, value - lag(value) OVER {_KW} AS d FROM tw), ob AS MATERIALIZED (SELECT *, lag(d,1) OVER {_KW} AS x1, lag(d,2) OVER {_KW} AS x2, lag(d,4) OVER {_KW} AS x4, lag(d,{m}) OVER {_KW} AS xm FROM oa),
 oz AS (SELECT series_id, cut, q, [1.0::DOUBLE] || [x1, x2, x4, xm][:q] || [d] AS z, 1+q AS p FROM ob, (SELECT unnest([1,2,3,4]::BIGINT[]) AS q) WHERE xm IS NOT NULL), {_solve("os", "oz", "series_id, cut, q", "p")},
 od AS (SELECT *, G[p+1][p+1] - list_sum(list_transform(cf, lambda r, i: r[1]*G[i][p+1])) AS sse FROM os WHERE n >= 30), oo AS (SELECT *, n*ln(sse/n)+2*p AS aic, sqrt(sse/(n-p)) AS sigma FROM od),
 of_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, cut ORDER BY aic, q) = 1 AS chosen FROM oo),
 oc AS (SELECT series_id, cut, arg_max(value, ts) AS lev, list(d ORDER BY ts) AS ch FROM ob WHERE d IS NOT NULL GROUP BY 1, 2),
 op AS (SELECT series_id, cut, 0::BIGINT AS step, lev AS pred, ch FROM oc UNION ALL SELECT series_id, cut, step+1, pred + v, ch || [v] FROM (SELECT op.*, list_sum(list_transform(cf, lambda r, i: r[1]*CASE i WHEN 1 THEN 1.0 WHEN 2 THEN ch[-1] WHEN 3 THEN ch[-2] WHEN 4 THEN ch[-4] ELSE ch[-{m}] END)) AS v
  FROM op JOIN of_ USING (series_id, cut) WHERE chosen AND step < {steps}))"""


@query("lag_orders", f"""WITH RECURSIVE {PRICE}, {_PRESENT}, {_seasonal(52, 1)} SELECT series_id, cut, array_to_string(([1,2,4,52]::BIGINT[])[:q], ',') AS lags, {r('aic')} AS aic, {r('sigma')} AS sigma, n, chosen FROM of_""")
def lag_orders(spark, sf):
    p = T.prices(spark, sf)
    out = K.lag_orders(K.training(p, K.present(p), "W"), 52)
    return rounded(longs(out.withColumn("lags", F.array_join(F.col("lags").cast("array<string>"), ","))))


@query("ar_seasonal", f"""WITH RECURSIVE {PRICE}, {_PRESENT}, {_seasonal(52, 26)} SELECT op.series_id, op.cut, step, {r('pred')} AS pred, ([1,2,4,52]::BIGINT[])[:q] AS lags_used, {r('aic')} AS aic, {r('sigma')} AS sigma FROM op JOIN of_ USING (series_id, cut) WHERE chosen AND step > 0""")
def ar_seasonal(spark, sf):
    p = T.prices(spark, sf)
    return rounded(longs(K.autoregression(K.training(p, K.present(p), "W"), 26, (*K.LAGS, 52))))


def _side(freq: str) -> str:
    label = {"W": "CAST(date_trunc('week', ts) AS DATE) + 6", "ME": "last_day(ts)"}[freq]
    return f"""sd AS (SELECT t AS ts, [a, d] AS u FROM (SELECT {label} AS t, sum(value) AS a FROM volume WHERE series_id = 'arrivals' GROUP BY 1) JOIN (SELECT {label} AS t, avg(value) AS d FROM driver GROUP BY 1) USING (t) WHERE a IS NOT NULL AND d IS NOT NULL)"""


def _drivers(spark, sf, freq: str):
    return S.resample(T.arrivals(spark, sf), freq, "sum").unionByName(S.resample(T.driver(spark, sf), freq))


DRIVER_NAMES = ["arrivals", "driver"]


@query("ar_ols_drivers", f"""WITH RECURSIVE {PRICE}, {VOLUME}, {DRIVER}, {_side("W")}, tw AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM price GROUP BY 1, 2),
 dw AS (SELECT series_id, -1::BIGINT AS cut, ts, value, u FROM tw JOIN sd USING (ts)), {_driven(26)} SELECT series_id, cut, step, {r('pred')} AS pred, ([1,2,4]::BIGINT[])[:q] AS lags_used, {r('aic')} AS aic, {r('sigma')} AS sigma FROM dp JOIN df USING (series_id, cut) WHERE step > 0""")
def ar_ols_drivers(spark, sf):
    p = T.prices(spark, sf)
    hist = K.history(K.with_drivers(S.resample(p, "W"), _drivers(spark, sf, "W"), DRIVER_NAMES), K.present(p).withColumn("origin", F.date_add("origin", 6)), DRIVER_NAMES)
    return rounded(longs(K.autoregression(hist, 26, drivers=len(DRIVER_NAMES))))


_MARKET_NOW = f"""WITH RECURSIVE {MARKET}, mw AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM market GROUP BY 1, 2),
 vc AS (SELECT -1::BIGINT AS cut, max(ts) AS origin FROM (SELECT ts FROM mw GROUP BY 1 HAVING count(*) = {len(T.MARKETS)})), {_vectors(T.MARKETS, "vc", "mw", 12)}"""


@query("var_ols", f"{_MARKET_NOW} SELECT series_id, origin, step, {r('pred')} AS point FROM vm, vc WHERE model = 'vector_autoregression'")
def var_ols(spark, sf):
    return rounded(longs(K.vector_autoregression(S.resample(T.market_prices(spark, sf), "W"), T.MARKETS, 12)))


@query("error_correction", f"{_MARKET_NOW} SELECT series_id, origin, step, {r('pred')} AS point FROM vm, vc WHERE model = 'error_correction'")
def error_correction(spark, sf):
    return rounded(longs(K.vector_autoregression(S.resample(T.market_prices(spark, sf), "W"), T.MARKETS, 12, correct=True)))


@query("vecm")
def vecm(spark, sf):
    """Markets with a correction term per relation of the trace test, or the reason why there is none."""
    return rounded(longs(K.cointegrated_forecast(S.resample(T.market_prices(spark, sf), "W"), T.MARKETS, 12)))


@query("cointegrating_vectors")
def cointegrating_vectors(spark, sf):
    return rounded(longs(regress.cointegrating_vectors(S.resample(T.market_prices(spark, sf), "W"), T.MARKETS)), 6)


_FOLD = f"""me AS (SELECT series_id, last_day(ts) AS ts, avg(value) AS value FROM price GROUP BY 1, 2), nm AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY series_id) AS n FROM me),
 us AS (SELECT *, least(5, greatest(0, floor((n-greatest(20, floor(n*0.5)))/6))) AS u, (n-i)/6.0 AS b FROM nm)"""


@query("folds", f"WITH {PRICE}, {_FOLD} SELECT series_id, CAST(u-b AS BIGINT) AS cut, ts AS origin, {r('value')} AS anchor FROM us WHERE b = floor(b) AND b BETWEEN 1 AND u AND i >= greatest(20, floor(n*0.5))")
def folds(spark, sf):
    return rounded(longs(K.folds(S.resample(T.prices(spark, sf), "ME"), 6)))


def _rolling(spark, sf):
    return K.rolling_backtest(S.resample(T.prices(spark, sf), "ME"), 6, "ME")


_ROLL = f"""WITH RECURSIVE {PRICE}, {_FOLD}, fo AS (SELECT series_id, CAST(u-b AS BIGINT) AS cut, ts AS origin, value AS anchor, i AS e FROM us WHERE b = floor(b) AND b BETWEEN 1 AND u AND i >= greatest(20, floor(n*0.5))),
 tw AS (SELECT m.series_id, fo.cut, m.ts, m.value FROM me m JOIN fo ON fo.series_id = m.series_id AND m.ts <= fo.origin), {_smooth(12)}, {_AR},
 ts AS (SELECT nm.series_id, fo.cut, fo.anchor, nm.i - fo.e AS step, nm.value AS actual FROM nm JOIN fo ON fo.series_id = nm.series_id WHERE nm.i - fo.e BETWEEN 1 AND 6),
 rb AS (SELECT ts.*, 'holt_winters' AS model, lev+step*tre+sea[(n+step-1)%12+1] AS pred FROM ts JOIN hb ON hb.series_id = ts.series_id AND hb.cut = ts.cut UNION ALL SELECT ts.*, 'autoregression', ap.pred FROM ts JOIN ap ON ap.series_id = ts.series_id AND ap.cut = ts.cut AND ap.step = ts.step)"""


@query("rolling_backtest", f"{_ROLL} SELECT series_id, cut, step, {r('anchor')} AS anchor, {r('actual')} AS actual, {r('pred')} AS pred, model FROM rb")
def rolling_backtest(spark, sf):
    return rounded(longs(_rolling(spark, sf)))


@query("rolling_metrics", f"""{_ROLL} SELECT series_id, model, {r('sqrt(avg(pow(actual-pred,2)))')} AS rmse, {r('avg(abs(actual-pred))')} AS mae, {r('avg(abs((actual-pred)/actual))*100')} AS mape, {r('1-sum(pow(actual-pred,2))/(var_pop(actual)*count(*))')} AS r2,
 {r('avg(CASE WHEN actual <> anchor THEN CASE WHEN sign(actual-anchor) = sign(pred-anchor) THEN 1.0 ELSE 0.0 END END)*100')} AS directional_accuracy, count(DISTINCT cut) AS folds, count(*) AS points FROM rb GROUP BY 1, 2""")
def rolling_metrics(spark, sf):
    return rounded(longs(K.pooled_metrics(_rolling(spark, sf))))


MODELS = ["holt_winters", "autoregression", "autoregression_drivers", *K.VECTOR_MODELS]


def _five(spark, sf):
    """Held-out steps of all five models over monthly prices, and what each model skipped."""
    p = landed(S.resample(T.prices(spark, sf), "ME"))
    drivers = landed(_drivers(spark, sf, "ME"))
    vectors, skipped = K.rolling_vectors(p, T.VARIETIES, 6)
    points = K.rolling_backtest(p, 6, "ME", drivers, DRIVER_NAMES).unionByName(vectors)
    return p, points, K.rolling_skips(p, 6, "ME", drivers, DRIVER_NAMES).unionByName(skipped)


_FIVE = f"""{_ROLL}, {VOLUME}, {DRIVER}, {_side("ME")}, dw AS (SELECT tw.series_id, cut, tw.ts, value, u FROM tw JOIN sd USING (ts)), {_driven(6)},
 pm AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM (SELECT ts FROM me GROUP BY ts HAVING count(*) = {len(T.VARIETIES)})), pu AS (SELECT *, least(5, greatest(0, floor((n-greatest(20, floor(n*0.5)))/6))) AS u, (n-i)/6.0 AS b FROM pm),
 vc AS MATERIALIZED (SELECT CAST(u-b AS BIGINT) AS cut, ts AS origin, i AS e FROM pu WHERE b = floor(b) AND b BETWEEN 1 AND u AND i >= greatest(20, floor(n*0.5))), {_vectors(T.VARIETIES, "vc", "me", 6)},
 vt AS (SELECT me.series_id, cut, a.value AS anchor, pm.i - e AS step, me.value AS actual FROM me JOIN pm USING (ts) JOIN vc ON pm.i - e BETWEEN 1 AND 6 JOIN me a ON a.series_id = me.series_id AND a.ts = origin),
 r5 AS (SELECT series_id, cut, anchor, step, actual, model, pred FROM rb UNION ALL SELECT ts.series_id, ts.cut, anchor, ts.step, actual, 'autoregression_drivers', dp.pred FROM ts JOIN dp ON dp.series_id = ts.series_id AND dp.cut = ts.cut AND dp.step = ts.step JOIN df ON df.series_id = ts.series_id AND df.cut = ts.cut
  UNION ALL SELECT vt.series_id, vt.cut, anchor, vt.step, actual, model, pred FROM vt JOIN vm ON vm.series_id = vt.series_id AND vm.cut = vt.cut AND vm.step = vt.step)"""


@query("rolling_five", f"{_FIVE} SELECT series_id, cut, step, {r('anchor')} AS anchor, {r('actual')} AS actual, {r('pred')} AS pred, model FROM r5")
def rolling_five(spark, sf):
    return rounded(longs(_five(spark, sf)[1]))


_ROLL_METRICS = f"""{_FIVE}, rm AS (SELECT series_id, model, sqrt(avg(pow(actual-pred,2))) AS rmse, avg(abs(actual-pred)) AS mae, avg(abs((actual-pred)/actual))*100 AS mape, 1-sum(pow(actual-pred,2))/(var_pop(actual)*count(*)) AS r2,
 avg(CASE WHEN actual <> anchor THEN CASE WHEN sign(actual-anchor) = sign(pred-anchor) THEN 1.0 ELSE 0.0 END END)*100 AS da, count(DISTINCT cut) AS folds, count(*) AS points FROM r5 GROUP BY 1, 2)"""


@query("scoreboard", f"""{_ROLL_METRICS}, op AS (SELECT s.series_id, m.model FROM (SELECT DISTINCT series_id FROM price) s, (SELECT unnest([{', '.join(f"'{m}'" for m in MODELS)}]) AS model) m),
 nf AS (SELECT series_id, cut, count(*) AS n FROM tw GROUP BY 1, 2), nd AS (SELECT series_id, cut, count(*) FILTER (u IS NOT NULL) AS n FROM tw LEFT JOIN sd USING (ts) GROUP BY 1, 2),
 nv AS (SELECT vc.cut, count(*) FILTER (c2 IS NOT NULL) AS n FROM vc JOIN pz ON ts <= origin GROUP BY 1),
 sk AS (SELECT series_id, 'holt_winters' AS model, cut, 'needs 24 periods, has ' || n AS reason FROM nf WHERE n < 24 UNION ALL SELECT series_id, 'autoregression', cut, 'needs 30 changes after lag 4, has ' || greatest(n-5, 0) FROM nf WHERE n-5 < 30
  UNION ALL SELECT series_id, 'autoregression_drivers', cut, 'needs 30 changes beside its drivers after lag 4, has ' || greatest(n-5, 0) FROM nd WHERE n-5 < 30
  UNION ALL SELECT s.series_id, m.model, cut, 'needs ' || need || ' complete rows of the panel, has ' || n FROM nv, (SELECT DISTINCT series_id FROM price) s, (VALUES ('vector_autoregression', 40), ('error_correction', 60)) m(model, need) WHERE n < need),
 sw AS (SELECT series_id, model, arg_max(reason, cut) AS why, count(*) AS k FROM sk GROUP BY 1, 2)
 SELECT op.series_id, op.model, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('mape')} AS mape, {r('r2')} AS r2, {r('da')} AS directional_accuracy, folds, points, coalesce(k, 0) AS skipped_folds, CASE WHEN rmse IS NOT NULL THEN row_number() OVER (PARTITION BY op.series_id ORDER BY rmse NULLS LAST, op.model) END AS rank,
 CASE WHEN rmse IS NULL THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN rmse IS NULL THEN why END AS reason FROM op LEFT JOIN rm ON rm.series_id = op.series_id AND rm.model = op.model LEFT JOIN sw ON sw.series_id = op.series_id AND sw.model = op.model""")
def scoreboard(spark, sf):
    p, points, skipped = _five(spark, sf)
    return rounded(longs(K.scoreboard(K.pooled_metrics(points), p, MODELS, skipped)))


_BANDS = f"""{_ROLL.replace("tw AS (SELECT m.series_id", "tw AS (SELECT series_id, -1::BIGINT AS cut, ts, value FROM me UNION ALL SELECT m.series_id")}, sr AS (SELECT series_id, step, sqrt(avg(pow(actual-pred,2))) AS rmse FROM rb WHERE model = 'holt_winters' GROUP BY 1, 2),
 sl AS (SELECT series_id, max(step) AS s, arg_max(rmse, step) AS q FROM sr GROUP BY 1), pb AS (SELECT hb.series_id, h AS step, lev+h*tre+sea[(n+h-1)%12+1] AS pred, sqrt(sse/(n-12)) AS sigma, sqrt(sse/(n-12))*sqrt(h) AS own FROM hb, (SELECT unnest(generate_series(1, 8)) AS h) WHERE hb.cut = -1),
 pc AS (SELECT pb.*, coalesce(sr.rmse, q*sqrt(pb.step::DOUBLE/s)) AS seen FROM pb LEFT JOIN sr ON sr.series_id = pb.series_id AND sr.step = pb.step LEFT JOIN sl ON sl.series_id = pb.series_id)"""


@query("prediction_bands", f"""{_BANDS} SELECT series_id, step, 'holt_winters' AS model, {r('pred')} AS pred, {r('sigma')} AS sigma, {r('pred-1.2815515655446004*own')} AS conf_lower, {r('pred+1.2815515655446004*own')} AS conf_upper, {r('pred-1.959963984540054*sqrt(own*own+seen*seen)')} AS pred_lower,
 {r('pred+1.959963984540054*sqrt(own*own+seen*seen)')} AS pred_upper FROM pc""")
def prediction_bands(spark, sf):
    p = S.resample(T.prices(spark, sf), "ME")
    path = K.holt_winters(K.training(p, K.present(p), "ME"), 12, 8).select("series_id", "step", "pred", "sigma").withColumn("model", F.lit("holt_winters"))
    return rounded(longs(K.bands(path, K.step_rmse(_rolling(spark, sf)))))


@query("future_periods", f"""WITH {PRICE}, l AS (SELECT series_id, max(ts) AS m FROM price GROUP BY 1), s AS (SELECT unnest(generate_series(1, 12)) AS step),
 h AS (SELECT series_id, step, date_trunc('month', m) + INTERVAL 1 MONTH * CAST(floor(((CASE WHEN day(m) <= 15 THEN 0 ELSE 1 END) + step)/2.0) AS INTEGER) AS mo, ((CASE WHEN day(m) <= 15 THEN 0 ELSE 1 END) + step) % 2 AS half FROM l, s)
 SELECT 'ME' AS freq, series_id, step, last_day(CAST(date_trunc('month', m) + INTERVAL 1 MONTH * step AS DATE)) AS ts FROM l, s UNION ALL SELECT 'W', series_id, step, CAST(date_trunc('week', m) AS DATE) + 6 + CAST(step*7 AS INTEGER) FROM l, s
 UNION ALL SELECT 'SME', series_id, step, CASE WHEN half = 0 THEN CAST(mo AS DATE) + 14 ELSE last_day(CAST(mo AS DATE)) END FROM h""")
def future_periods(spark, sf):
    p = T.prices(spark, sf)
    parts = [K.future_periods(p, f, 12).withColumn("freq", F.lit(f)) for f in ("ME", "W", "SME")]
    return longs(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_GAP = " + ".join(f"pow((x.{c}-o.{c})/(CASE WHEN s_{c}=0 THEN 1 ELSE s_{c} END),2)" for c in K.FEATURES)


@query("similar_periods", f"""WITH {PRICE}, {VOLUME}, {DRIVER}, {_FEATURES}, x AS (SELECT * FROM ft WHERE {' AND '.join(f'{c} IS NOT NULL' for c in K.FEATURES)}), e AS (SELECT series_id, max(ts) AS fin FROM price GROUP BY 1),
 sd AS (SELECT series_id, {', '.join(f'stddev_samp({c}) AS s_{c}' for c in K.FEATURES)} FROM x GROUP BY 1), o AS (SELECT x.*, fin FROM x JOIN e USING (series_id) WHERE ts BETWEEN fin - 10 AND fin QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) = 1),
 d AS (SELECT x.series_id, x.ts, o.ts AS used_ts, date_diff('day', o.ts, fin) AS days_back, x.price_lag_0 AS price_then, sqrt({_GAP}) AS distance FROM x JOIN o USING (series_id) JOIN sd USING (series_id) WHERE x.ts <= o.ts - 120 AND x.ts + 30 <= fin),
 oh AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY distance, ts) AS rank, CAST(ts + 30 AS DATE) AS t FROM d QUALIFY rank <= 3), n AS (SELECT *, {_near('oh.t', 2)} AS price_after FROM oh)
 SELECT series_id, ts, used_ts, days_back, {r('price_then')} AS price_then, {r('distance', 6)} AS distance, rank, {r('price_after')} AS price_after, {r('(price_after-price_then)/price_then*100')} AS change_pct FROM n WHERE price_after IS NOT NULL""")
def similar_periods(spark, sf):
    return rounded(longs(K.similar_periods(_features(spark, sf), T.prices(spark, sf), 30)), 4, distance=6)


@query("realised_accuracy", f"""WITH {PRICE}, {_ORIGINS}, {_NAIVE} SELECT series_id, 'seasonal_naive' AS model, CAST(horizon AS BIGINT) AS horizon, {r('sqrt(avg(pow(actual-pred,2)))')} AS rmse, {r('avg(abs(actual-pred))')} AS mae, {r('avg(abs((actual-pred)/actual))*100')} AS mape, count(*) AS n FROM nb GROUP BY 1, 3""")
def realised_accuracy(spark, sf):
    p = T.prices(spark, sf)
    return rounded(longs(K.realised_accuracy(K.realised(_log(p), p))))


def _log(p):
    made = K.seasonal_naive(p, K.with_horizons(K.origins(p))).where("pred is not null").withColumn("model", F.lit("seasonal_naive"))
    return K.log_rows(made.withColumnsRenamed({"origin": "as_of", "pred": "point"}), "r1")


@query("forecasts_pending", f"WITH {PRICE}, {_ORIGINS}, {_NAIVE} SELECT count(actual) AS scored, count(*) FILTER (actual IS NULL) AS pending FROM nv WHERE pred IS NOT NULL")
def forecasts_pending(spark, sf):
    p = T.prices(spark, sf)
    return K.pending(K.realised(_log(p), p))


@query("companions", f"""WITH {MARKET}, t AS (SELECT ts FROM market WHERE series_id='ASIA') SELECT series_id, count(*) AS shared, {r('count(*)*1.0/(SELECT count(*) FROM t)', 6)} AS coverage FROM market WHERE series_id <> 'ASIA' AND ts IN (SELECT ts FROM t)
 GROUP BY 1 HAVING count(*)*1.0/(SELECT count(*) FROM t) >= 0.6 ORDER BY coverage DESC, series_id LIMIT 3""")
def companions(spark, sf):
    return rounded(K.companions(T.market_prices(spark, sf), "ASIA"), 6)


_KEY = "list_filter([CASE WHEN trend <> 'neutral' THEN 'trend: ' || trend END, CASE WHEN momentum <> 'neutral' THEN 'momentum: ' || momentum END, CASE WHEN season <> 'neutral' THEN 'season: ' || season END, CASE WHEN arrivals <> 'neutral' THEN 'arrivals: ' || arrivals END, 'trend regime = ' || regime, printf('momentum over 30 = %.2f %%', roc_30)], lambda x: x IS NOT NULL)"


@query("key_drivers", SQL["score_votes"].replace("SELECT *, (CASE", "SELECT series_id, array_to_string(" + _KEY + ", '; ') AS statements, (CASE", 1).replace(", 4::BIGINT AS signals FROM s", ", 'ok' AS status FROM s JOIN (SELECT series_id, regime, roc_30 FROM pm) USING (series_id)") if "score_votes" in SQL else None)
def key_drivers(spark, sf):
    p = T.prices(spark, sf)
    module = X.price_module(p)
    out = K.key_drivers(Z.votes(module, M.same_month_comparison(p), X.arrival_module(T.volumes(spark, sf))), Z.variety_scores(module))
    return rounded(out.withColumn("statements", F.array_join("statements", "; ")))


@query("explanation")
def explanation(spark, sf):
    p = T.prices(spark, sf)
    drivers = S.resample(T.volumes(spark, sf), "W", "sum")
    fit = regress.driver_regression(S.resample(p, "W"), drivers, ["arrivals", "offtake"])
    return rounded(longs(K.explanation(K.forecast(p), M.variance_shares(M.decompose(p, "ME")), fit)))


_NOW = "tm AS (SELECT series_id, -1::BIGINT AS cut, 30::BIGINT AS horizon, max(ts) AS origin FROM price GROUP BY 1)"


@query("gbt_direct", f"WITH {PRICE}, {VOLUME}, {DRIVER}, {_FEATURES}, {_NOW}, {_trees()} SELECT series_id, cut, horizon, {r('pred')} AS pred, n AS rows FROM tp")
def gbt_direct(spark, sf):
    """Direct trees of every series at the present."""
    p = T.prices(spark, sf)
    return rounded(longs(K.boosted_trees(p, _features(spark, sf), K.present(p), (30,)).select("series_id", "cut", "horizon", "pred", "rows")))


_STRUCTURE = f"""nf AS (SELECT unnest([{', '.join(f"'{c}'" for c in K.FEATURES)}]) AS name, unnest(range(1, {len(K.FEATURES) + 1})) AS f),
 tq AS (SELECT m, name, gain, sum(gain) OVER (PARTITION BY m) AS whole, row_number() OVER (PARTITION BY m ORDER BY gain DESC, f) AS k FROM tg JOIN nf USING (f)),
 tt AS (SELECT m, string_agg(name || printf(' %.1f %%', 100*gain/whole), ', ' ORDER BY k) AS top FROM tq WHERE k <= 3 GROUP BY 1)"""


@query("model_notes", f"""WITH RECURSIVE {PRICE}, {_PRESENT}, {_SMOOTH}, {_AR}, {VOLUME}, {DRIVER}, {_FEATURES}, {_NOW}, {_trees()}, {_STRUCTURE}
 SELECT series_id, cut, 'holt_winters' AS model, printf('level weight %.2f, trend weight %.2f, season weight %.2f', a, b, g) AS structure FROM hb
 UNION ALL SELECT series_id, cut, 'autoregression', 'changes on lags ' || array_to_string(([1,2,4]::BIGINT[])[:p], ', ') || printf(', AIC %.1f', aic) FROM af
 UNION ALL SELECT series_id, cut, 'boosted_trees', printf('%d days ahead from %d rows: ', horizon, n) || top FROM tk JOIN tt USING (m)""")
def model_notes(spark, sf):
    p = T.prices(spark, sf)
    train = K.training(p, K.present(p), "W")
    return longs(K.model_notes(K.holt_winters(train, 52, 1), K.autoregression(train, 1), K.boosted_trees(p, _features(spark, sf), K.present(p), (30,))))
