"""Analysis modules and composite scores."""

from pyspark.sql import functions as F

from tidemark.operators import seasonal as M, series as S
from tidemark.plans import modules as X, scores as Z
from tidemark.registry.base import BALANCE, DRIVER, EXPORTS, MARKET, PAIRS, PRICE, SUPPLY, VOLUME, W, full, longs, query, r, rounded, student_sql
from tidemark.registry.pairs import market_pairs, supply_pairs
from tidemark.registry.seasons import _PL, _YOY, _monthly
from tidemark.sources import grids, tables as T

# Price module as CTEs up to pm.
PM = f"""pn AS (SELECT *, row_number() OVER {W} AS rn, -row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k, {full('avg', 'value', 7)} AS s7, {full('avg', 'value', 30)} AS s30,
   {full('avg', 'value', 90)} AS s90, ({full('stddev_samp', 'value', 30)}) / ({full('avg', 'value', 30)}) AS cv, (value - lag(value, 7) OVER {W}) / lag(value, 7) OVER {W} AS r7,
   (value - lag(value, 30) OVER {W}) / lag(value, 30) OVER {W} AS r30, (value - lag(value, 90) OVER {W}) / lag(value, 90) OVER {W} AS r90,
   max(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top, last_value(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastv FROM price),
 pt AS (SELECT series_id, regr_slope(value, k)/avg(value)*100 AS sl, regr_r2(value, k) AS r2 FROM pn WHERE k >= -90 GROUP BY 1),
 py AS (SELECT series_id, avg(CASE WHEN value <= lastv THEN 1.0 ELSE 0.0 END)*100 AS p1 FROM pn WHERE k >= -365 GROUP BY 1),
 pa AS (SELECT series_id, max(ts) AS as_of, arg_max(value, ts) AS latest, arg_max(s7, ts) s7, arg_max(s30, ts) s30, arg_max(s90, ts) s90, arg_max(cv, ts) cv, arg_max(r7, ts)*100 r7, arg_max(r30, ts)*100 r30, arg_max(r90, ts)*100 r90,
   min((value-top)/top)*100 AS dd, count(*) AS n, (pow(arg_max(value, ts)/arg_min(value, ts), 365.25/date_diff('day', min(ts), max(ts)))-1)*100 AS cagr, avg(CASE WHEN value <= lastv THEN 1.0 ELSE 0.0 END)*100 AS pall FROM pn GROUP BY 1),
 pm AS (SELECT pa.series_id, as_of, {r('latest', 2)} AS latest, {r('s7', 2)} AS sma_7, {r('s30', 2)} AS sma_30, {r('s90', 2)} AS sma_90, {r('cv', 2)} AS cv_30, {r('r7', 2)} AS roc_7, {r('r30', 2)} AS roc_30, {r('r90', 2)} AS roc_90,
   {r('dd', 2)} AS max_drawdown_pct, n AS observations, {r('cagr', 2)} AS cagr_pct, {r('sl', 4)} AS slope_pct, {r('r2', 3)} AS r_squared,
   CASE WHEN r2 >= 0.3 AND sl > 0.05 THEN 'uptrend' WHEN r2 >= 0.3 AND sl < -0.05 THEN 'downtrend' ELSE 'range_bound' END AS regime, {r('p1', 1)} AS percentile_1y, {r('pall', 1)} AS percentile_all FROM pa JOIN pt USING (series_id) JOIN py USING (series_id))"""
_PM_COLS = ["series_id", "as_of", "latest", "sma_7", "sma_30", "sma_90", "cv_30", "roc_7", "roc_30", "roc_90", "max_drawdown_pct", "observations", "cagr_pct", "slope_pct", "r_squared", "regime",
            "percentile_1y", "percentile_all"]
# Arrival module as CTEs up to am.
AM = f"""{_monthly('volume', 'sum')}, aw AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) AS ts, sum(value) AS v FROM volume WHERE value IS NOT NULL GROUP BY 1, 2),
 ag AS (SELECT series_id, arg_max(value, ts) AS lm, arg_max(y, ts) AS yoy, arg_max(mo, ts) AS mom FROM (SELECT *, (value/lag(value,12) OVER {W}-1)*100 AS y, (value/lag(value,1) OVER {W}-1)*100 AS mo FROM m) GROUP BY 1),
 ad AS (SELECT series_id, max(ts) FILTER (value IS NOT NULL) AS as_of, count(value) AS n, arg_max(value, ts) AS lv, arg_max(m30, ts) AS m30, arg_max(m90, ts) AS m90, arg_max(cv, ts) AS cv FROM (SELECT *, {full('avg','value',30)} AS m30, {full('avg','value',90)} AS m90,
   ({full('stddev_samp','value',30)})/({full('avg','value',30)}) AS cv FROM volume) GROUP BY 1), al AS (SELECT series_id, arg_max(v, ts) AS lw FROM aw GROUP BY 1),
 am AS (SELECT ad.series_id, as_of, n AS observations, {r('lv', 1)} AS latest_daily, {r('m30', 1)} AS mean_30, {r('m90', 1)} AS mean_90, {r('cv', 1)} AS cv_30, {r('lw', 1)} AS latest_weekly_total, {r('lm', 1)} AS latest_monthly_total, {r('yoy', 1)} AS yoy_pct, {r('mom', 1)} AS mom_pct
  FROM ad JOIN al USING (series_id) JOIN ag USING (series_id))"""


@query("mod_price", f"WITH {PRICE}, {PM} SELECT {', '.join(_PM_COLS)} FROM pm")
def mod_price(spark, sf):
    return X.price_module(T.prices(spark, sf)).select(*_PM_COLS)


@query("mod_arrival", f"WITH {VOLUME}, {AM} SELECT * FROM am")
def mod_arrival(spark, sf):
    return X.arrival_module(T.volumes(spark, sf))


_R = "covar_pop(x,y)/(stddev_pop(x)*stddev_pop(y))"
_RELATION = f"""rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1)/2.0 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1)/2.0 AS y FROM pr),
 c AS (SELECT a, b, {_R} AS r, count(*) AS n, regr_slope(ln(y), ln(x)) AS el, regr_r2(ln(y), ln(x)) AS e2 FROM pr GROUP BY 1, 2), q AS (SELECT a, b, {_R} AS rho FROM rk GROUP BY 1, 2),
 rl AS (SELECT a, b, arg_max(rr, ts) AS rr FROM (SELECT a, b, ts, CASE WHEN count(*) OVER w = WINDOW_N THEN covar_pop(x,y) OVER w/(stddev_pop(x) OVER w*stddev_pop(y) OVER w) END AS rr FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN WINDOW_N-1 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2),
 i AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts) AS rn FROM pr), g AS (SELECT unnest(generate_series(-LAG_N, LAG_N)) AS lag),
 cv AS (SELECT i.a, i.b, g.lag, covar_pop(i.x,j.y)/(stddev_pop(i.x)*stddev_pop(j.y)) AS r, count(*) AS n FROM i, g, i j WHERE j.a = i.a AND j.b = i.b AND j.rn = i.rn + g.lag GROUP BY 1, 2, 3 HAVING count(*) >= 30),
 bl AS (SELECT a, b, lag, r FROM cv QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, lag) = 1), t AS (SELECT *, r*sqrt(n-2)/sqrt(1-r*r) AS t, n-2 AS v FROM c)
 SELECT t.a, t.b, {r('t.r', 4)} AS r, {r(student_sql('t.t', 't.v'), 4)} AS p_value, n, 'ok' AS status, {r('rho', 4)} AS spearman_r, {r('rr', 4)} AS rolling_r, bl.lag AS best_lag, {r('bl.r', 4)} AS best_r, {r('el', 4)} AS elasticity, {r('e2', 3)} AS elasticity_r2
 FROM t JOIN q USING (a, b) JOIN rl USING (a, b) JOIN bl USING (a, b)"""


def _relation(window: int, lag: int) -> str:
    return _RELATION.replace("WINDOW_N", str(window)).replace("LAG_N", str(lag))


@query("mod_price_arrival", f"WITH {PRICE}, {VOLUME}, {SUPPLY}, {_relation(90, 30)}")
def mod_price_arrival(spark, sf):
    return longs(X.relation_module(supply_pairs(spark, sf)))


@query("mod_fx_vs_price", f"WITH {PRICE}, {DRIVER}, pr AS (SELECT 'driver' AS a, p.series_id AS b, p.ts, d.value AS x, p.value AS y FROM price p JOIN driver d ON p.ts = d.ts), {_relation(90, 30)}")
def mod_fx_vs_price(spark, sf):
    both = T.prices(spark, sf).unionByName(T.driver(spark, sf))
    return longs(X.relation_module(S.align(both, [("driver", v) for v in T.VARIETIES])))


@query("mod_export_vs_price", f"WITH {PRICE}, {EXPORTS}, {_monthly('price')}, pr AS (SELECT 'exports' AS a, m.series_id AS b, m.ts, e.value AS x, m.value AS y FROM m JOIN exports e ON m.ts = e.ts WHERE m.value IS NOT NULL), {_relation(24, 6)}")
def mod_export_vs_price(spark, sf):
    both = S.resample(T.prices(spark, sf), "MS").unionByName(T.exports(spark, sf))
    return longs(X.relation_module(S.align(both, [("exports", v) for v in T.VARIETIES]), 24, 6))


@query("mod_export", f"""WITH {EXPORTS}, g AS (SELECT *, (value/lag(value,12) OVER {W}-1)*100 AS y, (value/lag(value,1) OVER {W}-1)*100 AS m FROM exports)
 SELECT series_id, {r("(pow(arg_max(value, ts)/arg_min(value, ts), 365.25/date_diff('day', min(ts), max(ts)))-1)*100", 2)} AS cagr_pct, {r('arg_max(y, ts)', 2)} AS yoy_pct, {r('arg_max(m, ts)', 2)} AS mom_pct, 'ok' AS status, count(*) AS observations FROM g GROUP BY 1""")
def mod_export(spark, sf):
    return X.export_module(T.exports(spark, sf))


@query("mod_fx", f"""WITH RECURSIVE {DRIVER}, o AS (SELECT *, row_number() OVER {W} AS rn, {full('avg','value',30)} AS s30, {full('avg','value',90)} AS s90 FROM driver),
 e AS (SELECT rn, value AS e FROM o WHERE rn = 1 UNION ALL SELECT o.rn, e.e*(1-2.0::DOUBLE/31) + o.value*(2.0::DOUBLE/31) FROM e JOIN o ON o.rn = e.rn+1)
 SELECT series_id, max(ts) AS as_of, {r('arg_max(value, ts)')} AS latest, {r("(pow(arg_max(value, ts)/arg_min(value, ts), 365.25/date_diff('day', min(ts), max(ts)))-1)*100", 2)} AS cagr_pct, 'ok' AS status,
 {r('arg_max(s30, ts)')} AS sma_30, {r('arg_max(s90, ts)')} AS sma_90, {r('arg_max(e, ts)')} AS ema_30 FROM o JOIN e USING (rn) GROUP BY 1""")
def mod_fx(spark, sf):
    return X.rate_module(T.driver(spark, sf))


_ACT = "act AS (SELECT category AS series_id, make_date(CAST(year AS INTEGER),1,1) AS ts, value FROM balance WHERE NOT is_estimate)"


@query("mod_balance", f"""WITH {BALANCE}, {_ACT}, k AS (SELECT *, row_number() OVER {W} AS x, (value/lag(value) OVER {W}-1)*100 AS y FROM act),
 t AS (SELECT series_id, max(year(ts)) AS latest_year, arg_max(value, ts) AS lv, arg_max(y, ts) AS y, regr_slope(value, x)/avg(value)*100 AS sl, regr_r2(value, x) AS r2, count(*) AS n, (pow(arg_max(value, ts)/arg_min(value, ts), 365.25/date_diff('day', min(ts), max(ts)))-1)*100 AS cagr FROM k GROUP BY 1),
 e AS (SELECT category AS series_id, max(value) AS estimate FROM balance WHERE is_estimate GROUP BY 1)
 SELECT t.series_id, latest_year, {r('lv', 2)} AS latest_value, {r('estimate', 2)} AS estimate, CASE WHEN n >= 6 THEN {r('cagr', 2)} END AS cagr_pct, CASE WHEN n >= 6 THEN 'ok' ELSE 'insufficient_evidence' END AS cagr_status,
 {r('sl')} AS slope_pct, {r('r2', 3)} AS r_squared, CASE WHEN r2 >= 0.3 AND sl > 0.05 THEN 'uptrend' WHEN r2 >= 0.3 AND sl < -0.05 THEN 'downtrend' ELSE 'range_bound' END AS regime, {r('y', 2)} AS yoy_pct FROM t LEFT JOIN e USING (series_id)""")
def mod_balance(spark, sf):
    return longs(X.balance_module(T.balance(spark, sf)))


@query("balance_surplus", f"WITH {BALANCE}, {_ACT} SELECT s.ts, {r('s.value-d.value')} AS surplus FROM act s JOIN act d ON s.ts = d.ts AND s.series_id = 'Total Supply' AND d.series_id = 'Total Demand' WHERE d.value IS NOT NULL")
def balance_surplus(spark, sf):
    return rounded(X.surplus(T.balance(spark, sf)))


@query("balance_vs_price", f"""WITH {PRICE}, {BALANCE}, {_ACT}, y AS (SELECT series_id, CAST(date_trunc('year', ts) AS DATE) AS ts, avg(value) AS value FROM price GROUP BY 1, 2),
 c AS (SELECT act.series_id AS a, y.series_id AS b, covar_pop(act.value,y.value)/(stddev_pop(act.value)*stddev_pop(y.value)) AS r, count(*) AS n FROM act JOIN y ON act.ts = y.ts AND act.series_id IN ('Total Supply','Total Demand') GROUP BY 1, 2), t AS (SELECT *, r*sqrt(n-2)/sqrt(1-r*r) AS t, n-2 AS v FROM c)
 SELECT a, b, {r('r')} AS r, {r(student_sql('t','v'))} AS p_value, n, CASE WHEN n >= 6 THEN 'ok' ELSE 'insufficient_evidence' END AS status FROM t""")
def balance_vs_price(spark, sf):
    return rounded(X.balance_vs_price(T.balance(spark, sf), T.prices(spark, sf), ["Total Supply", "Total Demand"], T.VARIETIES).select("a", "b", "r", "p_value", "n", "status"))


@query("mod_cold", """WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, CASE WHEN l_linestatus='F' THEN 'north' ELSE 'south' END AS series_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
 SELECT series_id, round(arg_max(v, ts), 0) AS latest, max(ts) AS latest_ts, count(*) AS observations, 'insufficient_evidence_for_trend' AS status FROM m GROUP BY 1 UNION ALL SELECT 'east', NULL, NULL, 0, 'insufficient_evidence'""")
def mod_cold(spark, sf):
    from tidemark.functions.coerce import to_number
    from tidemark.operators import reshape
    from tidemark.registry.landing import STOCK
    from tidemark.sources.store import landed
    obs = reshape.parse_tracker(landed(grids.tracker_sheet(spark, sf)), STOCK).select(F.col("metric").alias("series_id"), "ts", to_number("raw").alias("value"))
    return X.storage_module(obs, ["north", "south", "east"])


@query("premium_profile", f"""WITH {MARKET}, {PAIRS} SELECT a, b, {r('quantile_cont(x-y, 0.5)')} AS median_premium, {r('avg(x-y)')} AS mean_premium, {r('min(x-y)')} AS min_premium, {r('max(x-y)')} AS max_premium, {r('avg(CASE WHEN x-y > 0 THEN 1.0 ELSE 0.0 END)')} AS share_positive, count(*) AS n FROM pr GROUP BY 1, 2""")
def premium_profile(spark, sf):
    return rounded(X.premium_profile(market_pairs(spark, sf)))


@query("exogenous_matrix", f"""WITH {VOLUME}, {DRIVER}, a AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(CASE WHEN series_id='arrivals' THEN value END) AS arrivals, avg(CASE WHEN series_id='offtake' THEN value END) AS offtake FROM volume GROUP BY 1),
 d AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS driver FROM driver GROUP BY 1) SELECT ts, {r('arrivals')} AS arrivals, {r('offtake')} AS offtake, {r('driver')} AS driver, CAST(NULL AS DOUBLE) AS exports FROM a FULL JOIN d USING (ts)""")
def exogenous_matrix(spark, sf):
    every = T.volumes(spark, sf).unionByName(T.driver(spark, sf)).unionByName(T.exports(spark, sf))
    return rounded(X.exogenous(every, "W", ["arrivals", "offtake", "driver", "exports"], monthly=("exports",)).drop("refused"))


@query("exogenous_candidates", f"""WITH {VOLUME}, {DRIVER}, {EXPORTS}, u AS (SELECT * FROM volume UNION ALL SELECT * FROM driver UNION ALL SELECT * FROM exports), w AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
 SELECT series_id, count(*) AS periods, min(ts) AS from_ts, max(ts) AS to_ts, CASE WHEN series_id = 'exports' THEN 'insufficient_evidence' ELSE 'ok' END AS status, CASE WHEN series_id = 'exports' THEN 'monthly source, not spread over shorter periods' END AS reason FROM w GROUP BY 1""")
def exogenous_candidates(spark, sf):
    every = T.volumes(spark, sf).unionByName(T.driver(spark, sf)).unionByName(T.exports(spark, sf))
    return X.exogenous_candidates(every, "W", ["arrivals", "offtake", "driver", "exports"], monthly=("exports",))


@query("component_rows", f"WITH {BALANCE} SELECT category, year, {r('value')} AS value, {r('avg(value) OVER (PARTITION BY category)')} AS line_mean, {r('value-avg(value) OVER (PARTITION BY category)')} AS vs_mean, is_estimate FROM balance WHERE category LIKE 'Total%'")
def component_rows(spark, sf):
    return rounded(longs(X.component_rows(T.balance(spark, sf), "^total")))


@query("supply_cards", f"""WITH {VOLUME}, {EXPORTS}, {BALANCE}, {_ACT}, arr AS (SELECT * FROM volume WHERE series_id='arrivals'), {_monthly('arr')}, {_YOY},
 e AS (SELECT *, (value/lag(value,12) OVER {W}-1)*100 AS y FROM exports), q AS (SELECT s.ts, (s.value-d.value)/d.value*100 AS q FROM act s JOIN act d ON s.ts = d.ts AND s.series_id='Total Supply' AND d.series_id='Total Demand' WHERE d.value IS NOT NULL)
 SELECT 'arrivals latest month' AS card, {r('value')} AS value, {r('hist')} AS reference FROM h WHERE k = 1 UNION ALL SELECT 'exports latest month, yoy %', {r('arg_max(value, ts)')}, {r('arg_max(y, ts)')} FROM e UNION ALL SELECT 'stock to use %', {r('arg_max(q, ts)')}, {r('avg(q)')} FROM q""")
def supply_cards(spark, sf):
    return rounded(X.supply_cards(T.volumes(spark, sf), T.exports(spark, sf), T.balance(spark, sf)))


# ---- scores -------------------------------------------------------------------------------------------------------

def _sc(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN (least(greatest({x},{lo}),{hi})-({lo}))/(({hi})-({lo}))*100 END)"


VS = f"""vp AS (SELECT *, CASE regime WHEN 'uptrend' THEN 100.0 WHEN 'range_bound' THEN 50.0 WHEN 'downtrend' THEN 0.0 END AS g, {_sc('roc_30', -20, 20)} AS mo, {_sc('cv_30', 0, 0.1)} AS vo, {_sc('abs(max_drawdown_pct)', 0, 80)} AS ds FROM pm),
 vs AS (SELECT series_id, regime, roc_30, {r('(g+mo+percentile_1y)/3', 1)} AS market_strength, 3::BIGINT AS strength_parts, {r('100-vo', 1)} AS stability, {r('(vo+ds)/2', 1)} AS risk, {r('(100+least(observations/100.0,1)*100)/2', 1)} AS confidence FROM vp)"""


@query("score_variety", f"WITH {PRICE}, {PM}, {VS} SELECT * FROM vs")
def score_variety(spark, sf):
    return Z.variety_scores(X.price_module(T.prices(spark, sf)))


@query("score_votes", f"""WITH {PRICE}, {VOLUME}, {PM}, {AM}, {_monthly('price', 'avg', 'mp')}, h AS (SELECT *, avg(value) OVER (PARTITION BY series_id, month(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM mp),
 dv AS (SELECT series_id, (arg_max(value, ts)-arg_max(hist, ts))/arg_max(hist, ts)*100 AS d FROM h GROUP BY 1),
 s AS (SELECT pm.series_id, CASE regime WHEN 'uptrend' THEN 'bullish' WHEN 'downtrend' THEN 'bearish' ELSE 'neutral' END AS trend, CASE WHEN roc_30 > 2 THEN 'bullish' WHEN roc_30 < -2 THEN 'bearish' ELSE 'neutral' END AS momentum,
  CASE WHEN d > 5 THEN 'bullish' WHEN d < -5 THEN 'bearish' ELSE 'neutral' END AS season, (SELECT CASE WHEN yoy_pct < 0 THEN 'bullish' WHEN yoy_pct > 0 THEN 'bearish' ELSE 'neutral' END FROM am WHERE series_id='arrivals') AS arrivals FROM pm JOIN dv USING (series_id))
 SELECT *, {r("(CAST(trend='bullish' AS INT)+CAST(momentum='bullish' AS INT)+CAST(season='bullish' AS INT)+CAST(arrivals='bullish' AS INT))/4.0*100", 1)} AS bullish, {r("(CAST(trend='bearish' AS INT)+CAST(momentum='bearish' AS INT)+CAST(season='bearish' AS INT)+CAST(arrivals='bearish' AS INT))/4.0*100", 1)} AS bearish, 4::BIGINT AS signals FROM s""")
def score_votes(spark, sf):
    p = T.prices(spark, sf)
    return Z.votes(X.price_module(p), M.same_month_comparison(p), X.arrival_module(T.volumes(spark, sf)))


MS = f"""{_PL}, su AS (SELECT {r('arg_max(s.value-d.value, s.ts)', 2)} AS surplus FROM act s JOIN act d ON s.ts = d.ts AND s.series_id='Total Supply' AND d.series_id='Total Demand' WHERE d.value IS NOT NULL),
 mk AS (SELECT a.yoy_pct, a.mean_30, a.mean_90, {r('pl.mt', 0)} AS norm, pl.rank, o.yoy_pct AS oy, o.mom_pct AS om, surplus FROM am a JOIN am o ON a.series_id='arrivals' AND o.series_id='offtake' JOIN pl ON pl.series_id='arrivals' AND pl.month = month(a.as_of), su),
 ms AS (SELECT 'all' AS market, {r(f"({_sc('yoy_pct', -50, 50)}+{_sc('mean_30*30/norm', 0.5, 1.5)}+{_sc('surplus', -5, 5)})/3", 1)} AS supply_pressure, 3::BIGINT AS supply_parts,
  {r(f"((CASE WHEN rank <= 3 THEN 80.0 WHEN rank > 9 THEN 20.0 ELSE 50.0 END)+{_sc('mean_30/mean_90', 0.5, 1.5)})/2", 1)} AS arrival_pressure, CASE WHEN oy IS NULL AND om IS NULL THEN NULL ELSE {r(f"(coalesce({_sc('oy', -50, 50)},0)+coalesce({_sc('om', -20, 20)},0))/(CAST(oy IS NOT NULL AS INT)+CAST(om IS NOT NULL AS INT))", 1)} END AS demand FROM mk)"""


@query("score_market", f"WITH {VOLUME}, {BALANCE}, {_ACT}, {AM}, {MS} SELECT * FROM ms")
def score_market(spark, sf):
    v = T.volumes(spark, sf)
    return Z.market_scores(X.arrival_module(v), M.peak_lean(v), X.surplus(T.balance(spark, sf)))


@query("score_composite", f"WITH {PRICE}, {VOLUME}, {BALANCE}, {_ACT}, {PM}, {VS}, {AM}, {MS} SELECT series_id, {r('0.4*market_strength+0.3*(100-supply_pressure)+0.2*demand+0.1*stability', 1)} AS composite, 4::BIGINT AS parts_used, false AS weights_renormalised FROM vs, ms")
def score_composite(spark, sf):
    v = T.volumes(spark, sf)
    market = Z.market_scores(X.arrival_module(v), M.peak_lean(v), X.surplus(T.balance(spark, sf)))
    return Z.composite(Z.variety_scores(X.price_module(T.prices(spark, sf))), market)


def _cl(x: str) -> str:
    return f"least(greatest({x},-1.0),1.0)"


@query("sentiment", f"""WITH {PRICE}, {VOLUME}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY series_id) AS n, max(ts) OVER (PARTITION BY series_id) AS l FROM price),
 f AS (SELECT series_id, max(l) AS as_of, arg_max(value, ts) AS v, avg(value) FILTER (k <= least(180, greatest(30, n // 3))) AS ma, min(value) FILTER (ts >= l - INTERVAL 12 MONTH) AS lo, max(value) FILTER (ts >= l - INTERVAL 12 MONTH) AS hi FROM k GROUP BY 1),
 me AS (SELECT series_id, last_day(ts) AS ts, avg(value) AS value FROM price GROUP BY 1, 2), mc AS (SELECT *, value/lag(value) OVER {W}-1 AS c FROM me), mv AS (SELECT series_id, arg_max(c, ts) AS rc, quantile_cont(abs(c), 0.5) AS ty FROM mc GROUP BY 1),
 vm AS (SELECT last_day(ts) AS ts, sum(value) AS value FROM volume WHERE series_id='arrivals' GROUP BY 1), sm AS (SELECT arg_max(value, ts) AS rv, avg(value) FILTER (ts < (SELECT max(ts) FROM vm)) AS norm FROM vm WHERE month(ts) = (SELECT month(max(ts)) FROM vm)),
 ov AS (SELECT series_id, avg(value) AS o FROM me GROUP BY 1), si AS (SELECT me.series_id, month(ts) AS month, avg(value)/max(o) AS ix FROM me JOIN ov USING (series_id) GROUP BY 1, 2),
 s AS (SELECT f.series_id, as_of, {_cl('(v-ma)/ma/0.15')} AS a, {_cl('rc/(3*ty)')} AS b, {_cl('((v-lo)/(hi-lo)-0.5)*2')} AS c, {_cl('-((rv-norm)/norm)/0.4')} AS d, {_cl('(ix-1)/0.1')} AS e FROM f JOIN mv USING (series_id) JOIN si ON si.series_id = f.series_id AND si.month = month(as_of + INTERVAL 1 MONTH), sm)
 SELECT series_id, as_of, {r('a', 6)} AS trend, {r('b', 6)} AS momentum, {r('c', 6)} AS range_position, {r('d', 6)} AS arrivals_pressure, {r('e', 6)} AS season_ahead, {r('(a+b+c+d+e)/5', 6)} AS score, 5::BIGINT AS parts_used,
  CASE WHEN (a+b+c+d+e)/5 >= 0.45 THEN 'Strongly bullish' WHEN (a+b+c+d+e)/5 >= 0.15 THEN 'Mildly bullish' WHEN (a+b+c+d+e)/5 > -0.15 THEN 'Neutral' WHEN (a+b+c+d+e)/5 > -0.45 THEN 'Mildly bearish' ELSE 'Strongly bearish' END AS label FROM s""")
def sentiment(spark, sf):
    return rounded(Z.sentiment(T.prices(spark, sf), T.volumes(spark, sf)), 6)
