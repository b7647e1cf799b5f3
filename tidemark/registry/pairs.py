"""Correlation, lead-lag, elasticity, thresholds, spreads."""



from tidemark.operators import series as S, stats
from tidemark.registry.base import MARKET, P, PAIRS, PRICE, SUPPLY, VOLUME, full, longs, query, r, rounded, student_sql
from tidemark.sources import tables as T


def market_pairs(spark, sf):
    return S.align(T.market_prices(spark, sf), S.all_pairs(T.MARKETS))


def supply_pairs(spark, sf):
    """Arrivals (x) against the price of every variety (y)."""
    return S.align(T.prices(spark, sf).unionByName(T.arrivals(spark, sf)), [("arrivals", v) for v in T.VARIETIES])


def weekly_supply_pairs(spark, sf):
    both = S.resample(T.prices(spark, sf), "W").unionByName(S.resample(T.arrivals(spark, sf), "W", "sum"))
    return S.align(both, [("arrivals", v) for v in T.VARIETIES])


WEEKLY = """wp AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM price GROUP BY 1, 2),
 wv AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, sum(value) AS value FROM volume WHERE series_id='arrivals' GROUP BY 1),
 pr AS (SELECT 'arrivals' AS a, wp.series_id AS b, wp.ts, wv.value AS x, wp.value AS y FROM wp JOIN wv ON wp.ts = wv.ts)"""
_R = "covar_pop(x,y)/(stddev_pop(x)*stddev_pop(y))"


def _pearson_sql(rows: str) -> str:
    return f"""c AS (SELECT a, b, {_R} AS r, count(*) AS n FROM {rows} GROUP BY 1, 2), s AS (SELECT *, r*sqrt(n-2)/sqrt(1-r*r) AS t, n-2 AS v FROM c)
 SELECT a, b, {r('r', 6)} AS r, {r('t')} AS t, {r(student_sql('t', 'v'), 6)} AS p_value, {r('r*r', 6)} AS r_squared, n, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM s"""


@query("pearson_pairs", f"WITH {MARKET}, {PAIRS}, {_pearson_sql('pr')}")
def pearson_pairs(spark, sf):
    return rounded(stats.pearson(market_pairs(spark, sf)), 6, t=4)


_RANKED = """rk AS (SELECT a, b, ts, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1)/2.0 AS x,
 rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1)/2.0 AS y FROM pr)"""


@query("spearman_pairs", f"WITH {PRICE}, {VOLUME}, {SUPPLY}, {_RANKED}, {_pearson_sql('rk')}")
def spearman_pairs(spark, sf):
    return rounded(stats.spearman(supply_pairs(spark, sf)), 6, t=4)


@query("pair_summary", f"""WITH {PRICE}, {VOLUME}, {SUPPLY}, {_RANKED}, c AS (SELECT a, b, {_R} AS r, count(*) AS n FROM pr GROUP BY 1, 2), q AS (SELECT a, b, {_R} AS rho FROM rk GROUP BY 1, 2),
 s AS (SELECT *, r*sqrt(n-2)/sqrt(1-r*r) AS t, rho*sqrt(n-2)/sqrt(1-rho*rho) AS u, n-2 AS v FROM c JOIN q USING (a, b))
 SELECT a, b, {r('r', 6)} AS pearson_r, {r(student_sql('t', 'v'), 6)} AS pearson_p, {r('r*r', 6)} AS r_squared, n,
  CASE WHEN abs(r)>=0.9 THEN 'very strong' WHEN abs(r)>=0.7 THEN 'strong' WHEN abs(r)>=0.5 THEN 'moderate' WHEN abs(r)>=0.3 THEN 'weak' ELSE 'negligible' END AS strength,
  {r('rho', 6)} AS spearman_rho, {r(student_sql('u', 'v'), 6)} AS spearman_p FROM s""")
def pair_summary(spark, sf):
    return rounded(stats.pair_summary(supply_pairs(spark, sf)), 6)


@query("correlation_matrix", f"WITH {MARKET}, {PAIRS}, c AS (SELECT a, b, {_R} AS r FROM pr GROUP BY 1, 2), m AS (SELECT a, b, r FROM c UNION ALL SELECT b, a, r FROM c UNION ALL SELECT r_name, r_name, 1.0 FROM region) SELECT a, "
       + ", ".join(f"{r(f'max(CASE WHEN b={chr(39)}{m}{chr(39)} THEN r END)', 6)} AS \"{m}\"" for m in T.MARKETS) + " FROM m GROUP BY a")
def correlation_matrix(spark, sf):
    p = stats.pearson(market_pairs(spark, sf)).select("a", "b", "r")
    return rounded(stats.symmetric_matrix(p, "r", T.MARKETS), 6)


@query("rolling_corr", f"WITH {MARKET}, {PAIRS} SELECT a, b, ts, {r('CASE WHEN count(*) OVER w = 90 THEN covar_pop(x,y) OVER w/(stddev_pop(x) OVER w*stddev_pop(y) OVER w) END', 6)} AS r FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)")
def rolling_corr(spark, sf):
    return rounded(stats.rolling_corr(market_pairs(spark, sf), 90).select("a", "b", "ts", "r"), 6)


_CURVE = f"""i AS (SELECT *, row_number() OVER {P} AS rn FROM pr), g AS (SELECT unnest(generate_series(-30, 30)) AS lag),
 cv AS (SELECT i.a, i.b, g.lag, covar_pop(i.x,j.y)/(stddev_pop(i.x)*stddev_pop(j.y)) AS r, count(*) AS n FROM i, g, i j WHERE j.a = i.a AND j.b = i.b AND j.rn = i.rn + g.lag GROUP BY 1, 2, 3)"""


@query("lag_correlogram", f"WITH {PRICE}, {VOLUME}, {SUPPLY}, {_CURVE} SELECT a, b, lag, {r('r', 6)} AS r, n FROM cv WHERE n >= 30")
def lag_correlogram(spark, sf):
    return rounded(longs(stats.correlogram(supply_pairs(spark, sf), 30)), 6)


@query("best_lag", f"WITH {PRICE}, {VOLUME}, {SUPPLY}, {_CURVE} SELECT a, b, lag AS best_lag, {r('r', 6)} AS best_r FROM cv WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, lag) = 1")
def best_lag(spark, sf):
    return rounded(longs(stats.best_lag(stats.correlogram(supply_pairs(spark, sf), 30))), 6)


_CCF = f"""df AS (SELECT a, b, ts, x - lag(x) OVER {P} AS x, y - lag(y) OVER {P} AS y FROM pr), i AS (SELECT *, row_number() OVER {P} AS rn, date_diff('day', lag(ts) OVER {P}, ts) AS g FROM df WHERE x IS NOT NULL),
 sp AS (SELECT a, b, quantile_cont(g, 0.5) AS days_per_lag FROM i GROUP BY 1, 2), g AS (SELECT unnest(generate_series(-20, 20)) AS lag),
 tn AS (SELECT a, b, count(*) AS total FROM i GROUP BY 1, 2),
 cu AS (SELECT i.a, i.b, g.lag, covar_pop(i.x,j.y)/(stddev_pop(i.x)*stddev_pop(j.y)) AS r, count(*) AS n FROM i, g, i j WHERE j.a = i.a AND j.b = i.b AND j.rn = i.rn + g.lag GROUP BY 1, 2, 3),
 cv AS (SELECT cu.* FROM cu JOIN tn USING (a, b) WHERE total >= 30 AND n >= 10 AND NOT isnan(r) AND abs(lag) <= CASE WHEN total < 60 THEN greatest(1, least(20, total // 4)) ELSE 20 END)"""


@query("ccf_diff", f"WITH {MARKET}, {PAIRS}, {_CCF} SELECT a, b, lag, {r('r', 6)} AS r, n, {r('1.96/sqrt(n)', 6)} AS band, abs(r) > 1.96/sqrt(n) AS significant, {r('days_per_lag')} AS days_per_lag FROM cv JOIN sp USING (a, b)")
def ccf_diff(spark, sf):
    return rounded(longs(stats.cross_correlation(market_pairs(spark, sf), 20)), 6, days_per_lag=4)


@query("lead_lag", f"""WITH {MARKET}, {PAIRS}, {_CCF}, z AS (SELECT a, b, r AS zero FROM cv WHERE lag = 0), k AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, lag) = 1)
 SELECT a, b, lag AS peak_lag, {r('lag*days_per_lag')} AS peak_days, {r('r', 6)} AS peak_r, {r('zero', 6)} AS zero_lag_r, abs(r) > 1.96/sqrt(n) AS significant, n,
  CASE WHEN lag > 0 THEN a WHEN lag < 0 THEN b ELSE 'contemporaneous' END AS leader FROM k JOIN sp USING (a, b) JOIN z USING (a, b)""")
def lead_lag(spark, sf):
    out = stats.lead_lag(stats.cross_correlation(market_pairs(spark, sf), 20)).drop("sentence")
    return rounded(longs(out), 6, peak_days=4)


@query("trend", f"""WITH {PRICE}, k AS (SELECT *, -row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS x FROM price), t AS (SELECT series_id, regr_slope(value, x)/avg(value)*100 AS s, regr_r2(value, x) AS r2, count(*) AS n FROM k WHERE x >= -90 GROUP BY 1)
 SELECT series_id, {r('s', 6)} AS slope_pct, {r('r2', 6)} AS r_squared, CASE WHEN r2 >= 0.3 AND s > 0.05 THEN 'uptrend' WHEN r2 >= 0.3 AND s < -0.05 THEN 'downtrend' ELSE 'range_bound' END AS regime,
 'ok' AS status, CAST(NULL AS VARCHAR) AS reason, n AS available_n, CAST(10 AS BIGINT) AS required_n FROM t""")
def trend(spark, sf):
    return rounded(stats.trend(T.prices(spark, sf), 90), 6)


@query("elasticity", f"""WITH {PRICE}, {VOLUME}, {SUPPLY}, l AS (SELECT a, b, ln(x) AS lx, ln(y) AS ly FROM pr WHERE x > 0 AND y > 0)
 SELECT a, b, {r('regr_slope(ly,lx)', 6)} AS elasticity, {r('regr_r2(ly,lx)', 6)} AS r_squared, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason, count(*) AS available_n, CAST(30 AS BIGINT) AS required_n FROM l GROUP BY 1, 2""")
def elasticity(spark, sf):
    return rounded(stats.log_elasticity(supply_pairs(spark, sf)), 6)


def _lagged_sql(dx: str, dy: str, lags: int, extra: str = "") -> str:
    return f"""ch AS (SELECT a, b, row_number() OVER {P} AS rn, {dx} AS dx, {dy} AS dy FROM pr {extra}), lg AS (SELECT c.a, c.b, g.lag, c.dy AS y, d.dx AS x
  FROM ch c, (SELECT unnest(generate_series(0, {lags})) AS lag) g, ch d WHERE d.a = c.a AND d.b = c.b AND d.rn = c.rn - g.lag AND c.dy IS NOT NULL AND d.dx IS NOT NULL)"""


@query("elasticity_lags", f"""WITH {PRICE}, {VOLUME}, {WEEKLY}, {_lagged_sql(f'ln(x)-lag(ln(x)) OVER {P}', f'ln(y)-lag(ln(y)) OVER {P}', 4)},
 m AS (SELECT a, b, lag, regr_slope(y,x) AS slope, regr_sxx(y,x) AS sxx, regr_sxy(y,x) AS sxy, regr_syy(y,x) AS syy, count(*) AS n FROM lg GROUP BY 1,2,3),
 e AS (SELECT *, sqrt((syy-sxy*sxy/sxx)/((n-2)*sxx)) AS se, n-2 AS v FROM m), t AS (SELECT *, slope/se AS t FROM e)
 SELECT a, b, lag, {r('slope', 6)} AS slope, {r('se', 6)} AS se, {r('t')} AS t, {r(student_sql('t','v'), 6)} AS p_value, {r('sxy*sxy/(sxx*syy)', 6)} AS r_squared, n, {student_sql('t','v')} < 0.05 AS significant FROM t""")
def elasticity_lags(spark, sf):
    return rounded(longs(stats.elasticity_by_lag(weekly_supply_pairs(spark, sf))), 6, t=4)


@query("lagged_impact", f"""WITH {PRICE}, {VOLUME}, {WEEKLY}, {_lagged_sql(f'(x-lag(x) OVER {P})/lag(x) OVER {P}', f'(y-lag(y) OVER {P})/lag(y) OVER {P}', 8)},
 c AS (SELECT a, b, lag, {_R} AS r, count(*) AS n FROM lg GROUP BY 1,2,3), t AS (SELECT *, r*sqrt(n-2)/sqrt(1-r*r) AS t, n-2 AS v FROM c)
 SELECT a, b, lag, {r('r', 6)} AS r, {r('t')} AS t, {r(student_sql('t','v'), 6)} AS p_value, n, {student_sql('t','v')} < 0.05 AS significant FROM t""")
def lagged_impact(spark, sf):
    return rounded(longs(stats.lagged_impact(weekly_supply_pairs(spark, sf))), 6, t=4)


_BUCKET = f"""ch AS (SELECT a, b, ts, x, y, (y-lag(y) OVER {P})/lag(y) OVER {P} AS s, (lead(y) OVER {P}-y)/y AS nx FROM pr),
 ed AS (SELECT a, b, list_distinct(quantile_cont(x, [0.0,0.2,0.4,0.6,0.8,1.0])) AS e FROM pr GROUP BY 1, 2), bk AS (SELECT ch.*, greatest(1, len(list_filter(e, lambda q: q < x))) AS bucket, len(e)-1 AS nb FROM ch JOIN ed USING (a, b))"""


@query("thresholds", f"""WITH {PRICE}, {VOLUME}, {WEEKLY}, {_BUCKET} SELECT a, b, bucket, {r('min(x)')} AS from_x, {r('max(x)')} AS to_x, {r('avg(x)')} AS mean_x, {r('avg(y)')} AS mean_y, {r('quantile_cont(y,0.5)')} AS median_y,
 {r('avg(s)*100')} AS same_change_pct, {r('avg(nx)*100')} AS next_change_pct, {r('avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END)*100')} AS fall_share_pct, count(*) AS n FROM bk GROUP BY 1,2,3""")
def thresholds(spark, sf):
    return rounded(longs(stats.thresholds(weekly_supply_pairs(spark, sf))))


@query("threshold_test", f"""WITH {PRICE}, {VOLUME}, {WEEKLY}, {_BUCKET}, w AS (SELECT a, b, count(nx) FILTER (bucket=nb) AS n1, avg(nx) FILTER (bucket=nb) AS m1, var_samp(nx) FILTER (bucket=nb) AS v1, count(nx) FILTER (bucket=1) AS n2, avg(nx) FILTER (bucket=1) AS m2, var_samp(nx) FILTER (bucket=1) AS v2, min(x) FILTER (bucket=nb) AS level FROM bk GROUP BY 1,2),
 t AS (SELECT *, (m1-m2)/sqrt(v1/n1+v2/n2) AS t, pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)) AS dof FROM w)
 SELECT a, b, {r('level')} AS level, {r('t')} AS t, {r('dof')} AS dof, {r(student_sql('t','dof'), 6)} AS p_value, n1 AS n_top, n2 AS n_low FROM t""")
def threshold_test(spark, sf):
    return rounded(stats.threshold_test(weekly_supply_pairs(spark, sf)), 4, p_value=6)


@query("pair_spread", f"""WITH {MARKET}, {PAIRS}, s AS (SELECT *, x-y AS spread FROM pr), w AS (SELECT *, spread/y*100 AS prem, CASE WHEN count(*) OVER f = 90 THEN avg(spread) OVER f END AS av, CASE WHEN count(*) OVER f = 90 THEN (spread-avg(spread) OVER f)/stddev_samp(spread) OVER f END AS z,
  -row_number() OVER (PARTITION BY a, b ORDER BY ts DESC) AS k FROM s WINDOW f AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
 t AS (SELECT a, b, regr_slope(abs(spread), k)/avg(abs(spread))*100 AS sl, regr_r2(abs(spread), k) AS r2 FROM w WHERE k >= -90 GROUP BY 1, 2), l AS (SELECT a, b, arg_max(spread, ts) sp, arg_max(prem, ts) prem, arg_max(av, ts) av, arg_max(z, ts) z, count(*) n FROM w GROUP BY 1, 2)
 SELECT a, b, {r('sp')} AS spread, {r('prem')} AS premium_pct, {r('av')} AS avg_spread, {r('z')} AS z, {r('sl')} AS slope_pct, {r('r2')} AS r_squared,
  CASE WHEN r2 >= 0.3 AND sl > 0.05 THEN 'diverging' WHEN r2 >= 0.3 AND sl < -0.05 THEN 'converging' ELSE 'stable' END AS convergence, coalesce(abs(z) > 2, false) AS anomaly, n, 'ok' AS status FROM l JOIN t USING (a, b)""")
def pair_spread(spark, sf):
    return rounded(stats.pair_spread(market_pairs(spark, sf)))


@query("benchmark_ratio", f"""WITH {PRICE}, pr AS (SELECT p.series_id AS a, q.series_id AS b, p.ts, p.value AS x, q.value AS y FROM price p JOIN price q ON p.ts = q.ts AND q.series_id = '1-URGENT' AND p.series_id <> '1-URGENT'),
 m AS (SELECT *, x/y AS ratio, x-y AS spread FROM pr), w AS (SELECT *, {full('stddev_samp','spread',30,'a, b')} AS sd, ({full('stddev_samp','ratio',30,'a, b')})/({full('avg','ratio',30,'a, b')}) AS cv,
  (ratio-lag(ratio,30) OVER {P})/lag(ratio,30) OVER {P}*100 AS r30, (ratio-lag(ratio,90) OVER {P})/lag(ratio,90) OVER {P}*100 AS r90, first_value(ratio) OVER (PARTITION BY a, b ORDER BY ts DESC) AS lastr FROM m)
 SELECT a, b, {r('arg_max(ratio,ts)')} AS ratio, {r('arg_max(spread/y*100,ts)')} AS premium_pct, {r('arg_max(spread,ts)')} AS spread, {r('arg_max(sd,ts)')} AS spread_sd_30, {r('arg_max(cv,ts)')} AS ratio_cv_30,
  {r('arg_max(r30,ts)')} AS ratio_roc_30, {r('arg_max(r90,ts)')} AS ratio_roc_90, {r(_R)} AS r, {r('avg(CASE WHEN ratio <= lastr THEN 1.0 ELSE 0.0 END)*100')} AS ratio_percentile, count(*) AS n, 'ok' AS status FROM w GROUP BY 1, 2""")
def benchmark_ratio(spark, sf):
    pairs = S.align(T.prices(spark, sf), [(v, T.BENCHMARK) for v in T.VARIETIES if v != T.BENCHMARK])
    return rounded(stats.benchmark_profile(pairs))


@query("fit_line", f"WITH {PRICE}, {VOLUME}, {SUPPLY} SELECT a, b, {r('regr_slope(y,x)')} AS slope, {r('regr_intercept(y,x)')} AS intercept, {r(_R, 6)} AS r, count(*) AS n FROM pr GROUP BY 1, 2")
def fit_line(spark, sf):
    return rounded(stats.fit_line(supply_pairs(spark, sf)), 4, r=6)
