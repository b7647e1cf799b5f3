"""Regression-based tests."""

from pyspark.sql import functions as F

from tidemark.operators import regress as G, series as S, stats
from tidemark.registry.base import DRIVER, MARKET, PAIRS, PRICE, VOLUME, W, f_sql, longs, query, r, rounded, student_sql
from tidemark.registry.pairs import market_pairs
from tidemark.sources import tables as T
from tidemark.sources.store import landed

WEEKLY_PRICE = "wp AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM price GROUP BY 1, 2)"


def _weekly_markets(spark, sf):
    return S.align(S.resample(T.market_prices(spark, sf), "W"), S.all_pairs(T.MARKETS))


@query("granger")
def granger(spark, sf):
    return rounded(G.granger(_weekly_markets(spark, sf)), 6)


@query("granger_lag_1", f"""WITH {MARKET}, wm AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM market GROUP BY 1, 2),
 pr AS (SELECT p.series_id AS a, q.series_id AS b, p.ts, p.value AS x, q.value AS y FROM wm p JOIN wm q ON p.ts = q.ts AND p.series_id < q.series_id),
 d AS (SELECT a, b, ts, x - lag(x) OVER w AS x, y - lag(y) OVER w AS y FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
 l AS (SELECT a, b, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM d WHERE x IS NOT NULL WINDOW w AS (PARTITION BY a, b ORDER BY ts)), o AS (SELECT * FROM l WHERE y1 IS NOT NULL),
 f AS (SELECT a, b, regr_slope(y,y1) s1, regr_intercept(y,y1) i1, regr_slope(x1,y1) s2, regr_intercept(x1,y1) i2 FROM o GROUP BY 1, 2),
 e AS (SELECT a, b, y-i1-s1*y1 AS ey, x1-i2-s2*y1 AS ex FROM o JOIN f USING (a, b)),
 g AS (SELECT a, b, sum(ey*ey) AS sr, sum(ey*ey)-pow(sum(ey*ex),2)/sum(ex*ex) AS su, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT *, (sr-su)/su*(n-3) AS f, n-3 AS d2 FROM g)
 SELECT a, b, {r('f')} AS f, d2 AS df2, {r(f_sql('f', '1', 'd2'), 6)} AS p_value FROM t""")
def granger_lag_1(spark, sf):
    return rounded(G.granger(_weekly_markets(spark, sf), 1).select("a", "b", "f", "df2", "p_value"), 4, p_value=6)


@query("influence")
def influence(spark, sf):
    pairs = landed(_weekly_markets(spark, sf))
    return rounded(longs(G.influence(pairs, stats.lead_lag(stats.cross_correlation(pairs)))), 6)


@query("influence_edges")
def influence_edges(spark, sf):
    pairs = landed(_weekly_markets(spark, sf))
    return rounded(G.influence_edges(G.influence(pairs, stats.lead_lag(stats.cross_correlation(pairs)))), 6)


@query("leadership")
def leadership(spark, sf):
    pairs = landed(_weekly_markets(spark, sf))
    return rounded(longs(G.leadership(G.influence(pairs, stats.lead_lag(stats.cross_correlation(pairs))))), 6)


@query("adf")
def adf(spark, sf):
    return rounded(G.dickey_fuller(S.resample(T.prices(spark, sf), "W")), 6)


_KPSS = f"""dv AS (SELECT series_id, ts, value - avg(value) OVER (PARTITION BY series_id) AS e, count(*) OVER (PARTITION BY series_id) AS n FROM wp),
 rw AS (SELECT *, row_number() OVER {W} AS i, sum(e) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM dv),
 ga AS (SELECT p.series_id, p.i - q.i AS k, sum(p.e*q.e) AS g FROM rw p JOIN rw q ON p.series_id = q.series_id AND p.i >= q.i GROUP BY 1, 2),
 nn AS (SELECT series_id, max(n) AS n, sum(s*s) AS ss FROM rw GROUP BY 1),
 a0 AS (SELECT series_id, n, ss, (sum(CASE WHEN k=0 THEN g END) + 2*sum(CASE WHEN k BETWEEN 1 AND floor(pow(n,2.0/9)) THEN g ELSE 0 END))/n AS s0, 2*sum(CASE WHEN k BETWEEN 1 AND floor(pow(n,2.0/9)) THEN k*g ELSE 0 END)/n AS s1 FROM nn JOIN ga USING (series_id) GROUP BY series_id, n, ss),
 lg AS (SELECT *, least(CAST(floor(1.1447*pow(pow(s1/s0,2),1.0/3)*pow(n,1.0/3)) AS BIGINT), n-1) AS l FROM a0),
 st AS (SELECT series_id, n, l, ss/(n*n::DOUBLE)/((sum(CASE WHEN k=0 THEN g END) + 2*sum(CASE WHEN k BETWEEN 1 AND l THEN g*(1-k/(l+1.0)) ELSE 0 END))/n) AS t FROM lg JOIN ga USING (series_id) GROUP BY series_id, n, l, ss)"""


@query("kpss", f"WITH {PRICE}, {WEEKLY_PRICE}, {_KPSS} SELECT series_id, {r('t', 6)} AS statistic, l AS lags_used, n AS observations FROM st")
def kpss(spark, sf):
    return rounded(longs(G.kpss(S.resample(T.prices(spark, sf), "W")).select("series_id", "statistic", "lags_used", "observations")), 6)


@query("stationarity")
def stationarity(spark, sf):
    return rounded(longs(G.stationarity(S.resample(T.prices(spark, sf), "W"))), 6)


@query("acf", f"""WITH {PRICE}, {WEEKLY_PRICE}, dv AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS e, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY series_id) AS n FROM wp),
 ga AS (SELECT p.series_id, p.n, p.i - q.i AS lag, sum(p.e*q.e) AS g FROM dv p JOIN dv q ON p.series_id = q.series_id AND p.i - q.i BETWEEN 0 AND 40 GROUP BY 1, 2, 3)
 SELECT series_id, lag, {r('g/max(CASE WHEN lag=0 THEN g END) OVER (PARTITION BY series_id)', 6)} AS acf, {r('1.96/sqrt(n)', 6)} AS band FROM ga""")
def acf(spark, sf):
    return rounded(longs(G.autocorrelation(S.resample(T.prices(spark, sf), "W"), 40).drop("pacf")), 6)


@query("pacf", f"""WITH RECURSIVE {PRICE}, {WEEKLY_PRICE}, dv AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS e, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY series_id) AS n FROM wp),
 ga AS (SELECT p.series_id, p.n, p.i - q.i AS lag, sum(p.e*q.e) AS g FROM dv p JOIN dv q ON p.series_id = q.series_id AND p.i - q.i BETWEEN 0 AND 40 GROUP BY 1, 2, 3),
 rh AS (SELECT series_id, n, list(g ORDER BY lag) AS g FROM ga GROUP BY 1, 2), rr AS (SELECT series_id, n, list_transform(g, lambda x: x/g[1]) AS rho FROM rh),
 lv AS (SELECT series_id, n, rho, 0::BIGINT AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS er, 1.0::DOUBLE AS re FROM rr UNION ALL
  SELECT series_id, n, rho, k, list_append(list_transform(phi, lambda x, i: x - re*phi[len(phi)-i+1]), re), er*(1-re*re), re FROM (
   SELECT series_id, n, rho, k+1 AS k, phi, er, (rho[k+2] - coalesce(list_sum(list_transform(phi, lambda x, i: x*rho[k+1-i+1])), 0))/er AS re FROM lv WHERE k < 40))
 SELECT series_id, k AS lag, {r('re', 6)} AS pacf, {r('1.96/sqrt(n)', 6)} AS band FROM lv""")
def pacf(spark, sf):
    return rounded(longs(G.autocorrelation(S.resample(T.prices(spark, sf), "W"), 40).drop("acf")), 6)


@query("engle_granger")
def engle_granger(spark, sf):
    return rounded(G.engle_granger(_weekly_markets(spark, sf)), 4)


@query("cointegrating_line", f"WITH {MARKET}, {PAIRS} SELECT a, b, {r('regr_slope(x,y)', 6)} AS slope, {r('regr_intercept(x,y)', 3)} AS intercept, count(*) AS n FROM pr GROUP BY 1, 2")
def cointegrating_line(spark, sf):
    return rounded(stats.fit_line(G.reversed_pairs(market_pairs(spark, sf))).select(F.col("b").alias("a"), F.col("a").alias("b"), "slope", "intercept", "n"), 6, intercept=3)


@query("johansen")
def johansen(spark, sf):
    return rounded(longs(G.johansen(S.resample(T.market_prices(spark, sf), "W"), T.MARKETS)), 4)


def _drivers(spark, sf):
    w = S.resample(T.volumes(spark, sf), "W", "sum")
    return w.unionByName(S.resample(T.driver(spark, sf), "W"))


_OLS3 = f"""{WEEKLY_PRICE}, va AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, sum(value) AS value FROM volume WHERE value IS NOT NULL GROUP BY 1, 2),
 vb AS (SELECT series_id, min(ts) lo, max(ts) hi FROM va GROUP BY 1), vg AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ts FROM vb),
 vw AS (SELECT g.series_id, g.ts, coalesce(va.value, 0) AS value FROM vg g LEFT JOIN va ON va.series_id = g.series_id AND va.ts = g.ts), dw AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM driver GROUP BY 1),
 j AS (SELECT p.series_id, p.ts, p.value AS y, a.value AS x1, o.value AS x2, d.value AS x3 FROM wp p JOIN vw a ON a.ts = p.ts AND a.series_id='arrivals' JOIN vw o ON o.ts = p.ts AND o.series_id='offtake' JOIN dw d ON d.ts = p.ts),
 df AS (SELECT series_id, y-lag(y) OVER {W} AS y, x1-lag(x1) OVER {W} AS x1, x2-lag(x2) OVER {W} AS x2, x3-lag(x3) OVER {W} AS x3 FROM j),
 m AS (SELECT series_id, count(*) AS n, avg(y) my, avg(x1) m1, avg(x2) m2, avg(x3) m3, var_pop(y)*count(*) yy, var_pop(x1)*count(*) a, covar_pop(x1,x2)*count(*) b, covar_pop(x1,x3)*count(*) c, var_pop(x2)*count(*) d, covar_pop(x2,x3)*count(*) e,
   var_pop(x3)*count(*) f, covar_pop(x1,y)*count(*) s1, covar_pop(x2,y)*count(*) s2, covar_pop(x3,y)*count(*) s3 FROM df WHERE y IS NOT NULL GROUP BY 1),
 iv AS (SELECT *, a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS det FROM m), i2 AS (SELECT *, (d*f-e*e)/det AS i11, (c*e-b*f)/det AS i12, (b*e-c*d)/det AS i13, (a*f-c*c)/det AS i22, (b*c-a*e)/det AS i23, (a*d-b*b)/det AS i33 FROM iv),
 co AS (SELECT *, i11*s1+i12*s2+i13*s3 AS b1, i12*s1+i22*s2+i23*s3 AS b2, i13*s1+i23*s2+i33*s3 AS b3, n-4 AS v FROM i2), er AS (SELECT *, (yy-b1*s1-b2*s2-b3*s3) AS sse FROM co),
 st AS (SELECT *, sse/v AS s2e, 1-sse/yy AS r2, my-b1*m1-b2*m2-b3*m3 AS b0, 1.0/n+m1*m1*i11+m2*m2*i22+m3*m3*i33+2*(m1*m2*i12+m1*m3*i13+m2*m3*i23) AS i00 FROM er),
 tm AS (SELECT st.*, t.* FROM st, LATERAL (VALUES ('const', b0, i00, NULL::DOUBLE), ('arrivals', b1, i11, sqrt(a/yy)), ('offtake', b2, i22, sqrt(d/yy)), ('driver', b3, i33, sqrt(f/yy))) AS t(term, co, iv, sc)),
 tt AS (SELECT *, co/sqrt(s2e*iv) AS t, (r2/3)/((1-r2)/v) AS ff FROM tm)"""


@query("driver_ols", f"""WITH {PRICE}, {VOLUME}, {DRIVER}, {_OLS3} SELECT series_id, term, {r('co')} AS coefficient, {r('sqrt(s2e*iv)')} AS se, {r('t')} AS t, {r(student_sql('t', 'v'), 6)} AS p_value, {r('co*sc', 6)} AS standardised, {r('r2', 6)} AS r_squared,
 {r('1-(1-r2)*(n-1)/v', 6)} AS adj_r_squared, {r(f_sql('ff', '3', 'v'), 6)} AS f_p_value, n FROM tt""")
def driver_ols(spark, sf):
    out = G.driver_regression(S.resample(T.prices(spark, sf), "W"), _drivers(spark, sf), ["arrivals", "offtake", "driver"])
    return rounded(out, 6, coefficient=4, se=4, t=4)


@query("driver_ols_single", f"""WITH {PRICE}, {VOLUME}, {WEEKLY_PRICE}, wv AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, sum(value) AS v FROM volume WHERE series_id='arrivals' GROUP BY 1),
 j AS (SELECT series_id, value - lag(value) OVER {W} AS y, v - lag(v) OVER {W} AS x FROM (SELECT wp.*, v FROM wp JOIN wv ON wp.ts = wv.ts)),
 m AS (SELECT series_id, regr_slope(y,x) AS b, regr_sxx(y,x) AS sxx, regr_sxy(y,x) AS sxy, regr_syy(y,x) AS syy, count(*) AS n FROM j WHERE y IS NOT NULL GROUP BY 1),
 e AS (SELECT *, sqrt((syy-sxy*sxy/sxx)/((n-2)*sxx)) AS se, n-2 AS v, sxy*sxy/(sxx*syy) AS r2 FROM m), t AS (SELECT *, b/se AS t FROM e)
 SELECT series_id, {r('b')} AS coefficient, {r('se')} AS se, {r('t')} AS t, {r(student_sql('t', 'v'), 6)} AS p_value, {r('sqrt(r2)*sign(b)')} AS standardised, {r('r2', 6)} AS r_squared, n FROM t""")
def driver_ols_single(spark, sf):
    out = G.driver_regression(S.resample(T.prices(spark, sf), "W"), _drivers(spark, sf), ["arrivals"]).where("term = 'arrivals'")
    return rounded(out.select("series_id", "coefficient", "se", "t", "p_value", "standardised", "r_squared", "n"), 4, p_value=6, r_squared=6)


@query("vif", f"""WITH {VOLUME}, {DRIVER}, a AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, sum(value) AS v FROM volume WHERE series_id='arrivals' GROUP BY 1), d AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS w FROM driver GROUP BY 1),
 c AS (SELECT corr(v, w) AS r, count(*) AS n FROM a JOIN d USING (ts)) SELECT x AS variable, {r('1/(1-r*r)', 6)} AS vif, 'Acceptable' AS interpretation, n FROM c, (SELECT unnest(['arrivals','driver']) AS x)""")
def vif(spark, sf):
    return rounded(G.variance_inflation(_drivers(spark, sf), ["arrivals", "driver"]), 6)
