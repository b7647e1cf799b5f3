"""Seasonality and decomposition."""

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import seasonal as M, series as S
from tidemark.registry.base import EXPORTS, MARKET, PRICE, VOLUME, W, longs, query, r, rounded
from tidemark.sources import tables as T


def _monthly(src: str, agg: str = "avg", out: str = "m") -> str:
    return f"""{out}0 AS (SELECT series_id, CAST(date_trunc('month', ts) AS DATE) AS ts, {agg}(value) AS value FROM {src} WHERE value IS NOT NULL GROUP BY 1, 2),
 {out}b AS (SELECT series_id, min(ts) lo, max(ts) hi FROM {out}0 GROUP BY 1), {out}g AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ts FROM {out}b),
 {out} AS (SELECT g.series_id, g.ts, {'coalesce(x.value, 0)' if agg == 'sum' else 'x.value'} AS value FROM {out}g g LEFT JOIN {out}0 x ON g.series_id = x.series_id AND g.ts = x.ts)"""


def _index(out: str, src: str = "m") -> str:
    f = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)"
    return f"""{out}r AS (SELECT series_id, ts, value / CASE WHEN count(value) {f} = 12 THEN avg(value) {f} END AS q FROM {src}),
 {out}f AS (SELECT series_id, month(ts) AS month, avg(q) AS f, count(DISTINCT year(ts)) AS years_used FROM {out}r WHERE q IS NOT NULL GROUP BY 1, 2),
 {out} AS (SELECT *, f*100/avg(f) OVER (PARTITION BY series_id) AS index_100 FROM {out}f)"""


@query("seasonal_index", f"WITH {PRICE}, {_monthly('price')}, {_index('ix')} SELECT series_id, month, {r('index_100')} AS index_100, years_used, CASE WHEN years_used >= 2 THEN 'ok' ELSE 'insufficient_evidence' END AS status FROM ix")
def seasonal_index(spark, sf):
    return rounded(longs(M.ratio_index(T.prices(spark, sf))))


_ME = "me AS (SELECT series_id, last_day(ts) AS ts, avg(value) AS value FROM price GROUP BY 1, 2)"


@query("month_index", f"""WITH {PRICE}, {_ME}, o AS (SELECT series_id, avg(value) AS o FROM me GROUP BY 1)
 SELECT me.series_id, month(ts) AS month, {r('avg(value)')} AS mean, {r('quantile_cont(value,0.5)')} AS median, {r('stddev_samp(value)')} AS sd, count(*) AS years_observed, {r('min(value)')} AS minimum, {r('max(value)')} AS maximum,
 {r('avg(value)/max(o)', 6)} AS index, {r('avg(value)/max(o)-1', 6)} AS deviation FROM me JOIN o USING (series_id) GROUP BY 1, 2""")
def month_index(spark, sf):
    return rounded(longs(M.month_table(T.prices(spark, sf))), 4, index=6, deviation=6)


@query("month_boxes", f"WITH {PRICE}, {_ME} SELECT series_id, month(ts) AS month, {r('min(value)')} AS minimum, {r('quantile_cont(value,0.25)')} AS q1, {r('quantile_cont(value,0.5)')} AS median, {r('quantile_cont(value,0.75)')} AS q3, {r('max(value)')} AS maximum, count(*) AS n FROM me GROUP BY 1, 2")
def month_boxes(spark, sf):
    return rounded(longs(M.month_boxes(T.prices(spark, sf))))


@query("weekday", f"""WITH {PRICE}, c AS (SELECT *, (value/lag(value) OVER {W}-1)*100 AS c FROM price), o AS (SELECT series_id, avg(value) AS o FROM price GROUP BY 1)
 SELECT c.series_id, isodow(ts) AS weekday, {r('avg(value)')} AS mean_level, count(*) AS n, {r('avg(c)')} AS mean_change_pct, {r('stddev_samp(c)')} AS sd_change_pct, {r('avg(value)/max(o)', 6)} AS index FROM c JOIN o USING (series_id) GROUP BY 1, 2""")
def weekday(spark, sf):
    return rounded(longs(M.weekdays(T.prices(spark, sf))), 4, index=6)


_YOY = f"""h AS (SELECT *, avg(value) OVER (PARTITION BY series_id, month(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist,
 count(*) OVER (PARTITION BY series_id, month(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS yh, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM m)"""


@query("yoy_same_month", f"WITH {PRICE}, {_monthly('price')}, {_YOY} SELECT series_id, ts, {r('value')} AS actual, {r('hist')} AS historical, {r('(value-hist)/hist*100')} AS deviation_pct, yh AS years_of_history FROM h WHERE k <= 12 AND yh > 0")
def yoy_same_month(spark, sf):
    return rounded(M.same_month_comparison(T.prices(spark, sf)))


_PL = "pl AS (SELECT series_id, month(ts) AS month, avg(value) AS mt, count(DISTINCT year(ts)) AS yu, row_number() OVER (PARTITION BY series_id ORDER BY avg(value) DESC, month(ts)) AS rank FROM m GROUP BY 1, 2)"


@query("peak_lean_months", f"WITH {VOLUME}, {_monthly('volume', 'sum')}, {_PL} SELECT series_id, month, {r('mt')} AS mean_total, yu AS years_used, rank, CASE WHEN rank <= 3 THEN 'peak' WHEN rank > 9 THEN 'lean' ELSE 'shoulder' END AS position FROM pl")
def peak_lean_months(spark, sf):
    return rounded(longs(M.peak_lean(T.volumes(spark, sf))))


@query("season_profile", f"""WITH {VOLUME}, {_monthly('volume', 'sum')}, t AS (SELECT series_id, month(ts) AS month, avg(value) AS mt, quantile_cont(value,0.5) AS md, count(*) AS n FROM m GROUP BY 1, 2),
 k AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY mt DESC) AS rk, avg(mt) OVER (PARTITION BY series_id) AS am FROM t)
 SELECT series_id, month, {r('mt')} AS mean_total, {r('md')} AS median_total, n AS years_observed, {r('mt/am', 6)} AS index_vs_mean, CASE WHEN rk <= 4 THEN 'Peak arrivals' WHEN rk > 8 THEN 'Lean arrivals' ELSE 'Shoulder' END AS season FROM k""")
def season_profile(spark, sf):
    return rounded(longs(M.season_profile(T.volumes(spark, sf))), 4, index_vs_mean=6)


@query("harvest", f"""WITH {PRICE}, {VOLUME}, arr AS (SELECT * FROM volume WHERE series_id='arrivals'), {_monthly('price')}, {_index('ix')}, {_monthly('arr', 'avg', 'v')}, {_index('vx', 'v')},
 k AS (SELECT month, row_number() OVER (ORDER BY index_100 DESC, month) AS k, count(*) OVER () AS n FROM vx)
 SELECT series_id, {r('avg(CASE WHEN k <= 3 THEN index_100 END)')} AS harvest_index, {r('avg(CASE WHEN k > n-3 THEN index_100 END)')} AS off_season_index FROM ix JOIN k USING (month) GROUP BY 1""")
def harvest(spark, sf):
    return rounded(M.harvest_behaviour(T.arrivals(spark, sf), T.prices(spark, sf)))


@query("supplied_month_means", f"WITH {PRICE}, {_ME} SELECT month(ts) AS month, {r('avg(value)')} AS mean, count(value) AS years FROM me GROUP BY 1")
def supplied_month_means(spark, sf):
    supplied = S.resample(T.prices(spark, sf), "ME").withColumn("month", F.month("ts"))
    return rounded(longs(M.monthly_means_by_label(supplied, "month", "value")))


@query("calendar_grid", f"WITH {PRICE}, {_ME} SELECT series_id, year(ts) AS year, " + ", ".join(f"{r(f'avg(CASE WHEN month(ts)={i + 1} THEN value END)')} AS {m}" for i, m in enumerate(fixed.MONTHS)) + " FROM me GROUP BY 1, 2")
def calendar_grid(spark, sf):
    return rounded(longs(M.calendar_grid(S.resample(T.prices(spark, sf), "ME"))))


@query("year_totals", f"WITH {EXPORTS} SELECT series_id, year(ts) AS year, {r('sum(value)')} AS total, count(value) AS months, count(value) = 12 AS complete FROM exports GROUP BY 1, 2")
def year_totals(spark, sf):
    return rounded(longs(M.year_totals(T.exports(spark, sf))))


def _classical(src: str) -> str:
    return f"""{_monthly(src)}, p AS (SELECT series_id, last_day(ts) AS ts, value, row_number() OVER {W} - 1 AS i FROM m),
 tr AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
  (0.5*(lag(value,6) OVER {W} + lead(value,6) OVER {W}) + sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))/12 END AS trend FROM p),
 ph AS (SELECT series_id, i % 12 AS ph, avg(value-trend) AS s FROM tr GROUP BY 1, 2), se AS (SELECT series_id, ph, s - avg(s) OVER (PARTITION BY series_id) AS seasonal FROM ph),
 dc AS (SELECT tr.series_id, ts, value AS observed, trend, seasonal, value-trend-seasonal AS residual FROM tr JOIN se ON tr.series_id = se.series_id AND tr.i % 12 = se.ph)"""


@query("decompose_classical", f"WITH {MARKET}, {_classical('market')} SELECT series_id, ts, {r('observed')} AS observed, {r('trend')} AS trend, {r('seasonal')} AS seasonal, {r('residual')} AS residual, false AS interpolated FROM dc")
def decompose_classical(spark, sf):
    return rounded(M.decompose(T.market_prices(spark, sf), "ME"))


@query("variance_shares", f"WITH {PRICE}, {_classical('price')}, v AS (SELECT series_id, var_samp(trend) t, var_samp(seasonal) s, var_samp(residual) e FROM dc GROUP BY 1) SELECT series_id, {r('t/(t+s+e)', 6)} AS trend_share, {r('s/(t+s+e)', 6)} AS seasonal_share, {r('e/(t+s+e)', 6)} AS residual_share, 0::BIGINT AS n_interpolated FROM v")
def variance_shares(spark, sf):
    return rounded(M.variance_shares(M.decompose(T.prices(spark, sf), "ME")), 6)
