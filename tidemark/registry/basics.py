"""Series construction, resampling, windows and per-series aggregates."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.operators import series as S
from tidemark.operators import stats, windows as W_
from tidemark.registry.base import DRIVER, MARKET, PRICE, VOLUME, W, full, longs, query, r, rounded
from tidemark.sources import tables as T

FILTER = S.SeriesFilter(start=date(1996, 1, 1), end=date(2000, 12, 31), months=(1, 2, 3, 10, 11, 12),
                        price_min=50000.0, price_max=400000.0)


@query("price_snapshot", f"""WITH {PRICE},
 n AS (SELECT *, row_number() OVER {W} AS rn, {full('avg', 'value', 7)} AS s7, {full('avg', 'value', 30)} AS s30,
   {full('avg', 'value', 90)} AS s90, {full('stddev_samp', 'value', 30)} / {full('avg', 'value', 30)} AS cv,
   (value - lag(value, 7) OVER {W}) / lag(value, 7) OVER {W} AS r7,
   (value - lag(value, 30) OVER {W}) / lag(value, 30) OVER {W} AS r30,
   (value - lag(value, 90) OVER {W}) / lag(value, 90) OVER {W} AS r90,
   max(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM price),
 l AS (SELECT series_id, max(rn) AS rn, min((value-top)/top) AS dd, count(*) AS n FROM n GROUP BY 1)
 SELECT n.series_id, n.ts AS as_of, {r('n.value')} AS latest, {r('s7')} AS sma_7, {r('s30')} AS sma_30, {r('s90')} AS sma_90,
  {r('cv', 6)} AS cv_30, {r('r7*100')} AS roc_7, {r('r30*100')} AS roc_30, {r('r90*100')} AS roc_90,
  {r('dd*100')} AS max_drawdown_pct, l.n AS observations, CASE WHEN l.n >= 30 THEN 'ok' ELSE 'insufficient_evidence' END AS status
 FROM n JOIN l ON n.series_id = l.series_id AND n.rn = l.rn""")
def price_snapshot(spark, sf):
    out = stats.snapshot(T.prices(spark, sf))
    return rounded(out, 4, cv_30=6)


for _name, _freq, _how, _sql in [
    ("resample_week", "W", "mean", "CAST(date_trunc('week', ts) AS DATE) + 6"),
    ("resample_fortnight", "SME", "mean", "CASE WHEN day(ts) <= 15 THEN make_date(year(ts), month(ts), 15) ELSE last_day(ts) END"),
    ("resample_month", "ME", "mean", "last_day(ts)"),
    ("resample_year", "YE", "mean", "make_date(year(ts), 12, 31)"),
]:
    @query(_name, f"WITH {PRICE} SELECT series_id, CAST({_sql} AS DATE) AS ts, {r('avg(value)')} AS value FROM price GROUP BY 1, 2")
    def _resample(spark, sf, freq=_freq, how=_how):
        return rounded(S.resample(T.prices(spark, sf), freq, how))


@query("resample_month_sum_keep", f"""WITH {VOLUME}, m AS (SELECT series_id, CAST(date_trunc('month', ts) AS DATE) AS ts, sum(value) AS value
   FROM volume WHERE value IS NOT NULL GROUP BY 1, 2), b AS (SELECT series_id, min(ts) lo, max(ts) hi FROM m GROUP BY 1),
  g AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ts FROM b)
 SELECT g.series_id, g.ts, {r('coalesce(m.value, 0.0)')} AS value FROM g LEFT JOIN m ON g.series_id = m.series_id AND g.ts = m.ts""")
def resample_month_sum_keep(spark, sf):
    return rounded(S.resample(T.volumes(spark, sf), "MS", "sum", empty="keep"))


@query("resample_week_sum_keep", f"""WITH {MARKET}, m AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, sum(value) AS value
   FROM market GROUP BY 1, 2), b AS (SELECT series_id, min(ts) lo, max(ts) hi FROM m GROUP BY 1),
  g AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ts FROM b)
 SELECT g.series_id, g.ts, {r('coalesce(m.value, 0.0)')} AS value FROM g LEFT JOIN m ON g.series_id = m.series_id AND g.ts = m.ts""")
def resample_week_sum_keep(spark, sf):
    return rounded(S.resample(T.market_prices(spark, sf), "W", "sum", empty="keep"))


@query("exports_month_end", """SELECT 'exports' AS series_id, last_day(CAST(l_shipdate AS DATE)) AS ts, round(sum(l_quantity),4) AS value
 FROM lineitem WHERE l_returnflag='R' GROUP BY 2""")
def exports_month_end(spark, sf):
    return rounded(S.to_month_end(T.exports(spark, sf)))


@query("filter_state", f"""WITH {PRICE} SELECT series_id, ts, {r('value')} AS value FROM price WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
 AND month(ts) IN (1,2,3,10,11,12) AND value BETWEEN 50000 AND 400000""")
def filter_state(spark, sf):
    again = S.SeriesFilter.from_json(FILTER.to_json())
    return rounded(again.apply(T.prices(spark, sf), "price"))


@query("preset_last_3_years", f"""WITH {PRICE}, c AS (SELECT series_id, greatest(min(ts), CAST(max(ts) - INTERVAL 36 MONTH AS DATE)) AS cut FROM price GROUP BY 1)
 SELECT p.series_id, p.ts, {r('value')} AS value FROM price p JOIN c ON p.series_id = c.series_id WHERE p.ts >= cut""")
def preset_last_3_years(spark, sf):
    return rounded(S.last_years(T.prices(spark, sf), 3))


@query("training_tail", f"""WITH {PRICE} SELECT series_id, ts, {r('value')} AS value FROM price
 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 120""")
def training_tail(spark, sf):
    return rounded(S.tail(T.prices(spark, sf), 120))


@query("default_filter", f"WITH {PRICE} SELECT min(ts) AS start, max(ts) AS \"end\", 'W' AS frequency FROM price")
def default_filter(spark, sf):
    return S.default_filter_bounds(T.prices(spark, sf))


@query("dedupe_last", """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, max_by(o_totalprice, o_orderkey) AS value
 FROM orders GROUP BY 1, 2""")
def dedupe_last(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts"),
                                              F.col("o_totalprice").alias("value"), "o_orderkey")
    return S.keep_last(rows, "o_orderkey")


@query("dedupe_mean", f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, {r('avg(o_totalprice)')} AS value
 FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2""")
def dedupe_mean(spark, sf):
    rows = T.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts"),
                                              F.col("o_totalprice").alias("value"))
    return rounded(S.keep_mean(rows))


@query("dedupe_exact_rows", """SELECT event_type, user_id, day, row_ref, is_copy FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS day, event_id AS row_ref,
 row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY event_id) > 1 AS is_copy FROM events)""")
def dedupe_exact_rows(spark, sf):
    rows = T.read(spark, sf, "events").select("event_type", "user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("row_ref"))
    kept, dropped = S.drop_exact_duplicates(rows, ["event_type", "user_id", "day"], "row_ref")
    return kept.withColumn("is_copy", F.lit(False)).unionByName(dropped.withColumn("is_copy", F.lit(True)))


@query("sma", f"""WITH {PRICE} SELECT series_id, ts, {r(full('avg', 'value', 7))} AS sma_7, {r(full('avg', 'value', 30))} AS sma_30,
 {r(full('avg', 'value', 90))} AS sma_90 FROM price""")
def sma(spark, sf):
    return rounded(T.prices(spark, sf).select("series_id", "ts", *[W_.sma("value", n).alias(f"sma_{n}") for n in (7, 30, 90)]))


_EMA = f"""WITH RECURSIVE {PRICE}, o AS (SELECT *, row_number() OVER {W} AS rn FROM price),
 e AS (SELECT series_id, ts, rn, value AS e7, value AS e30 FROM o WHERE rn = 1 UNION ALL
  SELECT o.series_id, o.ts, o.rn, e.e7*0.75 + o.value*0.25, e.e30*(1-2.0::DOUBLE/31) + o.value*(2.0::DOUBLE/31) FROM e JOIN o ON o.series_id = e.series_id AND o.rn = e.rn+1)
 SELECT series_id, ts, {r('CASE WHEN rn >= 7 THEN e7 END')} AS ema_7, {r('CASE WHEN rn >= 30 THEN e30 END')} AS ema_30 FROM e"""


@query("ema", _EMA)
def ema(spark, sf):
    p = T.prices(spark, sf)
    out = W_.with_ema(W_.with_ema(p, 7, "ema_7"), 30, "ema_30")
    return rounded(out.select("series_id", "ts", "ema_7", "ema_30"))


@query("rolling_cv", f"""WITH {PRICE} SELECT series_id, ts, {r(f"({full('stddev_samp', 'value', 30)}) / ({full('avg', 'value', 30)})", 6)} AS cv_30 FROM price""")
def rolling_cv(spark, sf):
    return rounded(T.prices(spark, sf).select("series_id", "ts", W_.rolling_cv("value", 30).alias("cv_30")), 6)


@query("rolling_z", f"""WITH {PRICE} SELECT series_id, ts, {r(f"(value - {full('avg', 'value', 90)}) / ({full('stddev_samp', 'value', 90)})", 6)} AS z_90 FROM price""")
def rolling_z(spark, sf):
    return rounded(T.prices(spark, sf).select("series_id", "ts", W_.rolling_z("value", 90).alias("z_90")), 6)


@query("spacing", f"""WITH {PRICE}, {DRIVER}, u AS (SELECT * FROM price UNION ALL SELECT * FROM driver),
 g AS (SELECT series_id, date_diff('day', lag(ts) OVER {W}, ts) AS g FROM u),
 s AS (SELECT series_id, quantile_cont(g, 0.5) AS m, count(*) AS n FROM g GROUP BY 1)
 SELECT series_id, m AS median_gap, n AS n_obs, CASE WHEN m <= 3 THEN 'D' WHEN m <= 10 THEN 'W' WHEN m <= 20 THEN 'SME' ELSE 'ME' END AS freq FROM s""")
def spacing(spark, sf):
    return longs(W_.spacing(T.prices(spark, sf).unionByName(T.driver(spark, sf))))


@query("bands_volatility", f"""WITH {PRICE}, w AS (SELECT series_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, avg(value) AS value FROM price GROUP BY 1, 2),
 l AS (SELECT *, ln(value / lag(value) OVER {W}) AS lr FROM w),
 b AS (SELECT series_id, ts, value, {full('avg', 'value', 30)} AS m, {full('stddev_samp', 'value', 30)} AS s, {full('stddev_samp', 'lr', 30)} AS v FROM l)
 SELECT series_id, ts, {r('value')} AS value, {r('m')} AS mean, {r('s')} AS sd, {r('v*sqrt(52)', 6)} AS volatility, {r('m+2*s')} AS upper, {r('m-2*s')} AS lower FROM b""")
def bands_volatility(spark, sf):
    out = W_.bands(S.resample(T.prices(spark, sf), "W"), 30)
    return rounded(out.select("series_id", "ts", "value", "mean", "sd", "volatility", "upper", "lower"), 4, volatility=6)


@query("momentum", f"""WITH {PRICE} SELECT series_id, ts, {r(f'(value - lag(value,7) OVER {W}) / lag(value,7) OVER {W}', 6)} AS roc_7,
 {r(f'(value - lag(value,30) OVER {W}) / lag(value,30) OVER {W}', 6)} AS roc_30, {r(f'(value - lag(value,90) OVER {W}) / lag(value,90) OVER {W}', 6)} AS roc_90 FROM price""")
def momentum(spark, sf):
    return rounded(T.prices(spark, sf).select("series_id", "ts", *[W_.momentum("value", n).alias(f"roc_{n}") for n in (7, 30, 90)]), 6)


@query("yoy_mom", f"""WITH {VOLUME}, m AS (SELECT series_id, CAST(date_trunc('month', ts) AS DATE) AS ts, sum(value) AS value
   FROM volume WHERE value IS NOT NULL GROUP BY 1, 2)
 SELECT series_id, ts, {r('value')} AS value, {r(f'(value - lag(value,12) OVER {W}) / lag(value,12) OVER {W} * 100')} AS yoy_pct,
  {r(f'(value - lag(value,1) OVER {W}) / lag(value,1) OVER {W} * 100')} AS mom_pct FROM m""")
def yoy_mom(spark, sf):
    m = S.resample(T.volumes(spark, sf), "MS", "sum", empty="keep")
    return rounded(m.select("series_id", "ts", "value", W_.growth_pct("value", 12).alias("yoy_pct"), W_.growth_pct("value", 1).alias("mom_pct")))


@query("drawdown", f"""WITH {PRICE}, d AS (SELECT *, max(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM price),
 t AS (SELECT series_id, min((value-top)/top) AS dd, arg_min(ts, struct_pack(a := (value-top)/top, b := ts)) AS trough FROM d GROUP BY 1),
 k AS (SELECT p.series_id, max(value) AS pv FROM price p JOIN t USING (series_id) WHERE p.ts <= trough GROUP BY 1)
 , z AS (SELECT t.series_id, {r('dd*100')} AS max_drawdown_pct, (SELECT min(ts) FROM price p WHERE p.series_id = t.series_id AND p.ts <= trough AND p.value = pv) AS peak_ts,
  trough AS trough_ts, (SELECT min(ts) FROM price p WHERE p.series_id = t.series_id AND p.ts >= trough AND p.value >= pv) AS recovery_ts
  FROM t JOIN k USING (series_id))
 SELECT *, recovery_ts IS NOT NULL AS recovered, CAST(date_diff('day', trough_ts, recovery_ts) AS BIGINT) AS days_to_recover FROM z""")
def drawdown(spark, sf):
    return rounded(longs(W_.drawdown(T.prices(spark, sf))))


@query("running_drawdown", f"""WITH {PRICE}, d AS (SELECT *, max(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM price)
 SELECT series_id, ts, {r('top')} AS running_max, {r('(value-top)/top*100')} AS drawdown_pct FROM d""")
def running_drawdown(spark, sf):
    return rounded(W_.running_drawdown(T.prices(spark, sf)).select("series_id", "ts", "running_max", "drawdown_pct"))


@query("outliers", f"""WITH {PRICE}, f AS (SELECT series_id, avg(value) m, stddev_samp(value) s, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM price GROUP BY 1)
 SELECT p.series_id, p.ts, {r('(value-m)/s', 6)} AS z, {r('z_rolling', 6)} AS z_rolling,
  value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1) AS iqr_outlier, abs((value-m)/s) > 3 AS z_outlier
 FROM (SELECT *, (value - {full('avg', 'value', 30)}) / ({full('stddev_samp', 'value', 30)}) AS z_rolling FROM price) p JOIN f USING (series_id)""")
def outliers(spark, sf):
    return rounded(W_.outliers(T.prices(spark, sf)).select("series_id", "ts", "z", "z_rolling", "iqr_outlier", "z_outlier"), 6)


@query("coverage_gaps", f"""WITH {PRICE}, {MARKET}, u AS (SELECT * FROM price UNION ALL SELECT * FROM market),
 g AS (SELECT series_id, lag(ts) OVER {W} AS from_ts, ts AS to_ts FROM u)
 SELECT series_id, from_ts, to_ts, date_diff('day', from_ts, to_ts) AS days FROM g WHERE date_diff('day', from_ts, to_ts) > 5""")
def coverage_gaps(spark, sf):
    both = T.prices(spark, sf).unionByName(T.market_prices(spark, sf))
    return longs(W_.coverage_gaps(both, 5))


@query("partial_period", f"""WITH {PRICE}, l AS (SELECT series_id, max(ts) AS last_ts FROM price GROUP BY 1),
 e AS (SELECT 'W' AS freq, *, CAST(date_trunc('week', last_ts) AS DATE) + 6 AS period_end, CAST(date_trunc('week', last_ts) AS DATE) AS period_start FROM l
  UNION ALL SELECT 'ME', *, last_day(last_ts), CAST(date_trunc('month', last_ts) AS DATE) FROM l
  UNION ALL SELECT 'SME', *, CASE WHEN day(last_ts) <= 15 THEN make_date(year(last_ts), month(last_ts), 15) ELSE last_day(last_ts) END,
    CASE WHEN day(last_ts) <= 15 THEN CAST(date_trunc('month', last_ts) AS DATE) ELSE make_date(year(last_ts), month(last_ts), 16) END FROM l)
 SELECT freq, series_id, last_ts, period_end, period_start, date_diff('day', period_start, last_ts)+1 AS covered_days,
  date_diff('day', period_start, period_end)+1 AS total_days FROM e WHERE period_end > last_ts""")
def partial_period(spark, sf):
    p = T.prices(spark, sf)
    parts = [W_.partial_last_period(p, f).withColumn("freq", F.lit(f)) for f in ("W", "ME", "SME")]
    return longs(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("rebase_100", f"""WITH {PRICE} SELECT series_id, ts, {r(f'value / first_value(value) OVER {W} * 100')} AS index_100 FROM price""")
def rebase_100(spark, sf):
    return rounded(T.prices(spark, sf).select("series_id", "ts", W_.rebased().alias("index_100")))


@query("describe", f"""WITH {PRICE}, m AS (SELECT series_id, avg(value) AS mu FROM price GROUP BY 1)
 SELECT p.series_id, count(*) AS observations, {r('avg(value)')} AS mean, {r('quantile_cont(value,0.5)')} AS median, {r('stddev_samp(value)')} AS sd,
  {r('stddev_samp(value)/avg(value)', 6)} AS cv, {r('min(value)')} AS minimum, {r('quantile_cont(value,0.25)')} AS p25, {r('quantile_cont(value,0.75)')} AS p75,
  {r('max(value)')} AS maximum, {r('max(value)-min(value)')} AS range, {r('quantile_cont(value,0.75)-quantile_cont(value,0.25)')} AS iqr,
  {r('avg(pow(value-mu,3))/pow(var_pop(value),1.5)', 6)} AS skewness, {r('kurtosis_pop(value)', 6)} AS excess_kurtosis, min(ts) AS first_ts, max(ts) AS last_ts,
  CASE WHEN count(*) >= 3 THEN 'ok' ELSE 'insufficient_evidence' END AS status FROM price p JOIN m USING (series_id) GROUP BY 1""")
def describe(spark, sf):
    return rounded(stats.describe(T.prices(spark, sf)), 4, cv=6, skewness=6, excess_kurtosis=6)


_LAGS = stats.BATTERY_LAGS
_BATTERY = {
    "descriptive": {"mean": "avg(value)", "sd": "stddev_samp(value)", "cv": "stddev_samp(value)/avg(value)", "minimum": "min(value)", "median": "quantile_cont(value, 0.5)", "maximum": "max(value)"},
    "rolling": {"mean": "arg_max(rm, ts)", "sd": "arg_max(rs, ts)", "z": "arg_max((value-rm)/rs, ts)"},
    "changes": {"latest_pct": "arg_max(ch, ts)", "mean_abs_pct": "avg(abs(ch))", "up_share_pct": "avg(CASE WHEN p IS NOT NULL THEN CASE WHEN value > p THEN 1.0 ELSE 0.0 END END)*100", "largest_rise_pct": "max(ch)", "largest_fall_pct": "min(ch)",
                "longest_gap_days": "max(date_diff('day', pt, ts))"},
    "outliers": {"beyond_3_sd": "count(*) FILTER (abs(d/sd) > 3)", "latest_z": "arg_max(d/sd, ts)"},
    "autocorrelation": {f"lag_{k}": f"sum(g{k})/sum(d*d)" for k in _LAGS},
    "drawdown": {"deepest_pct": "min((value-top)/top)*100", "latest_pct": "arg_max((value-top)/top, ts)*100"},
    "trend": {"slope_pct": "regr_slope(value, x)/avg(value)*100", "r_squared": "regr_r2(value, x)"},
    "seasonal_index": {f"month_{m}": f"avg(value) FILTER (month(ts) = {m})/avg(value)" for m in range(1, 13)},
}


@query("battery", f"""WITH {PRICE}, a AS (SELECT *, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd, row_number() OVER o AS x, max(value) OVER (o ROWS UNBOUNDED PRECEDING) AS top, lag(value) OVER o AS p, lag(ts) OVER o AS pt,
  CASE WHEN count(*) OVER (o ROWS 29 PRECEDING) >= 30 THEN avg(value) OVER (o ROWS 29 PRECEDING) END AS rm, CASE WHEN count(*) OVER (o ROWS 29 PRECEDING) >= 30 THEN stddev_samp(value) OVER (o ROWS 29 PRECEDING) END AS rs
  FROM price WINDOW w AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY ts)), b AS (SELECT *, value-mu AS d, (value-p)/p*100 AS ch FROM a),
 c AS (SELECT *, {', '.join(f'd*lag(d, {k}) OVER (PARTITION BY series_id ORDER BY ts) AS g{k}' for k in _LAGS)} FROM b)
 {' UNION ALL '.join(f"SELECT series_id, '{section}' AS section, '{name}' AS statistic, {r(sql, 6)} AS value, 'ok' AS status FROM c GROUP BY series_id" for section, cols in _BATTERY.items() for name, sql in cols.items())}""")
def battery(spark, sf):
    return rounded(stats.battery(T.prices(spark, sf)), 6)


@query("percentile_rank", f"""WITH {PRICE}, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM price),
 l AS (SELECT series_id, value AS latest FROM t WHERE k = 1), w AS (SELECT t.*, latest, v.scope, v.n FROM t JOIN l USING (series_id), (VALUES ('trailing_1y', 365), ('full_history', 1000000)) AS v(scope, n))
 SELECT series_id, w.scope, {r('max(latest)')} AS latest, {r('avg(CASE WHEN value <= latest THEN 1.0 ELSE 0.0 END)*100')} AS percentile, {r('min(value)')} AS minimum,
  {r('quantile_cont(value,0.25)')} AS q1, {r('quantile_cont(value,0.5)')} AS median, {r('quantile_cont(value,0.75)')} AS q3, {r('max(value)')} AS maximum, count(*) AS observations
 FROM w WHERE k <= n GROUP BY 1, 2""")
def percentile_rank(spark, sf):
    p = T.prices(spark, sf)
    return rounded(stats.percentile_rank(p, 365, "trailing_1y").unionByName(stats.percentile_rank(p, None, "full_history")))


@query("cagr", f"""WITH {PRICE}, a AS (SELECT series_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(value, ts) AS sv, arg_max(value, ts) AS ev,
  date_diff('day', min(ts), max(ts))/365.25 AS y FROM price GROUP BY 1)
 SELECT series_id, {r('(pow(ev/sv, 1.0/y)-1)*100')} AS cagr_pct, start_ts, end_ts, {r('sv')} AS start_value, {r('ev')} AS end_value, {r('y')} AS years,
  CASE WHEN n >= 30 THEN 'ok' ELSE 'insufficient_evidence' END AS status, CAST(NULL AS VARCHAR) AS reason, n AS available_n, CAST(30 AS BIGINT) AS required_n FROM a""")
def cagr(spark, sf):
    return rounded(stats.cagr(T.prices(spark, sf)))


@query("latest_value", f"WITH {MARKET} SELECT series_id, max(ts) AS as_of, {r('arg_max(value, ts)')} AS latest FROM market GROUP BY 1")
def latest_value(spark, sf):
    return rounded(stats.latest(T.market_prices(spark, sf)))


@query("scalar_scores", f"""WITH {PRICE}, d AS (SELECT series_id, ts, (value - lag(value) OVER {W}) / lag(value) OVER {W} AS x FROM price)
 SELECT series_id, ts, {r('CASE WHEN x IS NOT NULL THEN (least(greatest(x*100,-20),20)+20)/40*100 END')} AS momentum_score, {r('CASE WHEN x IS NOT NULL THEN least(greatest(x,-1),1) END', 6)} AS clipped,
  CASE WHEN x IS NULL THEN 'undetermined' WHEN abs(x)>=0.9 THEN 'very strong' WHEN abs(x)>=0.7 THEN 'strong' WHEN abs(x)>=0.5 THEN 'moderate' WHEN abs(x)>=0.3 THEN 'weak' ELSE 'negligible' END AS strength,
  CASE WHEN abs(x)<0.01 THEN '***' WHEN abs(x)<0.05 THEN '**' WHEN abs(x)<0.1 THEN '*' ELSE '' END AS stars, {r('sign(x)')} AS direction,
  {r('CASE WHEN x IS NULL THEN 1.0 ELSE (1.0+x)/2 END', 6)} AS mean_present FROM d""")
def scalar_scores(spark, sf):
    d = T.prices(spark, sf).withColumn("x", W_.momentum("value", 1))
    return rounded(d.select("series_id", "ts", coerce.scaled(F.col("x") * 100, -20, 20).alias("momentum_score"), coerce.clipped("x", -1, 1).alias("clipped"),
                            coerce.strength_label("x").alias("strength"), coerce.significance_stars(F.abs("x")).alias("stars"),
                            F.signum("x").alias("direction"), coerce.mean_present(F.lit(1.0), "x").alias("mean_present")), 4, clipped=6, mean_present=6)


@query("common_span", f"WITH {MARKET}, s AS (SELECT series_id, min(ts) lo, max(ts) hi FROM market GROUP BY 1) SELECT max(lo) AS start, min(hi) AS \"end\" FROM s")
def common_span(spark, sf):
    return S.common_span(T.market_prices(spark, sf))


@query("month_tercile_rank", f"""WITH {VOLUME}, m AS (SELECT series_id, month(ts) AS month, sum(value) AS total FROM volume GROUP BY 1, 2)
 SELECT series_id, CAST(month AS BIGINT) AS month, {r('total')} AS total, {r('rank() OVER (PARTITION BY series_id ORDER BY total DESC) + (count(*) OVER (PARTITION BY series_id, total)-1)/2.0')} AS month_rank FROM m""")
def month_tercile_rank(spark, sf):
    m = T.volumes(spark, sf).groupBy("series_id", F.month("ts").alias("month")).agg(F.sum("value").alias("total"))
    return rounded(longs(m.withColumn("month_rank", W_.average_rank("total", ["series_id"], ascending=False))))


@query("market_tonnes_by_year", f"""WITH {VOLUME} SELECT series_id, CAST(year(ts) AS BIGINT) AS year, {r('sum(value*45.0/1000)')} AS tonnes,
 'ok' AS status FROM volume GROUP BY 1, 2""")
def market_tonnes_by_year(spark, sf):
    """Bags to tonnes with the weight the header states; without one the row is a refusal."""
    v = T.volumes(spark, sf).withColumn("header", F.concat("series_id", F.lit(" (1 bag = 45 Kg)")))
    v = v.withColumn("t", coerce.tonnes("value", coerce.bag_weight("header")))
    out = v.groupBy("series_id", F.year("ts").alias("year")).agg(F.sum("t").alias("tonnes"))
    return rounded(longs(out.withColumn("status", F.when(F.col("tonnes").isNotNull(), "ok").otherwise("unit not stated"))))
