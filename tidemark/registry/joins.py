"""Date joins, panels, matching of labels, set membership."""

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.registry.base import BALANCE, DRIVER, EXPORTS, MARKET, PAIRS, PRICE, VOLUME, longs, query, r, rounded
from tidemark.sources import tables as T


@query("align_pair", f"WITH {MARKET}, {PAIRS} SELECT a, b, ts, {r('x')} AS x, {r('y')} AS y FROM pr")
def align_pair(spark, sf):
    return rounded(S.align(T.market_prices(spark, sf), S.all_pairs(T.MARKETS)))


_PANEL_SQL = f"WITH {MARKET} SELECT ts, " + ", ".join(
    f"{r(f'max(CASE WHEN series_id={chr(39)}{m}{chr(39)} THEN value END)')} AS \"{m}\"" for m in T.MARKETS) + " FROM market GROUP BY ts"


@query("panel", _PANEL_SQL)
def panel(spark, sf):
    return rounded(S.panel(T.market_prices(spark, sf), T.MARKETS))


@query("panel_complete", f"WITH p AS ({_PANEL_SQL}) SELECT * FROM p WHERE " + " AND ".join(f'"{m}" IS NOT NULL' for m in T.MARKETS))
def panel_complete(spark, sf):
    return rounded(S.complete_rows(S.panel(T.market_prices(spark, sf), T.MARKETS)))


@query("calendar_join", f"WITH {PRICE}, {VOLUME} SELECT p.series_id, p.ts, {r('p.value')} AS value, {r('v.value')} AS arrivals FROM price p LEFT JOIN volume v ON v.ts = p.ts AND v.series_id = 'arrivals'")
def calendar_join(spark, sf):
    return rounded(S.on_calendar(T.prices(spark, sf), T.arrivals(spark, sf), "arrivals").select("series_id", "ts", "value", "arrivals"))


@query("ffill_join", f"""WITH {PRICE}, {DRIVER}, j AS (SELECT p.*, d.value AS q FROM price p LEFT JOIN driver d ON p.ts = d.ts)
 SELECT series_id, ts, {r('value')} AS value, {r(f'last_value(q IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS rate FROM j""")
def ffill_join(spark, sf):
    return rounded(S.carry_forward(T.prices(spark, sf), T.driver(spark, sf), "rate").select("series_id", "ts", "value", "rate"))


@query("asof_join", f"""WITH {PRICE}, {DRIVER} SELECT p.series_id, p.ts, {r('p.value')} AS value, {r('d.value')} AS rate FROM price p ASOF LEFT JOIN driver d ON p.ts >= d.ts""")
def asof_join(spark, sf):
    return rounded(S.carry_forward(T.prices(spark, sf), T.driver(spark, sf), "rate", off_calendar=True).select("series_id", "ts", "value", "rate"))


@query("nearest_asof", f"""WITH {MARKET}, q AS (SELECT series_id, ts, CAST(ts + 30 AS DATE) AS target FROM market)
 SELECT q.series_id, q.ts, q.target, {r("(SELECT value FROM market m WHERE m.series_id = q.series_id AND abs(date_diff('day', q.target, m.ts)) <= 2 ORDER BY abs(date_diff('day', q.target, m.ts)), m.ts LIMIT 1)")} AS nearest FROM q""")
def nearest_asof(spark, sf):
    m = T.market_prices(spark, sf)
    requests = m.select("series_id", "ts", F.date_add("ts", 30).alias("target"))
    return rounded(S.nearest(requests, m, "target", 2, "nearest"))


_CHANGE = f"""WITH {PRICE}, l AS (SELECT series_id, max(ts) AS latest_ts, arg_max(value, ts) AS latest FROM price GROUP BY 1),
 pv AS (SELECT p.series_id, max(p.ts) AS prev FROM price p JOIN l USING (series_id) WHERE p.ts < latest_ts GROUP BY 1),
 h AS (SELECT l.*, v.* FROM l JOIN pv USING (series_id), LATERAL (VALUES ('Previous observation', prev, 0), ('Week on week (WoW)', CAST(latest_ts - 7 AS DATE), 5),
  ('Fortnight on fortnight', CAST(latest_ts - 14 AS DATE), 6), ('Month on month (MoM)', CAST(latest_ts - INTERVAL 1 MONTH AS DATE), 10),
  ('Quarter on quarter (QoQ)', CAST(latest_ts - INTERVAL 3 MONTH AS DATE), 15), ('Year on year (YoY)', CAST(latest_ts - INTERVAL 12 MONTH AS DATE), 20)) AS v(horizon, target, tolerance)),
 g AS (SELECT h.series_id, horizon, latest_ts, latest, target, tolerance, max(p.ts) AS reference_ts, arg_max(p.value, p.ts) AS reference FROM h LEFT JOIN price p
  ON p.series_id = h.series_id AND p.ts <= h.target GROUP BY 1,2,3,4,5,6)"""


@query("change_by_horizon", _CHANGE + f""" SELECT series_id, horizon, latest_ts, {r('latest')} AS latest, reference_ts, {r('reference')} AS reference, {r('latest-reference')} AS change,
 {r('(latest-reference)/reference', 6)} AS change_pct, CASE WHEN reference_ts IS NULL THEN 'no earlier observation'
  WHEN tolerance > 0 AND date_diff('day', reference_ts, target) > tolerance THEN 'reference is ' || date_diff('day', reference_ts, target) || ' days before the target' ELSE '' END AS note FROM g""")
def change_by_horizon(spark, sf):
    return rounded(S.change_by_horizon(T.prices(spark, sf)), 4, change_pct=6)


@query("shifted_target", f"""WITH {MARKET}, h AS (SELECT m.*, unnest([7,14,30,60,90,120,180]) AS horizon FROM market m)
 SELECT h.series_id, h.ts, {r('h.value')} AS value, CAST(horizon AS BIGINT) AS horizon, {r('t.value')} AS target FROM h LEFT JOIN market t ON t.series_id = h.series_id AND t.ts = h.ts + CAST(horizon AS INTEGER)""")
def shifted_target(spark, sf):
    from tidemark.fixed import HORIZONS
    return rounded(longs(S.shifted_target(T.market_prices(spark, sf), HORIZONS).select("series_id", "ts", "value", "horizon", "target")))


@query("anti_unconfigured", """SELECT DISTINCT p_brand AS sheet FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || regionkey FROM (SELECT r_regionkey + 1 AS regionkey FROM region))""")
def anti_unconfigured(spark, sf):
    found = T.read(spark, sf, "part").select(F.col("p_brand").alias("sheet")).distinct()
    spec = T.read(spark, sf, "region").select(F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 1).cast("string")).alias("sheet"))
    return S.not_in_spec(found, spec, "sheet")


@query("semi_months", f"""WITH {PRICE}, {VOLUME}, m AS (SELECT month(ts) AS m, sum(value) AS s FROM volume WHERE series_id='arrivals' GROUP BY 1 QUALIFY row_number() OVER (ORDER BY sum(value) DESC, m) <= 4)
 SELECT series_id, ts, {r('value')} AS value FROM price WHERE month(ts) IN (SELECT m FROM m)""")
def semi_months(spark, sf):
    v = T.arrivals(spark, sf).groupBy(F.month("ts").alias("m")).agg(F.sum("value").alias("s"))
    top = v.orderBy(F.desc("s"), "m").limit(4)
    rows = S.only_in(T.prices(spark, sf).withColumn("m", F.month("ts")), top, "m")
    return rounded(rows.select("series_id", "ts", "value"))


@query("label_join", """SELECT r_name AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def label_join(spark, sf):
    left = T.read(spark, sf, "region").select(F.col("r_name").alias("label"), "r_regionkey")
    right = T.read(spark, sf, "region").select(F.concat(F.lit(" "), F.lower("r_name")).alias("label"), F.col("r_regionkey").alias("k"))
    n = T.read(spark, sf, "nation").select("n_regionkey")
    return S.by_label(left, right, "label").join(n, F.col("k") == F.col("n_regionkey")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_label", """SELECT o_orderpriority AS label, 2::BIGINT AS match_rank FROM orders WHERE o_orderpriority LIKE '%NOT SPECIFIED%' GROUP BY 1""")
def resolve_label(spark, sf):
    labels = T.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    return longs(S.resolve_label(labels, "Not Specified"))


@query("year_join", f"""WITH {PRICE}, {BALANCE}, y AS (SELECT series_id, year(ts) AS year, avg(value) AS price FROM price GROUP BY 1, 2)
 SELECT y.series_id, CAST(y.year AS BIGINT) AS year, {r('price')} AS price, {r('b.value')} AS supply FROM y JOIN balance b ON b.year = y.year AND b.category = 'Total Supply' AND NOT b.is_estimate""")
def year_join(spark, sf):
    y = S.resample(T.prices(spark, sf), "YE").select("series_id", F.year("ts").alias("year"), F.col("value").alias("price"))
    b = T.balance(spark, sf).where("category = 'Total Supply' and not is_estimate").select("year", F.col("value").alias("supply"))
    return rounded(longs(y.join(b, "year")))


@query("offtake_ratio", f"""WITH {VOLUME}, j AS (SELECT a.ts, o.value / a.value AS ratio FROM volume a JOIN volume o ON a.ts = o.ts AND a.series_id = 'arrivals' AND o.series_id = 'offtake' AND o.value IS NOT NULL)
 SELECT {r('arg_max(ratio, ts)', 6)} AS latest_ratio, {r('avg(ratio)', 6)} AS mean_ratio, count(*) AS n FROM j""")
def offtake_ratio(spark, sf):
    rows = S.align(T.volumes(spark, sf), [("arrivals", "offtake")]).withColumn("ratio", F.try_divide("y", "x"))
    return rounded(rows.agg(F.max_by("ratio", "ts").alias("latest_ratio"), F.avg("ratio").alias("mean_ratio"), F.count(F.lit(1)).alias("n")), 6)


_SHORT = {"Previous observation": "prev", "Week on week (WoW)": "wow", "Month on month (MoM)": "mom", "Year on year (YoY)": "yoy"}


@query("snapshots", _CHANGE + " SELECT series_id, latest_ts, " + r("latest") + " AS latest, " + ", ".join(
    f"{r(f'max(CASE WHEN horizon={chr(39)}{k}{chr(39)} THEN (latest-reference)/reference END)', 6)} AS {v}" for k, v in _SHORT.items()) + " FROM g GROUP BY series_id, latest_ts, latest")
def snapshots(spark, sf):
    c = S.change_by_horizon(T.prices(spark, sf))
    wide = c.groupBy("series_id", "latest_ts", "latest").pivot("horizon", list(_SHORT)).agg(F.first("change_pct"))
    return rounded(wide.withColumnsRenamed(_SHORT), 6, latest=4)


@query("rebase_panel", f"""WITH {MARKET}, {EXPORTS} SELECT p.series_id, e.ts, {r('avg(p.value)')} AS price, {r('max(e.value)')} AS exports FROM market p JOIN exports e ON CAST(date_trunc('month', p.ts) AS DATE) = e.ts GROUP BY 1, 2""")
def rebase_panel(spark, sf):
    monthly = S.resample(T.market_prices(spark, sf), "MS").select("series_id", "ts", F.col("value").alias("price"))
    return rounded(S.on_calendar(monthly, T.exports(spark, sf), "exports").where("exports is not null").select("series_id", "ts", "price", "exports"))
