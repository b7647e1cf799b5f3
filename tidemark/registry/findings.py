"""Insights and streaming."""

from functools import cached_property

from pyspark.sql import functions as F

from tidemark.operators import quality as Q, regress as G, reshape, seasonal as M, series as S, stats, windows as W
from tidemark.plans import insights as I, modules as X, scores as Z
from tidemark.registry.base import DRIVER, MARKET, PAIRS, PRICE, longs, query
from tidemark.registry.landing import STOCK
from tidemark.sources import grids, store, tables as T
from tidemark.streaming import live, runner


class Inputs:
    """Series of one data set, each landed once and shared by every generator that reads it."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def prices(self):
        return store.landed(T.prices(self.spark, self.sf))

    @cached_property
    def markets(self):
        return store.landed(T.market_prices(self.spark, self.sf))

    @cached_property
    def volumes(self):
        return store.landed(T.volumes(self.spark, self.sf))

    @cached_property
    def arrivals(self):
        return self.volumes.where("series_id = 'arrivals'")

    @cached_property
    def market_pairs(self):
        return S.align(self.markets, S.all_pairs(T.MARKETS))

    @cached_property
    def verdicts(self):
        pairs = store.landed(S.align(S.resample(self.markets, "W"), S.all_pairs(T.MARKETS)))
        return store.landed(G.influence(pairs, stats.lead_lag(stats.cross_correlation(pairs))))

    def months(self, name, rows):
        both = S.resample(self.prices, "ME").unionByName(S.resample(rows, "ME"))
        return store.landed(S.align(both, [(name, v) for v in T.VARIETIES]))


def leadership(d):
    return I.leadership(G.leadership(d.verdicts)).unionByName(I.sentiment_proxy(stats.pearson(d.market_pairs)))


def integration(d):
    return I.integration(d.verdicts, G.johansen(S.resample(d.markets, "W"), T.MARKETS), "ASIA")


def arrivals(d):
    both = S.resample(d.prices, "W").unionByName(S.resample(d.arrivals, "W", "sum"))
    p = store.landed(S.align(both, [("arrivals", v) for v in T.VARIETIES]))
    return I.arrivals(stats.elasticity_by_lag(p), stats.thresholds(p), stats.threshold_test(p), stats.lagged_impact(p))


def seasonality(d):
    return I.seasonality(M.month_table(d.prices), M.variance_shares(M.decompose(d.prices, "ME")), M.season_profile(d.arrivals))


def exports(d):
    p = d.months("exports", T.exports(d.spark, d.sf))
    return I.relation(stats.pair_summary(p), stats.lead_lag(stats.cross_correlation(p)), stats.rolling_corr(p, 24), "Exports", "exports")


def currency(d):
    rate = store.landed(T.driver(d.spark, d.sf))
    p = d.months("driver", rate)
    return I.currency(W.coverage_gaps(rate, 4), stats.pair_summary(p), G.granger(p), "driver")


def balance(d):
    b = T.balance(d.spark, d.sf)
    flat = store.landed(b.groupBy("year", "is_estimate").agg(F.max(F.when(F.col("category") == "Total Supply", F.col("value"))).alias("s"), F.max(F.when(F.col("category") == "Total Demand", F.col("value"))).alias("d")))
    stock = flat.select("year", "is_estimate", (F.try_divide(F.col("s") - F.col("d"), F.col("d")) * 100).alias("value")).where("value is not null")
    ratio = stock.select(F.lit("stock").alias("series_id"), F.make_date("year", F.lit(1), F.lit(1)).alias("ts"), "value")
    yearly = S.align(ratio.unionByName(S.resample(d.prices, "YS")), [("stock", v) for v in T.VARIETIES])
    return I.balance(stock, yearly, flat.select("year", F.col("s").alias("value")))


def storage(d):
    records = reshape.sparse_records(reshape.parse_tracker(store.landed(grids.tracker_sheet(d.spark, d.sf)), STOCK))
    return I.storage(records, X.premium_profile(d.market_pairs))


def volatility(d):
    w = S.resample(d.prices, "W")
    return I.volatility(W.bands(w, 30), W.outliers(w, 30))


def data_quality(d):
    return I.data_quality(Q.quality_notes(d.markets, 4))


GENERATORS = {"Price leadership": leadership, "Market integration": integration, "Arrivals impact": arrivals, "Seasonality": seasonality, "Exports": exports,
              "Currency": currency, "Balance sheet": balance, "Cold storage": storage, "Volatility": volatility, "Data quality": data_quality}


def _flat(df):
    return df.withColumn("evidence", F.array_join("evidence", "; "))


for _name, _fn in GENERATORS.items():
    if _fn not in (data_quality,):
        @query("insights_" + _fn.__name__)
        def _one(spark, sf, fn=_fn):
            return _flat(fn(Inputs(spark, sf)))


@query("insights_data_quality", f"""WITH {MARKET}, g AS (SELECT series_id, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS f, ts AS t FROM market), d AS (SELECT *, date_diff('day', f, t) AS days FROM g WHERE date_diff('day', f, t) > 4)
 SELECT 'Data quality' AS category, series_id || ' has a coverage limitation' AS headline, series_id || ': ' || count(*) || ' coverage gap(s) over 4 days; the largest spans ' || max(days) || ' days (' || arg_max(f, struct_pack(a := days, b := f)) || ' to ' || arg_max(t, struct_pack(a := days, b := f)) || ')' AS detail,
 'data gap' AS strength, 'n/a' AS direction, '' AS evidence FROM d GROUP BY series_id""")
def insights_data_quality(spark, sf):
    return _flat(data_quality(Inputs(spark, sf)))


@query("insights_storage_premium", f"""WITH {MARKET}, {PAIRS}, p AS (SELECT a, b, quantile_cont(x-y, 0.5) AS m, avg(CASE WHEN x-y > 0 THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM pr GROUP BY 1, 2)
 SELECT 'Cold storage' AS category, a || ' trades at a median premium of ' || printf('%.0f', m) || ' over ' || b AS headline, 'dearer on ' || printf('%.0f', s*100) || ' % of ' || n || ' common days' AS detail, 'strong' AS strength, 'n/a' AS direction FROM p""")
def insights_storage_premium(spark, sf):
    return storage(Inputs(spark, sf)).where("headline like '%median premium%'").drop("evidence")


@query("insights")
def insights(spark, sf):
    d = Inputs(spark, sf)
    found, failed = I.generate_all({n: (lambda f=f: f(d)) for n, f in GENERATORS.items()})
    return longs(_flat(I.with_failures(spark, found, failed)))


@query("executive_highlights")
def executive_highlights(spark, sf):
    d = Inputs(spark, sf)
    found, failed = I.generate_all({n: (lambda f=f: f(d)) for n, f in GENERATORS.items()})
    return longs(_flat(I.highlights(I.with_failures(spark, found, failed))))


@query("module_runs", f"""WITH {PRICE}, s AS (SELECT count(DISTINCT series_id) AS n FROM price) SELECT * FROM (VALUES ('price', 'ok', (SELECT n FROM s)), ('arrivals', 'ok', 2), ('broken', 'failed', NULL), ('after_broken', 'skipped', NULL), ('votes', 'ok', (SELECT n FROM s)))
 AS t(module, status, rows)""")
def module_runs(spark, sf):
    """A run over modules of which one fails in a task: its own status says so, the one that needs it is skipped, the others have results."""
    p = T.prices(spark, sf)
    steps = [runner.Module("price", lambda t: X.price_module(t["prices"]), ("prices",)), runner.Module("arrivals", lambda t: X.arrival_module(t["volumes"]), ("volumes",)),
             runner.Module("broken", lambda t: t["prices"].withColumn("value", F.raise_error(F.concat(F.lit("no value for "), "series_id"))), ("prices",)),
             runner.Module("after_broken", lambda t: t["broken"], ("broken",)),
             runner.Module("votes", lambda t: Z.votes(t["price"], M.same_month_comparison(t["prices"]), t["arrivals"]), ("price", "prices", "arrivals"))]
    return runner.run_modules(spark, steps, {"prices": p, "volumes": T.volumes(spark, sf)}, live.workspace(spark, "modules"), "r1").drop("reason")


# ---- streaming --------------------------------------------------------------------------------------------------

def _events(spark, sf):
    path = f"{sf}/events.parquet"
    return live.file_stream(spark, path, spark.read.parquet(path).schema, glob="*")


@query("stream_daily_totals", """SELECT event_type AS series_id, CAST(ts AS DATE) AS ts, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def stream_daily_totals(spark, sf):
    """The live period table after the stream has caught up equals the batch aggregate."""
    out = live.workspace(spark, "daily-totals")
    live.run_to_end(live.write_batches(_events(spark, sf), out, lambda batch: live.period_parts(batch, "event_type")))
    return live.live_periods(spark, out)


@query("stream_last_wins", """SELECT event_type AS series_id, CAST(ts AS DATE) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def stream_last_wins(spark, sf):
    """Corrections arrive as new rows; the newest one per series and day counts."""
    out = live.workspace(spark, "last-wins")
    live.run_to_end(live.write_batches(_events(spark, sf).select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ts"), "value", "event_id"), out))
    return S.keep_last(live.without_repeats(spark, out, ["event_id"]), "event_id")


def _periods(width: str, start: str) -> str:
    return f"""SELECT event_type AS series_id, CAST({start} AS DATE) AS ts, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high
FROM events GROUP BY 1, 2"""


@query("stream_weekly_totals", _periods("week", "date_trunc('week', ts)"))
def stream_weekly_totals(spark, sf):
    """Weeks from Monday, kept live from daily parts."""
    return _from_daily_parts(spark, sf, F.date_trunc("week", F.col("period")))


@query("stream_half_month_totals", _periods("half", "date_trunc('month', ts) + CASE WHEN day(ts) > 15 THEN INTERVAL 15 DAY ELSE INTERVAL 0 DAY END"))
def stream_half_month_totals(spark, sf):
    """Halves of months, from the 1st and the 16th, kept live from daily parts."""
    return _from_daily_parts(spark, sf, F.date_add(F.trunc(F.to_date("period"), "month"), F.when(F.dayofmonth("period") > 15, 15).otherwise(0)))


@query("stream_monthly_totals", _periods("month", "date_trunc('month', ts)"))
def stream_monthly_totals(spark, sf):
    return _from_daily_parts(spark, sf, F.date_trunc("month", F.col("period")))


def _from_daily_parts(spark, sf, start):
    """Longer periods need no state of their own: they are sums of the daily parts."""
    out = live.workspace(spark, "period-totals")
    live.run_to_end(live.write_batches(_events(spark, sf), out, lambda batch: live.period_parts(batch, "event_type")))
    parts = spark.read.parquet(f"{out}/data").withColumn("ts", start.cast("date"))
    total = parts.groupBy("series_id", "ts").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return total.select("series_id", "ts", "n", "total", "low", "high")


@query("retrain_gate", f"WITH {PRICE} SELECT max(ts) AS trained_through, false AS again FROM price")
def retrain_gate(spark, sf):
    """After a training is noted the same data does not ask for another one."""
    p, state = T.prices(spark, sf), live.workspace(spark, "state")
    newest = p.agg(F.max("ts").alias("trained_through"))
    if live.retrain_needed(spark, p, state):
        store.save_trained_through(spark, state, newest.first()[0], "r1")
    return newest.withColumn("again", F.lit(live.retrain_needed(spark, p, state)))


@query("result_store", f"WITH {PRICE} SELECT series_id, max(ts) AS as_of, count(*) AS n, 'r2' AS refresh_id FROM price GROUP BY 1")
def result_store(spark, sf):
    """Two refreshes are kept; readers get the newest."""
    out = live.workspace(spark, "gold")
    rows = T.prices(spark, sf).groupBy("series_id").agg(F.max("ts").alias("as_of"), F.count("value").alias("n"))
    for rid in ("r1", "r2"):
        store.append_result(rows, out, rid)
    return store.read_result(spark, out)


@query("results_as_json", f"WITH {PRICE} SELECT series_id, CAST(max(ts) AS VARCHAR) AS as_of, count(*) AS n FROM price GROUP BY 1")
def results_as_json(spark, sf):
    """Result rows survive the trip through one JSON text each."""
    out = live.workspace(spark, "json")
    rows = T.prices(spark, sf).groupBy("series_id").agg(F.max("ts").cast("string").alias("as_of"), F.count("value").alias("n"))
    store.append_json(store.as_json(rows, "series_id"), out)
    back = spark.read.schema("series_id string, result string").json(out)
    return back.select("series_id", F.from_json("result", "as_of string, n bigint").alias("r")).select("series_id", "r.*")


@query("csv_export", f"WITH {DRIVER} SELECT ts, count(*) AS n FROM driver GROUP BY 1")
def csv_export(spark, sf):
    out = live.workspace(spark, "csv")
    store.write_csv(T.driver(spark, sf).groupBy("ts").agg(F.count("value").alias("n")), out)
    return spark.read.option("header", True).schema("ts date, n bigint").csv(out)
