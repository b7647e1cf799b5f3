"""Analysis modules: one row per series, pair or category, joined from per-key aggregates."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import GATES
from tidemark.functions.coerce import slug
from tidemark.operators import seasonal as M, series as S, stats, windows as W


def shown(c, digits: int) -> Column:
    """A figure as reports state it; the guard keeps last-bit differences from deciding a tie."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 0.013 * 10.0 ** -digits, digits)


def _join(parts, keys) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def _newest(rows: DataFrame, cols, keys=("series_id",)) -> DataFrame:
    """Per column the newest value that is not null."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in cols])


def price_module(series: DataFrame) -> DataFrame:
    """Level, averages, volatility, drawdown, momentum (in percent), trend and percentile of every price series."""
    rows = W.with_ema(W.with_ema(series, 7, "ema_7"), 30, "ema_30")
    base = stats.snapshot(series)
    ema = _newest(rows, ["ema_7", "ema_30"])
    growth = stats.cagr(series).select("series_id", "cagr_pct")
    fall = W.drawdown(series).select("series_id", "peak_ts", "trough_ts", "recovered")
    line = stats.trend(series, 90).select("series_id", "slope_pct", "r_squared", "regime", F.col("status").alias("trend_status"))
    year = stats.percentile_rank(series, 365, "1y").select("series_id", F.col("percentile").alias("percentile_1y"))
    every = stats.percentile_rank(series, None, "all").select("series_id", F.col("percentile").alias("percentile_all"))
    out = _join([base, ema, growth, fall, line, year, every], "series_id")
    two = ["latest", "sma_7", "sma_30", "sma_90", "ema_7", "ema_30", "cv_30", "roc_7", "roc_30", "roc_90", "cagr_pct", "max_drawdown_pct"]
    digits = {**{c: 2 for c in two}, "slope_pct": 4, "r_squared": 3, "percentile_1y": 1, "percentile_all": 1}
    return out.select(*[shown(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def arrival_module(series: DataFrame) -> DataFrame:
    """Daily, weekly and monthly totals, rolling means and growth of every volume series."""
    rows = series.select("series_id", "ts", "value", W.sma("value", 30).alias("mean_30"), W.sma("value", 90).alias("mean_90"),
                         W.rolling_cv("value", 30).alias("cv_30"))
    daily = _newest(rows, ["value", "mean_30", "mean_90", "cv_30"]).withColumnRenamed("value", "latest_daily")
    facts = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.max("ts").alias("as_of"), F.count("value").alias("observations"))
    weekly = stats.latest(S.resample(series, "W", "sum", "keep")).select("series_id", F.col("latest").alias("latest_weekly_total"))
    monthly = S.resample(series, "MS", "sum", "keep")
    growth = monthly.select("series_id", "ts", F.col("value").alias("latest_monthly_total"), W.growth_pct("value", 12).alias("yoy_pct"), W.growth_pct("value", 1).alias("mom_pct"))
    out = _join([facts, daily, weekly, _newest(growth, ["latest_monthly_total", "yoy_pct", "mom_pct"])], "series_id")
    digits = {c: 1 for c in ("latest_daily", "mean_30", "mean_90", "cv_30", "latest_weekly_total", "latest_monthly_total", "yoy_pct", "mom_pct")}
    return out.select(*[shown(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def relation_module(pairs: DataFrame, window: int = 90, max_lag: int = 30) -> DataFrame:
    """How two series move together: level correlation, ranks, rolling, best lag, elasticity of y to x."""
    p = stats.pearson(pairs).select("a", "b", "r", "p_value", "n", "status")
    s = stats.spearman(pairs).select("a", "b", F.col("r").alias("spearman_r"))
    roll = stats.rolling_corr(pairs, window)
    roll = _newest(roll, ["r"], ("a", "b")).withColumnRenamed("r", "rolling_r")
    lag = stats.best_lag(stats.correlogram(pairs, max_lag))
    e = stats.log_elasticity(pairs).select("a", "b", "elasticity", F.col("r_squared").alias("elasticity_r2"))
    out = _join([p, s, roll, lag, e], ["a", "b"])
    digits = {"r": 4, "p_value": 4, "spearman_r": 4, "rolling_r": 4, "best_r": 4, "elasticity": 4, "elasticity_r2": 3}
    return out.select(*[shown(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def export_module(monthly: DataFrame) -> DataFrame:
    """Growth of a monthly volume series; its relation to prices is ``relation_module`` on monthly pairs."""
    growth = monthly.select("series_id", "ts", W.growth_pct("value", 12).alias("yoy_pct"), W.growth_pct("value", 1).alias("mom_pct"))
    out = stats.cagr(monthly).select("series_id", "cagr_pct", "status", "available_n").join(_newest(growth, ["yoy_pct", "mom_pct"]), "series_id")
    return out.select("series_id", *[shown(c, 2).alias(c) for c in ("cagr_pct", "yoy_pct", "mom_pct")], "status", F.col("available_n").alias("observations"))


def rate_module(rate: DataFrame) -> DataFrame:
    """Latest level, growth and averages of a rate series."""
    rows = W.with_ema(rate, 30, "ema_30").withColumn("sma_30", W.sma("value", 30)).withColumn("sma_90", W.sma("value", 90))
    out = _join([stats.latest(rate), stats.cagr(rate).select("series_id", "cagr_pct", "status"), _newest(rows, ["sma_30", "sma_90", "ema_30"])], "series_id")
    digits = {"latest": 4, "cagr_pct": 2, "sma_30": 4, "sma_90": 4, "ema_30": 4}
    return out.select(*[shown(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def balance_actuals(balance: DataFrame) -> DataFrame:
    """Yearly series per category without the estimates."""
    return balance.where(~F.col("is_estimate") & F.col("year").isNotNull()).select(
        F.col("category").alias("series_id"), F.make_date("year", F.lit(1), F.lit(1)).alias("ts"), "value")


def balance_module(balance: DataFrame) -> DataFrame:
    """Latest actual, yearly change, growth and trend per category; estimates are only quoted."""
    actual = balance_actuals(balance)
    change = _newest(actual.withColumn("yoy_pct", W.growth_pct("value", 1)), ["yoy_pct"])
    last = stats.latest(actual).select("series_id", F.year("as_of").alias("latest_year"), F.col("latest").alias("latest_value"))
    est = balance.where("is_estimate").groupBy(F.col("category").alias("series_id")).agg(F.max("value").alias("estimate"))
    growth = stats.cagr(actual, GATES.annual).select("series_id", "cagr_pct", F.col("status").alias("cagr_status"))
    line = stats.trend(actual, None, 5).select("series_id", "slope_pct", "r_squared", "regime")
    out = _join([last, est, growth, line, change], "series_id")
    digits = {"latest_value": 2, "estimate": 2, "cagr_pct": 2, "slope_pct": 4, "r_squared": 3, "yoy_pct": 2}
    return out.select(*[shown(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def surplus(balance: DataFrame, supply: str = "Total Supply", demand: str = "Total Demand") -> DataFrame:
    """Supply minus demand per actual year."""
    p = S.align(balance_actuals(balance), [(supply, demand)])
    return p.select("ts", (F.col("x") - F.col("y")).alias("surplus"))


def balance_vs_price(balance: DataFrame, price: DataFrame, categories, varieties) -> DataFrame:
    """Yearly correlation of named balance lines with yearly prices, at the lower yearly gate."""
    both = balance_actuals(balance).unionByName(S.resample(price, "YS"))
    return stats.pearson(S.align(both, [(c, v) for c in categories for v in varieties]), GATES.annual)


def storage_module(series: DataFrame, regions) -> DataFrame:
    """Newest stock per region; trends of a sparse tracker are always refused."""
    spec = S.small_table(series.sparkSession, "series_id string", [(n,) for n in regions])
    known = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(
        F.max_by("value", "ts").alias("latest"), F.max("ts").alias("latest_ts"), F.count("value").alias("observations"))
    out = spec.join(known, "series_id", "left")
    return out.select("series_id", shown("latest", 0).alias("latest"), "latest_ts", F.coalesce("observations", F.lit(0)).alias("observations"),
                      F.when(F.col("latest").isNull(), "insufficient_evidence").otherwise("insufficient_evidence_for_trend").alias("status"))


def premium_profile(pairs: DataFrame) -> DataFrame:
    """Median premium of x over y, how often it is positive, its range."""
    rows = pairs.withColumn("_p", F.col("x") - F.col("y"))
    out = rows.groupBy("a", "b").agg(F.percentile("_p", 0.5).alias("median_premium"), F.avg("_p").alias("mean_premium"), F.min("_p").alias("min_premium"),
                                     F.max("_p").alias("max_premium"), F.avg((F.col("_p") > 0).cast("double")).alias("share_positive"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= GATES.correlation)


def exogenous(series: DataFrame, freq: str, names, monthly=()) -> DataFrame:
    """Driver table at a frequency.  A monthly source is refused at a finer one instead of being spread."""
    usable = [n for n in names if n not in monthly or freq in ("ME", "MS")]
    wide = S.panel(S.resample(series.where(F.col("series_id").isin(usable)), freq), usable)
    for n in names:
        if n not in usable:
            wide = wide.withColumn(n, F.lit(None).cast("double"))
    return wide.withColumn("refused", F.array(*[F.lit(n) for n in names if n not in usable]).cast("array<string>"))


def exogenous_candidates(series: DataFrame, freq: str, names, monthly=()) -> DataFrame:
    """Which drivers can serve at a frequency, with coverage and the reason when not."""
    spec = S.small_table(series.sparkSession, "series_id string, _coarse boolean", [(n, n in monthly and freq not in ("ME", "MS")) for n in names])
    have = S.resample(series, freq).groupBy("series_id").agg(F.count("value").alias("periods"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    reason = F.when(F.col("_coarse"), "monthly source, not spread over shorter periods").when(F.col("periods").isNull(), "no data")
    return spec.join(have, "series_id", "left").select("series_id", "periods", "from_ts", "to_ts", F.when(reason.isNull(), "ok").otherwise("insufficient_evidence").alias("status"),
                                                       reason.alias("reason"))


def component_rows(balance: DataFrame, pattern: str) -> DataFrame:
    """Lines whose label matches, one column per year label, with each line's mean."""
    hit = balance.where(slug("category").rlike(pattern))
    return hit.withColumn("line_mean", F.avg("value").over(Window.partitionBy("category"))).withColumn("vs_mean", F.col("value") - F.col("line_mean")).select(
        "category", "year", "value", "line_mean", "vs_mean", "is_estimate")


def supply_cards(volume: DataFrame, exports: DataFrame, balance: DataFrame) -> DataFrame:
    """Headline figures of supply and trade as (card, value, reference)."""
    monthly = M.same_month_comparison(volume.where("series_id = 'arrivals'"))
    last = monthly.orderBy(F.desc("ts")).limit(1).select(F.lit("arrivals latest month").alias("card"), F.col("actual").alias("value"), F.col("historical").alias("reference"))
    e = _newest(exports.withColumn("yoy_pct", W.growth_pct("value", 12)), ["value", "yoy_pct"])
    trade = e.select(F.lit("exports latest month, yoy %").alias("card"), "value", F.col("yoy_pct").alias("reference"))
    ratio = S.align(balance_actuals(balance), [("Total Supply", "Total Demand")]).withColumn("q", F.try_divide(F.col("x") - F.col("y"), F.col("y")) * 100)
    stock = ratio.agg(F.max_by("q", "ts").alias("value"), F.avg("q").alias("reference")).select(F.lit("stock to use %").alias("card"), "value", "reference")
    return last.unionByName(trade).unionByName(stock)
