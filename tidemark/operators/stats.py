"""Per-series and pairwise statistics: one aggregate each, all series and all pairs in the same job."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import GATES
from tidemark.functions import tails
from tidemark.functions.coerce import refusal, strength_label
from tidemark.operators import windows as W
from tidemark.operators.series import by_pair, by_series, small_table


def safe_corr(x: str, y: str) -> Column:
    """Pearson r; null when either side is constant."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


# ---- one series ------------------------------------------------------------------------------------------------

def snapshot(series: DataFrame) -> DataFrame:
    """Latest value with moving averages, volatility, momentum and deepest drawdown: one sort, one aggregate."""
    known = series.where(F.col("value").isNotNull())
    top = F.max("value").over(by_series().rowsBetween(Window.unboundedPreceding, 0))
    cols = {f"sma_{n}": W.sma("value", n) for n in (7, 30, 90)}
    cols["cv_30"] = W.rolling_cv("value", 30)
    cols.update({f"roc_{n}": W.momentum("value", n) * 100 for n in (7, 30, 90)})
    wide = known.select("series_id", "ts", "value", *[c.alias(k) for k, c in cols.items()],
                        F.try_divide(F.col("value") - top, top).alias("_dd"))
    newest = F.max_by(F.struct("value", *cols), "ts")
    out = wide.groupBy("series_id").agg(F.max("ts").alias("as_of"), newest.alias("_l"), (F.min("_dd") * 100).alias("max_drawdown_pct"),
                                        F.count("value").alias("observations"))
    status = F.when(F.col("observations") >= GATES.correlation, "ok").otherwise("insufficient_evidence")
    return out.select("series_id", "as_of", F.col("_l.value").alias("latest"), *[F.col(f"_l.{k}").alias(k) for k in cols],
                      "max_drawdown_pct", "observations", status.alias("status"))


def latest(series: DataFrame) -> DataFrame:
    known = series.where(F.col("value").isNotNull())
    return known.groupBy("series_id").agg(F.max("ts").alias("as_of"), F.max_by("value", "ts").alias("latest"))


def describe(series: DataFrame) -> DataFrame:
    known = series.where(F.col("value").isNotNull())
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    out = known.groupBy("series_id").agg(
        F.count("value").alias("observations"), F.avg("value").alias("mean"), q.alias("_q"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("excess_kurtosis"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select(
        "series_id", "observations", "mean", F.col("_q")[1].alias("median"), "sd", F.try_divide("sd", "mean").alias("cv"), "minimum",
        F.col("_q")[0].alias("p25"), F.col("_q")[2].alias("p75"), "maximum", (F.col("maximum") - F.col("minimum")).alias("range"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "skewness", "excess_kurtosis", "first_ts", "last_ts",
        F.when(F.col("observations") >= GATES.describe, "ok").otherwise("insufficient_evidence").alias("status"))


def percentile_rank(series: DataFrame, window: int | None, scope: str) -> DataFrame:
    """Where the latest value stands in its own history or in its trailing N observations."""
    known = series.where(F.col("value").isNotNull())
    newest = Window.partitionBy("series_id").orderBy(F.desc("ts"))
    ranked = known.withColumn("_k", F.row_number().over(newest)).withColumn("_last", F.first("value").over(newest))
    if window is not None:
        ranked = ranked.where(F.col("_k") <= window)
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    share = F.avg((F.col("value") <= F.col("_last")).cast("double")) * 100
    out = ranked.groupBy("series_id").agg(F.max("_last").alias("latest"), share.alias("percentile"), F.min("value").alias("minimum"),
                                          q.alias("_q"), F.max("value").alias("maximum"), F.count("value").alias("observations"))
    return out.select("series_id", F.lit(scope).alias("scope"), "latest", "percentile", "minimum", F.col("_q")[0].alias("q1"),
                      F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "maximum", "observations")


def cagr(series: DataFrame, gate: int = GATES.correlation, keys=("series_id",)) -> DataFrame:
    known = series.where(F.col("value").isNotNull())
    agg = known.groupBy(*keys).agg(
        F.count("value").alias("_n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.min_by("value", "ts").alias("start_value"), F.max_by("value", "ts").alias("end_value"))
    years = F.datediff("end_ts", "start_ts") / 365.25
    usable = (years > 0) & (F.col("start_value") > 0)
    value = F.when((F.col("_n") >= gate) & usable, (F.pow(F.col("end_value") / F.col("start_value"), 1.0 / years) - 1) * 100)
    enough = F.col("_n") >= gate
    return agg.select(
        *keys, value.alias("cagr_pct"), "start_ts", "end_ts", "start_value", "end_value", years.alias("years"),
        F.when(enough & usable, "ok").otherwise("insufficient_evidence").alias("status"),
        F.when(~enough, "too few observations").when(~usable, "start value or span not positive").alias("reason"),
        F.col("_n").alias("available_n"), F.lit(gate).cast("long").alias("required_n"))


def trend(series: DataFrame, window: int | None = 90, gate: int = GATES.trend, keys=("series_id",)) -> DataFrame:
    """Least-squares line over the last N observations: slope in % of the mean, fit, regime."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    k = F.row_number().over(newest)
    rows = series.where(F.col("value").isNotNull()).withColumn("_k", k)
    if window is not None:
        rows = rows.where(F.col("_k") <= window)
    x = (-F.col("_k")).cast("double")
    agg = rows.withColumn("_x", x).groupBy(*keys).agg(
        F.regr_slope("value", "_x").alias("_b"), F.avg("value").alias("_m"), F.count("value").alias("_n"),
        F.regr_r2("value", "_x").alias("_r2"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    r2 = F.when(F.col("_lo") < F.col("_hi"), F.col("_r2")).otherwise(0.0)
    slope = F.coalesce(F.try_divide("_b", "_m") * 100, F.lit(0.0))
    out = agg.withColumn("slope_pct", slope).withColumn("r_squared", r2)
    regime = (F.when((F.col("r_squared") >= 0.3) & (F.col("slope_pct") > 0.05), "uptrend")
              .when((F.col("r_squared") >= 0.3) & (F.col("slope_pct") < -0.05), "downtrend").otherwise("range_bound"))
    ok = F.col("_n") >= gate
    return out.select(*keys, F.when(ok, F.col("slope_pct")).alias("slope_pct"), F.when(ok, F.col("r_squared")).alias("r_squared"),
                      F.when(ok, regime).alias("regime"), *refusal("_n", gate, "too few observations in the window"))


BATTERY_LAGS = (1, 2, 3, 5, 10)


def battery(series: DataFrame, window: int = GATES.rolling_window) -> DataFrame:
    """The standard battery of every series as rows: series_id, section, statistic, ``value``, ``status``.

    Sections: descriptive, rolling (at the newest observation), changes, outliers (rule of three deviations over the full sample),
    autocorrelation (biased, full-sample mean), drawdown, trend (per observation, in % of the mean) and seasonal index (month mean over
    mean).  Everything comes from one sort of the series and one aggregate on the same partitioning, so the rows move once.
    A section below its minimum sample is refused: null values and the status insufficient_evidence.  Null values are not observations.
    """
    whole, order = Window.partitionBy("series_id"), by_series()
    upto, last_n = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1 - window, 0)
    v, dev = F.col("value"), F.col("_d")
    rows = series.where(v.isNotNull()).select("series_id", "ts", "value", F.avg(v).over(whole).alias("_mu"), F.stddev_samp(v).over(whole).alias("_sd"), F.row_number().over(order).cast("double").alias("_x"),
                                              F.max(v).over(upto).alias("_top"), F.lag(v).over(order).alias("_p"), F.lag("ts").over(order).alias("_pt"), F.avg(v).over(last_n).alias("_rm"),
                                              F.stddev_samp(v).over(last_n).alias("_rs"), F.count(v).over(last_n).alias("_rn")).withColumn("_d", v - F.col("_mu"))
    rows = rows.select("*", *[(dev * F.lag("_d", k).over(order)).alias(f"_g{k}") for k in BATTERY_LAGS])
    change = F.try_divide(v - F.col("_p"), F.col("_p")) * 100
    newest = lambda c: F.max_by(c, "ts")
    full = F.col("_rn") >= window
    parts = {
        "descriptive": {"mean": F.avg(v), "sd": F.stddev_samp(v), "cv": F.try_divide(F.stddev_samp(v), F.avg(v)), "minimum": F.min(v), "median": F.percentile(v, 0.5), "maximum": F.max(v)},
        "rolling": {"mean": newest(F.when(full, F.col("_rm"))), "sd": newest(F.when(full, F.col("_rs"))), "z": newest(F.when(full, F.try_divide(v - F.col("_rm"), F.col("_rs"))))},
        "changes": {"latest_pct": newest(change), "mean_abs_pct": F.avg(F.abs(change)), "up_share_pct": F.avg((v > F.col("_p")).cast("double")) * 100, "largest_rise_pct": F.max(change), "largest_fall_pct": F.min(change),
                    "longest_gap_days": F.max(F.datediff("ts", "_pt")).cast("double")},
        "outliers": {"beyond_3_sd": F.count_if(F.abs(F.try_divide(dev, F.col("_sd"))) > GATES.outlier_z).cast("double"), "latest_z": newest(F.try_divide(dev, F.col("_sd")))},
        "autocorrelation": {f"lag_{k}": F.try_divide(F.sum(f"_g{k}"), F.sum(dev * dev)) for k in BATTERY_LAGS},
        "drawdown": {"deepest_pct": F.min(F.try_divide(v - F.col("_top"), F.col("_top"))) * 100, "latest_pct": newest(F.try_divide(v - F.col("_top"), F.col("_top"))) * 100},
        "trend": {"slope_pct": F.try_divide(F.regr_slope(v, F.col("_x")), F.avg(v)) * 100, "r_squared": F.when(F.min(v) < F.max(v), F.regr_r2(v, F.col("_x")))},
        "seasonal_index": {f"month_{m}": F.try_divide(F.avg(F.when(F.month("ts") == m, v)), F.avg(v)) for m in range(1, 13)},
    }
    n, span = F.col("_n"), F.col("_span")
    enough = {"descriptive": n >= GATES.describe, "rolling": n >= window, "changes": n >= 2, "outliers": n >= GATES.outliers, "autocorrelation": n >= 20, "drawdown": n >= 2, "trend": n >= GATES.trend,
              "seasonal_index": span >= 365 * GATES.seasonal_years}
    flat = [(section, name, f"{section}__{name}", c) for section, cols in parts.items() for name, c in cols.items()]
    wide = rows.groupBy("series_id").agg(F.count(v).alias("_n"), F.datediff(F.max("ts"), F.min("ts")).alias("_span"), *[c.alias(key) for _, _, key, c in flat])
    cells = [F.struct(F.lit(section).alias("section"), F.lit(name).alias("statistic"), F.when(enough[section], F.col(key)).alias("value"),
                      F.when(enough[section], "ok").otherwise("insufficient_evidence").alias("status")) for section, name, key, _ in flat]
    return wide.select("series_id", F.inline(F.array(*cells)))


# ---- pairs -------------------------------------------------------------------------------------------------------

def pearson(pairs: DataFrame, gate: int = GATES.correlation, keys=("a", "b")) -> DataFrame:
    """r, t, p and n per pair from one aggregate; thin or constant pairs are refused with a reason."""
    agg = pairs.groupBy(*keys).agg(safe_corr("x", "y").alias("_r"), F.count(F.lit(1)).alias("n"))
    enough, varies = F.col("n") >= gate, F.col("_r").isNotNull()
    rr = F.when(enough, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r"))))
    out = agg.withColumn("r", rr).withColumn(
        "t", F.try_divide(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)).cast("double")), F.sqrt(1 - F.col("r") * F.col("r"))))
    return out.select(*keys, "r", "t", tails.student_p(F.col("t"), F.col("n") - 2).alias("p_value"), (F.col("r") * F.col("r")).alias("r_squared"),
                      "n", F.when(enough & varies, "ok").otherwise("insufficient_evidence").alias("status"),
                      F.when(~enough, "too few aligned observations").when(~varies, "a side is constant").alias("reason"))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """The pair columns replaced by their average ranks."""
    return pairs.select("a", "b", "ts", W.average_rank("x", ["a", "b"]).alias("x"), W.average_rank("y", ["a", "b"]).alias("y"))


def spearman(pairs: DataFrame, gate: int = GATES.correlation) -> DataFrame:
    return pearson(ranked_pairs(pairs), gate)


def pair_summary(pairs: DataFrame, gate: int = GATES.correlation) -> DataFrame:
    p = pearson(pairs, gate).select("a", "b", F.col("r").alias("pearson_r"), F.col("p_value").alias("pearson_p"), "r_squared", "n",
                                    strength_label("r").alias("strength"))
    s = spearman(pairs, gate).select("a", "b", F.col("r").alias("spearman_rho"), F.col("p_value").alias("spearman_p"))
    return p.join(s, ["a", "b"])


def symmetric_matrix(pairs: DataFrame, value: str, names) -> DataFrame:
    """Both halves and the unit diagonal of a one-sided pair table, one column per name."""
    both = pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    diag = small_table(pairs.sparkSession, f"a string, b string, {value} double", [(n, n, 1.0) for n in names])
    return both.unionByName(diag).groupBy("a").pivot("b", list(names)).agg(F.first(value))


def rolling_corr(pairs: DataFrame, n: int) -> DataFrame:
    frame = by_pair().rowsBetween(-(n - 1), 0)
    sx, sy = F.stddev_pop("x").over(frame), F.stddev_pop("y").over(frame)
    r = F.when(F.count("x").over(frame) == n, F.try_divide(F.covar_pop("x", "y").over(frame), F.when((sx > 0) & (sy > 0), sx * sy)))
    return pairs.withColumn("r", r)


def _at_lags(pairs: DataFrame, lags) -> DataFrame:
    """Each row once per lag with the y of that lag: all lags come out of one sort, and the aggregate that follows
    combines before anything is shuffled."""
    options = F.expr("array(" + ", ".join(f"named_struct('lag', {k}, 'y', lead(y, {k}) over (partition by a, b order by ts))" for k in lags) + ")")
    return (pairs.withColumn("_l", options).select("a", "b", "ts", "x", F.explode("_l").alias("_l"))
            .select("a", "b", "ts", "x", "_l.lag", "_l.y").where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def correlogram(pairs: DataFrame, max_lag: int, gate: int = GATES.correlation) -> DataFrame:
    """Correlation of x_t with y_(t+lag) on levels; a positive lag means x moves first."""
    return (_at_lags(pairs, range(-max_lag, max_lag + 1)).groupBy("a", "b", "lag")
            .agg(safe_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= gate))


def best_lag(curve: DataFrame) -> DataFrame:
    """Lag with the largest |r|; the smallest lag wins ties."""
    key = F.when(F.col("r").isNotNull(), F.struct(F.abs("r").alias("s"), (-F.col("lag")).alias("l")))
    return curve.groupBy("a", "b").agg(F.max_by("lag", key).alias("best_lag"), F.max_by("r", key).alias("best_r"))


def differenced(pairs: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.lag("x").over(by_pair()), F.col("y") - F.lag("y").over(by_pair())
    return pairs.select("a", "b", "ts", dx.alias("x"), dy.alias("y")).where(F.col("x").isNotNull())


def cross_correlation(pairs: DataFrame, max_lag: int = GATES.max_lag, on_changes: bool = True) -> DataFrame:
    """Cross-correlation of changes with its 95 % band; short pairs use fewer lags."""
    base = differenced(pairs) if on_changes else pairs
    w = Window.partitionBy("a", "b")
    sized = base.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_g", F.datediff("ts", F.lag("ts").over(by_pair())))
    spacing = sized.groupBy("a", "b").agg(F.coalesce(F.percentile("_g", 0.5), F.lit(1.0)).alias("days_per_lag"), F.max("_n").alias("total_n"))
    lag_limit = F.when(F.col("total_n") < max(3 * max_lag, GATES.correlation),
                       F.greatest(F.lit(1), F.least(F.lit(max_lag), F.floor(F.col("total_n") / 4)))).otherwise(max_lag)
    curve = (_at_lags(base, range(-max_lag, max_lag + 1)).groupBy("a", "b", "lag")
             .agg(safe_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")))
    out = curve.join(spacing, ["a", "b"]).where((F.col("total_n") >= GATES.correlation) & (F.abs("lag") <= lag_limit)
                                                & (F.col("n") >= max(10, GATES.correlation // 3)) & F.col("r").isNotNull())
    band = 1.96 / F.sqrt(F.col("n").cast("double"))
    return out.select("a", "b", "lag", "r", "n", band.alias("band"), (F.abs("r") > band).alias("significant"), "days_per_lag")


def lead_lag(ccf: DataFrame) -> DataFrame:
    """Peak of the cross-correlation per pair, the value at lag zero, and who moves first."""
    key = F.struct(F.abs("r").alias("s"), (-F.col("lag")).alias("l"))
    out = ccf.groupBy("a", "b").agg(F.max_by(F.struct("lag", "r", "n", "significant", "days_per_lag"), key).alias("p"),
                                    F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("zero_lag_r"))
    lag = F.col("p.lag")
    days = lag * F.col("p.days_per_lag")
    leader = F.when(lag > 0, F.col("a")).when(lag < 0, F.col("b")).otherwise("contemporaneous")
    text = F.when(lag == 0, F.format_string("%s and %s move together (r %.2f)", "a", "b", "p.r")).otherwise(
        F.format_string("%s %s %s by %d periods (%.0f days), r %.2f against %.2f at lag zero", F.col("a"),
                        F.when(lag > 0, "leads").otherwise("lags"), F.col("b"), F.abs(lag), F.abs(days), F.col("p.r"), F.col("zero_lag_r")))
    return out.select("a", "b", lag.alias("peak_lag"), days.alias("peak_days"), F.col("p.r").alias("peak_r"), "zero_lag_r",
                      F.col("p.significant").alias("significant"), F.col("p.n").alias("n"), leader.alias("leader"), text.alias("sentence"))


def log_elasticity(pairs: DataFrame, gate: int = GATES.correlation) -> DataFrame:
    """% change of y per 1 % of x from a log-log line over positive rows."""
    logs = pairs.where((F.col("x") > 0) & (F.col("y") > 0)).select("a", "b", F.ln("x").alias("lx"), F.ln("y").alias("ly"))
    agg = logs.groupBy("a", "b").agg(F.regr_slope("ly", "lx").alias("_e"), F.regr_r2("ly", "lx").alias("_r2"), F.count("lx").alias("_n"))
    ok = F.col("_n") >= gate
    return agg.select("a", "b", F.when(ok, F.col("_e")).alias("elasticity"), F.when(ok, F.col("_r2")).alias("r_squared"),
                      *refusal("_n", gate, "too few positive aligned observations"))


def _simple_ols(grouped_rows: DataFrame, keys: list, y: str, x: str, gate: int) -> DataFrame:
    """Slope with its standard error, t and p from the moments of one regressor."""
    agg = grouped_rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"), F.regr_syy(y, x).alias("_syy"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= gate)
    sse = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    se = F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx")))
    out = agg.withColumn("se", se).withColumn("t", F.try_divide("slope", "se"))
    return out.select(*keys, "slope", "se", "t", tails.student_p(F.col("t"), F.col("n") - 2).alias("p_value"),
                      F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy")).alias("r_squared"), "n")


def _lagged(pairs: DataFrame, x: Column, y: Column, max_lag: int) -> DataFrame:
    """Change of x ``lag`` rows earlier next to the change of y, for every lag."""
    base = pairs.select("a", "b", "ts", x.alias("_dx"), y.alias("dy"))
    options = F.expr("array(" + ", ".join(f"named_struct('lag', {k}, 'dx', lag(_dx, {k}) over (partition by a, b order by ts))" for k in range(max_lag + 1)) + ")")
    return base.withColumn("_l", options).select("a", "b", "dy", F.explode("_l").alias("_l")).select("a", "b", "dy", "_l.lag", "_l.dx").where(
        F.col("dy").isNotNull() & F.col("dx").isNotNull())


def elasticity_by_lag(pairs: DataFrame, max_lag: int = 4, gate: int = GATES.correlation) -> DataFrame:
    """Response of the log change of y to the log change of x at lags 0..max_lag."""
    positive = pairs.where((F.col("x") > 0) & (F.col("y") > 0))
    sized = positive.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).where(F.col("_n") >= gate)
    dx, dy = F.ln("x") - F.lag(F.ln("x")).over(by_pair()), F.ln("y") - F.lag(F.ln("y")).over(by_pair())
    out = _simple_ols(_lagged(sized, dx, dy, max_lag), ["a", "b", "lag"], "dy", "dx", 20)
    return out.withColumn("significant", F.col("p_value") < GATES.alpha)


def lagged_impact(pairs: DataFrame, max_lag: int = 8) -> DataFrame:
    """Correlation between the % change of x and the % change of y after 0..max_lag periods."""
    sized = pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).where(F.col("_n") >= max(30, 4 * max_lag))
    px, py = F.lag("x").over(by_pair()), F.lag("y").over(by_pair())
    rows = _lagged(sized, F.try_divide(F.col("x") - px, px), F.try_divide(F.col("y") - py, py), max_lag)
    out = pearson(rows.withColumnsRenamed({"dx": "x", "dy": "y"}), 20, ("a", "b", "lag"))
    return out.where("status = 'ok'").select("a", "b", "lag", "r", "t", "p_value", "n", (F.col("p_value") < GATES.alpha).alias("significant"))


def _with_changes(pairs: DataFrame) -> DataFrame:
    prev, nxt = F.lag("y").over(by_pair()), F.lead("y").over(by_pair())
    return (pairs.withColumn("same_change", F.try_divide(F.col("y") - prev, prev))
            .withColumn("next_change", F.try_divide(nxt - F.col("y"), F.col("y"))))


def thresholds(pairs: DataFrame, buckets: int = GATES.threshold_buckets) -> DataFrame:
    """Behaviour of y by quantile bucket of x, same and next period."""
    w = Window.partitionBy("a", "b")
    sized = pairs.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= 10 * buckets)
    rows = W.quantile_bucket(_with_changes(sized), "x", buckets, ["a", "b"])
    fall = F.avg(F.when(F.col("same_change").isNotNull(), (F.col("same_change") < 0).cast("double")).otherwise(0.0))
    return rows.groupBy("a", "b", "bucket").agg(
        F.min("x").alias("from_x"), F.max("x").alias("to_x"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.percentile("y", 0.5).alias("median_y"), (F.avg("same_change") * 100).alias("same_change_pct"),
        (F.avg("next_change") * 100).alias("next_change_pct"), (fall * 100).alias("fall_share_pct"), F.count(F.lit(1)).alias("n"))


def threshold_test(pairs: DataFrame, buckets: int = GATES.threshold_buckets) -> DataFrame:
    """Welch test of the next-period change between the heaviest and the lightest bucket; as ``thresholds``, not below 10 rows a bucket."""
    sized = pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("a", "b"))).where(F.col("_n") >= 10 * buckets)
    rows = W.quantile_bucket(_with_changes(sized), "x", buckets, ["a", "b"])
    top, low = F.col("bucket") == F.col("n_buckets"), F.col("bucket") == 1

    def part(cond):
        v = F.when(cond, F.col("next_change"))
        return F.count(v), F.avg(v), F.var_samp(v)
    (n1, m1, v1), (n2, m2, v2) = part(top), part(low)
    agg = rows.groupBy("a", "b").agg(n1.alias("n_top"), m1.alias("m1"), v1.alias("v1"), n2.alias("n_low"), m2.alias("m2"), v2.alias("v2"),
                                     F.min(F.when(top, F.col("x"))).alias("level")).where("n_top > 5 and n_low > 5")
    e1, e2 = F.col("v1") / F.col("n_top"), F.col("v2") / F.col("n_low")
    out = agg.withColumn("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2))).withColumn(
        "dof", F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n_top") - 1) + e2 * e2 / (F.col("n_low") - 1)))
    return out.select("a", "b", "level", "t", "dof", tails.student_p(F.col("t"), F.col("dof")).alias("p_value"), "n_top", "n_low")


def fit_line(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                                       safe_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def _pair_latest(rows: DataFrame, cols: list) -> DataFrame:
    """Per column the newest value that is not null."""
    return rows.groupBy("a", "b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in cols],
                                      F.count(F.lit(1)).alias("n"))


def pair_spread(pairs: DataFrame, window: int = 90) -> DataFrame:
    """Spread of a over b: level, premium, own average, convergence and anomaly flag."""
    rows = pairs.withColumn("spread", F.col("x") - F.col("y"))
    rows = (rows.withColumn("premium_pct", F.try_divide("spread", "y") * 100).withColumn("avg_spread", W.sma("spread", window, by_pair()))
            .withColumn("z", W.rolling_z("spread", window, by_pair())))
    cols = ["spread", "premium_pct", "avg_spread", "z"]
    gap = trend(rows.select("a", "b", "ts", F.abs("spread").alias("value")), window, GATES.trend, ("a", "b"))
    label = F.create_map(*[F.lit(v) for v in ("uptrend", "diverging", "downtrend", "converging", "range_bound", "stable")])
    out = _pair_latest(rows, cols).join(gap.select("a", "b", "slope_pct", "r_squared", "regime"), ["a", "b"])
    ok = F.col("n") >= GATES.correlation
    return out.select("a", "b", *[F.when(ok, F.col(c)).alias(c) for c in cols + ["slope_pct", "r_squared"]],
                      F.when(ok, F.try_element_at(label, F.col("regime"))).alias("convergence"),
                      F.coalesce(ok & (F.abs("z") > 2), F.lit(False)).alias("anomaly"), "n",
                      F.when(ok, "ok").otherwise("insufficient_evidence").alias("status"))


def benchmark_profile(pairs: DataFrame) -> DataFrame:
    """a against its benchmark b: ratio, premium, spread and their volatility, momentum and percentile."""
    rows = pairs
    for name, c in W.against("x", "y").items():
        rows = rows.withColumn(name, c)
    rows = (rows.withColumn("spread_sd_30", W.rolling_sd("spread", 30, by_pair())).withColumn("ratio_cv_30", W.rolling_cv("ratio", 30, by_pair()))
            .withColumn("ratio_roc_30", W.momentum("ratio", 30, by_pair()) * 100).withColumn("ratio_roc_90", W.momentum("ratio", 90, by_pair()) * 100))
    last = F.first("ratio").over(Window.partitionBy("a", "b").orderBy(F.desc("ts")))
    rows = rows.withColumn("_le", (F.col("ratio") <= last).cast("double"))
    cols = ["ratio", "premium_pct", "spread", "spread_sd_30", "ratio_cv_30", "ratio_roc_30", "ratio_roc_90"]
    out = rows.groupBy("a", "b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in cols],
                                     safe_corr("x", "y").alias("r"), (F.avg("_le") * 100).alias("ratio_percentile"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("status", F.when(F.col("n") >= GATES.correlation, "ok").otherwise("insufficient_evidence"))
