"""Running and rolling measures.  All of them use the same window order, so one sort serves a whole profile.

Frames count rows; the null rows of a series take part in the frame and are left out of the counts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import GATES
from tidemark.functions.coerce import periods_per_year
from tidemark.operators.series import by_series, period_label, period_start


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over_last(fn, c, n: int, by=None, min_periods: int | None = None, shift: int = 0) -> Column:
    """``fn`` over the last n rows (ending ``shift`` rows back), null below the minimum count."""
    frame = (by or by_series()).rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(_c(c)).over(frame) >= (n if min_periods is None else min_periods), fn(_c(c)).over(frame))


def sma(c, n: int, by=None) -> Column:
    return over_last(F.avg, c, n, by)


def rolling_sd(c, n: int, by=None) -> Column:
    return over_last(F.stddev_samp, c, n, by)


def rolling_cv(c, n: int, by=None) -> Column:
    return F.try_divide(rolling_sd(c, n, by), sma(c, n, by))


def rolling_z(c, n: int, by=None) -> Column:
    return F.try_divide(_c(c) - sma(c, n, by), rolling_sd(c, n, by))


def with_ema(series: DataFrame, span: int, out: str, keys=("series_id",), min_periods: int | None = None) -> DataFrame:
    """Exponential mean (alpha = 2/(span+1), recursive form) as plain window sums.

    The recursion e_t = a_t e_(t-1) + b_t x_t unrolls to a sum of b_i x_i weighted by the decay between i and t.
    Decay is kept as a cumulative log and cut into blocks of 300 nats, so the scaled prefix sum of a block neither
    overflows nor cancels; what a block receives from the one before is its last value, and anything older has
    decayed below double precision.  A gap of g rows decays the old weight g times.
    """
    keys = list(keys)
    alpha, floor = 2.0 / (span + 1), span if min_periods is None else min_periods
    order = Window.partitionBy(*keys).orderBy("ts")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    base = series.withColumn("_row", F.row_number().over(order))
    valid = base.where(F.col("value").isNotNull())
    gap = F.col("_row") - F.lag("_row").over(order)
    old = F.pow(F.lit(1.0 - alpha), gap.cast("double"))
    first = F.lag("_row").over(order).isNull()
    steps = (valid.withColumn("_a", F.when(first, F.lit(1.0)).otherwise(old / (old + alpha)))
             .withColumn("_b", F.when(first, F.lit(1.0)).otherwise(1.0 - F.col("_a")))
             .withColumn("_log", -F.sum(F.ln("_a")).over(seen)).withColumn("_obs", F.count("value").over(seen))
             .withColumn("_block", F.floor(F.col("_log") / 300.0)))
    block = Window.partitionBy(*keys, "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.exp(F.col("_log") - F.col("_block") * 300.0)
    local = steps.withColumn("_local", F.sum(F.col("_b") * F.col("value") * scale).over(block) / scale)
    carried = (local.withColumn("_end", F.when(F.lead("_block").over(order) != F.col("_block"), F.struct("_local", "_log")))
               .withColumn("_prev", F.last("_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    ema = F.col("_local") + F.coalesce(F.col("_prev._local") * F.exp(F.col("_prev._log") - F.col("_log")), F.lit(0.0))
    return carried.withColumn(out, F.when(F.col("_obs") >= floor, ema)).drop(
        "_row", "_a", "_b", "_log", "_obs", "_block", "_local", "_end", "_prev")


def momentum(c, n: int, by=None) -> Column:
    """Relative change over n observations; call it on rows without nulls."""
    past = F.lag(_c(c), n).over(by or by_series())
    return F.try_divide(_c(c) - past, past)


def growth_pct(c, periods: int, by=None) -> Column:
    past = F.lag(_c(c), periods).over(by or by_series())
    return F.try_divide(_c(c) - past, past) * 100


def log_return(c, by=None) -> Column:
    past = F.lag(_c(c)).over(by or by_series())
    return F.when((_c(c) > 0) & (past > 0), F.ln(_c(c) / past))


def spacing(series: DataFrame) -> DataFrame:
    """Median days between observations per series and the frequency that implies."""
    gaps = series.where(F.col("value").isNotNull()).withColumn("_g", F.datediff("ts", F.lag("ts").over(by_series())))
    med = F.percentile("_g", 0.5)
    n = F.count(F.lit(1))
    freq = (F.when((n < 3) | med.isNull() | (med <= 3), "D").when(med <= 10, "W").when(med <= 20, "SME").otherwise("ME"))
    return gaps.groupBy("series_id").agg(med.alias("median_gap"), n.alias("n_obs"), freq.alias("freq"))


def bands(series: DataFrame, n: int = GATES.rolling_window) -> DataFrame:
    """Rolling mean, sd, +-2 sd bands and annualised volatility of log returns; needs n + 1 observations."""
    known = series.where(F.col("value").isNotNull())
    sized = known.join(spacing(series).select("series_id", "freq", "n_obs"), "series_id").where(F.col("n_obs") >= n + 1)
    base = sized.withColumn("log_return", log_return("value"))
    mean, sd = sma("value", n), rolling_sd("value", n)
    return (base.withColumn("mean", mean).withColumn("sd", sd)
            .withColumn("volatility", rolling_sd("log_return", n) * F.sqrt(periods_per_year("freq").cast("double")))
            .withColumn("upper", F.col("mean") + 2 * F.col("sd")).withColumn("lower", F.col("mean") - 2 * F.col("sd")))


def drawdown(series: DataFrame, keys=("series_id",)) -> DataFrame:
    """Deepest fall from a running peak: depth, peak, trough and recovery dates."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("ts")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    known = series.where(F.col("value").isNotNull())
    marked = (known.withColumn("_top", F.max("value").over(run))
              .withColumn("_dd", (F.col("value") - F.col("_top")) / F.col("_top"))
              .withColumn("_trough", F.min_by("ts", F.struct("_dd", "ts")).over(whole))
              .withColumn("_peak_value", F.max(F.when(F.col("ts") <= F.col("_trough"), F.col("value"))).over(whole)))
    upto, after = F.col("ts") <= F.col("_trough"), F.col("ts") >= F.col("_trough")
    at_peak = F.col("value") == F.col("_peak_value")
    back = F.min(F.when(after & (F.col("value") >= F.col("_peak_value")), F.col("ts")))
    return marked.groupBy(*keys).agg(
        (F.min("_dd") * 100).alias("max_drawdown_pct"), F.min(F.when(upto & at_peak, F.col("ts"))).alias("peak_ts"),
        F.min("_trough").alias("trough_ts"), back.alias("recovery_ts")).withColumn(
        "recovered", F.col("recovery_ts").isNotNull()).withColumn(
        "days_to_recover", F.datediff("recovery_ts", "trough_ts"))


def running_drawdown(series: DataFrame) -> DataFrame:
    top = F.max("value").over(by_series().rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("running_max", top).withColumn(
        "drawdown_pct", F.try_divide(F.col("value") - F.col("running_max"), F.col("running_max")) * 100)


def outliers(series: DataFrame, n: int = GATES.rolling_window, z_limit: float = GATES.outlier_z) -> DataFrame:
    """Full-sample and rolling z with flags by the z rule and the IQR rule; nothing is removed."""
    known = series.where(F.col("value").isNotNull())
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    facts = known.groupBy("series_id").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
                                           q.alias("_q"), F.count("value").alias("_n"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    return (known.join(facts, "series_id").where(F.col("_n") >= GATES.outliers)
            .withColumn("z", F.try_divide(F.col("value") - F.col("_m"), F.col("_s")))
            .withColumn("z_rolling", F.when(F.col("_n") > n, rolling_z("value", n)))
            .withColumn("iqr_outlier", (F.col("value") < F.col("_q")[0] - 1.5 * iqr) | (F.col("value") > F.col("_q")[1] + 1.5 * iqr))
            .withColumn("z_outlier", F.coalesce(F.abs("z") > z_limit, F.lit(False))).drop("_m", "_s", "_q", "_n"))


def coverage_gaps(series: DataFrame, min_days: int = GATES.gap_days) -> DataFrame:
    """Breaks between observations longer than ``min_days``."""
    previous = F.lag("ts").over(by_series())
    return (series.where(F.col("value").isNotNull()).withColumn("from_ts", previous)
            .withColumn("days", F.datediff("ts", "from_ts")).where(F.col("days") > min_days)
            .select("series_id", "from_ts", F.col("ts").alias("to_ts"), "days"))


def partial_last_period(series: DataFrame, freq: str) -> DataFrame:
    """Days covered by the newest period against its length; complete periods are not listed."""
    last = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    end = period_label("last_ts", freq)
    out = last.withColumn("period_end", end).withColumn("period_start", period_start("period_end", freq))
    return (out.withColumn("covered_days", F.datediff("last_ts", "period_start") + 1)
            .withColumn("total_days", F.datediff("period_end", "period_start") + 1)
            .where((F.col("period_end") > F.col("last_ts")) & (F.col("covered_days") < F.col("total_days"))))


def average_rank(value, partition: list, ascending: bool = True) -> Column:
    """Rank with ties sharing their mean rank."""
    v = _c(value)
    order = Window.partitionBy(*partition).orderBy(v.asc() if ascending else v.desc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, v))
    return F.rank().over(order) + (ties - 1) / 2.0


def quantile_bucket(rows: DataFrame, value: str, buckets: int, keys: list) -> DataFrame:
    """1-based bucket between the distinct quantile edges of each group, right-closed, lowest value included."""
    points = F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.percentile(value, points)).alias("_e"))
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return rows.join(edges, keys).withColumn("bucket", F.greatest(F.lit(1), below)).withColumn(
        "n_buckets", F.size("_e") - 1).drop("_e")


def rebased(c="value", by=None) -> Column:
    """Index with the first observation at 100."""
    return F.try_divide(_c(c), F.first(_c(c), ignorenulls=True).over((by or by_series()).rowsBetween(Window.unboundedPreceding, 0))) * 100


def centred_year_mean(c="value", by=None) -> Column:
    """Mean over the 12 rows from six before to five after, complete windows only."""
    frame = (by or by_series()).rowsBetween(-6, 5)
    return F.when(F.count(_c(c)).over(frame) == 12, F.avg(_c(c)).over(frame))


def against(c, benchmark) -> dict:
    """Spread, ratio and premium of one aligned column over another."""
    x, y = _c(c), _c(benchmark)
    return {"spread": x - y, "ratio": F.try_divide(x, y), "premium_pct": F.try_divide(x - y, y) * 100}
