"""Seasonal indices, season classes, decomposition.  Everything here works on at most one row per month or period."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.config import GATES
from tidemark.operators import windows as W
from tidemark.operators.series import by_series, resample


def ratio_index(series: DataFrame, min_years: int = GATES.seasonal_years) -> DataFrame:
    """Ratio to the centred 12-month mean by calendar month, scaled so the months of a series average 100."""
    monthly = resample(series, "MS", "mean", empty="keep")
    sized = monthly.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series_id"))).where(F.col("_n") >= GATES.seasonal_months)
    ratio = sized.withColumn("_r", F.try_divide("value", W.centred_year_mean())).where(F.col("_r").isNotNull())
    raw = ratio.groupBy("series_id", F.month("ts").alias("month")).agg(F.avg("_r").alias("_f"), F.count_distinct(F.year("ts")).alias("years_used"))
    mean = F.avg("_f").over(Window.partitionBy("series_id"))
    return raw.select("series_id", "month", (F.col("_f") * 100.0 / mean).alias("index_100"), "years_used",
                      F.when(F.col("years_used") >= min_years, "ok").otherwise("insufficient_evidence").alias("status"))


def month_table(series: DataFrame) -> DataFrame:
    """Month mean over overall mean (1 = average) with the spread of each calendar month."""
    n = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.count("value").alias("_n"))
    monthly = resample(series, "ME").join(n.where(F.col("_n") >= 24).select("series_id"), "series_id")
    overall = monthly.groupBy("series_id").agg(F.avg("value").alias("_o"))
    table = monthly.groupBy("series_id", F.month("ts").alias("month")).agg(
        F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("sd"),
        F.count("value").alias("years_observed"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    return table.join(overall, "series_id").withColumn("index", F.try_divide("mean", "_o")).withColumn(
        "deviation", F.col("index") - 1.0).drop("_o")


def month_boxes(series: DataFrame) -> DataFrame:
    """Five-number summary per calendar month; from 24 observations."""
    n = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.count("value").alias("_n"))
    series = series.join(n.where(F.col("_n") >= 24).select("series_id"), "series_id", "left_semi")
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    box = resample(series, "ME").groupBy("series_id", F.month("ts").alias("month")).agg(
        F.min("value").alias("minimum"), q.alias("_q"), F.max("value").alias("maximum"), F.count("value").alias("n"))
    return box.select("series_id", "month", "minimum", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                      F.col("_q")[2].alias("q3"), "maximum", "n")


def weekdays(series: DataFrame) -> DataFrame:
    """Level and change by day of week (1 = Monday)."""
    known = series.where(F.col("value").isNotNull()).withColumn("_c", W.momentum("value", 1) * 100)
    sized = known.groupBy("series_id").agg(F.count("value").alias("_n"), F.avg("value").alias("_o"))
    out = known.groupBy("series_id", (F.weekday("ts") + 1).alias("weekday")).agg(
        F.avg("value").alias("mean_level"), F.count("value").alias("n"), F.avg("_c").alias("mean_change_pct"), F.stddev_samp("_c").alias("sd_change_pct"))
    return out.join(sized.where(F.col("_n") >= 30), "series_id").withColumn("index", F.try_divide("mean_level", "_o")).drop("_n", "_o")


def same_month_comparison(series: DataFrame) -> DataFrame:
    """The last 12 months against the mean of the same calendar month in all earlier years."""
    monthly = resample(series, "MS", "mean", empty="keep")
    earlier = Window.partitionBy("series_id", "month").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    newest = Window.partitionBy("series_id").orderBy(F.desc("ts"))
    rows = (monthly.withColumn("month", F.month("ts")).withColumn("historical", F.avg("value").over(earlier))
            .withColumn("years_of_history", F.count(F.lit(1)).over(earlier)).withColumn("_k", F.row_number().over(newest))
            .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series_id"))))
    return rows.where((F.col("_k") <= 12) & (F.col("_n") >= 13) & (F.col("years_of_history") > 0)).select(
        "series_id", "ts", F.col("value").alias("actual"), "historical",
        (F.try_divide(F.col("value") - F.col("historical"), "historical") * 100).alias("deviation_pct"), "years_of_history")


def peak_lean(series: DataFrame, min_years: int = GATES.seasonal_years) -> DataFrame:
    """Mean monthly total per calendar month with its rank from the top; ranks 1-3 are peak, the last three lean."""
    monthly = resample(series, "MS", "sum", empty="keep")
    table = monthly.groupBy("series_id", F.month("ts").alias("month")).agg(
        F.avg("value").alias("mean_total"), F.count_distinct(F.year("ts")).alias("years_used"))
    top = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("mean_total"), "month"))
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    usable = F.max("years_used").over(Window.partitionBy("series_id")) >= min_years
    label = F.when(F.col("rank") <= 3, "peak").when(F.col("rank") > n - 3, "lean").otherwise("shoulder")
    return table.withColumn("rank", top).withColumn("position", F.when(usable, label))


def season_profile(series: DataFrame) -> DataFrame:
    """Calendar months classed by mean total: top third peak, bottom third lean."""
    monthly = resample(series, "MS", "sum", empty="keep")
    table = monthly.groupBy("series_id", F.month("ts").alias("month")).agg(
        F.avg("value").alias("mean_total"), F.percentile("value", 0.5).alias("median_total"), F.count("value").alias("years_observed"))
    whole = Window.partitionBy("series_id")
    ranked = (table.withColumn("index_vs_mean", F.col("mean_total") / F.avg("mean_total").over(whole))
              .withColumn("_rank", W.average_rank("mean_total", ["series_id"], ascending=False)).withColumn("_n", F.count(F.lit(1)).over(whole)))
    season = F.when(F.col("_rank") <= F.col("_n") / 3, "Peak arrivals").when(F.col("_rank") > 2 * F.col("_n") / 3, "Lean arrivals").otherwise("Shoulder")
    return ranked.withColumn("season", season).drop("_rank", "_n")


def harvest_behaviour(volume: DataFrame, price: DataFrame, arrivals: str = "arrivals") -> DataFrame:
    """Average price index in the three heaviest and the three lightest months of the named arrivals series, by its own index."""
    by_volume = ratio_index(volume.where(F.col("series_id") == arrivals)).select("series_id", "month", F.col("index_100").alias("_v"))
    order = Window.partitionBy("series_id").orderBy(F.desc("_v"), "month")
    ranked = by_volume.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series_id")))
    tagged = ranked.withColumn("part", F.when(F.col("_k") <= 3, "harvest").when(F.col("_k") > F.col("_n") - 3, "off_season")).where("part is not null")
    return (ratio_index(price).join(tagged.select("month", "part"), "month").groupBy("series_id")
            .agg(F.avg(F.when(F.col("part") == "harvest", F.col("index_100"))).alias("harvest_index"),
                 F.avg(F.when(F.col("part") == "off_season", F.col("index_100"))).alias("off_season_index")))


def monthly_means_by_label(table: DataFrame, label: str, value: str) -> DataFrame:
    """Supplied monthly figures averaged over the years, echoed as a reference."""
    return table.where(F.col(value).isNotNull()).groupBy(label).agg(F.avg(value).alias("mean"), F.count(value).alias("years"))


def calendar_grid(series: DataFrame) -> DataFrame:
    """Year rows, month columns, mean values."""
    monthly = series.select("series_id", F.year("ts").alias("year"), F.month("ts").alias("month"), "value")
    return monthly.groupBy("series_id", "year").pivot("month", list(range(1, 13))).agg(F.avg("value")).withColumnsRenamed(
        {str(i + 1): m for i, m in enumerate(fixed.MONTHS)})


def year_totals(series: DataFrame) -> DataFrame:
    """Yearly total of a monthly series with a flag for complete years."""
    return series.groupBy("series_id", F.year("ts").alias("year")).agg(
        F.sum("value").alias("total"), F.count("value").alias("months"), (F.count("value") == 12).alias("complete"))


def interpolate(series: DataFrame) -> DataFrame:
    """Straight line in time between the neighbours of a null; ends take the nearest value.  Only for decomposition."""
    past, ahead = by_series().rowsBetween(Window.unboundedPreceding, 0), by_series().rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("value").isNotNull(), F.struct(F.col("ts").alias("t"), F.col("value").alias("v")))
    rows = series.withColumn("_p", F.last(point, ignorenulls=True).over(past)).withColumn("_q", F.first(point, ignorenulls=True).over(ahead))
    share = F.try_divide(F.datediff("ts", "_p.t").cast("double"), F.datediff("_q.t", "_p.t").cast("double"))
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share
    filled = F.coalesce(F.col("value"), line, F.col("_p.v"), F.col("_q.v"))
    return rows.withColumn("interpolated", F.col("value").isNull()).withColumn("value", filled).drop("_p", "_q")


def decompose(series: DataFrame, freq: str = "ME", period: int | None = None) -> DataFrame:
    """Classical additive split into trend, seasonal and residual on the regular grid of the frequency."""
    m = period or fixed.PERIODS_PER_YEAR[freq]
    grid = interpolate(resample(series, freq, "mean", empty="keep"))
    known = F.count(F.when(~F.col("interpolated"), F.lit(1))).over(Window.partitionBy("series_id"))
    rows = grid.withColumn("_n", known).where(F.col("_n") >= 2 * m + 1).withColumn("_i", F.row_number().over(by_series()) - 1)
    half = m // 2
    frame = by_series().rowsBetween(-half, half)
    if m % 2 == 0:
        ends = F.lag("value", half).over(by_series()) + F.lead("value", half).over(by_series())
        inner = F.sum("value").over(by_series().rowsBetween(-half + 1, half - 1))
        centred = (0.5 * ends + inner) / m
    else:
        centred = F.avg("value").over(frame)
    rows = rows.withColumn("trend", F.when(F.count("value").over(frame) == 2 * half + 1, centred))
    phase = (F.col("_i") % m).alias("_phase")
    means = rows.groupBy("series_id", phase).agg(F.avg(F.col("value") - F.col("trend")).alias("_s"))
    means = means.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy("series_id"))).drop("_s")
    out = rows.withColumn("_phase", F.col("_i") % m).join(means, ["series_id", "_phase"])
    return out.select("series_id", "ts", F.col("value").alias("observed"), "trend", "seasonal",
                      (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"), "interpolated")


def variance_shares(parts: DataFrame) -> DataFrame:
    """Share of trend, seasonal and residual variance per series."""
    v = parts.groupBy("series_id").agg(*[F.var_samp(c).alias(c) for c in ("trend", "seasonal", "residual")],
                                       F.count_if("interpolated").alias("n_interpolated"))
    total = F.col("trend") + F.col("seasonal") + F.col("residual")
    return v.select("series_id", *[F.try_divide(F.col(c), total).alias(f"{c}_share") for c in ("trend", "seasonal", "residual")], "n_interpolated")
