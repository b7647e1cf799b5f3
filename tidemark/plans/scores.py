"""Composite scores.  Every score keeps its parts; a part that is missing is left out, never taken as neutral."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.coerce import clipped, mean_present, present, scaled
from tidemark.operators import seasonal as M, series as S, windows as W
from tidemark.plans.modules import shown

B = fixed.SCORE_BOUNDS


def _flag(ok: Column) -> Column:
    return F.when(ok, "ok").otherwise("insufficient_evidence")


def the_row(df: DataFrame, *cols: str) -> Column:
    """A one-row table as a struct value for every row of another plan; null when it is empty."""
    return df.agg(F.first(F.struct(*cols)).alias("row")).scalar()


def variety_scores(price: DataFrame) -> DataFrame:
    """Market strength, stability, risk and confidence from the price module."""
    regimes = F.create_map(*[F.lit(x) for k, v in fixed.REGIME_SCORES.items() for x in (k, v)])
    rows = (price.withColumn("regime_score", F.try_element_at(regimes, F.col("regime"))).withColumn("momentum_score", scaled("roc_30", *B["momentum_roc"]))
            .withColumn("volatility_score", scaled("cv_30", *B["volatility_cv"])).withColumn("drawdown_score", scaled(F.abs("max_drawdown_pct"), *B["drawdown"])))
    used = present("regime_score", "momentum_score", "percentile_1y")
    strength = F.when(used >= 2, shown(mean_present("regime_score", "momentum_score", "percentile_1y"), 1))
    checks = [(F.col("trend_status") == "ok"), F.col("percentile_1y").isNotNull(), F.col("max_drawdown_pct").isNotNull()]
    availability = sum((c.cast("int") for c in checks), F.lit(0)) / 3.0 * 100
    adequacy = F.least(F.col("observations") / 100.0, F.lit(1.0)) * 100
    return rows.select(
        "series_id", "regime", "roc_30", strength.alias("market_strength"), used.cast("bigint").alias("strength_parts"),
        shown(100 - F.col("volatility_score"), 1).alias("stability"), shown(mean_present("volatility_score", "drawdown_score"), 1).alias("risk"),
        shown((availability + adequacy) / 2, 1).alias("confidence"))


def votes(price: DataFrame, deviations: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Share of bullish and bearish votes among the signals that exist."""
    latest = deviations.groupBy("series_id").agg(F.max_by("deviation_pct", "ts").alias("deviation_pct"))
    supply = the_row(arrivals.where("series_id = 'arrivals'"), "yoy_pct")
    rows = price.join(latest, "series_id", "left").withColumn("arrivals_yoy", supply["yoy_pct"])

    def vote(c, up, down):
        return F.when(F.col(c).isNull(), None).when(F.col(c) > up, "bullish").when(F.col(c) < down, "bearish").otherwise("neutral")
    regime = F.when(F.col("regime") == "uptrend", "bullish").when(F.col("regime") == "downtrend", "bearish").when(F.col("regime").isNotNull(), "neutral")
    falling = F.when(F.col("arrivals_yoy") < 0, "bullish").when(F.col("arrivals_yoy") > 0, "bearish").when(F.col("arrivals_yoy").isNotNull(), "neutral")
    signals = {"trend": regime, "momentum": vote("roc_30", 2.0, -2.0), "season": vote("deviation_pct", 5.0, -5.0), "arrivals": falling}
    out = rows.select("series_id", *[c.alias(k) for k, c in signals.items()])
    every = F.array_compact(F.array(*signals))
    n = F.size(every)

    def share(side):
        return F.when(n > 0, shown(F.size(F.filter(every, lambda s: s == side)) / n * 100, 1))
    return out.select("series_id", *signals, share("bullish").alias("bullish"), share("bearish").alias("bearish"), n.cast("bigint").alias("signals"))


def market_scores(arrivals: DataFrame, months: DataFrame, surplus: DataFrame) -> DataFrame:
    """Supply pressure, arrival pressure and demand of the whole market: one row."""
    a = arrivals.where("series_id = 'arrivals'").select(F.col("yoy_pct").alias("yoy"), "mean_30", "mean_90", F.month("as_of").alias("month"))
    o = the_row(arrivals.where("series_id = 'offtake'"), "yoy_pct", "mom_pct")
    seas = months.where("series_id = 'arrivals' and position is not null").select("month", shown("mean_total", 0).alias("norm"), "position")
    s = surplus.agg(shown(F.max_by("surplus", "ts"), 2).alias("surplus")).scalar()
    rows = a.join(seas, "month", "left").withColumn("_o", o).withColumn("surplus", s).withColumn("off_yoy", F.col("_o.yoy_pct")).withColumn("off_mom", F.col("_o.mom_pct"))
    ratio = F.try_divide(F.col("mean_30") * 30, F.col("norm"))
    place = F.when(F.col("position") == "peak", 80.0).when(F.col("position") == "lean", 20.0).when(F.col("position").isNotNull(), 50.0)
    rows = (rows.withColumn("p1", scaled("yoy", *B["arrival_yoy"])).withColumn("p2", scaled(ratio, *B["arrival_ratio"])).withColumn("p3", scaled("surplus", *B["surplus"]))
            .withColumn("q1", place).withColumn("q2", scaled(F.try_divide("mean_30", "mean_90"), *B["arrival_ratio"]))
            .withColumn("d1", scaled("off_yoy", *B["offtake_yoy"])).withColumn("d2", scaled("off_mom", *B["offtake_mom"])))
    return rows.select(F.lit("all").alias("market"), shown(mean_present("p1", "p2", "p3"), 1).alias("supply_pressure"), present("p1", "p2", "p3").cast("bigint").alias("supply_parts"),
                       shown(mean_present("q1", "q2"), 1).alias("arrival_pressure"), shown(mean_present("d1", "d2"), 1).alias("demand"))


def composite(variety: DataFrame, market: DataFrame) -> DataFrame:
    """Weighted blend of strength, inverted supply pressure, demand and stability over the parts that exist."""
    rows = variety.withColumn("_m", the_row(market, "supply_pressure", "demand")).select("*", "_m.*")
    parts = {"market_strength": F.col("market_strength"), "supply_pressure_inverted": 100 - F.col("supply_pressure"), "demand": F.col("demand"), "stability": F.col("stability")}
    num = sum((F.coalesce(c * fixed.COMPOSITE_WEIGHTS[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), fixed.COMPOSITE_WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    used = sum((c.isNotNull().cast("int") for c in parts.values()), F.lit(0))
    return rows.select("series_id", shown(F.try_divide(num, den), 1).alias("composite"), used.cast("bigint").alias("parts_used"), (used < 4).alias("weights_renormalised"))


def sentiment(price: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Mean of up to five parts between -1 and +1: trend, momentum, range, arrivals pressure, season ahead."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("ts"))
    whole = Window.partitionBy("series_id")
    rows = (price.where(F.col("value").isNotNull()).withColumn("_k", F.row_number().over(newest)).withColumn("_n", F.count(F.lit(1)).over(whole))
            .withColumn("_last", F.max("ts").over(whole)).where("_n >= 60"))
    window = F.least(F.lit(180), F.greatest(F.lit(30), F.floor(F.col("_n") / 3)))
    recent = F.col("ts") >= F.add_months("_last", -12)
    facts = rows.groupBy("series_id").agg(
        F.max("_last").alias("as_of"), F.max_by("value", "ts").alias("latest"), F.avg(F.when(F.col("_k") <= window, F.col("value"))).alias("ma"),
        F.min(F.when(recent, F.col("value"))).alias("lo"), F.max(F.when(recent, F.col("value"))).alias("hi"), F.count_if(recent).alias("n_year"))
    monthly = S.resample(price, "ME").withColumn("chg", W.momentum("value", 1))
    move = monthly.groupBy("series_id").agg(F.max_by("chg", "ts").alias("recent"), F.percentile(F.abs("chg"), 0.5).alias("typical"), F.count(F.lit(1)).alias("n_months"))
    vol = S.resample(arrivals.where("series_id = 'arrivals'"), "ME", "sum").withColumn("m", F.month("ts")).withColumn("_end", F.max("ts").over(whole)).withColumn(
        "_nm", F.count(F.lit(1)).over(whole))
    same = vol.where(F.col("m") == F.month("_end"))
    prior = F.when(F.col("ts") < F.col("_end"), F.col("value"))
    supply = same.agg(F.avg(prior).alias("norm"), F.count(prior).alias("prior_years"), F.max_by("value", "ts").alias("recent_volume"), F.max("_nm").alias("n_vol"))
    season = M.month_table(price).select("series_id", "month", F.col("index").alias("season_index"))
    joined = (facts.join(move, "series_id", "left").withColumn("_m", the_row(supply, *supply.columns)).select("*", "_m.*").withColumn("month", F.month(F.add_months("as_of", 1)))
              .join(season, ["series_id", "month"], "left"))
    span = F.when((F.col("n_year") >= 20) & (F.col("hi") > F.col("lo")), (F.col("latest") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    excess = F.when((F.col("n_vol") >= 24) & (F.col("prior_years") >= 3) & (F.col("norm") > 0), (F.col("recent_volume") - F.col("norm")) / F.col("norm"))
    parts = {
        "trend": clipped(F.try_divide(F.col("latest") - F.col("ma"), F.col("ma")) / 0.15, -1, 1),
        "momentum": clipped(F.when((F.col("n_months") >= 13) & (F.col("typical") > 0), F.col("recent") / (3 * F.col("typical"))), -1, 1),
        "range_position": clipped((span - 0.5) * 2, -1, 1), "arrivals_pressure": clipped(-excess / 0.4, -1, 1),
        "season_ahead": clipped((F.col("season_index") - 1.0) / 0.10, -1, 1)}
    out = joined.select("series_id", "as_of", *[c.alias(k) for k, c in parts.items()])
    score = mean_present(*parts)
    (top, first), *rest, (_, lowest) = fixed.SENTIMENT_LABELS
    label = F.when(score >= top, first)
    for bound, text in rest:  # a bound belongs to the label farther from neutral
        label = label.when(score >= bound if bound > 0 else score > bound, text)
    label = label.otherwise(lowest)
    return out.select("series_id", "as_of", *parts, score.alias("score"), present(*parts).cast("bigint").alias("parts_used"), label.alias("label"))
