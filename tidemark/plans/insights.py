"""Findings as rows: each rule is a condition and a sentence over a result table."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import GATES
from tidemark.functions.coerce import strength_label
from tidemark.fixed import MONTHS
from tidemark.operators.series import small_table
from tidemark.sources.store import landed

# Order of strengths in a ranked list.
STRENGTHS = ["strong", "moderate", "weak", "informational", "data gap"]


def finding(rows: DataFrame, category: str, headline: Column, detail: Column, strength="moderate", direction="n/a", evidence: Column | None = None) -> DataFrame:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)
    proof = F.array() if evidence is None else F.array_compact(evidence)
    return rows.select(F.lit(category).alias("category"), headline.alias("headline"), detail.alias("detail"), col(strength).alias("strength"),
                       col(direction).alias("direction"), proof.cast("array<string>").alias("evidence"))


def together(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _month_name(c) -> Column:
    return F.element_at(F.array(*[F.lit(m.title()) for m in MONTHS]), F.col(c) if isinstance(c, str) else c)


def leadership(ranking: DataFrame) -> DataFrame:
    """Who leads price discovery, who follows, whether timing offers anything."""
    top = ranking.where("rank = 1")
    level = F.when(F.col("score") >= 0.6, "strong").when(F.col("score") >= 0.45, "moderate").otherwise("weak")
    proof = F.array(F.when(F.col("influences") > 0, F.format_string("one-way influence on %d others", "influences")),
                    F.when(F.col("dominant") > 0, F.format_string("stronger side in %d two-way pairs", "dominant")))
    first = finding(top, "Price leadership", F.concat("series_id", F.lit(" leads price discovery")), F.format_string("score %.2f over %d comparisons", "score", "comparisons"), level, evidence=proof)
    size = ranking.agg(F.max("rank").alias("_n"), F.sum("times_leader").alias("_led"))
    last = ranking.join(size, F.col("rank") > F.greatest(F.lit(1), F.col("_n") - 2)).groupBy().agg(F.array_sort(F.collect_list("series_id")).alias("names")).where(F.size("names") > 0)
    after = finding(last, "Price leadership", F.concat(F.array_join("names", " and "), F.lit(" follow rather than lead")), F.lit("lowest net influence in the panel"))
    still = finding(size.where("_led = 0"), "Price leadership", F.lit("no series offers a timing lead"), F.lit("every cross-correlation peaks at lag zero"), "strong")
    return together([first, after, still])


def sentiment_proxy(correlations: DataFrame) -> DataFrame:
    """The series with the highest mean correlation to the others stands for the whole."""
    both = correlations.select(F.col("a").alias("s"), "r").unionByName(correlations.select(F.col("b").alias("s"), "r"))
    best = both.groupBy("s").agg(F.avg("r").alias("m")).where("m is not null").orderBy(F.desc("m"), "s").limit(1)
    return finding(best, "Price leadership", F.concat("s", F.lit(" represents the panel best")), F.format_string("mean correlation %.2f with the others", "m"))


def integration(verdicts: DataFrame, johansen: DataFrame, hub: str) -> DataFrame:
    """Whether the hub market drives others, which pairs are independent, whether the system is cointegrated."""
    out = verdicts.where((F.col("source_name") == hub) & F.col("verdict").isin("One-way", "Feedback"))
    kind = F.when(F.col("verdict") == "One-way", "one-way").otherwise("stronger side of a two-way relation")
    driven = out.groupBy().agg(F.array_sort(F.collect_list("target_name")).alias("names"), F.bool_or(F.col("verdict") == "One-way").alias("one"), F.array_sort(F.collect_list(F.concat("target_name", F.lit(": "), kind))).alias("how"))
    lead = finding(driven.where(F.size("names") > 0), "Market leadership", F.concat(F.lit(f"{hub} influences "), F.array_join("names", ", ")), F.array_join("how", "; "), F.when(F.col("one"), "strong").otherwise("moderate"))
    none = finding(driven.where(F.size("names") == 0), "Market leadership", F.lit(f"{hub} does not measurably lead"), F.lit("no one-way or dominant relation from it"))
    alone = finding(verdicts.where("verdict = 'Independent'"), "Market leadership", F.concat("a", F.lit(" and "), "b", F.lit(" move independently")), F.format_string("best p values %.3f and %.3f", "p_ab", "p_ba"))
    rank = johansen.agg(F.coalesce(F.max(F.when(F.col("rejected"), F.col("rank") + 1)), F.lit(0)).alias("k"), F.max("n").alias("n"))
    tied = finding(rank.where("k > 0"), "Market integration", F.format_string("the markets are cointegrated (rank %d): spreads revert", "k"), F.format_string("%d common periods", "n"), "strong")
    free = finding(rank.where("k = 0 and n is not null"), "Market integration", F.lit("no cointegrating relation is detectable"), F.format_string("%d common periods", "n"))
    thin = finding(rank.where("n is null"), "Market integration", F.lit("cointegration could not be tested"), F.lit("too few common periods"), "data gap")
    return together([lead, none, alone, tied, free, thin])


def arrivals(by_lag: DataFrame, buckets: DataFrame, tests: DataFrame, lagged: DataFrame) -> DataFrame:
    """How volumes move prices: elasticity, heavy against light periods, delay."""
    best = F.max_by(F.struct("lag", "slope", "p_value", "r_squared", "n"), F.when(F.col("significant"), F.struct((-F.col("p_value")).alias("p"), (-F.col("lag")).alias("l"))))
    e = by_lag.groupBy("b").agg(best.alias("_b"))
    hit = e.where("_b is not null").select("b", "_b.*")
    moves = finding(hit, "Arrivals impact", F.format_string("1 %% more arrivals moves %s %s %.3f %% after %d periods", F.col("b"), F.when(F.col("slope") < 0, "down").otherwise("up"), F.abs("slope"), F.col("lag")),
                    F.format_string("p %.4f, fit %.3f over %d periods", "p_value", "r_squared", "n"), F.when(F.abs("slope") > 0.05, "moderate").otherwise("weak"), F.when(F.col("slope") < 0, "bearish").otherwise("bullish"))
    flat = finding(e.where("_b is null"), "Arrivals impact", F.concat(F.lit("arrivals show no significant elasticity on "), "b"), F.lit("no lag from 0 to 4 periods is significant"))
    edge = buckets.groupBy("b").agg(F.max_by(F.struct("next_change_pct", "fall_share_pct"), "bucket").alias("hi"), F.min_by(F.struct("next_change_pct", "fall_share_pct"), "bucket").alias("lo"))
    t = edge.join(tests.select("b", "level", "p_value"), "b")
    heavy = finding(t, "Arrivals impact", F.format_string("arrivals above %.0f go with a change of %+.2f %% in %s next period", F.col("level"), F.col("hi.next_change_pct"), F.col("b")),
                    F.format_string("lightest bucket %+.2f %%; prices fell in %.0f %% against %.0f %% of periods; p %.3f", F.col("lo.next_change_pct"), F.col("hi.fall_share_pct"), F.col("lo.fall_share_pct"), F.col("p_value")),
                    F.when(F.col("p_value") < GATES.alpha, "moderate").otherwise("weak"), "bearish")
    peak = lagged.where("significant").groupBy("b").agg(F.max_by(F.struct("lag", "r", "p_value"), F.abs("r")).alias("_p")).select("b", "_p.*")
    late = finding(peak, "Arrivals impact", F.format_string("the arrivals effect on %s comes after %d periods", "b", "lag"), F.format_string("r %.3f, p %.4f", "r", "p_value"), "weak")
    return together([moves, flat, heavy, late])


def seasonality(months: DataFrame, shares: DataFrame, seasons: DataFrame) -> DataFrame:
    """Firm and soft months, weight of the season, heavy and lean arrival months, and what the data cannot show."""
    order = Window.partitionBy("series_id")
    ranked = months.withColumn("_hi", F.row_number().over(order.orderBy(F.desc("index"), "month"))).withColumn("_lo", F.row_number().over(order.orderBy("index", "month")))
    spread = ranked.groupBy("series_id").agg((F.max("index") - F.min("index")).alias("spread"),
                                             F.transform(F.array_sort(F.collect_list(F.when(F.col("_hi") <= 3, F.struct("_hi", _month_name("month").alias("m"))))), lambda e: e["m"]).alias("firm"),
                                             F.transform(F.array_sort(F.collect_list(F.when(F.col("_lo") <= 3, F.struct("_lo", _month_name("month").alias("m"))))), lambda e: e["m"]).alias("soft"))
    a = finding(spread, "Seasonality", F.format_string("%s is firmest in %s and softest in %s", F.col("series_id"), F.array_join("firm", ", "), F.array_join("soft", ", ")),
                F.format_string("spread of %.1f %% of the average level", F.col("spread") * 100), F.when(F.col("spread") > 0.15, "strong").otherwise("moderate"))
    b = finding(shares.where("seasonal_share is not null"), "Seasonality", F.format_string("the season explains %.0f %% of the variation of %s", F.col("seasonal_share") * 100, F.col("series_id")),
                F.format_string("trend %.0f %%, irregular %.0f %%", F.col("trend_share") * 100, F.col("residual_share") * 100))
    lists = seasons.groupBy("series_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("season") == s, F.struct("month", _month_name("month").alias("m"))))), lambda e: e["m"]).alias(n)
                                               for s, n in (("Peak arrivals", "peak"), ("Lean arrivals", "lean"))]).where("size(peak) > 0 and size(lean) > 0")
    c = finding(lists, "Seasonality", F.format_string("%s peak in %s; %s are lean", F.col("series_id"), F.array_join("peak", ", "), F.array_join("lean", ", ")), F.lit("months ranked by their mean over all years"), "strong")
    one = months.agg(F.count(F.lit(1)).alias("n"))
    d = finding(one, "Seasonality", F.lit("festival effects cannot be measured"), F.lit("the data holds no festival calendar"), "data gap")
    return together([a, b, c, d])


def relation(summary: DataFrame, readings: DataFrame, rolling: DataFrame, category: str, name: str) -> DataFrame:
    """Level correlation with another series, its timing, and whether it is stable."""
    ok = F.col("pearson_p") < GATES.alpha
    r = F.col("pearson_r")
    a = finding(summary.where("pearson_r is not null"), category, F.format_string("%s and %s: %s %s relation (r %.2f)", F.lit(name), F.col("b"), strength_label("pearson_r"), F.when(r > 0, "positive").otherwise("negative"), r),
                F.format_string("%d common periods, p %.4f", "n", "pearson_p"), F.when(ok, "moderate").otherwise("weak"), F.when((r > 0.3) & ok, "bullish").otherwise("n/a"))
    b = finding(readings, category, F.col("sentence"), F.when(F.col("significant"), "the peak clears the 95 % band").otherwise("the peak does not clear the 95 % band"), F.when(F.col("significant"), "moderate").otherwise("weak"))
    wide = rolling.where("r is not null").groupBy("a", "b").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max_by("r", "ts").alias("now"))
    c = finding(wide, category, F.concat(F.lit(f"the relation of {name} and "), "b", F.when(F.col("hi") - F.col("lo") > 0.8, " is unstable").otherwise(" is reasonably stable")),
                F.format_string("rolling correlation from %.2f to %.2f, now %.2f", "lo", "hi", "now"))
    return together([a, b, c])


def currency(gaps: DataFrame, summary: DataFrame, causes: DataFrame, name: str) -> DataFrame:
    """Holes in the rate series, its co-movement and whether it leads."""
    worst = gaps.groupBy("series_id").agg(F.max_by(F.struct("from_ts", "to_ts", "days"), "days").alias("w"), F.count(F.lit(1)).alias("n"))
    a = finding(worst, "Currency", F.format_string("the %s series has a %d-day hole", F.lit(name), F.col("w.days")), F.format_string("%d gaps; longest %s to %s", F.col("n"), F.col("w.from_ts").cast("string"), F.col("w.to_ts").cast("string")), "data gap")
    r, ok = F.col("pearson_r"), F.col("pearson_p") < GATES.alpha
    b = finding(summary.where("pearson_r is not null"), "Currency", F.format_string("%s and %s: %s co-movement (r %.2f)", F.lit(name), F.col("b"), strength_label("pearson_r"), r),
                F.format_string("%d common months, p %.4f; a shared trend may be part of it", "n", "pearson_p"), F.when(ok, "moderate").otherwise("weak"), F.when((r > 0.3) & ok, "bullish").otherwise("n/a"))
    best = causes.groupBy("b").agg(F.min_by(F.struct("lag", "p_value"), "p_value").alias("g"))
    c = finding(best, "Currency", F.when(F.col("g.p_value") < GATES.alpha, F.format_string("past moves of %s help predict %s %d periods ahead", F.lit(name), F.col("b"), F.col("g.lag"))).otherwise(
        F.format_string("%s does not predict %s", F.lit(name), F.col("b"))), F.format_string("best p %.4f", "g.p_value"))
    return together([a, b, c])


def balance(stock: DataFrame, yearly: DataFrame, production: DataFrame) -> DataFrame:
    """Stock to use against its mean, its relation to yearly prices, and the yearly change of production.

    ``stock`` and ``production`` hold (year, value, is_estimate), ``yearly`` aligned pairs of stock (x) and price (y).
    """
    last = stock.groupBy().agg(F.max_by(F.struct("year", "value", "is_estimate"), "year").alias("l"), F.max("year").alias("_y"), F.sort_array(F.collect_list(F.struct("year", "value"))).alias("h"))
    past = last.withColumn("m", F.aggregate(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(1))), F.lit(0.0), lambda acc, e: acc + e["value"]) / F.greatest(F.size("h") - 1, F.lit(1))).where("l is not null")
    low = F.col("l.value") < F.col("m")
    a = finding(past, "Balance sheet", F.format_string("stock to use for %d is %.1f %%, %s the average of %.1f %%", F.col("l.year"), F.col("l.value"), F.when(low, "below").otherwise("above"), F.col("m")),
                F.when(F.col("l.is_estimate"), "the latest year is an expected figure").otherwise("realised figures"), "moderate", F.when(low, "bullish").otherwise("bearish"))
    r = yearly.groupBy("b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    b = finding(r, "Balance sheet", F.format_string("stock to use and the yearly price of %s: %s %s relation (r %.2f)", F.col("b"), strength_label("r"), F.when(F.col("r") < 0, "inverse").otherwise("positive"), F.col("r")),
                F.format_string("only %d years: a direction, not a finding", "n"), "weak")
    order = Window.orderBy(F.desc("year"))  # a dozen yearly rows
    p = production.withColumn("_k", F.row_number().over(order)).where("_k <= 2").groupBy().agg(F.max(F.when(F.col("_k") == 1, F.struct("year", "value"))).alias("n"), F.max(F.when(F.col("_k") == 2, F.struct("year", "value"))).alias("o")).where("n is not null and o is not null")
    change = (F.col("n.value") - F.col("o.value")) / F.col("o.value")
    c = finding(p, "Balance sheet", F.format_string("production of %d is %+.1f %% against %d", F.col("n.year"), change * 100, F.col("o.year")), F.format_string("%.2f after %.2f", "n.value", "o.value"), "moderate",
                F.when(change < -0.05, "bullish").when(change > 0.05, "bearish").otherwise("neutral"))
    return together([a, b, c])


def storage(records: DataFrame, premium: DataFrame) -> DataFrame:
    """What a sparse stock tracker supports, and the premium of stored over fresh lots."""
    most = records.agg(F.coalesce(F.max("observations"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"))
    a = finding(most.where(F.col("n") < GATES.correlation), "Cold storage", F.lit("stocks are too sparsely reported for an analysis"), F.format_string("%d locations, the best with %d observations", "k", "n"), "data gap")
    b = finding(premium, "Cold storage", F.format_string("%s trades at a median premium of %.0f over %s", "a", "median_premium", "b"), F.format_string("dearer on %.0f %% of %d common days", F.col("share_positive") * 100, F.col("n")), "strong",
                evidence=F.array(F.format_string("mean premium %.0f, range %.0f to %.0f", "mean_premium", "min_premium", "max_premium")))
    return together([a, b])


def volatility(bands: DataFrame, flags: DataFrame, recent: int = 26) -> DataFrame:
    """Current volatility against its median, and outliers among the newest periods."""
    v = bands.where("volatility is not null").groupBy("series_id").agg(F.max_by("volatility", "ts").alias("now"), F.percentile("volatility", 0.5).alias("med"), F.count(F.lit(1)).alias("n")).where("n > 10")
    ratio = F.try_divide("now", "med")
    text = F.when(ratio >= 1.15, F.format_string("%.1f times its median", ratio)).when(ratio <= 0.87, F.format_string("%.1f times below its median", 1 / ratio)).otherwise("close to its median")
    a = finding(v, "Volatility", F.concat(F.format_string("%s volatility is %.0f %% a year, ", F.col("series_id"), F.col("now") * 100), text), F.format_string("median %.0f %%", F.col("med") * 100))
    newest = Window.partitionBy("series_id").orderBy(F.desc("ts"))
    n = flags.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= recent).groupBy("series_id").agg(F.sum(F.col("z_outlier").cast("int") + F.col("iqr_outlier").cast("int")).alias("n")).where("n > 0")
    b = finding(n, "Volatility", F.format_string("%d outlier flags in the newest window of %s", "n", "series_id"), F.lit("flagged for review, not removed"), "informational")
    return together([a, b])


def data_quality(notes: DataFrame) -> DataFrame:
    return finding(notes, "Data quality", F.concat("series_id", F.lit(" has a coverage limitation")), F.col("note"), "data gap")


def ranked(findings: DataFrame) -> DataFrame:
    """Strongest first, then by category and headline."""
    order = F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), F.col("strength"))
    return findings.withColumn("strength_order", F.when(order == 0, 10).otherwise(order)).orderBy("strength_order", "category", "headline")


def highlights(findings: DataFrame, limit: int = 6) -> DataFrame:
    """The few strongest findings for a summary page."""
    return ranked(findings.where(F.col("strength").isin("strong", "moderate"))).limit(limit)


def generate_all(generators: dict):
    """Run every generator; one that fails, while it is planned or in a task, is reported and does not stop the others: (findings, failures)."""
    done, failed = [], []
    for name, build in generators.items():
        try:
            done.append(landed(build()))
        except Exception as error:  # a missing input must not hide the other findings
            failed.append((name, f"{type(error).__name__}: {error}"))
    return ranked(together(done)) if done else None, failed


def with_failures(spark, findings: DataFrame | None, failed) -> DataFrame:
    """Findings with a row for each generator that failed, after all others."""
    rows = small_table(spark, "category string, why string", failed)
    lost = ranked(rows.select("category", F.lit("could not be computed").alias("headline"), F.col("why").alias("detail"), F.lit("not available").alias("strength"), F.lit("n/a").alias("direction"),
                              F.array().cast("array<string>").alias("evidence")))
    return lost if findings is None else findings.unionByName(lost) if failed else findings
