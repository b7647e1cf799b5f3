"""Forecasting as tables over (series, cut, horizon, model).

A cut is a date up to which a model may look.  The backtest origins and the present are rows of the same cut table,
so every model is fitted for all series and all cuts in one job.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import linalg, paths, trees
from tidemark.operators import series as S, stats, windows as W
from tidemark.operators.regress import panel_rows
from tidemark.sources.store import landed

KEYS = ["series_id", "cut"]
LAGS = (1, 2, 4)    # of the autoregression
FEATURES = (["price_lag_0"] + [f"price_lag_{k}" for k in fixed.PRICE_LAGS] + [f"price_mean_{w}" for w in fixed.FEATURE_WINDOWS]
            + [f"price_sd_{w}" for w in fixed.FEATURE_WINDOWS] + ["month", "day_of_year", "is_harvest", "arrivals_lag_1", "arrivals_mean_30", "rate_lag_1", "rate_mean_30"])


# ---- features and labels ---------------------------------------------------------------------------------------

def features(price: DataFrame, arrivals: DataFrame, rate: DataFrame) -> DataFrame:
    """What was known at each price date, by row position, nothing later."""
    base = S.on_calendar(price, arrivals, "_a")
    base = S.carry_forward(base, rate, "_f")
    cols = {"price_lag_0": F.col("value")}
    cols.update({f"price_lag_{k}": F.lag("value", k).over(S.by_series()) for k in fixed.PRICE_LAGS})
    for w in fixed.FEATURE_WINDOWS:
        cols[f"price_mean_{w}"] = W.over_last(F.avg, "value", w, min_periods=max(3, w // 2), shift=1)
    for w in fixed.FEATURE_WINDOWS:
        cols[f"price_sd_{w}"] = W.over_last(F.stddev_samp, "value", w, min_periods=max(3, w // 2), shift=1)
    month = F.month("ts")
    cols.update({"month": month.cast("double"), "day_of_year": F.dayofyear("ts").cast("double"),
                 "is_harvest": month.isin(fixed.HARVEST_MONTHS).cast("double"), "arrivals_lag_1": F.lag("_a").over(S.by_series()),
                 "arrivals_mean_30": W.over_last(F.avg, "_a", 30, min_periods=15, shift=1), "rate_lag_1": F.lag("_f").over(S.by_series()),
                 "rate_mean_30": W.over_last(F.avg, "_f", 30, shift=1)})
    return base.select("series_id", "ts", *[c.alias(k) for k, c in cols.items()])


def labelled(feature_rows: DataFrame, price: DataFrame, horizon: int) -> DataFrame:
    """Features with the price exactly ``horizon`` days later; rows without one stay unlabelled."""
    ahead = price.select("series_id", F.date_sub("ts", horizon).alias("ts"), F.col("value").alias("target"))
    return feature_rows.join(ahead, ["series_id", "ts"], "left")


# ---- cuts ------------------------------------------------------------------------------------------------------

def origins(series: DataFrame, count: int = 6, min_years: int = 3, horizons=tuple(fixed.HORIZONS)) -> DataFrame:
    """Evenly spaced backtest dates: at least three years of history before, the longest horizon after."""
    span = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    early, late = F.add_months("_a", 12 * min_years), F.date_sub("_b", max(horizons) + 5)
    ok = span.withColumn("_e", early).withColumn("_d", F.datediff(late, early)).where(F.col("_d") > 0)
    step = ok.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return step.select("series_id", "cut", F.expr(f"date_add(_e, cast(floor(cut * _d / {count - 1}.0) as int))").alias("origin"))


def present(series: DataFrame) -> DataFrame:
    """The cut 'now': the last observation of every series, numbered -1."""
    return series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.max("ts").alias("origin")).select("series_id", F.lit(-1).alias("cut"), "origin")


def with_horizons(cuts: DataFrame, horizons=tuple(fixed.HORIZONS)) -> DataFrame:
    options = F.explode(F.array(*[F.lit(h) for h in horizons]))
    return cuts.withColumn("horizon", options).withColumn("target_ts", F.date_add("origin", F.col("horizon")))


def folds(periods: DataFrame, horizon: int, count: int = 5) -> DataFrame:
    """Rolling-origin folds of a period series: the last ``count`` blocks of ``horizon`` that leave enough to train on."""
    numbered = periods.where(F.col("value").isNotNull()).withColumn("_i", F.row_number().over(S.by_series())).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("series_id")))
    least = F.greatest(F.lit(20), F.floor(F.col("_n") * 0.5))
    usable = F.least(F.lit(count), F.greatest(F.lit(0), F.floor((F.col("_n") - least) / horizon)))
    back = (F.col("_n") - F.col("_i")) / horizon
    hit = numbered.where((F.col("_i") >= least) & (back == F.floor(back)) & back.between(1, usable))
    return hit.select("series_id", (usable - back).cast("int").alias("cut"), F.col("ts").alias("origin"), F.col("value").alias("anchor"))


def history(periods: DataFrame, cuts: DataFrame, names=()) -> DataFrame:
    """The ordered periods of each series up to each cut, as one short array (``names`` are further columns to carry).

    A series is collected once; the cuts take prefixes of it, so more folds do not mean more shuffled rows.
    """
    entry = F.struct("ts", "value", *[F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(names)])
    whole = periods.dropna(subset=["value", *names]).groupBy("series_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    return cuts.join(whole, "series_id").select("series_id", "cut", "origin", F.filter("_all", lambda e: e["ts"] <= F.col("origin")).alias("hist"))


def training(series: DataFrame, cuts: DataFrame, freq: str) -> DataFrame:
    """Period means of what lies before each cut, as ``history``; the last period only holds the days up to the cut."""
    label = S.period_label("ts", freq)
    cut_label = cuts.withColumn("_p", S.period_label("origin", freq))
    before = S.resample(series, freq).dropna(subset=["value"]).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("_all"))
    days = series.where(F.col("value").isNotNull()).withColumn("_p", label).join(cut_label, ["series_id", "_p"]).where(F.col("ts") <= F.col("origin"))
    partial = days.groupBy("series_id", "cut", F.col("_p").alias("ts")).agg(F.avg("value").alias("value"))
    begun = partial.groupBy("series_id").agg(F.collect_list(F.struct("cut", "ts", "value")).alias("_begun"))
    rows = cut_label.select("series_id", "cut", "origin", "_p").join(before, "series_id", "left").join(begun, "series_id", "left")
    none = F.expr("cast(array() as array<struct<ts:date,value:double>>)")
    last = F.transform(F.filter("_begun", lambda e: e["cut"] == F.col("cut")), lambda e: F.struct(e["ts"].alias("ts"), e["value"].alias("value")))
    hist = F.concat(F.coalesce(F.filter("_all", lambda e: e["ts"] < F.col("_p")), none), F.coalesce(last, none))
    return rows.select("series_id", "cut", "origin", hist.alias("hist"))


# ---- models ------------------------------------------------------------------------------------------------------

def seasonal_naive(series: DataFrame, points: DataFrame) -> DataFrame:
    """The observation one year before the target."""
    asked = points.withColumn("_t", F.date_sub("target_ts", 365))
    return S.nearest(asked, series, "_t", 3, "pred").drop("_t")


def _values(column: str) -> Column:
    return F.transform("hist", lambda e: e[column])


def holt_winters(hist: DataFrame, period: int, steps: int) -> DataFrame:
    """Additive Holt-Winters per cut over a grid of weights."""
    fit = hist.withColumn("_f", paths.holt_winters_path(_values("value"), F.lit(period).cast("bigint"), F.lit(steps).cast("bigint")))
    sigma = F.sqrt(F.try_divide("_f.sse", "_f.n"))
    return fit.where("_f.path is not null").select(*KEYS, F.posexplode("_f.path").alias("step", "pred"), "_f.alpha", "_f.beta", "_f.gamma", sigma.alias("sigma")).withColumn(
        "step", F.col("step") + 1)


def autoregression(hist: DataFrame, steps: int, lags=LAGS, drivers: int = 0) -> DataFrame:
    """Regression of the change on its own lags and the changes of the carried drivers per cut, iterated forward."""
    extra = F.array(*[_values(f"x{i}") for i in range(drivers)]).cast("array<array<double>>")
    order = F.array(*[F.lit(k).cast("bigint") for k in lags])
    fit = hist.withColumn("_f", paths.autoregressive_path(_values("value"), extra, order, F.lit(steps).cast("bigint")))
    return fit.where("_f.path is not null").select(*KEYS, F.posexplode("_f.path").alias("step", "pred"), F.col("_f.lags").alias("lags_used"), F.col("_f.aic").alias("aic"),
                                                   F.col("_f.sigma").alias("sigma")).withColumn("step", F.col("step") + 1)


def lag_orders(hist: DataFrame, season: int, lags=LAGS, drivers: int = 0) -> DataFrame:
    """AIC of the nested lag sets up to the season per cut, from one moment matrix each: series_id, cut, ``lags``, ``aic``, ``sigma``, ``n``, ``chosen``
    (lowest AIC).  All sets share the rows that the season leaves, so their AIC compare."""
    order = F.array(*[F.lit(k).cast("bigint") for k in (*lags, season)])
    extra = F.array(*[_values(f"x{i}") for i in range(drivers)]).cast("array<array<double>>")
    flat = hist.withColumn("_f", paths.lag_order_scores(_values("value"), extra, order)).select(*KEYS, F.explode("_f").alias("_e")).select(*KEYS, "_e.*")
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy("aic", F.size("lags"))) == 1
    return flat.withColumn("chosen", best)


def with_drivers(periods: DataFrame, drivers: DataFrame, names) -> DataFrame:
    """Periods next to the drivers of the same date."""
    return periods.join(S.panel(drivers, names), "ts")


def _numbered_by_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of a panel with the class of the first cut that sees them; rows after the last cut are left out."""
    ordered = cuts.groupBy("panel").agg(F.array_sort(F.collect_list("origin")).alias("_c"))
    cls = F.size(F.filter("_c", lambda o: o < F.col("ts")))
    return rows.join(ordered, "panel").withColumn("cls", cls).where(F.col("cls") < F.size("_c")).drop("_c")


def _cells(rows: DataFrame, cols) -> DataFrame:
    return linalg.gram(rows, ["panel", "cls"], cols).groupBy("panel").agg(F.collect_list(F.struct("cls", "gram", "n")).alias("cells"))


def vector_paths(rows: DataFrame, cuts: DataFrame, k: int, steps: int, depth: int = 2, correct: int = 0) -> DataFrame:
    """Joint forecasts of a panel of ``k`` members at all its cuts: panel, cut, origin, ``path`` (steps x members), ``n``, ``reason`` (why there is no path).

    ``rows`` is as from ``panel_rows``, ``cuts`` has panel, cut and origin (dates of rows).  Every row enters one moment matrix, that of
    the first cut which sees it; a cut adds up the matrices before it.  ``correct`` is 1 for the deviation of the first member from its line on
    the others, 2 for the cointegrating relations that the trace test finds at the cut.
    """
    order = Window.partitionBy("panel").orderBy("ts")
    diff = rows.select("*", *[(F.col(f"s{i}") - F.lag(f"s{i}").over(order)).alias(f"c{i}") for i in range(k)])
    lagged = diff.select("*", F.lit(1.0).alias("one"), *[F.lag(f"c{i}", p).over(order).alias(f"p{p}_{i}") for p in range(1, depth + 1) for i in range(k)],
                         *[F.lag(f"s{i}").over(order).alias(f"l{i}") for i in range(k)])
    cols = [f"c{i}" for i in range(k)] + ["one"] + [f"p{p}_{i}" for p in range(1, depth + 1) for i in range(k)] + [f"l{i}" for i in range(k)]
    moments = _cells(_numbered_by_cut(lagged.dropna(), cuts), cols)
    lines = _cells(_numbered_by_cut(rows.withColumn("one", F.lit(1.0)), cuts), ["s0", "one"] + [f"s{i}" for i in range(1, k)]).withColumnRenamed("cells", "lines")
    recent = F.array(F.array(*[f"c{i}" for i in range(k)]), *[F.array(*[f"p{p}_{i}" for i in range(k)]) for p in range(1, depth)])
    state = lagged.select("panel", F.col("ts").alias("origin"), F.array(*[f"s{i}" for i in range(k)]).alias("_level"), recent.alias("_recent"))
    last = F.dense_rank().over(Window.partitionBy("panel").orderBy("origin")) - 1
    asked = cuts.withColumn("_last", last).join(state, ["panel", "origin"]).join(lines, "panel").join(moments, "panel", "left")
    number = lambda v: F.lit(v).cast("bigint")
    fit = paths.vector_path("cells", "lines", "_last", "_level", "_recent", number(k), number(depth), number(correct), number(60 if correct else 40), number(steps),
                            F.array(*[F.lit(fixed.JOHANSEN_TRACE[k - 1 - r][1]) for r in range(k)]) if correct == 2 else F.array().cast("array<double>"))
    return asked.withColumn("_f", fit).select("panel", "cut", "origin", "_f.path", "_f.n", "_f.reason")


def _members(paths_: DataFrame, names) -> DataFrame:
    """One row per cut, step and member, with the member's name as series_id."""
    flat = paths_.where("path is not null").select("cut", "origin", F.posexplode("path").alias("step", "_v")).select("cut", "origin", (F.col("step") + 1).alias("step"), F.posexplode("_v").alias("_i", "pred"))
    return flat.withColumn("series_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)).drop("_i")


def vector_autoregression(series: DataFrame, names, steps: int, depth: int = 2, correct: bool = False) -> DataFrame:
    """Joint forecast of a named panel; ``correct`` adds last period's deviation of the first member from the others."""
    rows = panel_rows(series, names)
    now = rows.groupBy("panel").agg(F.max("ts").alias("origin")).withColumn("cut", F.lit(-1))
    return _members(vector_paths(rows, now, len(names), steps, depth, int(correct)), names).select("series_id", "origin", "step", F.col("pred").alias("point"))


def cointegrated_forecast(series: DataFrame, names, steps: int, depth: int = 1) -> DataFrame:
    """Joint forecast with a correction term for each relation that the trace test finds: series_id, origin, step, ``point``, ``status``, ``reason``.

    Without a relation, or with too few rows, the forecast is refused: one row per member with the reason and no point.
    """
    rows = panel_rows(series, names)
    now = rows.groupBy("panel").agg(F.max("ts").alias("origin")).withColumn("cut", F.lit(-1))
    fit = landed(vector_paths(rows, now, len(names), steps, depth, 2))
    done = _members(fit, names).select("series_id", "origin", "step", F.col("pred").alias("point"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    refused = fit.where("path is null").select(F.explode(F.array(*[F.lit(n) for n in names])).alias("series_id"), "origin", F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("point"),
                                               F.lit("insufficient_evidence").alias("status"), "reason")
    return done.unionByName(refused)


VECTOR_MODELS = {"vector_autoregression": 0, "error_correction": 1}


def rolling_vectors(periods: DataFrame, names, horizon: int, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Held-out steps of every fold of a panel, as ``rolling_backtest``, for both vector models; and the folds that have none:
    series_id, model, cut, reason."""
    rows = landed(panel_rows(periods, names))
    by_panel = folds(rows.select(F.col("panel").alias("series_id"), "ts", F.col("s0").alias("value")), horizon).select(F.col("series_id").alias("panel"), "cut", "origin")
    cuts = landed(by_panel)
    long = rows.unpivot(["panel", "ts"], [f"s{i}" for i in range(len(names))], "_s", "value").withColumn("series_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.substring("_s", 2, 9).cast("int") + 1))
    numbered = long.withColumn("_i", F.row_number().over(S.by_series()))
    ends = cuts.select("cut", "origin").join(numbered.select("series_id", F.col("ts").alias("origin"), F.col("_i").alias("_e"), F.col("value").alias("anchor")), "origin")
    tests = numbered.join(ends, "series_id").withColumn("step", F.col("_i") - F.col("_e")).where(F.col("step").between(1, horizon)).select(*KEYS, "anchor", "step", F.col("value").alias("actual"))
    points, skipped = [], []
    for model, correct in VECTOR_MODELS.items():
        fit = landed(vector_paths(rows, cuts, len(names), horizon, depth, correct))
        points.append(tests.join(_members(fit, names).select(*KEYS, "step", "pred"), KEYS + ["step"]).withColumn("model", F.lit(model)))
        skipped.append(fit.where("path is null").select(F.explode(F.array(*[F.lit(n) for n in names])).alias("series_id"), F.lit(model).alias("model"), "cut", "reason"))
    return points[0].unionByName(points[1]), skipped[0].unionByName(skipped[1])


def boosted_trees(series: DataFrame, feature_rows: DataFrame, cuts: DataFrame, horizons=tuple(fixed.HORIZONS)) -> DataFrame:
    """Direct trees, one model per series, cut and horizon: series_id, cut, horizon, ``pred``, ``rows`` (it learned from), ``top`` features, ``share``.

    A model learns from the complete feature rows whose price ``horizon`` days later was known at its cut, and predicts from the
    newest row, if that is complete.  A series is collected once (a row per day) and grows its models together.
    """
    known = feature_rows.dropna(subset=FEATURES).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("ts").alias("d"), F.array(*FEATURES).alias("x")))).alias("_f"))
    quoted = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("ts").alias("d"), "value"))).alias("_p"))
    asked = cuts.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("cut", F.unix_date("origin").alias("o")))).alias("_c"))
    fit = trees.direct_trees(FEATURES)
    part = lambda c, e: F.transform(c, lambda v: v[e])
    rows = known.join(quoted, "series_id").join(asked, "series_id")
    out = rows.select("series_id", fit(part("_f", "d"), F.flatten(part("_f", "x")), part("_p", "d"), part("_p", "value"), part("_c", "cut"), part("_c", "o"), F.array(*[F.lit(h) for h in horizons])).alias("_m"))
    return out.select("series_id", F.inline("_m")).withColumns({"cut": F.col("cut").cast("int"), "horizon": F.col("horizon").cast("int")})


# ---- backtest ---------------------------------------------------------------------------------------------------

def weeks_ahead(horizon: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(horizon / 7.0).cast("int"))


def predictions(series: DataFrame, cuts: DataFrame, horizons=tuple(fixed.HORIZONS), feature_rows: DataFrame | None = None) -> DataFrame:
    """Point of every model for every cut and horizon; trees take part where ``feature_rows`` are given."""
    points = with_horizons(cuts, horizons).withColumn("step", weeks_ahead(F.col("horizon")))
    train = landed(training(series, cuts, "W"))              # read by two models
    steps = max(1, round(max(horizons) / 7)) + 1
    naive = seasonal_naive(series, points).where("pred is not null").withColumn("model", F.lit("seasonal_naive"))
    hw = points.join(holt_winters(train, 52, steps).select(*KEYS, "step", "pred"), KEYS + ["step"]).withColumn("model", F.lit("holt_winters"))
    ar = points.join(autoregression(train, steps).select(*KEYS, "step", "pred"), KEYS + ["step"]).withColumn("model", F.lit("autoregression"))
    cols = ["series_id", "cut", "origin", "horizon", "target_ts", "model", "pred"]
    every = naive.select(*cols).unionByName(hw.select(*cols)).unionByName(ar.select(*cols))
    if feature_rows is None:
        return every
    grown = points.join(boosted_trees(series, feature_rows, cuts, horizons), [*KEYS, "horizon"]).withColumn("model", F.lit("boosted_trees"))
    return every.unionByName(grown.select(*cols))


def backtest(series: DataFrame, cuts: DataFrame | None = None, horizons=tuple(fixed.HORIZONS), feature_rows: DataFrame | None = None) -> DataFrame:
    """Predictions at the origins next to what happened (nearest observation within two days of the target)."""
    cuts = origins(series) if cuts is None else cuts
    actual = S.nearest(with_horizons(cuts, horizons), series, "target_ts", 2, "actual").where("actual is not null")
    return predictions(series, cuts, horizons, feature_rows).join(actual.select("series_id", "cut", "horizon", "actual"), ["series_id", "cut", "horizon"])


def error_metrics(points: DataFrame, keys=("series_id", "model", "horizon")) -> DataFrame:
    e = F.col("actual") - F.col("pred")
    return points.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.abs(F.try_divide(e, F.col("actual")))) * 100).alias("mape"),
        (F.avg(F.try_divide(F.abs(e), (F.abs("actual") + F.abs("pred")) / 2)) * 100).alias("smape"), F.count(F.lit(1)).alias("n"))


def pooled_metrics(points: DataFrame, keys=("series_id", "model")) -> DataFrame:
    """Rolling-origin scores over all folds; ``anchor`` is the last value known at the origin."""
    e = F.col("actual") - F.col("pred")
    moved = F.signum(F.col("actual") - F.col("anchor"))
    right = (moved == F.signum(F.col("pred") - F.col("anchor"))).cast("double")
    share = F.when(F.abs("actual") > 1e-9, F.abs(e / F.col("actual")))
    return points.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(share) * 100).alias("mape"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("actual") * F.count("actual"))).alias("r2"),
        (F.avg(F.when(moved != 0, right)) * 100).alias("directional_accuracy"), F.count_distinct("cut").alias("folds"), F.count(F.lit(1)).alias("points"))


def rolling_backtest(periods: DataFrame, horizon: int, freq: str, drivers: DataFrame | None = None, names=()) -> DataFrame:
    """Every held-out step of every fold for Holt-Winters and autoregression (with drivers where given)."""
    f = folds(periods, horizon)
    numbered = periods.where(F.col("value").isNotNull()).withColumn("_i", F.row_number().over(S.by_series()))
    ends = f.join(numbered.select("series_id", F.col("ts").alias("origin"), F.col("_i").alias("_e")), ["series_id", "origin"])
    tests = numbered.join(ends, "series_id").withColumn("step", F.col("_i") - F.col("_e")).where(F.col("step").between(1, horizon)).select(
        *KEYS, "anchor", "step", F.col("value").alias("actual"))
    cuts = f.select(*KEYS, "origin")
    train = history(periods, cuts)
    hw = holt_winters(train, fixed.PERIODS_PER_YEAR[freq], horizon).select(*KEYS, "step", "pred").withColumn("model", F.lit("holt_winters"))
    ar = autoregression(train, horizon).select(*KEYS, "step", "pred").withColumn("model", F.lit("autoregression"))
    both = hw.unionByName(ar)
    if names:
        driven = history(with_drivers(periods, drivers, names), cuts, names)
        both = both.unionByName(autoregression(driven, horizon, drivers=len(names)).select(*KEYS, "step", "pred").withColumn("model", F.lit("autoregression_drivers")))
    return tests.join(both, KEYS + ["step"])


def rolling_skips(periods: DataFrame, horizon: int, freq: str, drivers: DataFrame | None = None, names=()) -> DataFrame:
    """Folds of ``rolling_backtest`` that a model does not get, and why: series_id, model, cut, reason.  A series too short for any fold
    has one row per model, with a null cut."""
    f = folds(periods, horizon).select(*KEYS, "origin")
    m = fixed.PERIODS_PER_YEAR[freq]
    known = periods.where(F.col("value").isNotNull())
    have = known.join(f, "series_id").groupBy(*KEYS).agg(F.count_if(F.col("ts") <= F.col("origin")).alias("n"))
    changes = F.col("n") - 1 - max(LAGS)
    reasons = [(have, "holt_winters", F.when(F.col("n") < 2 * m, F.format_string(f"needs {2 * m} periods, has %d", "n"))),
               (have, "autoregression", F.when(changes < paths.LEAST_CHANGES, F.format_string(f"needs {paths.LEAST_CHANGES} changes after lag {max(LAGS)}, has %d", F.greatest(changes, F.lit(0)))))]
    if names:
        driven = with_drivers(known, drivers, names).dropna(subset=["value", *names]).join(f, "series_id").groupBy(*KEYS).agg(F.count_if(F.col("ts") <= F.col("origin")).alias("n"))
        driven = f.select(*KEYS).join(driven, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        reasons.append((driven, "autoregression_drivers", F.when(changes < paths.LEAST_CHANGES, F.format_string(f"needs {paths.LEAST_CHANGES} changes beside its drivers after lag {max(LAGS)}, has %d", F.greatest(changes, F.lit(0))))))
    out = [t.select(*KEYS, F.lit(model).alias("model"), why.alias("reason")).where("reason is not null") for t, model, why in reasons]
    short = known.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).join(f, "series_id", "left_anti")
    models = F.explode(F.array(*[F.lit(model) for _, model, _ in reasons])).alias("model")
    out.append(short.select("series_id", F.lit(None).cast("int").alias("cut"), models, F.format_string(f"no fold of {horizon} periods leaves enough to train on, has %d", "n").alias("reason")))
    return reduce(DataFrame.unionByName, [o.select("series_id", "model", "cut", "reason") for o in out])


def select_best(metrics: DataFrame, keys=("series_id", "horizon"), by: str = "rmse") -> DataFrame:
    """Model with the lowest error per key, its runner-up and the gap between them."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(by, "model"))
    ranked = metrics.withColumn("_k", nth).where("_k <= 2")
    first, second = F.col("_k") == 1, F.col("_k") == 2

    def pick(cond, c):
        return F.max(F.when(cond, F.col(c)))
    out = ranked.groupBy(*keys).agg(pick(first, "model").alias("model"), pick(first, by).alias(by), pick(first, "mape").alias("mape"), pick(first, "n").alias("n_folds"),
                                    pick(second, "model").alias("runner_up"), pick(second, by).alias("_second"))
    return out.withColumn("gap_pct", F.try_divide(F.col("_second") - F.col(by), F.col(by)) * 100).drop("_second")


def scoreboard(metrics: DataFrame, series: DataFrame, models, skipped: DataFrame) -> DataFrame:
    """Every candidate ranked by error; one that scored in no fold is listed with the reason of its newest skip (``rolling_skips``,
    ``rolling_vectors``)."""
    options = series.select("series_id").distinct().select("series_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    why = skipped.groupBy("series_id", "model").agg(F.max_by("reason", F.struct(F.coalesce("cut", F.lit(-1)), "reason")).alias("_why"), F.count("cut").alias("skipped_folds"))
    rows = options.join(metrics, ["series_id", "model"], "left").join(why, ["series_id", "model"], "left")
    order = Window.partitionBy("series_id").orderBy(F.col("rmse").asc_nulls_last(), "model")
    ran = F.col("rmse").isNotNull()
    return rows.withColumns({"rank": F.when(ran, F.row_number().over(order)), "status": F.when(ran, "ok").otherwise("skipped"),
                             "reason": F.when(~ran, F.coalesce("_why", F.lit("not asked for"))), "skipped_folds": F.coalesce("skipped_folds", F.lit(0))}).drop("_why")


# ---- intervals, probability --------------------------------------------------------------------------------------

def residual_table(points: DataFrame) -> DataFrame:
    """Backtest residuals per series, model and horizon: a handful of folds each."""
    return points.groupBy("series_id", "model", "horizon").agg(
        F.collect_list(F.col("actual") - F.col("pred")).alias("residuals"), F.percentile(F.col("actual") - F.col("pred"), F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))


def with_interval(forecast: DataFrame, residuals: DataFrame) -> DataFrame:
    """Empirical 5-95 % band (from three residuals) and probability of a rise (from five)."""
    rows = forecast.join(residuals, ["series_id", "model", "horizon"], "left")
    n = F.coalesce(F.size("residuals"), F.lit(0))
    above = F.size(F.filter("residuals", lambda e: F.col("point") + e > F.col("current"))) / n * 100
    return rows.select(*forecast.columns, F.when(n >= 3, F.col("point") + F.col("_q")[0]).alias("lower"), F.when(n >= 3, F.col("point") + F.col("_q")[1]).alias("upper"),
                       F.when(n >= 5, above).alias("bullish_pct"), F.when(n >= 5, 100 - above).alias("bearish_pct"), n.cast("bigint").alias("residuals_used"))


def bands(path: DataFrame, rmse_by_step: DataFrame) -> DataFrame:
    """80 % band from the model sd growing with the root of the step, 95 % band with the backtest error added in quadrature."""
    last = rmse_by_step.groupBy("series_id", "model").agg(F.max("step").alias("_s"), F.max_by("rmse", "step").alias("_r"))
    rows = path.join(rmse_by_step.select("series_id", "model", "step", "rmse"), ["series_id", "model", "step"], "left").join(last, ["series_id", "model"], "left")
    own = F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    seen = F.coalesce(F.col("rmse"), F.col("_r") * F.sqrt(F.col("step") / F.col("_s")), F.lit(0.0))
    both = F.sqrt(own * own + seen * seen)
    return rows.select(*path.columns, (F.col("pred") - fixed.Z_CONFIDENCE * own).alias("conf_lower"), (F.col("pred") + fixed.Z_CONFIDENCE * own).alias("conf_upper"),
                       (F.col("pred") - fixed.Z_PREDICTION * both).alias("pred_lower"), (F.col("pred") + fixed.Z_PREDICTION * both).alias("pred_upper"))


def step_rmse(points: DataFrame) -> DataFrame:
    e = F.col("actual") - F.col("pred")
    return points.groupBy("series_id", "model", "step").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def future_periods(series: DataFrame, freq: str, steps: int) -> DataFrame:
    """Labels of the next periods after the last observed one."""
    last = series.where(F.col("value").isNotNull()).groupBy("series_id").agg(S.period_label(F.max("ts"), freq).alias("_t"))
    rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    if freq == "W":
        ts = F.expr("date_add(_t, step * 7)")
    elif freq == "ME":
        ts = F.last_day(F.add_months("_t", F.col("step")))
    elif freq == "SME":
        halves = F.month("_t") * 2 + F.when(F.dayofmonth("_t") <= 15, 0).otherwise(1) - 2 + F.col("step")
        month0 = F.add_months(F.trunc("_t", "year"), F.floor(halves / 2).cast("int"))
        ts = F.when(halves % 2 == 0, F.date_add(month0, 14)).otherwise(F.last_day(month0))
    else:
        ts = F.add_months("_t", F.col("step") * 12)
    return rows.select("series_id", "step", ts.alias("ts"))


# ---- similar periods ---------------------------------------------------------------------------------------------

def similar_periods(feature_rows: DataFrame, price: DataFrame, horizon: int, top: int = 3) -> DataFrame:
    """Past dates whose standardised features are nearest to the present, with what the price did next."""
    rows = feature_rows.dropna(subset=FEATURES)
    last = price.where(F.col("value").isNotNull()).groupBy("series_id").agg(F.max("ts").alias("_end"))
    facts = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"_s_{c}") for c in FEATURES])
    near = rows.join(last, "series_id").where(F.col("ts").between(F.date_sub("_end", 10), F.col("_end")))
    now = near.groupBy("series_id", "_end").agg(F.max("ts").alias("used_ts"), F.max_by(F.struct(*FEATURES), "ts").alias("_o"))
    joined = rows.join(facts.where("_n >= 50"), "series_id").join(now, "series_id")

    def gap(c):
        sd = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        z = (F.col(c) - F.col(f"_o.{c}")) / sd
        return z * z
    eligible = (F.col("ts") <= F.date_sub("used_ts", 120)) & (F.date_add("ts", horizon) <= F.col("_end"))
    scored = joined.where(eligible).select("series_id", "ts", "used_ts", F.datediff("_end", "used_ts").alias("days_back"), F.col("price_lag_0").alias("price_then"),
                                           F.sqrt(sum((gap(c) for c in FEATURES), F.lit(0.0))).alias("distance"))
    nth = F.row_number().over(Window.partitionBy("series_id").orderBy("distance", "ts"))
    pool = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    best = scored.withColumn("rank", nth).withColumn("_c", pool).where((F.col("rank") <= top) & (F.col("_c") >= 10)).drop("_c")
    asked = best.withColumn("_t", F.date_add("ts", horizon))
    out = S.nearest(asked, price, "_t", 2, "price_after").where("price_after is not null").drop("_t")
    return out.withColumn("change_pct", (F.col("price_after") - F.col("price_then")) / F.col("price_then") * 100)


# ---- explanation --------------------------------------------------------------------------------------------------

def key_drivers(votes: DataFrame, scores: DataFrame) -> DataFrame:
    """Statements behind a forecast: the signals that are not neutral and the measured parts."""
    sides = [F.when(F.col(c).isNotNull() & (F.col(c) != "neutral"), F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("trend", "momentum", "season", "arrivals")]
    facts = [F.when(F.col("regime").isNotNull(), F.concat(F.lit("trend regime = "), "regime")), F.when(F.col("roc_30").isNotNull(), F.format_string("momentum over 30 = %.2f %%", "roc_30"))]
    rows = votes.join(scores.select("series_id", "regime", "roc_30"), "series_id", "left")
    said = F.array_compact(F.array(*sides, *facts))
    return rows.select("series_id", said.alias("statements"), "bullish", "bearish", F.when(F.size(said) > 0, "ok").otherwise("insufficient_evidence").alias("status"))


def risks(chosen: DataFrame) -> DataFrame:
    """Checklist that follows from the horizon, the number of folds, the error and the model."""
    notes = F.array_compact(F.array(
        F.when(F.col("horizon") >= 90, F.format_string("%d days ahead: read the interval, not the point", "horizon")),
        F.when(F.col("n_folds") < 6, F.format_string("only %d folds behind the error estimate", "n_folds")),
        F.when(F.col("mape") > 10, F.format_string("past error of %.1f %% at this horizon", "mape")),
        F.when(F.col("model") == "seasonal_naive", "repeats last year and cannot react to a new shock")
        .when(F.col("model") == "holt_winters", "horizon rounded to whole weeks, up to three days off")
        .when(F.col("model") == "boosted_trees", "importances describe past patterns, not causes")
        .when(F.col("model") == "autoregression", "models short memory only, no yearly season")))
    return chosen.withColumn("risks", notes)


def model_notes(hw: DataFrame, ar: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """Fitted structure of each model of each series; of trees (``boosted_trees``) per horizon."""
    a = hw.select(*KEYS, "alpha", "beta", "gamma").distinct().select("series_id", "cut", F.lit("holt_winters").alias("model"), F.format_string(
        "level weight %.2f, trend weight %.2f, season weight %.2f", "alpha", "beta", "gamma").alias("structure"))
    b = ar.select(*KEYS, "lags_used", "aic").distinct().select("series_id", "cut", F.lit("autoregression").alias("model"), F.concat(
        F.lit("changes on lags "), F.array_join(F.col("lags_used").cast("array<string>"), ", "), F.format_string(", AIC %.1f", "aic")).alias("structure"))
    if grown is None:
        return a.unionByName(b)
    named = F.array_join(F.zip_with("top", "share", lambda f, p: F.concat(f, F.format_string(" %.1f %%", p))), ", ")
    c = grown.select("series_id", "cut", F.lit("boosted_trees").alias("model"), F.concat(F.format_string("%d days ahead from %d rows: ", "horizon", "rows"), named).alias("structure"))
    return a.unionByName(b).unionByName(c)


def forecast(series: DataFrame, horizons=tuple(fixed.HORIZONS), feature_rows: DataFrame | None = None) -> DataFrame:
    """The selected model's point per horizon with interval, probability and risks, for every series at once."""
    tests = origins(series)
    every = landed(predictions(series, tests.unionByName(present(series)), horizons, feature_rows))  # read three times below
    actual = S.nearest(with_horizons(tests, horizons), series, "target_ts", 2, "actual").where("actual is not null")
    points = every.where("cut >= 0").join(actual.select("series_id", "cut", "horizon", "actual"), ["series_id", "cut", "horizon"])
    chosen = select_best(error_metrics(points))
    current = stats.latest(series).select("series_id", F.col("latest").alias("current"))
    now = every.where("cut = -1").withColumnRenamed("pred", "point").join(chosen, ["series_id", "horizon", "model"]).join(current, "series_id")
    base = now.select("series_id", F.col("origin").alias("as_of"), "horizon", "target_ts", "model", "point", "current", "rmse", "mape", "n_folds")
    out = with_interval(base, residual_table(points))
    return risks(out.withColumn("change_pct", F.try_divide(F.col("point") - F.col("current"), F.col("current")) * 100))


def log_rows(forecasts: DataFrame, refresh_id: str) -> DataFrame:
    return forecasts.select(F.lit(refresh_id).alias("refresh_id"), "series_id", "as_of", "horizon", "target_ts", "point", "model")


def realised(log: DataFrame, series: DataFrame) -> DataFrame:
    """Logged forecasts next to what happened; ``actual`` stays null while the target date is ahead."""
    return S.nearest(log, series, "target_ts", 2, "actual")


def realised_accuracy(scored: DataFrame) -> DataFrame:
    done = scored.where("actual is not null").withColumnRenamed("point", "pred")
    return error_metrics(done).drop("smape")


def pending(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("actual").alias("scored"), F.count_if(F.col("actual").isNull()).alias("pending"))


def companions(series: DataFrame, target: str, coverage: float = 0.6, most: int = 3) -> DataFrame:
    """Other series observed on enough of the target's dates, best covered first."""
    dates = series.where((F.col("series_id") == target) & F.col("value").isNotNull()).select("ts")
    total = dates.agg(F.count(F.lit(1)).alias("n")).scalar()
    have = series.where((F.col("series_id") != target) & F.col("value").isNotNull()).join(dates, "ts", "left_semi").groupBy("series_id").agg(F.count("value").alias("shared"))
    share = have.withColumn("coverage", F.col("shared") / total).where(F.col("coverage") >= coverage)
    return share.orderBy(F.desc("coverage"), "series_id").limit(most)


def explanation(forecasts: DataFrame, shares: DataFrame, drivers: DataFrame) -> DataFrame:
    """Direction and size of a forecast with the variance shares and the strongest significant drivers of its series."""
    strong = drivers.where("term <> 'const' and p_value < 0.05").groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.abs("standardised")).alias("k"), "term"))), lambda e: e["term"]).alias("drivers"))
    direction = F.when(F.col("change_pct") > 0.5, "up").when(F.col("change_pct") < -0.5, "down").otherwise("flat")
    return (forecasts.select("series_id", "horizon", "model", "change_pct", "rmse", "mape").withColumn("direction", direction)
            .join(shares.select("series_id", "trend_share", "seasonal_share", "residual_share"), "series_id", "left").join(strong, "series_id", "left")
            .withColumn("drivers", F.coalesce("drivers", F.array().cast("array<string>"))))
