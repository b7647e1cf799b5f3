"""Regressions and tests that rest on moment matrices.

Windows build the lagged columns, one aggregate forms the cross products for all series, pairs and panels at once,
and a small solve runs on the one row left per key.  Sub-samples that differ only in how many first rows they skip
(one per lag order) share the aggregate: rows carry a class, the class sums are added up from the back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.config import GATES
from tidemark.functions import linalg, tails
from tidemark.operators.series import by_pair, panel
from tidemark.operators.stats import differenced



def _packed(grams: DataFrame, keys: list) -> DataFrame:
    return grams.groupBy(*keys).agg(F.collect_list(F.struct("h", "gram", "n")).alias("cells"))


# ---- Granger ------------------------------------------------------------------------------------------------------

def granger(pairs: DataFrame, max_lag: int = GATES.granger_max_lag, on_changes: bool = True) -> DataFrame:
    """Whether the past of a (column x) helps predict b (column y), per lag."""
    base = differenced(pairs) if on_changes else pairs
    order, whole = by_pair(), Window.partitionBy("a", "b")
    row = F.row_number().over(order)
    lagged = [F.expr(f"coalesce(lag({c}, {k}) over (partition by a, b order by ts), 0D) as {c}{k}") for c in ("y", "x") for k in range(1, max_lag + 1)]
    rows = base.select("a", "b", F.col("y").alias("y0"), F.lit(1.0).alias("one"), *lagged, F.least(row, F.lit(max_lag + 1)).alias("h"),
                       F.count(F.lit(1)).over(whole).alias("total"))
    cols = ["y0", "one"] + [f"{c}{k}" for c in ("y", "x") for k in range(1, max_lag + 1)]
    sized = rows.where(F.col("total") >= 20)
    packed = _packed(linalg.gram(sized, ["a", "b", "total", "h"], cols), ["a", "b", "total"])
    depth = F.when(F.col("total") < 3 * max_lag + 10, F.greatest(F.lit(1), F.floor((F.col("total") - 10) / 3))).otherwise(max_lag)
    tests = packed.select("a", "b", F.explode(linalg.granger_lags("cells", depth.cast("bigint"), F.lit(max_lag).cast("bigint"))).alias("t")).select("a", "b", "t.*")
    out = tests.withColumn("p_value", tails.f_p(F.col("f"), F.col("df1"), F.col("df2")))
    return out.withColumn("significant", F.col("p_value") < GATES.alpha)


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ts", F.col("y").alias("x"), F.col("x").alias("y"))


def influence(pairs: DataFrame, readings: DataFrame, max_lag: int = GATES.granger_max_lag) -> DataFrame:
    """Verdict per pair from the Granger tests in both directions, with the lead-lag peak beside it."""
    both = granger(pairs.unionByName(reversed_pairs(pairs)), max_lag)
    best = both.groupBy("a", "b").agg(F.min("p_value").alias("p"), F.bool_or("significant").alias("sig"))
    names = pairs.select("a", "b").distinct()
    fwd = best.withColumnsRenamed({"p": "p_ab", "sig": "sig_ab"})
    back = best.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("p").alias("p_ba"), F.col("sig").alias("sig_ba"))
    rows = names.join(fwd, ["a", "b"], "left").join(back, ["a", "b"], "left").join(readings, ["a", "b"], "left")
    ab, ba = F.coalesce("sig_ab", F.lit(False)), F.coalesce("sig_ba", F.lit(False))
    testable = F.col("p_ab").isNotNull() & F.col("p_ba").isNotNull()
    said = fixed.INFLUENCE_LABELS
    verdict = F.when(~testable, said["untested"]).when(ab & ba, said["both"]).when(ab | ba, said["one"]).otherwise(said["none"])
    a_first = (ab & ~ba) | (ab & ba & (F.col("p_ab") < F.col("p_ba")))
    return rows.select(
        "a", "b", ab.alias("a_to_b"), ba.alias("b_to_a"), "p_ab", "p_ba", verdict.alias("verdict"),
        F.when(testable & (ab | ba), F.when(a_first, F.col("a")).otherwise(F.col("b"))).alias("source_name"),
        F.when(testable & (ab | ba), F.when(a_first, F.col("b")).otherwise(F.col("a"))).alias("target_name"), "peak_lag", "peak_days", "peak_r")


def influence_edges(verdicts: DataFrame) -> DataFrame:
    """Graph edges; strength is -log10 of the p value of the edge's own direction."""
    p = F.when(F.col("source_name") == F.col("a"), F.col("p_ab")).otherwise(F.col("p_ba"))
    return verdicts.where(F.col("source_name").isNotNull()).select(
        F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.col("verdict").alias("kind"),
        (-F.log10(F.greatest(p, F.lit(1e-12)))).alias("strength"))


def leadership(verdicts: DataFrame) -> DataFrame:
    """Rank of every series by net influence, dominance, Granger pass rate and timing."""
    w = fixed.LEADERSHIP_WEIGHTS
    lead = F.when(F.col("peak_lag") > 0, F.col("a")).when(F.col("peak_lag") < 0, F.col("b"))

    def side(me, sig):
        one, two = F.col("verdict") == "One-way", F.col("verdict") == "Feedback"
        return F.struct(
            F.col(me).alias("series_id"), sig.cast("int").alias("win"), (one & (F.col("source_name") == F.col(me))).cast("int").alias("inf"),
            (one & (F.col("target_name") == F.col(me))).cast("int").alias("by"), (two & (F.col("source_name") == F.col(me))).cast("int").alias("dom"),
            F.coalesce((lead == F.col(me)).cast("int"), F.lit(0)).alias("led"), F.when(lead == F.col(me), F.abs("peak_days")).alias("days"),
            F.abs("peak_r").alias("peak"))
    ends = verdicts.select(F.explode(F.array(side("a", F.col("a_to_b")), side("b", F.col("b_to_a")))).alias("e")).select("e.*")
    agg = ends.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("comparisons"), F.sum("win").alias("granger_wins"), F.sum(F.coalesce("inf", F.lit(0))).alias("influences"),
        F.sum(F.coalesce("by", F.lit(0))).alias("influenced_by"), F.sum(F.coalesce("dom", F.lit(0))).alias("dominant"), F.sum("led").alias("times_leader"),
        F.coalesce(F.avg("days"), F.lit(0.0)).alias("mean_lead_days"), F.avg("peak").alias("mean_peak_r"))
    n = F.col("comparisons")
    net = ((F.col("influences") - F.col("influenced_by")) / n + 1) / 2
    score = (w["influence"] * net + w["dominance"] * F.col("dominant") / n + w["granger"] * F.col("granger_wins") / n + w["timing"] * F.col("times_leader") / n)
    out = agg.withColumn("win_rate", F.col("granger_wins") / n).withColumn("score", score)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("win_rate"), "series_id"))  # one row per panel member
    return out.withColumn("rank", rank)


# ---- unit roots, stationarity ----------------------------------------------------------------------------------

def response_surface_p(stat: Column, n_series: int = 1) -> Column:
    """Approximate p value of a unit-root t value from the published response surface."""
    i = n_series - 1
    s = sum((F.lit(c) * F.pow(stat, F.lit(float(k))) for k, c in enumerate(fixed.TAU_SMALL_P[i])), F.lit(0.0))
    g = sum((F.lit(c) * F.pow(stat, F.lit(float(k))) for k, c in enumerate(fixed.TAU_LARGE_P[i])), F.lit(0.0))
    return (F.when(stat > fixed.TAU_MAX[i], 1.0).when(stat < fixed.TAU_MIN[i], 0.0)
            .otherwise(normal_cdf(F.when(stat <= fixed.TAU_STAR[i], s).otherwise(g))))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function: series near zero, continued fraction in the tails."""
    a = F.least(F.abs(z), F.lit(38.0))
    dens = F.exp(-a * a / 2) / 2.5066282746310002
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("s")),
                         lambda acc, k: F.struct((acc["t"] * a * a / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * a * a / (2 * k + 1)).alias("s")),
                         lambda acc: acc["s"])
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc)
    upper = F.when(a < 3, 0.5 - dens * series).otherwise(dens / tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def dickey_fuller(series: DataFrame, keys=("series_id",), constant: bool = True, n_series: int = 1, max_lag: int | None = None) -> DataFrame:
    """ADF test of ``value`` per key with the lag order of lowest AIC.

    A series searches up to 12 (n/100)^(1/4) lags; as many columns are built as the longest series needs, which is one
    row asked for beforehand, unless ``max_lag`` states the search limit for all.
    """
    keys = list(keys)
    if max_lag is None:
        longest = series.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.count("value").alias("n")).agg(F.max("n")).first()[0] or 0
        max_lag = max(1, int(12 * (longest / 100) ** 0.25) + 1)
    order, whole = Window.partitionBy(*keys).orderBy("ts"), Window.partitionBy(*keys)
    known = series.where(F.col("value").isNotNull()).select(*keys, "ts", "value")
    change = F.col("value") - F.lag("value").over(order)
    base = known.select(*keys, "ts", "value", change.alias("d"), F.row_number().over(order).alias("_t"), F.count(F.lit(1)).over(whole).alias("total"))
    by = f"partition by {', '.join(keys)} order by ts"
    lagged = [F.expr(f"coalesce(lag(d, {k}) over ({by}), 0D) as d{k}") for k in range(1, max_lag + 1)]
    rows = base.select(*keys, "total", "d", F.lit(1.0).alias("one"), F.lag("value").over(order).alias("level"), *lagged,
                       F.least(F.col("_t"), F.lit(max_lag + 2)).alias("h")).where("d is not null")
    cols = ["d", "one", "level"] + [f"d{k}" for k in range(1, max_lag + 1)]
    sized = rows.where(F.col("total") >= GATES.stationarity)
    packed = _packed(linalg.gram(sized, keys + ["total", "h"], cols), keys + ["total"])
    out = packed.select(*keys, "total", linalg.unit_root("cells", "total", F.lit(constant)).alias("u")).select(*keys, "total", "u.*")
    crit = sum((F.lit(c) / F.pow(F.col("nobs").cast("double"), F.lit(float(k))) for k, c in enumerate(fixed.CRITICAL_5[n_series - 1])), F.lit(0.0))
    p = response_surface_p(F.col("stat"), n_series)
    return out.select(*keys, F.col("stat").alias("statistic"), p.alias("p_value"), crit.alias("critical_5"), F.col("lags").alias("lags_used"),
                      F.col("nobs").alias("observations"), (p < GATES.alpha).alias("rejects_unit_root"))


def _lag_products(most: int) -> Column:
    """The product of a deviation with each of its own lags, as (k, p) pairs."""
    return F.expr("array(" + ", ".join(f"named_struct('k', {k}, 'p', e * lag(e, {k}) over (partition by series_id order by ts))" for k in range(most + 1)) + ")")


def _autocovariances(walk: DataFrame, most: int) -> DataFrame:
    """Sums of lag products 0..most per series as an array ``g``, with ``ss``, the sum of squares of the running sum."""
    sums = (walk.withColumn("_l", _lag_products(most)).select("series_id", "n", "s", F.explode("_l").alias("_l"))
            .groupBy("series_id", "n", F.col("_l.k").alias("k")).agg(F.sum("_l.p").alias("g"), F.sum(F.col("s") * F.col("s")).alias("ss")))
    return sums.groupBy("series_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("g", F.lit(0.0)).alias("g")))), lambda e: e["g"]).alias("g"),
                                              F.max("ss").alias("ss"))


def kpss(series: DataFrame) -> DataFrame:
    """KPSS test around a constant with the data-driven number of autocovariances; stays in the JVM.

    The number of lags comes from the first n^(2/9) autocovariances; then exactly the autocovariances the longest choice
    needs are formed.  Both depths are one row asked for beforehand.
    """
    order, whole = Window.partitionBy("series_id").orderBy("ts"), Window.partitionBy("series_id")
    known = series.where(F.col("value").isNotNull())
    dev = known.select("series_id", "ts", (F.col("value") - F.avg("value").over(whole)).alias("e"), F.count(F.lit(1)).over(whole).alias("n"))
    walk = dev.where(F.col("n") >= GATES.stationarity).withColumn("s", F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nn = F.col("n").cast("double")
    covered = F.floor(F.pow(nn, F.lit(2.0 / 9.0))).cast("int")

    def total(weight, upto):
        return F.aggregate(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), F.lit(0.0),
                           lambda acc, i: acc + F.when(i <= upto, weight(i) * F.element_at("g", i + 1)).otherwise(0.0))
    longest = known.groupBy("series_id").agg(F.count("value").alias("n")).agg(F.max("n")).first()[0] or 0
    s0 = F.element_at("g", 1) / nn + 2.0 / nn * total(lambda i: F.lit(1.0), covered)
    s1 = 2.0 / nn * total(lambda i: i.cast("double"), covered)
    pick = F.floor(1.1447 * F.pow(F.pow(s1 / s0, F.lit(2.0)), F.lit(1.0 / 3.0)) * F.pow(nn, F.lit(1.0 / 3.0))).cast("int")
    chosen = _autocovariances(walk, int(longest ** (2 / 9)) + 1).select("series_id", F.least(pick, F.col("n").cast("int") - 1).alias("lags_used"))
    deepest = chosen.agg(F.max("lags_used")).first()[0] or 0
    rows = _autocovariances(walk, max(deepest, 1)).join(chosen, "series_id")
    bart = total(lambda i: 1.0 - i / (F.col("lags_used") + 1.0), F.col("lags_used"))
    rows = rows.withColumn("statistic", F.try_divide(F.col("ss") / (nn * nn), (F.element_at("g", 1) + 2.0 * bart) / nn))
    crit, ps = fixed.KPSS_CRITICAL, fixed.KPSS_P
    p = F.lit(ps[0])
    for (c0, c1), (p0, p1) in zip(zip(crit, crit[1:]), zip(ps, ps[1:])):
        p = F.when(F.col("statistic") > c0, p0 + (F.col("statistic") - c0) / (c1 - c0) * (p1 - p0)).otherwise(p)
    p = F.when(F.col("statistic") > crit[-1], ps[-1]).otherwise(p)
    return rows.select("series_id", "statistic", p.alias("p_value"), F.lit(crit[1]).alias("critical_5"), "lags_used", F.col("n").alias("observations"),
                       (p < GATES.alpha).alias("rejects_stationarity"))


def stationarity(series: DataFrame) -> DataFrame:
    """ADF and KPSS side by side, the combined verdict and the suggested order of differencing."""
    order = Window.partitionBy("series_id").orderBy("ts")
    changes = series.where(F.col("value").isNotNull()).select("series_id", "ts", (F.col("value") - F.lag("value").over(order)).alias("value"))
    level = dickey_fuller(series).select("series_id", F.col("statistic").alias("adf"), F.col("p_value").alias("adf_p"), F.col("lags_used").alias("adf_lags"))
    first = dickey_fuller(changes).select("series_id", F.col("p_value").alias("_p1"))
    k = kpss(series).select("series_id", F.col("statistic").alias("kpss"), F.col("p_value").alias("kpss_p"), F.col("lags_used").alias("kpss_lags"))
    both = level.join(k, "series_id").join(first, "series_id", "left")
    adf_ok, kpss_ok = F.col("adf_p") < GATES.alpha, F.col("kpss_p") >= GATES.alpha
    verdict = (F.when(adf_ok & kpss_ok, "stationary").when(~adf_ok & ~kpss_ok, "unit root").when(adf_ok, "trend-stationary").otherwise("difference-stationary"))
    d = F.when(adf_ok, 0).when(F.coalesce(F.col("_p1") < GATES.alpha, F.lit(True)), 1).otherwise(2)
    return both.select("series_id", "adf", "adf_p", "adf_lags", "kpss", "kpss_p", "kpss_lags", verdict.alias("verdict"), d.alias("integration_order"))


def autocorrelation(series: DataFrame, nlags: int = 40) -> DataFrame:
    """ACF (biased, full-sample mean) and Yule-Walker PACF with the 95 % band."""
    whole = Window.partitionBy("series_id")
    known = series.where(F.col("value").isNotNull())
    dev = known.select("series_id", "ts", (F.col("value") - F.avg("value").over(whole)).alias("e"), F.count(F.lit(1)).over(whole).alias("n")).where("n >= 20")
    lags = _lag_products(nlags)
    sums = (dev.withColumn("_l", lags).select("series_id", "n", F.explode("_l").alias("_l")).groupBy("series_id", "n", F.col("_l.k").alias("k"))
            .agg(F.sum("_l.p").alias("g"))).where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2) - 1))
    packed = sums.groupBy("series_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda e: e["g"]).alias("g")).where("g[0] > 0")
    acf = packed.withColumn("acf", F.transform("g", lambda v: v / F.element_at("g", 1)))
    both = acf.withColumn("pacf", linalg.partial_autocorrelation("acf"))
    band = 1.96 / F.sqrt(F.col("n").cast("double"))
    return both.select("series_id", "n", F.posexplode(F.arrays_zip("acf", "pacf")).alias("lag", "z")).select(
        "series_id", "lag", F.col("z.acf").alias("acf"), F.col("z.pacf").alias("pacf"), band.alias("band"))


# ---- cointegration ----------------------------------------------------------------------------------------------

def engle_granger(pairs: DataFrame) -> DataFrame:
    """Whether the residual of a on b has no unit root."""
    line = pairs.groupBy("a", "b").agg(F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("intercept"), F.count(F.lit(1)).alias("n"))
    rows = pairs.join(line.where(F.col("n") >= GATES.cointegration), ["a", "b"])
    resid = rows.select("a", "b", "ts", (F.col("x") - F.col("intercept") - F.col("slope") * F.col("y")).alias("value"))
    test = dickey_fuller(resid, ("a", "b"), constant=False, n_series=2)
    return test.join(line, ["a", "b"]).select("a", "b", "slope", "intercept", "statistic", "p_value", "critical_5", "lags_used", "n",
                                              F.col("rejects_unit_root").alias("cointegrated"))


def panel_rows(series: DataFrame, names) -> DataFrame:
    """Complete rows of a named panel with columns s0, s1, ... in date order."""
    wide = panel(series, names)
    return wide.dropna().select(F.lit("panel").alias("panel"), "ts", *[F.col(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names)])


def _johansen_moments(series: DataFrame, names) -> DataFrame:
    """Moments of changes, last levels, last changes and 1 over the complete rows of a panel, if they are enough."""
    k, order = len(names), Window.partitionBy("panel").orderBy("ts")
    rows = panel_rows(series, names)
    diff = rows.select("*", *[(F.col(f"s{i}") - F.lag(f"s{i}").over(order)).alias(f"c{i}") for i in range(k)])
    full = diff.select("panel", *[f"c{i}" for i in range(k)], *[F.lag(f"s{i}").over(order).alias(f"l{i}") for i in range(k)],
                       *[F.lag(f"c{i}").over(order).alias(f"p{i}") for i in range(k)], F.lit(1.0).alias("one")).dropna()
    cols = [f"{p}{i}" for p in "clp" for i in range(k)] + ["one"]
    return linalg.gram(full, ["panel"], cols).where(F.col("n") >= GATES.cointegration)


def johansen(series: DataFrame, names) -> DataFrame:
    """Trace and max-eigenvalue statistics of a panel, one row per null hypothesis 'rank <= r'.

    The panel has one row per common day, so its window is bounded by the calendar.
    """
    k = len(names)
    g = _johansen_moments(series, names)
    roots = g.withColumn("roots", linalg.johansen_vectors("gram", F.lit(k).cast("bigint"))["roots"])
    logs = roots.withColumn("g", F.transform("roots", lambda v: -F.col("n") * F.ln(1 - v)))
    crit = F.array(*[F.struct(F.array(*[F.lit(c) for c in fixed.JOHANSEN_TRACE[k - 1 - r]]).alias("t"), F.lit(fixed.JOHANSEN_MAX_EIGEN[k - 1 - r][1]).alias("m"))
                     for r in range(k)])
    flat = logs.select("n", "g", F.posexplode(F.arrays_zip("g", crit.alias("crit"))).alias("rank", "z"))
    trace = F.aggregate(F.slice("g", F.col("rank") + 1, F.size("g")), F.lit(0.0), lambda acc, v: acc + v)
    return flat.select("rank", trace.alias("trace"), F.col("z.crit.t")[0].alias("trace_90"), F.col("z.crit.t")[1].alias("trace_95"), F.col("z.crit.t")[2].alias("trace_99"),
                       (trace > F.col("z.crit.t")[1]).alias("rejected"), F.col("z.g").alias("max_eigen"), F.col("z.crit.m").alias("max_eigen_95"), "n")


def cointegrating_vectors(series: DataFrame, names) -> DataFrame:
    """Weights of the relations that the trace test finds in a panel: relation (from 1), member, ``weight`` (1 for the first member), ``root``, ``rank``,
    ``status``.  Without a relation there is one row without weights and the status no_relation."""
    k = len(names)
    fit = _johansen_moments(series, names).withColumn("v", linalg.johansen_vectors("gram", F.lit(k).cast("bigint")))
    logs = F.transform("v.roots", lambda r: -F.col("n") * F.ln(1 - r))
    tails_ = [F.aggregate(F.slice(logs, r + 1, k), F.lit(0.0), lambda acc, x: acc + x) for r in range(k)]
    kept = [F.when(t <= fixed.JOHANSEN_TRACE[k - 1 - r][1], r) for r, t in enumerate(tails_)]
    ranked = fit.withColumn("rank", F.coalesce(*kept, F.lit(k)))
    flat = ranked.where("rank > 0").select("rank", "v.roots", F.posexplode("v.vectors").alias("i", "w")).where("i < rank").select("rank", "roots", "i", F.posexplode("w").alias("j", "weight"))
    found = flat.select((F.col("i") + 1).alias("relation"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1).alias("member"), "weight", F.get("roots", "i").alias("root"), "rank", F.lit("ok").alias("status"))
    none = ranked.where("rank = 0").select(F.lit(None).cast("int").alias("relation"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("double").alias("weight"), F.get("v.roots", F.lit(0)).alias("root"), "rank",
                                           F.lit("no_relation").alias("status"))
    return found.unionByName(none)


# ---- drivers -----------------------------------------------------------------------------------------------------

def _driver_rows(targets: DataFrame, drivers: DataFrame, names, on_changes: bool) -> DataFrame:
    """Targets next to every driver on the same day, complete rows, as period-on-period changes."""
    wide = panel(drivers, names)
    rows = targets.where(F.col("value").isNotNull()).join(wide, "ts").dropna()
    order = Window.partitionBy("series_id").orderBy("ts")
    level = {"y": F.col("value"), **{f"x{i}": F.col(f"`{n}`") for i, n in enumerate(names)}}
    cols = {k: (c - F.lag(c).over(order) if on_changes else c) for k, c in level.items()}
    return rows.select("series_id", F.lit(1.0).alias("one"), *[c.alias(k) for k, c in cols.items()]).dropna()


def driver_regression(targets: DataFrame, drivers: DataFrame, names, on_changes: bool = True) -> DataFrame:
    """Coefficients of every target on the named drivers with se, t, p, standardised beta and fit."""
    k = len(names)
    rows = _driver_rows(targets, drivers, names, on_changes)
    g = linalg.gram(rows, ["series_id"], ["y", "one"] + [f"x{i}" for i in range(k)]).where(F.col("n") >= max(30, 5 * k))
    fit = g.withColumn("f", linalg.ols("gram", "n"))

    def at(i, j):
        """Position of (i, j) in the flattened upper triangle."""
        i, j, d = min(i, j), max(i, j), k + 2
        return F.element_at("gram", int(i * d - i * (i - 1) / 2 + (j - i)) + 1)

    def sd(i):
        return F.sqrt((at(i, i) - at(1, i) * at(1, i) / F.col("n")) / (F.col("n") - 1))
    dof = F.col("n") - (k + 1)
    r2 = 1 - F.try_divide("f.sse", "f.sst")
    terms = F.array(*[F.struct(F.lit(n).alias("term"), F.col("f.beta")[i].alias("coefficient"), F.col("f.se")[i].alias("se"),
                               (F.col("f.beta")[i] * sd(i + 1) / sd(0) if i else F.lit(None).cast("double")).alias("standardised"))
                      for i, n in enumerate(["const", *names])])
    stat = F.try_divide(r2 / k, (1 - r2) / dof)
    flat = fit.select("series_id", "n", r2.alias("r_squared"), (1 - (1 - r2) * (F.col("n") - 1) / dof).alias("adj_r_squared"), stat.alias("f"),
                      dof.alias("dof"), F.explode(terms).alias("t")).select("*", "t.*").drop("t")
    flat = flat.withColumn("t", F.try_divide("coefficient", "se"))
    return flat.select("series_id", "term", "coefficient", "se", "t", tails.student_p(F.col("t"), F.col("dof")).alias("p_value"), "standardised",
                       "r_squared", "adj_r_squared", tails.f_p(F.col("f"), F.lit(k), F.col("dof")).alias("f_p_value"), "n")


def variance_inflation(drivers: DataFrame, names) -> DataFrame:
    """How far each driver is explained by the others."""
    rows = panel_rows(drivers, names).withColumn("one", F.lit(1.0))
    k = len(names)
    g = linalg.gram(rows, ["panel"], ["one"] + [f"s{i}" for i in range(k)]).where(F.col("n") > k + 1)
    flat = g.withColumn("v", linalg.inflation("gram")).select("n", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("variable"), F.col("v").alias("vif"))).alias("z"))
    vif = F.col("z.vif")
    label = F.when(vif.isNull(), "constant")
    for bound, text in fixed.COLLINEARITY_LABELS:
        label = label.otherwise(text) if bound is None else label.when(vif > bound, text)
    return flat.select(F.col("z.variable").alias("variable"), vif.alias("vif"), label.alias("interpretation"), "n")
