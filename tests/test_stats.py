from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import linalg, tails
from tidemark.operators import regress as G, series as S, stats

RNG = np.random.default_rng(11)


def walk(n, seed, scale=1.0):
    return 100 + np.cumsum(np.random.default_rng(seed).normal(0, scale, n))


def test_tail_probabilities():
    assert abs(tails.student_tail(2.0, 10) - 0.0733880) < 1e-6
    assert abs(tails.student_tail(1.959964, 1e6) - 0.05) < 1e-5
    x = 20 / (20 + 4 * 3.0)  # closed form for four numerator degrees
    assert abs(tails.f_tail(3.0, 4, 20) - x ** 10 * (1 + 10 * (1 - x))) < 1e-12
    assert tails.student_tail(0.0, 5) == 1.0


def test_pearson_spearman_and_refusals(series, rows):
    x, y = walk(80, 1), walk(80, 2)
    s = series({"x": x, "y": y, "k": [5] * 80, "t": list(x[:10])})
    out = {(r["a"], r["b"]): r for r in rows(stats.pearson(S.align(s, [("x", "y"), ("x", "k"), ("x", "t")])))}
    assert abs(out["x", "y"]["r"] - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert out["x", "k"]["status"] == "insufficient_evidence" and "constant" in out["x", "k"]["reason"]
    assert out["x", "t"]["r"] is None and "few" in out["x", "t"]["reason"]
    rank = rows(stats.spearman(S.align(series({"x": x, "y": np.exp(x / 50)}), [("x", "y")])))[0]
    assert abs(rank["r"] - 1) < 1e-12


@pytest.mark.parametrize("lag", [5, -5])
def test_injected_lag_is_found(series, rows, lag):
    base = np.sin(np.arange(130) * 0.37) + RNG.normal(0, 0.01, 130)
    x, y = base[10:120], base[10 - lag:120 - lag]
    p = S.align(series({"x": x, "y": y}), [("x", "y")])
    assert rows(stats.best_lag(stats.correlogram(p, 7)))[0]["best_lag"] == lag
    reading = rows(stats.lead_lag(stats.cross_correlation(p, 7)))[0]
    assert reading["peak_lag"] == lag and reading["leader"] == ("x" if lag > 0 else "y") and "periods" in reading["sentence"]


def test_elasticity_one_half(series, rows):
    x = np.arange(1, 101, dtype=float)
    r = rows(stats.log_elasticity(S.align(series({"x": x, "y": np.sqrt(x)}), [("x", "y")])))[0]
    assert abs(r["elasticity"] - 0.5) < 1e-9 and abs(r["r_squared"] - 1) < 1e-9
    assert rows(stats.log_elasticity(S.align(series({"x": -x, "y": x}), [("x", "y")]))) == []


def test_trend_regimes(series, rows):
    assert rows(stats.trend(series({"a": np.arange(1, 50)})))[0]["regime"] == "uptrend"
    assert rows(stats.trend(series({"a": 100 - np.arange(50)})))[0]["regime"] == "downtrend"
    flat = rows(stats.trend(series({"a": [7] * 50})))[0]
    assert flat["regime"] == "range_bound" and flat["r_squared"] == 0.0
    assert rows(stats.trend(series({"a": [1, 2, 3]})))[0]["status"] == "insufficient_evidence"


def test_spread_flags_an_anomaly(series, rows):
    a = np.r_[np.full(99, 110.0) + RNG.normal(0, 1, 99), 200.0]
    r = rows(stats.pair_spread(S.align(series({"a": a, "b": [100.0] * 100}), [("a", "b")])))[0]
    assert r["anomaly"] and abs(r["premium_pct"] - 100) < 1e-9


def test_wide_and_narrow_moment_matrices_agree(spark, rows):
    z = RNG.normal(size=(200, 15))
    df = spark.createDataFrame([(i % 2, *map(float, r)) for i, r in enumerate(z)], "k int, " + ", ".join(f"c{i} double" for i in range(15))).repartition(5)
    out = {r["k"]: r for r in rows(linalg.gram(df, ["k"], [f"c{i}" for i in range(15)]))}
    for k in (0, 1):
        assert np.allclose(linalg.square(out[k]["gram"]), z[k::2].T @ z[k::2]) and out[k]["n"] == 100
    few = {r["k"]: r for r in rows(linalg.gram(df, ["k"], ["c0", "c1"]))}
    assert np.allclose(linalg.square(few[0]["gram"]), (z[::2].T @ z[::2])[:2, :2])


def granger_numpy(x, y, p):
    dx, dy = np.diff(x), np.diff(y)
    n = len(dy) - p
    lag = lambda v: np.column_stack([v[p - k:len(v) - k] for k in range(1, p + 1)])
    own = np.column_stack([np.ones(n), lag(dy)])
    both = np.column_stack([own, lag(dx)])
    sse = lambda m: float(np.sum((dy[p:] - m @ np.linalg.lstsq(m, dy[p:], rcond=None)[0]) ** 2))
    r, u = sse(own), sse(both)
    return (r - u) / u / p * (n - 2 * p - 1)


def test_granger_against_least_squares(series, rows):
    x = walk(160, 4)
    y = 50 + np.r_[0, 0, np.cumsum(np.diff(x)[:-1])] + walk(160, 5, 0.3)
    out = {r["lag"]: r for r in rows(G.granger(S.align(series({"x": x, "y": y}), [("x", "y")]), 4))}
    for p in (1, 2, 3, 4):
        assert abs(out[p]["f"] - granger_numpy(x, y, p)) < 1e-6 * max(1, out[p]["f"])
    assert out[1]["significant"]


def adf_numpy(y, constant=True):
    n = len(y)
    d = np.diff(y)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - int(constant) - 1)

    def fit(p, skip):
        t = np.arange(skip, len(d))
        x = [y[t]] + [d[t - k] for k in range(1, p + 1)] + ([np.ones(len(t))] if constant else [])
        x = np.column_stack(x)
        b, *_ = np.linalg.lstsq(x, d[t], rcond=None)
        e = d[t] - x @ b
        return b, e, x
    scores = []
    for p in range(top + 1):
        _, e, x = fit(p, top)
        m = len(e)
        scores.append((m * (np.log(2 * np.pi) + np.log(e @ e / m) + 1) + 2 * x.shape[1], p))
    p = min(scores)[1]
    b, e, x = fit(p, p)
    s2 = e @ e / (len(e) - x.shape[1])
    return b[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0]), p


def test_unit_root_against_least_squares(series, rows):
    noise = RNG.normal(0, 1, 150)
    ar = np.zeros(150)
    for i in range(1, 150):
        ar[i] = 0.3 * ar[i - 1] + noise[i]
    data = {"walk": walk(150, 8), "ar": 100 + ar}
    out = {r["series_id"]: r for r in rows(G.dickey_fuller(series(data)))}
    for name, y in data.items():
        stat, lags = adf_numpy(np.asarray(y))
        assert abs(out[name]["statistic"] - stat) < 1e-6 and out[name]["lags_used"] == lags
    assert out["ar"]["rejects_unit_root"] and not out["walk"]["rejects_unit_root"]
    assert abs(out["walk"]["critical_5"] + 2.88) < 0.02


def test_response_surface_hits_the_published_five_percent_point(spark):
    r = spark.range(1).select(G.response_surface_p(F.lit(-2.8615)).alias("p"), G.normal_cdf(F.lit(1.959964)).alias("c"), G.normal_cdf(F.lit(-5.0)).alias("d"),
                              G.response_surface_p(F.lit(-3.3361), 2).alias("q")).first()
    assert abs(r.p - 0.05) < 0.002 and abs(r.q - 0.05) < 0.002 and abs(r.c - 0.975) < 1e-6 and abs(r.d - 2.866516e-7) < 1e-12


def test_kpss_and_verdicts(series, rows):
    y = walk(200, 9)
    e = y - y.mean()
    n = len(e)
    g = [e[k:] @ e[:n - k] for k in range(n)]
    c = int(n ** (2 / 9))
    s0, s1 = g[0] / n + 2 / n * sum(g[1:c + 1]), 2 / n * sum(i * g[i] for i in range(1, c + 1))
    lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
    want = (np.cumsum(e) ** 2).sum() / n ** 2 / ((g[0] + 2 * sum(g[i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n)
    out = rows(G.kpss(series({"w": y})))[0]
    assert abs(out["statistic"] - want) < 1e-9 and out["lags_used"] == lags
    v = {r["series_id"]: r for r in rows(G.stationarity(series({"w": y, "s": RNG.normal(0, 1, 200)})))}
    assert v["w"]["verdict"] == "unit root" and v["w"]["integration_order"] == 1 and v["s"]["integration_order"] == 0


def test_autocorrelations(series, rows):
    y = RNG.normal(size=120)
    y[1:] += 0.6 * y[:-1]
    e = y - y.mean()
    acf = np.array([e[k:] @ e[:120 - k] for k in range(6)]) / (e @ e)
    out = rows(G.autocorrelation(series({"a": y}), 5), "lag")
    assert np.allclose([r["acf"] for r in out], acf)
    for k in (1, 3, 5):
        toeplitz = np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(out[k]["pacf"] - np.linalg.solve(toeplitz, acf[1:k + 1])[-1]) < 1e-9


def test_cointegration_finds_the_shared_trend(series, rows):
    base = walk(250, 20)
    data = {"a": base + RNG.normal(0, 0.5, 250), "b": 2 * base + RNG.normal(0, 0.5, 250), "c": walk(250, 21)}
    out = {(r["a"], r["b"]): r for r in rows(G.engle_granger(S.align(series(data), S.all_pairs("abc"))))}
    assert out["a", "b"]["cointegrated"] and not out["a", "c"]["cointegrated"]
    jo = rows(G.johansen(series(data), ["a", "b", "c"]), "rank")
    assert [r["rejected"] for r in jo][:2] == [True, False] and jo[0]["trace_95"] == fixed.JOHANSEN_TRACE[2][1]
    x = np.column_stack([data[k] for k in "abc"])
    d = np.diff(x, axis=0)
    z = np.column_stack([np.ones(len(d) - 1), d[:-1]])
    res = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    r0, r1 = res(d[1:]), res(x[1:-1])
    n = len(r0)
    roots = np.linalg.eigvals(np.linalg.solve(r1.T @ r1 / n, (r0.T @ r1 / n).T @ np.linalg.solve(r0.T @ r0 / n, r0.T @ r1 / n))).real
    assert abs(jo[0]["trace"] + n * np.log(1 - roots).sum()) < 1e-6 * abs(jo[0]["trace"])


def test_driver_regression_against_least_squares(series, rows):
    x1, x2 = walk(120, 30), walk(120, 31)
    y = 3 * x1 - 2 * x2 + walk(120, 32, 0.5)
    out = {r["term"]: r for r in rows(G.driver_regression(series({"y": y}), series({"x1": x1, "x2": x2}), ["x1", "x2"]))}
    m = np.column_stack([np.ones(119), np.diff(x1), np.diff(x2)])
    b, *_ = np.linalg.lstsq(m, np.diff(y), rcond=None)
    e = np.diff(y) - m @ b
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * (e @ e) / (119 - 3))
    assert np.allclose([out[t]["coefficient"] for t in ("const", "x1", "x2")], b) and np.allclose([out[t]["se"] for t in ("const", "x1", "x2")], se)
    assert abs(out["x1"]["standardised"] - b[1] * np.diff(x1).std(ddof=1) / np.diff(y).std(ddof=1)) < 1e-9
    vif = {r["variable"]: r for r in rows(G.variance_inflation(series({"p": x1, "q": x1 + RNG.normal(0, 0.01, 120), "k": [1.0] * 120}), ["p", "q", "k"]))}
    assert vif["p"]["interpretation"] == "Severe collinearity" and vif["k"]["vif"] is None


def test_influence_and_ranking(series, rows):
    x = walk(200, 40)
    y = 100 + np.r_[0, np.cumsum(np.r_[0, np.diff(x)[:-1]])] + RNG.normal(0, 0.05, 200)
    pairs = S.align(series({"x": x, "y": y}), [("x", "y")])
    verdicts = G.influence(pairs, stats.lead_lag(stats.cross_correlation(pairs, 5)), 2)
    v = rows(verdicts)[0]
    assert v["a_to_b"] and v["source_name"] == "x" and v["peak_lag"] == 1
    rank = rows(G.leadership(verdicts), "rank")
    assert rank[0]["series_id"] == "x" and rank[0]["score"] > rank[1]["score"]
    edge = rows(G.influence_edges(verdicts))[0]
    assert (edge["source"], edge["target"]) == ("x", "y") and edge["strength"] > 1


def test_welch_and_buckets(series, rows):
    n = 120
    q = RNG.uniform(1, 100, n)
    y = 100 * np.cumprod(1 + np.r_[0, np.where(q[:-1] > 80, -0.02, 0.01)] + RNG.normal(0, 0.001, n))
    p = S.align(series({"q": q, "y": y}), [("q", "y")])
    b = rows(stats.thresholds(p), "bucket")
    assert len(b) == 5 and b[-1]["next_change_pct"] < b[0]["next_change_pct"] and sum(r["n"] for r in b) == n
    assert rows(stats.threshold_test(p))[0]["p_value"] < 0.01
    assert stats.thresholds(S.align(series({"q": q[:20], "y": y[:20]}), [("q", "y")])).count() == 0


def test_battery_of_every_series_from_one_shuffle(series, rows):
    rng = np.random.default_rng(8)
    y = 100 + np.cumsum(rng.normal(0, 1, 800))
    df = series({"a": y.tolist(), "few": [1.0, None, 3.0], "flat": [5.0] * 40})
    out = stats.battery(df)
    got = {(r["series_id"], r["section"], r["statistic"]): r for r in rows(out)}
    value = lambda section, name: got["a", section, name]["value"]
    d = y - y.mean()
    ch = np.diff(y) / y[:-1] * 100
    top = np.maximum.accumulate(y)
    want = {("descriptive", "mean"): y.mean(), ("descriptive", "median"): np.median(y), ("rolling", "sd"): y[-30:].std(ddof=1), ("rolling", "z"): (y[-1] - y[-30:].mean()) / y[-30:].std(ddof=1),
            ("changes", "mean_abs_pct"): np.abs(ch).mean(), ("changes", "up_share_pct"): (ch > 0).mean() * 100, ("outliers", "beyond_3_sd"): (np.abs(d / y.std(ddof=1)) > 3).sum(),
            ("autocorrelation", "lag_10"): (d[10:] * d[:-10]).sum() / (d * d).sum(), ("drawdown", "deepest_pct"): ((y - top) / top).min() * 100,
            ("trend", "slope_pct"): np.polyfit(np.arange(800), y, 1)[0] / y.mean() * 100, ("trend", "r_squared"): np.corrcoef(np.arange(800), y)[0, 1] ** 2}
    for key, v in want.items():
        assert abs(value(*key) - v) < 1e-9, key
    assert abs(value("seasonal_index", "month_3") - np.mean([v for i, v in enumerate(y) if (date(2020, 1, 1) + timedelta(days=i)).month == 3]) / y.mean()) < 1e-12
    assert got["few", "descriptive", "mean"]["status"] == "insufficient_evidence" and got["few", "descriptive", "mean"]["value"] is None and got["few", "changes", "longest_gap_days"]["value"] == 2.0
    assert got["flat", "trend", "r_squared"]["value"] is None and got["flat", "rolling", "z"]["value"] is None and got["flat", "seasonal_index", "month_1"]["status"] == "insufficient_evidence"
    plan = stats.battery(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series_id") == 1 and rows(stats.battery(df.where("false"))) == []
