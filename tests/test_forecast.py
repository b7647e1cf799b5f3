from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import series as S
from tidemark.plans import forecast as K

START = date(2018, 1, 1)


def seasonal(days, seed=0):
    i = np.arange(days)
    return 1000 + 100 * np.sin(2 * np.pi * i / 365.25) + 50 * (i // 365) + np.random.default_rng(seed).normal(0, 3, days)


def flat(series, n, name="x"):
    return series({name: [50.0] * n}, START)


def test_a_spike_never_reaches_earlier_features(series, rows):
    base = list(range(200))
    spiked = base.copy()
    spiked[150] += 1_000_000
    other = flat(series, 200)
    def run(v):
        return [tuple(r[c] for c in K.FEATURES) for r in rows(K.features(series({"p": v}, START), other, other), "ts")]
    a, b = run(base), run(spiked)
    assert a[:150] == b[:150] and a[150] != b[150]
    i = K.FEATURES.index("price_mean_7")
    assert a[150][i] == b[150][i] and a[151][i] != b[151][i]


def test_label_in_a_gap_is_null(series, rows):
    v = {START + timedelta(days=i): float(i) for i in range(100) if i != 57}
    p = series({"p": v})
    other = flat(series, 100)
    out = {r["ts"]: r["target"] for r in rows(K.labelled(K.features(p, other, other), p, 7))}
    assert out[START + timedelta(days=50)] is None and out[START + timedelta(days=49)] == 56.0


def test_naive_is_one_year_back(series, rows):
    p = series({"p": seasonal(800)}, START)
    cut = p.sparkSession.createDataFrame([("p", 0, START + timedelta(days=700))], "series_id string, cut int, origin date")
    out = rows(K.seasonal_naive(p, K.with_horizons(cut, (30,))))[0]
    assert out["pred"] == seasonal(800)[700 + 30 - 365]


def test_origins_leave_history_before_and_horizon_after(series, rows):
    out = rows(K.origins(series({"long": seasonal(365 * 6), "short": seasonal(365 * 3)}, START)), "cut")
    assert {r["series_id"] for r in out} == {"long"} and len(out) == 6
    assert out[0]["origin"] == date(2021, 1, 1) and out[-1]["origin"] == START + timedelta(days=365 * 6 - 1 - 185)


def test_training_sees_nothing_after_the_cut(series, rows):
    y = list(range(100))
    s = series({"p": y}, START)
    cut = s.sparkSession.createDataFrame([("p", 0, START + timedelta(days=58))], "series_id string, cut int, origin date")
    hist = rows(K.training(s, cut, "W"))[0]["hist"]
    assert hist[-1]["value"] == np.mean([56, 57, 58]) and hist[-2]["value"] == np.mean(range(49, 56)) and len(hist) == 9


def smooth_loop(y, m, steps, a, b, g):
    level, trend, season = np.mean(y[:m]), (np.mean(y[m:2 * m]) - np.mean(y[:m])) / m, list(y[:m] - np.mean(y[:m]))
    sse = 0.0
    for t in range(m, len(y)):
        s = season[t % m]
        sse += (y[t] - level - trend - s) ** 2
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[t % m] = g * (y[t] - new) + (1 - g) * s
        level = new
    return [level + h * trend + season[(len(y) + h - 1) % m] for h in range(1, steps + 1)], sse


def test_smoothing_matches_a_plain_loop():
    rng = np.random.default_rng(2)
    y = 100 + np.arange(48) + 10 * np.sin(np.arange(48) * np.pi / 6) + rng.normal(0, 2, (3, 48))
    path, weights, sse = paths.smooth(y, 12, 5)
    for row, p, w, e in zip(y, path, weights, sse):
        want, s = smooth_loop(row, 12, 5, *w)
        assert np.allclose(p, want) and abs(s - e) < 1e-6
        assert all(smooth_loop(row, 12, 1, *g)[1] >= e - 1e-9 for g in paths.GRID[::7])


def test_autoregression_against_least_squares(spark, series, rows):
    rng = np.random.default_rng(6)
    d = np.zeros(300)
    for t in range(2, 300):
        d[t] = 0.5 * d[t - 1] - 0.3 * d[t - 2] + rng.normal()
    y = 100 + np.cumsum(d)
    p = S.resample(series({"p": y}, START), "D")
    cut = spark.createDataFrame([("p", 0, START + timedelta(days=299))], "series_id string, cut int, origin date")
    out = rows(K.autoregression(K.history(p, cut), 3, (1, 2)), "step")
    dd = np.diff(y)
    m = np.column_stack([np.ones(297), dd[1:-1], dd[:-2]])
    b, *_ = np.linalg.lstsq(m, dd[2:], rcond=None)
    first = y[-1] + b @ [1, dd[-1], dd[-2]]
    assert out[0]["lags_used"] == [1, 2] and abs(out[0]["pred"] - first) < 1e-8


def test_vector_forecasts_follow_the_panel(spark, series, rows):
    rng = np.random.default_rng(7)
    x = 100 + np.cumsum(rng.normal(0, 1, 200))
    s = series({"x": x, "y": 2 * x + 5 + rng.normal(0, 0.01, 200)}, START)
    for correct in (False, True):
        out = rows(K.vector_autoregression(s, ["x", "y"], 4, depth=1, correct=correct), "step", "series_id")
        assert len(out) == 8 and all(abs(b["point"] - 2 * a["point"] - 5) < 1.5 for a, b in zip(out[::2], out[1::2]))
    dx = np.diff(np.column_stack([x, [r["value"] for r in rows(s.where("series_id = 'y'"), "ts")]]), axis=0)
    m = np.column_stack([np.ones(198), dx[:-1]])
    b, *_ = np.linalg.lstsq(m, dx[1:], rcond=None)
    first = rows(K.vector_autoregression(s, ["x", "y"], 1, depth=1).where("series_id = 'x'"))[0]["point"]
    assert abs(first - (x[-1] + np.r_[1, dx[-1]] @ b[:, 0])) < 1e-6


def panel_by_hand(levels, horizon, depth, correct):
    """Paths of a panel (rows x members) by plain least squares on the rows up to its end."""
    k, d = levels.shape[1], np.diff(levels, axis=0)
    x = [np.r_[1, *[d[t - p] for p in range(1, depth + 1)]] for t in range(depth, len(d))]
    if correct:
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(levels)), levels[:, 1:]]), levels[:, 0], rcond=None)[0]
        off = lambda v: v[0] - beta[0] - v[1:] @ beta[1:]
        x = [np.r_[row, off(levels[t])] for row, t in zip(x, range(depth, len(d)))]
    coef = np.linalg.lstsq(np.array(x), d[depth:], rcond=None)[0]
    level, past, out = levels[-1], list(d[::-1][:depth]), []
    for _ in range(horizon):
        step = np.r_[1, *past, *([off(level)] if correct else [])] @ coef
        level, past = level + step, [step, *past][:depth]
        out.append(level)
    assert k == len(level)
    return np.array(out)


def test_every_fold_of_a_panel_equals_plain_least_squares(spark, series, rows):
    rng = np.random.default_rng(11)
    base = np.cumsum(rng.normal(0, 1, 90))
    y = np.column_stack([100 + base + rng.normal(0, 1, 90), 50 + 2 * base + rng.normal(0, 1, 90), 20 + np.cumsum(rng.normal(0, 1, 90))])
    names = ["x", "y", "z"]
    def run(v):
        points, skipped = K.rolling_vectors(series({n: v[:, i] for i, n in enumerate(names)}, START), names, 6)
        return {(r["model"], r["series_id"], r["cut"], r["step"]): (r["pred"], r["actual"], r["anchor"]) for r in rows(points)}, rows(skipped, "model", "series_id", "cut")
    got, skipped = run(y)
    ends = [60, 66, 72, 78, 84]
    for model, correct in K.VECTOR_MODELS.items():
        for cut, end in enumerate(ends):
            want = panel_by_hand(y[:end], 6, 2, correct)
            if correct and end - 3 < 60:
                assert (model, "x", cut, 1) not in got
                continue
            for i, n in enumerate(names):
                for step in range(1, 7):
                    pred, actual, anchor = got[model, n, cut, step]
                    assert abs(pred - want[step - 1, i]) < 1e-7 and (actual, anchor) == (y[end + step - 1, i], y[end - 1, i])
    assert [(r["model"], r["series_id"], r["cut"], r["reason"]) for r in skipped] == [("error_correction", n, 0, "needs 60 complete rows of the panel, has 57") for n in names]
    later = y.copy()
    later[72:] += 1000
    changed, _ = run(later)
    assert all(changed[key][0] == v[0] for key, v in got.items() if key[2] <= 2) and any(changed[key][0] != v[0] for key, v in got.items() if key[2] > 2)


def test_relations_and_their_correction_against_plain_algebra(spark, series, rows):
    from tidemark.operators import regress
    rng = np.random.default_rng(21)
    base = np.cumsum(rng.normal(0, 1, 300))
    y = np.column_stack([10 + base + rng.normal(0, 0.5, 300), 5 + 0.5 * base + rng.normal(0, 0.5, 300), np.cumsum(rng.normal(0, 1, 300))])
    names = ["x", "y", "z"]
    s = series({n: y[:, i] for i, n in enumerate(names)}, START)
    d = np.diff(y, axis=0)
    given = np.column_stack([np.ones(298), d[:-1]])
    off = lambda m: m - given @ np.linalg.lstsq(given, m, rcond=None)[0]
    r0, r1 = off(d[1:]), off(y[1:-1])
    roots, vectors = np.linalg.eig(np.linalg.inv(r1.T @ r1) @ (r1.T @ r0) @ np.linalg.inv(r0.T @ r0) @ (r0.T @ r1))
    best = vectors.real[:, roots.real.argmax()]
    got = rows(regress.cointegrating_vectors(s, names), "relation", "member")
    assert [(g["relation"], g["member"], g["rank"]) for g in got] == [(1, n, 1) for n in names]
    assert np.allclose([g["weight"] for g in got], best / best[0], atol=1e-8) and abs(got[0]["root"] - roots.real.max()) < 1e-10 and abs(got[1]["weight"] + 2) < 0.2
    w = best / best[0]
    coef = np.linalg.lstsq(np.column_stack([given, y[1:-1] @ w]), d[1:], rcond=None)[0]
    level, change, want = y[-1], d[-1], []
    for _ in range(4):
        change = np.r_[1, change, level @ w] @ coef
        level = level + change
        want += level.tolist()
    out = rows(K.cointegrated_forecast(s, names, 4), "step", "series_id")
    assert np.allclose([r["point"] for r in out], want, atol=1e-7) and {r["status"] for r in out} == {"ok"}
    apart = series({n: np.cumsum(np.random.default_rng(30 + i).normal(0, 1, 300)) for i, n in enumerate(names)}, START)
    refused = rows(K.cointegrated_forecast(apart, names, 4))
    assert [r["point"] for r in refused] == [None] * 3 and {r["reason"] for r in refused} == {"the trace test finds no relation between the members"}
    assert [(r["rank"], r["status"], r["weight"]) for r in rows(regress.cointegrating_vectors(apart, names))] == [(0, "no_relation", None)]


def test_scoreboard_lists_the_reason_of_each_skip(spark, series, rows):
    p = series({"long": list(seasonal(90)), "short": list(seasonal(35)), "tiny": [1.0] * 10}, START)
    p = p.select("series_id", F.expr("last_day(add_months(date'2010-01-01', datediff(ts, date'2018-01-01')))").alias("ts"), "value")
    points = K.rolling_backtest(p, 6, "ME")
    board = {(r["series_id"], r["model"]): r for r in rows(K.scoreboard(K.pooled_metrics(points), p, ["holt_winters", "autoregression", "boosted_trees"], K.rolling_skips(p, 6, "ME")))}
    assert board["long", "holt_winters"]["status"] == "ok" and board["long", "holt_winters"]["reason"] is None and {board["long", m]["rank"] for m in ("holt_winters", "autoregression")} == {1, 2}
    assert board["short", "autoregression"]["reason"] == "needs 30 changes after lag 4, has 24" and board["short", "autoregression"]["skipped_folds"] == 2
    assert board["short", "holt_winters"]["status"] == "ok" and board["short", "holt_winters"]["skipped_folds"] == 1
    assert board["tiny", "holt_winters"]["reason"] == "no fold of 6 periods leaves enough to train on, has 10" and board["long", "boosted_trees"]["reason"] == "not asked for"


def test_sweeps_equal_separate_fits(spark, series, rows):
    rng = np.random.default_rng(5)
    season = rng.normal(0, 2, 12)
    d = np.array([season[t % 12] + rng.normal(0, 0.3) for t in range(160)])
    x = np.cumsum(rng.normal(0, 1, 161))
    y = 100 + np.r_[0, np.cumsum(d)] + 0.5 * x
    order = [1, 2, 4, 12]
    n, fits = paths.lag_fits(y, [x, np.ones(161)], order)  # the second driver never moves
    dy, dx = np.diff(y), np.diff(x)
    for p, (used, beta, aic, sigma) in enumerate(fits, 1):
        m = np.column_stack([np.ones(n), dx[12:], *[dy[12 - k:len(dy) - k] for k in order[:p]]])
        b, sse, *_ = np.linalg.lstsq(m, dy[12:], rcond=None)
        assert used == order[:p] and np.allclose(beta, np.r_[b[0], b[2:]], atol=1e-9) and abs(aic - (n * np.log(sse[0] / n) + 2 * (p + 3))) < 1e-6
    s = series({"p": y}, START)
    cut = spark.createDataFrame([("p", 0, START + timedelta(days=160))], "series_id string, cut int, origin date")
    scores = rows(K.lag_orders(K.history(S.resample(s, "D"), cut), 12), "aic")
    assert scores[0]["lags"] == order and scores[0]["chosen"] and sum(r["chosen"] for r in scores) == 1 and {r["n"] for r in scores} == {148}


POINTS = "series_id string, model string, horizon int, cut int, actual double, pred double"


def test_metrics_selection_interval_and_probability(spark, rows):
    data = [("a", "m1", 7, i, 100.0 + i, 100.0) for i in range(6)] + [("a", "m2", 7, i, 100.0, 90.0) for i in range(6)]
    pts = spark.createDataFrame(data, POINTS)
    metrics = K.error_metrics(pts)
    best = rows(K.select_best(metrics))[0]
    assert best["model"] == "m1" and best["runner_up"] == "m2" and best["gap_pct"] > 0
    base = spark.createDataFrame([("a", "m1", 7, 100.0, 102.0), ("a", "m3", 7, 100.0, 102.0)], "series_id string, model string, horizon int, point double, current double")
    out = {r["model"]: r for r in rows(K.with_interval(base, K.residual_table(pts)))}
    assert out["m1"]["lower"] == 100.25 and out["m1"]["upper"] == 104.75 and out["m1"]["bullish_pct"] == 50.0
    assert out["m3"]["lower"] is None and out["m3"]["bullish_pct"] is None and out["m3"]["residuals_used"] == 0
    notes = rows(K.risks(K.select_best(metrics).withColumn("horizon", F.lit(120)).withColumn("n_folds", F.lit(3))))[0]["risks"]
    assert len(notes) == 2


def test_pooled_metrics_by_hand(spark, rows):
    pts = spark.createDataFrame([("a", "m", 0, 10.0, 12.0, 11.0), ("a", "m", 0, 10.0, 8.0, 11.0), ("a", "m", 1, 10.0, 0.0, 1.0)], "series_id string, model string, cut int, anchor double, actual double, pred double")
    r = rows(K.pooled_metrics(pts))[0]
    a, p = np.array([12.0, 8, 0]), np.array([11.0, 11, 1])
    assert abs(r["rmse"] - np.sqrt(np.mean((a - p) ** 2))) < 1e-12 and abs(r["r2"] - (1 - np.sum((a - p) ** 2) / np.sum((a - a.mean()) ** 2))) < 1e-12
    assert abs(r["mape"] - np.mean([1 / 12, 3 / 8]) * 100) < 1e-9 and abs(r["directional_accuracy"] - 200 / 3) < 1e-9 and r["folds"] == 2


def test_folds_and_future_periods(series, rows):
    m = S.resample(series({"a": np.arange(365 * 5)}, START), "ME")
    f = rows(K.folds(m, 6), "cut")
    assert [r["cut"] for r in f] == [0, 1, 2, 3, 4] and str(f[-1]["origin"]) == "2022-06-30"
    assert [str(r["ts"]) for r in rows(K.future_periods(m, "SME", 3), "step")] == ["2023-01-15", "2023-01-31", "2023-02-15"]
    assert [str(r["ts"]) for r in rows(K.future_periods(m, "ME", 2), "step")] == ["2023-01-31", "2023-02-28"]


def test_similar_periods_exclude_the_recent_past_and_fall_back(spark, series, rows):
    y = list(seasonal(365 * 4, 3))
    other = flat(series, 365 * 4)
    last = START + timedelta(days=365 * 4 - 1)
    p = series({"p": y}, START)
    out = rows(K.similar_periods(K.features(p, other, other), p, 30), "rank")
    assert len(out) == 3 and all((last - r["ts"]).days >= 120 for r in out) and out[0]["distance"] <= out[-1]["distance"] and out[0]["days_back"] == 0
    y[-2] = None
    p = series({"p": y}, START)
    assert rows(K.similar_periods(K.features(p, other, other), p, 30), "rank")[0]["days_back"] > 0


def test_realised_accuracy_scores_only_what_has_happened(spark, series, rows):
    p = series({"p": [100.0] * 30}, START)
    log = spark.createDataFrame([("r", "p", START, 7, START + timedelta(days=7), 90.0, "m"), ("r", "p", START, 60, START + timedelta(days=60), 90.0, "m")],
                                "refresh_id string, series_id string, as_of date, horizon int, target_ts date, point double, model string")
    scored = K.realised(log, p)
    assert rows(K.pending(scored)) == [{"scored": 1, "pending": 1}]
    r = rows(K.realised_accuracy(scored))
    assert len(r) == 1 and r[0]["rmse"] == 10.0 and r[0]["mape"] == 10.0


def test_whole_forecast(spark, series, rows):
    p = series({"p": seasonal(365 * 5, 9), "q": seasonal(365 * 5, 10) * 2}, START)
    out = rows(K.forecast(p, (7, 30)), "series_id", "horizon")
    assert len(out) == 4 and all(r["lower"] <= r["upper"] for r in out) and all(abs(r["change_pct"]) < 40 for r in out)


def test_companions_need_enough_shared_dates(series, rows):
    s = series({"t": [1] * 10, "a": [1] * 9 + [None], "b": [1] * 3 + [None] * 7})
    assert [r["series_id"] for r in rows(K.companions(s, "t"))] == ["a"]


def test_each_model_runs_once(spark):
    """Filters on a model's result must not be pushed below it and evaluate it again."""
    from tidemark.plans import forecast as K
    from tidemark.sources import tables as T
    plan = K.backtest(T.prices(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_cuts_of_a_series_share_one_recursion(monkeypatch):
    """Cuts of a series, each with a begun last period of its own, are smoothed in one row, as if each were alone; only one that ends
    within the two seasons the recursion starts from needs a row of its own."""
    import pandas as pd
    rng = np.random.default_rng(8)
    values = []
    for n in (60, 75, 90):
        y = 100 + 10 * np.sin(np.arange(n) / 2) + rng.normal(0, 2, n)
        values += [np.r_[y[:k - 1], y[k - 1] + rng.normal()] for k in (30, 24, 23, n - 20, n - 1, n)]
    values.append(np.arange(24.0))
    seen, one = [], paths.smooth_cuts
    monkeypatch.setattr(paths, "smooth_cuts", lambda y, *rest: seen.append(len(y)) or one(y, *rest))
    got = paths.holt_winters_path.func(pd.Series(values), pd.Series([12] * 19), pd.Series([30] * 19))
    assert sum(seen) == 3 + 3 + 1
    for y, row in zip(values, got.itertuples()):
        if len(y) < 24:
            assert row.path is None
            continue
        path, weights, sse = paths.smooth(y[None], 12, 30)
        assert row.path == path[0].tolist() and (row.alpha, row.beta, row.gamma) == tuple(weights[0]) and row.sse == sse[0] and row.n == len(y) - 12


def test_autoregressions_together_are_those_alone():
    import pandas as pd
    rng = np.random.default_rng(9)
    values = [np.cumsum(rng.normal(0, 1, n)) for n in (20, 40, 60, 61, 200)] + [np.full(50, 3.0), np.arange(50.0)]
    args = lambda ys: (pd.Series(ys), pd.Series([[]] * len(ys)), pd.Series([[1, 2, 4]] * len(ys)), pd.Series([9] * len(ys)))
    got = paths.autoregressive_path.func(*args(values))
    assert got["path"].isna().tolist() == [True] + [False] * 6
    for i, y in enumerate(values[1:], 1):
        alone = paths.autoregressive_path.func(*args([y])).iloc[0]
        assert alone["lags"] == got["lags"][i] and np.allclose(alone["path"], got["path"][i]) and np.isclose(alone["aic"], got["aic"][i])
        used, beta, aic, _ = min(paths.lag_fits(y, [], [1, 2, 4])[1], key=lambda f: f[2])
        d = np.diff(y)
        assert used == got["lags"][i] and np.isclose(got["path"][i][0], y[-1] + beta[0] + sum(b * d[-k] for b, k in zip(beta[1:], used)))
