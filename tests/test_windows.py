from datetime import date, timedelta

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st

from tidemark.operators import seasonal as M, stats, windows as W


def test_sma_needs_a_full_window(series, rows):
    out = rows(series({"a": [1, 2, 3, None, 5]}).select("ts", W.sma("value", 3).alias("m")), "ts")
    assert [r["m"] for r in out] == [None, None, 2.0, None, None]


def test_ema_matches_the_recursion_with_gaps_and_over_many_blocks(series, rows):
    rng = np.random.default_rng(1)
    y = pd.Series(rng.normal(100, 10, 9000))
    y[rng.random(9000) < 0.2] = np.nan
    y[3000:3400] = np.nan
    for span in (3, 30):
        want = y.ewm(span=span, adjust=False, min_periods=span).mean()
        got = rows(W.with_ema(series({"a": [None if np.isnan(v) else v for v in y]}, date(1980, 1, 1)), span, "e").select("ts", "e"), "ts")
        ok = y.notna() & want.notna()
        have = {r["ts"]: r["e"] for r in got}
        days = [date(1980, 1, 1) + timedelta(days=i) for i in range(9000)]
        assert max(abs(have[days[i]] - want[i]) for i in np.where(ok)[0]) < 1e-8


def test_drawdown_by_hand(series, rows):
    r = rows(W.drawdown(series({"a": [100, 110, 120, 110, 90, 80, 60, 80, 100, 115, 120]})))[0]
    assert r["max_drawdown_pct"] == -50.0 and r["recovered"] and r["days_to_recover"] == 4
    assert rows(W.drawdown(series({"a": [3, 2, 1]})))[0]["recovered"] is False


def test_cagr_by_hand_and_gate(series, rows):
    n = 731
    ramp = {date(2020, 1, 1) + timedelta(days=i): 100 * 2 ** (i / (n - 1)) for i in range(n)}
    r = rows(stats.cagr(series({"a": ramp})))[0]
    assert abs(r["cagr_pct"] - 41.42) < 0.1 and r["status"] == "ok"
    r = rows(stats.cagr(series({"a": [1, 2, 3]})))[0]
    assert r["cagr_pct"] is None and (r["available_n"], r["required_n"]) == (3, 30)


def test_percentile_rank_and_constant_series(series, rows):
    r = rows(stats.percentile_rank(series({"a": [1, 2, 3, 4, 5]}), None, "all"))[0]
    assert (r["percentile"], r["median"], r["q1"]) == (100.0, 3.0, 2.0)
    assert rows(series({"a": [5] * 5}).select("ts", W.rolling_z("value", 3).alias("z")), "ts")[-1]["z"] is None


def test_buckets_equal_quantile_cut(spark, rows):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 2, 300), 1)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, x double")
    got = sorted((r["x"], r["bucket"]) for r in rows(W.quantile_bucket(df, "x", 5, ["g"])))
    want = sorted(zip(x, pd.qcut(x, 5, labels=False, duplicates="drop") + 1))
    assert [b for _, b in got] == [b for _, b in want]


def test_outliers_flag_but_keep(series, rows):
    out = rows(W.outliers(series({"a": [10, 11] * 20 + [500]})), "ts")
    assert len(out) == 41 and out[-1]["z_outlier"] and out[-1]["iqr_outlier"] and not out[0]["z_outlier"]


def test_seasonal_factors_are_recovered(series, rows):
    factor = {m: 1.0 for m in range(1, 13)} | {3: 0.8, 9: 1.2}
    monthly = {date(2015 + i // 12, i % 12 + 1, 1): 1000 * factor[i % 12 + 1] for i in range(72)}
    out = {r["month"]: r for r in rows(M.ratio_index(series({"a": monthly})))}
    assert abs(out[3]["index_100"] - 80) < 1.5 and abs(out[9]["index_100"] - 120) < 1.5 and abs(out[6]["index_100"] - 100) < 1.5
    assert M.ratio_index(series({"a": {date(2024, m, 1): m for m in range(1, 13)}})).count() == 0


def test_decomposition_against_numpy(series, rows):
    rng = np.random.default_rng(5)
    y = 100 + np.arange(60) + 10 * np.sin(np.arange(60) * np.pi / 6) + rng.normal(0, 1, 60)
    months = [date(2015 + i // 12, i % 12 + 1, 28) for i in range(60)]
    out = rows(M.decompose(series({"a": dict(zip(months, y))}), "ME"), "ts")
    w = np.r_[0.5, np.ones(11), 0.5] / 12
    trend = np.convolve(y, w, "valid")
    assert np.allclose([r["trend"] for r in out if r["trend"] is not None], trend)
    phase = np.array([np.mean((y[6:54] - trend)[[j for j in range(48) if (j + 6) % 12 == p]]) for p in range(12)])
    assert np.allclose([r["seasonal"] for r in out[:12]], phase - phase.mean())


def test_interpolation_stays_inside_decomposition(series, rows):
    s = series({"a": {date(2024, 1, 1): 10, date(2024, 1, 2): None, date(2024, 1, 5): 50}})
    out = rows(M.interpolate(s), "ts")
    assert [(r["value"], r["interpolated"]) for r in out] == [(10.0, False), (20.0, True), (50.0, False)]


def test_spacing_and_season_classes(series, rows):
    s = series({"a": {date(2020, 1, 5) + timedelta(days=7 * i): i for i in range(10)}})
    assert rows(W.spacing(s))[0]["freq"] == "W"
    v = {date(y, m, 10): float(m) for y in (2020, 2021) for m in range(1, 13)}
    out = {r["month"]: r["season"] for r in rows(M.season_profile(series({"a": v})))}
    assert out[12] == "Peak arrivals" and out[1] == "Lean arrivals" and out[6] == "Shoulder"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1e4), min_size=5, max_size=30), st.randoms())
def test_row_order_and_null_rows_do_not_matter(series, rows, values, rnd):
    items = [(date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)]
    mixed = items + [(date(2025, 1, 1), None)]
    rnd.shuffle(mixed)
    a, b = rows(stats.describe(series({"a": dict(items)})))[0], rows(stats.describe(series({"a": dict(mixed)})))[0]
    assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-6 * max(1.0, abs(a[k])) for k in a if isinstance(a[k], float))
