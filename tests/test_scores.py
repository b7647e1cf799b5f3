from datetime import date

from tidemark.operators import seasonal as M
from tidemark.plans import modules as X, scores as Z

PRICE = "series_id string, regime string, trend_status string, roc_30 double, cv_30 double, max_drawdown_pct double, percentile_1y double, observations bigint"


def price(spark, **over):
    base = dict(series_id="a", regime="uptrend", trend_status="ok", roc_30=10.0, cv_30=0.05, max_drawdown_pct=-40.0, percentile_1y=90.0, observations=200)
    row = {**base, **over}
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in PRICE.split(", "))], PRICE)


def arrivals(spark, **over):
    cols = "series_id string, as_of date, yoy_pct double, mom_pct double, mean_30 double, mean_90 double"
    a = dict(series_id="arrivals", as_of=date(2024, 3, 5), yoy_pct=-10.0, mom_pct=1.0, mean_30=100.0, mean_90=100.0, **{})
    a.update(over)
    o = dict(series_id="offtake", as_of=date(2024, 3, 5), yoy_pct=50.0, mom_pct=None, mean_30=1.0, mean_90=1.0)
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in cols.split(", ")) for r in (a, o)], cols)


def test_variety_scores_by_hand(spark, rows):
    r = rows(Z.variety_scores(price(spark)))[0]
    assert r["market_strength"] == round((100 + 75 + 90) / 3, 1) and r["stability"] == 50.0 and r["risk"] == 50.0 and r["confidence"] == 100.0


def test_strength_needs_two_of_three(spark, rows):
    r = rows(Z.variety_scores(price(spark, regime=None, trend_status="insufficient_evidence", roc_30=None)))[0]
    assert r["market_strength"] is None and r["strength_parts"] == 1
    assert rows(Z.variety_scores(price(spark, regime=None)))[0]["market_strength"] == round((75 + 90) / 2, 1)


def deviations(spark, pct):
    return spark.createDataFrame([("a", date(2024, 2, 1), -50.0), ("a", date(2024, 3, 1), pct)], "series_id string, ts date, deviation_pct double")


def test_votes_all_one_way_and_missing_is_not_neutral(spark, rows):
    r = rows(Z.votes(price(spark), deviations(spark, 20.0), arrivals(spark)))[0]
    assert (r["bullish"], r["bearish"], r["signals"]) == (100.0, 0.0, 4)
    r = rows(Z.votes(price(spark, regime=None, roc_30=None), deviations(spark, None), arrivals(spark)))[0]
    assert (r["bullish"], r["signals"]) == (100.0, 1)
    r = rows(Z.votes(price(spark, regime="range_bound", roc_30=0.0), deviations(spark, 0.0), arrivals(spark, yoy_pct=5.0)))[0]
    assert (r["bullish"], r["bearish"], r["signals"]) == (0.0, 25.0, 4)


def test_market_scores_and_renormalised_composite(spark, rows):
    months = spark.createDataFrame([("arrivals", 3, 3000.0, "peak")], "series_id string, month int, mean_total double, position string")
    surplus = spark.createDataFrame([(date(2023, 1, 1), 2.5)], "ts date, surplus double")
    m = Z.market_scores(arrivals(spark), months, surplus)
    r = rows(m)[0]
    assert r["supply_pressure"] == round((40 + 50 + 75) / 3, 1) and r["arrival_pressure"] == 65.0 and r["demand"] == 100.0
    full = rows(Z.composite(Z.variety_scores(price(spark)), m))[0]
    assert full["parts_used"] == 4 and not full["weights_renormalised"]
    part = rows(Z.composite(Z.variety_scores(price(spark, cv_30=None)), m))[0]
    assert part["parts_used"] == 3 and part["weights_renormalised"]


def test_balance_leaves_estimates_out(spark, rows):
    b = spark.createDataFrame([("Total Supply", str(y), y, 10.0 + y - 2015, False) for y in range(2015, 2024)] + [("Total Supply", "2024(exp)", 2024, 999.0, True), ("Import", "2023", 2023, 0.0, False)],
                              "category string, year_label string, year int, value double, is_estimate boolean")
    out = {r["series_id"]: r for r in rows(X.balance_module(b))}
    assert out["Total Supply"]["latest_value"] == 18.0 and out["Total Supply"]["estimate"] == 999.0 and out["Total Supply"]["cagr_status"] == "ok"
    assert out["Import"]["cagr_pct"] is None


def test_sparse_storage_is_always_refused_for_trend(spark, series, rows):
    out = {r["series_id"]: r for r in rows(X.storage_module(series({"north": [5, None, 7]}), ["north", "south"]))}
    assert out["north"]["status"] == "insufficient_evidence_for_trend" and out["north"]["latest"] == 7.0 and out["south"]["status"] == "insufficient_evidence"


def test_monthly_driver_is_not_spread_over_weeks(series, rows):
    s = series({"d": [1, 2, 3], "m": [4]})
    out = {r["series_id"]: r for r in rows(X.exogenous_candidates(s, "W", ["d", "m", "none"], monthly=("m",)))}
    assert out["d"]["status"] == "ok" and "monthly" in out["m"]["reason"] and out["none"]["reason"] == "no data"


def test_peak_and_lean_months(series, rows):
    v = {date(y, m, 1): float(m) for y in (2020, 2021) for m in range(1, 13)}
    out = {r["month"]: r["position"] for r in rows(M.peak_lean(series({"a": v})))}
    assert [m for m in out if out[m] == "peak"] and out[12] == "peak" and out[1] == "lean"
    one = {date(2020, m, 1): float(m) for m in range(1, 13)}
    assert {r["position"] for r in rows(M.peak_lean(series({"a": one})))} == {None}
