from datetime import date, timedelta
from math import floor

import numpy as np
import pytest

from tidemark.functions import trees as G
from tidemark.plans import forecast as K

START = date(2018, 1, 1)


def one_model(x, y, asked, rounds, depth, rate):
    """One boosted model in plain loops: prediction of the asked row."""
    n, width = len(y), len(asked)
    def bins_of(row):
        return [min(sum(x[i][f] < row[f] for i in range(n)) * G.BINS // n, G.BINS - 1) for f in range(width)]
    bins, last = [bins_of(r) for r in x], bins_of(asked)
    pred, point = [floor(sum(y) / n)] * n, floor(sum(y) / n)
    for _ in range(rounds):
        rest = [a - b for a, b in zip(y, pred)]
        groups, own = [(list(range(n)), True)], None
        for _ in range(depth):
            nxt = []
            for members, here in groups:
                best = (0.0, None, None)
                g = float(sum(rest[i] for i in members))
                for f in range(width):
                    for b in range(G.BINS):
                        left = [i for i in members if bins[i][f] <= b]
                        m = len(members) - len(left)
                        if len(left) >= G.SMALLEST and m >= G.SMALLEST:
                            lg = float(sum(rest[i] for i in left))
                            gain = lg * lg / (len(left) + G.RIDGE) + (g - lg) * (g - lg) / (m + G.RIDGE) - g * g / (len(members) + G.RIDGE)
                            if gain > best[0]:
                                best = (gain, f, b)
                _, f, b = best
                right = [i for i in members if f is not None and bins[i][f] > b]
                goes = f is not None and last[f] > b
                nxt += [([i for i in members if i not in set(right)], here and not goes), (right, here and goes)]
            groups = nxt
        for members, here in groups:
            v = floor(rate * sum(rest[i] for i in members) / (len(members) + G.RIDGE)) if members else 0
            for i in members:
                pred[i] += v
            point += v if here else 0
    return point


@pytest.mark.parametrize("rounds, depth, rate", [(6, 2, 0.4), (4, 3, 0.3)])
def test_models_grown_together_equal_each_grown_alone(rounds, depth, rate):
    r = np.random.default_rng(1)
    xs, ys = [], []
    for m, n in enumerate((60, 85, 40)):
        x = np.round(r.normal(size=(n + 1, 4)), 1)
        x[:, 3] = r.integers(0, 3, n + 1)
        y = np.floor(1000 * (x[:, 0] > 0.3) + 300 * m * x[:, 1] + r.normal(0, 20, n + 1))
        xs.append(x)
        ys.append(y)
    train = [np.r_[np.ones(len(y) - 1, bool), False] for y in ys]
    pred, gains = G.grow(np.concatenate([G.binned(x, t) for x, t in zip(xs, train)]), np.concatenate(ys), np.repeat(np.arange(3), [len(y) for y in ys]), np.concatenate(train), rounds, depth, rate)
    got = pred[~np.concatenate(train)]
    want = [one_model(x[:-1].tolist(), [int(v) for v in y[:-1]], x[-1].tolist(), rounds, depth, rate) for x, y in zip(xs, ys)]
    assert got.tolist() == want and gains[0].argmax() == 0


def walk(days, seed=0):
    i = np.arange(days)
    return 1000 + 100 * np.sin(2 * np.pi * i / 365.25) + 50 * (i // 365) + np.random.default_rng(seed).normal(0, 3, days)


def frames(series, y):
    other = series({"x": [50.0] * len(y)}, START)
    p = series({"p": y}, START)
    return p, K.features(p, other, other)


def cuts_of(spark, *days):
    return spark.createDataFrame([("p", i, START + timedelta(days=d)) for i, d in enumerate(days)], "series_id string, cut int, origin date")


def test_nothing_after_a_cut_is_learned_from(spark, series, rows):
    y = list(walk(1000))
    later = y[:801] + [v * 3 + 500 for v in y[801:]]
    cut = cuts_of(spark, 500, 800)
    def run(v):
        return {(r["cut"], r["horizon"]): (r["pred"], r["rows"], tuple(r["top"])) for r in rows(K.boosted_trees(*frames(series, v), cut, (7, 60)))}
    a, b = run(y), run(later)
    assert a == b and len(a) == 4
    assert a[1, 7][1] - a[1, 60][1] == 53 and a[1, 7][1] - a[0, 7][1] == 300  # targets up to the cut, a row per day
    assert run(y[:780] + [v + 400 for v in y[780:]])[1, 7] != a[1, 7] and run(y[:780] + [v + 400 for v in y[780:]])[0, 7] == a[0, 7]


def test_trees_follow_a_yearly_season(spark, series, rows):
    y = walk(1500, 3) - 50 * (np.arange(1500) // 365)
    out = {r["horizon"]: r for r in rows(K.boosted_trees(*frames(series, y), cuts_of(spark, 1300), (30, 90)))}
    assert all(abs(out[h]["pred"] - y[1300 + h]) < 25 for h in out) and len(out) == 2
    assert all(len(out[h]["top"]) == 3 and out[h]["share"] == sorted(out[h]["share"], reverse=True) and sum(out[h]["share"]) <= 100 for h in out)


def test_too_few_rows_or_an_incomplete_newest_row_give_no_model(spark, series, rows):
    y = list(walk(700))
    assert rows(K.boosted_trees(*frames(series, y), cuts_of(spark, 250), (30,))) == []
    p, f = frames(series, y)
    other = series({"x": [50.0] * 500 + [None] * 200}, START)
    assert rows(K.boosted_trees(p, K.features(p, other, other), cuts_of(spark, 690), (30,))) == []
    assert rows(K.boosted_trees(p.where("false"), f, cuts_of(spark, 690), (30,))) == []


def test_trees_take_part_in_the_contest(spark, series, rows):
    p, f = frames(series, walk(365 * 5, 9))
    points = K.backtest(p, horizons=(7, 30), feature_rows=f)
    metrics = K.error_metrics(points)
    assert {r["model"] for r in rows(metrics)} == {"seasonal_naive", "holt_winters", "autoregression", "boosted_trees"}
    assert len(rows(K.select_best(metrics))) == 2
    notes = {r["structure"] for r in rows(K.model_notes(K.holt_winters(K.training(p, K.present(p), "W"), 52, 1), K.autoregression(K.training(p, K.present(p), "W"), 1), K.boosted_trees(p, f, K.present(p), (7, 30)))) if r["model"] == "boosted_trees"}
    assert len(notes) == 2 and any(n.startswith("7 days ahead from ") for n in notes)
    assert len(rows(K.forecast(p, (7, 30), f))) == 2
