"""Boosted trees for many small models at once: one histogram of all models, nodes, features and bins per depth."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from tidemark.functions.linalg import _struct

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 16           # of each feature, by rank among a model's training rows
UNIT = 1000.0       # targets are whole multiples of 1/UNIT, so sums do not depend on their order
ROUNDS, DEPTH, RATE = 12, 2, 0.4
RIDGE, SMALLEST = 1.0, 5    # added to the rows of a node; rows on either side of a split
LEAST = 200         # training rows of a model
TOGETHER = 1 << 17  # training rows of the models that are grown at once, about


def binned(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Bin of each value: how many training values are smaller, in BINS equal parts of their number."""
    below = np.stack([np.searchsorted(np.sort(x[train, f]), x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    return np.minimum(below * BINS // int(train.sum()), BINS - 1)


def grow(bins: np.ndarray, y: np.ndarray, model: np.ndarray, train: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
    """Predictions of all rows, in the unit of ``y``, and the gain by model and feature.

    Row i belongs to ``model[i]``; rows outside ``train`` are predicted only.  All models grow the tree of a round together.  Of the
    splits that leave SMALLEST rows on both sides the one with the largest gain is taken (ties: first feature, then lowest
    bin).  ``y``, residuals and leaf values are whole numbers, so every sum is exact.
    """
    count, width = int(model.max()) + 1, bins.shape[1]
    own, mine = model[train], bins[train]
    cell = mine + BINS * np.arange(width)
    pred = np.floor(np.bincount(own, weights=y[train], minlength=count) / np.bincount(own, minlength=count))[model]
    gains = np.zeros((count, width))
    for _ in range(rounds):
        rest, node = (y - pred)[train], model
        for level in range(depth):
            nodes = count << level
            at = (node[train][:, None] * (width * BINS) + cell).ravel()
            n = np.bincount(at, minlength=nodes * width * BINS).reshape(nodes, width, BINS).astype(float)
            g = np.bincount(at, weights=np.repeat(rest, width), minlength=nodes * width * BINS).reshape(nodes, width, BINS)
            all_n, all_g = n[:, :1].sum(2, keepdims=True), g[:, :1].sum(2, keepdims=True)
            left_n, left_g = n.cumsum(2), g.cumsum(2)
            right_n, right_g = all_n - left_n, all_g - left_g
            gain = left_g * left_g / (left_n + RIDGE) + right_g * right_g / (right_n + RIDGE) - all_g * all_g / (all_n + RIDGE)
            gain = np.where((left_n >= SMALLEST) & (right_n >= SMALLEST), gain, 0.0).reshape(nodes, -1)
            best = gain.argmax(1)
            most = gain[np.arange(nodes), best]
            feature, last = best // BINS, np.where(most > 0, best % BINS, BINS)
            np.add.at(gains, (np.arange(nodes) >> level, feature), most)
            node = 2 * node + (bins[np.arange(len(node)), feature[node]] > last[node])
        leaves = count << depth
        value = np.floor(rate * np.bincount(node[train], weights=rest, minlength=leaves) / (np.bincount(node[train], minlength=leaves) + RIDGE))
        pred = pred + value[node]
    return pred, gains


def _models(days, x, price_days, prices, cuts, origins, horizons):
    """Per cut and horizon with enough rows: cut, horizon, binned rows (the newest last), targets."""
    for cut, origin in zip(cuts, origins):
        newest = np.searchsorted(price_days, origin, side="right") - 1
        now = np.searchsorted(days, price_days[newest]) if newest >= 0 else len(days)
        if now == len(days) or days[now] != price_days[newest]:
            continue  # the newest row is not complete
        for h in horizons:
            ahead = np.searchsorted(price_days, days + h)
            known = (days + h <= origin) & (ahead < len(price_days))
            known[known] = price_days[ahead[known]] == days[known] + h
            rows = np.flatnonzero(known)
            if len(rows) >= LEAST:
                train = np.r_[np.ones(len(rows), bool), False]
                yield cut, h, binned(x[np.r_[rows, now]], train), np.r_[np.floor(prices[ahead[rows]] * UNIT + 0.5), 0.0]


def _grown(models, names):
    """Point and note of each of a few models."""
    sizes = [len(y) for _, _, _, y in models]
    train = np.ones(sum(sizes), bool)
    train[np.cumsum(sizes) - 1] = False
    pred, gains = grow(np.concatenate([b for _, _, b, _ in models]), np.concatenate([y for *_, y in models]), np.repeat(np.arange(len(models)), sizes), train)
    for (cut, h, _, y), p, gain in zip(models, pred[~train], gains):
        top = [names[i] for i in np.argsort(-gain, kind="stable")[:3] if gain[i] > 0]
        share = [100 * float(gain[names.index(n)] / gain.sum()) for n in top]
        yield {"cut": int(cut), "horizon": int(h), "pred": float(p) / UNIT, "rows": len(y) - 1, "top": top, "share": share}


def direct_trees(names: list):
    """Function of a series' complete feature rows, prices, cuts and horizons: array of cut, horizon, pred, rows, top features with their share of
    the gain.  A model never sees a target after its cut."""
    from pyspark.sql.types import StringType
    out = ArrayType(_struct(cut=LongType(), horizon=LongType(), pred=DoubleType(), rows=LongType(), top=ArrayType(StringType()), share=ArrayType(DoubleType())))

    @F.pandas_udf(out)
    def fitted(days: pd.Series, x: pd.Series, price_days: pd.Series, prices: pd.Series, cuts: pd.Series, origins: pd.Series, horizons: pd.Series) -> pd.Series:
        result = []
        for d, flat, pd_, pv, c, o, h in zip(days, x, price_days, prices, cuts, origins, horizons):
            few, rows, done = [], 0, []
            for m in _models(np.asarray(d, np.int64), np.asarray(flat, float).reshape(len(d), len(names)), np.asarray(pd_, np.int64), np.asarray(pv, float), c, o, h):
                few.append(m)
                rows += len(m[3])
                if rows >= TOGETHER:
                    done += _grown(few, names)
                    few, rows = [], 0
            if few:
                done += _grown(few, names)
            result.append(done)
        return pd.Series(result)

    return fitted.asNondeterministic()
