"""Step-by-step recursions that cannot be written as window sums, each over one short array of periods."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from tidemark.functions.linalg import VECTOR, _struct, canonical, least_squares, square, trace_rank

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = np.array([(a, b, g) for a in (0.05, 0.1, 0.2, 0.35, 0.5, 0.8) for b in (0.0, 0.02, 0.1) for g in (0.0, 0.05, 0.2, 0.4)])

LEAST_CHANGES = 30  # rows of an autoregression


ROWS_AT_ONCE = 128


def smooth(y: np.ndarray, m: int, steps: int, grid: np.ndarray = GRID):
    """Additive trend and season for every row of ``y`` and every weight triple at once.

    Returns the path, the weights and the squared error of the best triple of each row.
    """
    return smooth_cuts(y, m, steps, np.arange(len(y)), np.full(len(y), y.shape[1]), y[:, -1], grid)


def smooth_cuts(y: np.ndarray, m: int, steps: int, row: np.ndarray, size: np.ndarray, last: np.ndarray, grid: np.ndarray = GRID):
    """``smooth`` of cuts of the rows of ``y``: cut ``i`` holds the first ``size[i] - 1`` values of row ``row[i]`` and then ``last[i]``.

    A row is smoothed once, up to its longest cut; where a cut ends its last value is added to what the recursion holds then.
    """
    first = y[:, :m].mean(axis=1)
    level = np.repeat(first[:, None], len(grid), axis=1)
    trend = np.repeat(((y[:, m:2 * m].mean(axis=1) - first) / m)[:, None], len(grid), axis=1)
    season = np.repeat(np.ascontiguousarray((y[:, :m] - first[:, None]).T)[:, :, None], len(grid), axis=2)    # m, rows, triples
    sse, err, gap, ahead = (np.zeros(level.shape) for _ in range(4))
    a, b, g = grid.T
    h = np.arange(1, steps + 1)
    path, best, error = np.empty((len(row), steps)), np.zeros(len(row), int), np.empty(len(row))
    order = np.argsort(size, kind="stable")
    ended = np.searchsorted(size[order], np.arange(int(size.max()) + 2))
    for t in range(m, int(size.max())):
        i = t % m
        at = order[ended[t + 1]:ended[t + 2]]
        if len(at):
            r, each, now = row[at], np.arange(len(at)), last[at][:, None]
            past, old, up = season[i, r], level[r], trend[r]
            to = old + up
            miss = now - to - past
            total = sse[r] + miss * miss
            k = total.argmin(axis=1)
            to, past, old, up, now = to[each, k], past[each, k], old[each, k], up[each, k], now[:, 0]
            new = to + a[k] * (now - past - to)
            up = up + b[k] * (new - old - up)
            coming = (t + h) % m
            seasons = np.where(coming == i, (past + g[k] * (now - new - past))[:, None], season[coming, r[:, None], k[:, None]])
            path[at] = new[:, None] + h * up[:, None] + seasons
            best[at], error[at] = k, total[each, k]
        now, past = y[:, t:t + 1], season[i]
        np.add(level, trend, out=ahead)
        np.subtract(now, ahead, out=err)
        err -= past
        err *= err
        sse += err
        np.subtract(now, past, out=gap)
        gap -= ahead
        gap *= a
        ahead += gap
        np.subtract(ahead, level, out=err)                    # the level moves from level to ahead
        err -= trend
        err *= b
        trend += err
        np.subtract(now, ahead, out=gap)
        gap -= past
        gap *= g
        past += gap
        level, ahead = ahead, level
    return path, grid[best], error


def _families(values: list, start: int) -> list:
    """Rows that begin alike, as lists of places: all but the last value of each are the first ones of the longest.  Rows that agree in
    ``start`` values are compared with the latest few lists only."""
    out, alike = [], {}
    for i, y in enumerate(values):
        near = alike.setdefault(y[:start].tobytes(), [])
        for family in near[-4:]:
            n = min(len(y), len(family[0])) - 1
            if np.array_equal(y[:n], family[0][:n]):
                family[0] = y if len(y) > len(family[0]) else family[0]
                family[1].append(i)
                break
        else:
            near.append([y, [i]])
            out.append(near[-1])
    return out


@F.pandas_udf(_struct(path=VECTOR, alpha=DoubleType(), beta=DoubleType(), gamma=DoubleType(), sse=DoubleType(), n=LongType()))
def holt_winters_path(values: pd.Series, period: pd.Series, steps: pd.Series) -> pd.DataFrame:
    """Forecast paths from the ordered values of each series; series of like length are smoothed together, and rows that begin alike
    (the cuts of a series, which differ in their last, begun period) in one recursion."""
    rows = [(None,) * 6] * len(values)
    m, h = int(period.iloc[0]) if len(period) else 1, int(steps.iloc[0]) if len(steps) else 1
    enough = [i for i, y in enumerate(values) if len(y) >= 2 * m]
    whole = [np.asarray(values.iloc[i], dtype=float) for i in enough]
    families = sorted(_families(whole, 2 * m), key=lambda f: len(f[0]))
    for at in range(0, len(families), ROWS_AT_ONCE):
        part = families[at:at + ROWS_AT_ONCE]
        y = np.zeros((len(part), len(part[-1][0])))
        for r, (longest, _) in enumerate(part):
            y[r, :len(longest)] = longest
        members = [(r, i) for r, (_, places) in enumerate(part) for i in places]
        row, size = np.array([r for r, _ in members]), np.array([len(whole[i]) for _, i in members])
        path, weights, sse = smooth_cuts(y, m, h, row, size, np.array([whole[i][-1] for _, i in members]))
        for (_, i), p, w, e, n in zip(members, path, weights, sse, size):
            rows[enough[i]] = (p.tolist(), *map(float, w), float(e), int(n) - m)
    return pd.DataFrame(rows, columns=["path", "alpha", "beta", "gamma", "sse", "n"])


def swept(g: np.ndarray, first: list, then: list):
    """Least squares of column 0 on ``first`` and ever more of ``then`` for a stack of moment matrices, swept column by column.

    Yields (columns so far, coefficients of those columns, residual sum of squares), the last two with a row per matrix.  A column that
    the earlier ones explain to within rounding is left out with a coefficient of zero.
    """
    a, whole, used = g.copy(), np.diagonal(g, axis1=1, axis2=2).copy(), np.zeros(g.shape[:2], bool)
    for i, column in enumerate([*first, *then]):
        pivot = a[:, column, column]
        ok = pivot > 1e-12 * whole[:, column]
        pivot = np.where(ok, pivot, 1.0)[:, None]
        row, rest = a[:, column] / pivot, a[:, :, column].copy()
        swept_one = a - rest[:, :, None] * row[:, None, :]
        swept_one[:, column], swept_one[:, :, column] = row, -rest / pivot
        swept_one[:, column, column] = 1 / pivot[:, 0]
        a = np.where(ok[:, None, None], swept_one, a)
        used[:, column] = ok
        if i + 1 > len(first):
            x = [*first, *then][:i + 1]
            yield x, np.where(used[:, x], a[:, x, 0], 0.0), np.maximum(a[:, 0, 0], 0.0)


def lag_moments(y, drivers, order):
    """Moments of the change, a constant, its lags and the driver changes: (rows, matrix, or None with too few rows)."""
    d, top = np.diff(np.asarray(y, dtype=float)), max(order)
    count = len(d) - top
    if count < LEAST_CHANGES:
        return count, None
    z = np.empty((2 + len(order) + len(drivers), count))
    z[0], z[1] = d[top:], 1.0
    for i, k in enumerate(order, 2):
        z[i] = d[top - k:len(d) - k]
    for i, x in enumerate(drivers, 2 + len(order)):
        z[i] = np.diff(np.asarray(x, dtype=float))[top:]
    return count, z @ z.T


def stacked_lag_fits(grams: np.ndarray, count: np.ndarray, order) -> list:
    """Per nested lag set of a stack of moments: (lags, [constant, lags...], aic, sigma), the last three with a row per matrix."""
    lags = list(range(2, 2 + len(order)))
    fits = []
    for x, beta, sse in swept(grams, [1, *range(2 + len(order), grams.shape[1])], lags):
        p = sum(c in lags for c in x)
        fits.append((order[:p], np.column_stack([beta[:, :1], beta[:, len(x) - p:]]), count * np.log(np.maximum(sse, 1e-300) / count) + 2 * len(x), np.sqrt(sse / (count - len(x)))))
    return fits


def lag_fits(y, drivers, order):
    """Nested regressions of the change on a constant, driver changes and the first 1, 2, ... lags: (rows, [(lags, [constant, lags...], aic, sigma)])."""
    count, gram = lag_moments(y, drivers, order)
    if gram is None:
        return count, []
    return count, [(used, beta[0], aic[0], sigma[0]) for used, beta, aic, sigma in stacked_lag_fits(gram[None], np.array([count]), order)]


@F.pandas_udf(_struct(path=VECTOR, lags=ArrayType(LongType()), aic=DoubleType(), sigma=DoubleType()))
def autoregressive_path(values: pd.Series, drivers: pd.Series, lags: pd.Series, steps: pd.Series) -> pd.DataFrame:
    """Changes regressed on their own lags and on driver changes; the nested lag set with the lowest AIC is iterated.

    Drivers are held at their last value over the horizon, so their future changes are zero.  Rows with the same lags and as many
    drivers are solved and iterated together.
    """
    rows, alike = [(None,) * 4] * len(values), {}
    for i, (y, extra, order, h) in enumerate(zip(values, drivers, lags, steps)):
        order = tuple(int(k) for k in order)
        count, gram = lag_moments(y, extra, order)
        if gram is not None:
            alike.setdefault((order, len(extra), int(h)), []).append((i, count, gram))
    for (order, _, h), members in alike.items():
        at = np.array([i for i, _, _ in members])
        fits = stacked_lag_fits(np.stack([g for _, _, g in members]), np.array([n for _, n, _ in members]), list(order))
        best, aic = np.zeros(len(at), int), fits[0][2]
        for p, fit in enumerate(fits):
            best, aic = np.where(fit[2] < aic, p, best), np.where(fit[2] < aic, fit[2], aic)
        for p, (used, beta, _, sigma) in enumerate(fits):
            mine = np.flatnonzero(best == p)
            if not len(mine):
                continue
            past, beta = max(used), beta[mine]
            ys = [np.asarray(values.iloc[i], dtype=float) for i in at[mine]]
            changes = np.empty((len(mine), past + h))
            changes[:, :past] = [np.diff(y[-past - 1:]) for y in ys]
            for t in range(past, past + h):
                changes[:, t] = beta[:, 0] + sum(beta[:, j] * changes[:, t - k] for j, k in enumerate(used, 1))
            path = np.array([y[-1] for y in ys])[:, None] + np.cumsum(changes[:, past:], axis=1)
            for i, w, e, s in zip(at[mine], path.tolist(), aic[mine], sigma[mine]):
                rows[i] = (w, used, float(e), float(s))
    return pd.DataFrame(rows, columns=["path", "lags", "aic", "sigma"])


@F.pandas_udf(ArrayType(_struct(lags=ArrayType(LongType()), aic=DoubleType(), sigma=DoubleType(), n=LongType())))
def lag_order_scores(values: pd.Series, drivers: pd.Series, lags: pd.Series) -> pd.Series:
    """AIC of every nested lag set."""
    out = []
    for y, extra, order in zip(values, drivers, lags):
        n, fits = lag_fits(y, extra, [int(k) for k in order])
        out.append([{"lags": used, "aic": float(aic), "sigma": float(sigma), "n": n} for used, _, aic, sigma in fits])
    return pd.Series(out)


def up_to_class(cells, last: int):
    """Sum of the moment matrices of the classes up to ``last``, and their rows: (None, 0) without any."""
    parts = [(square(c["gram"]), int(c["n"])) for c in cells if c["cls"] <= last]
    return (sum(g for g, _ in parts), sum(n for _, n in parts)) if parts else (None, 0)


@F.pandas_udf(_struct(path=ArrayType(VECTOR), n=LongType(), reason=StringType()))
def vector_path(cells: pd.Series, lines: pd.Series, last: pd.Series, levels: pd.Series, recent: pd.Series, size: pd.Series, depth: pd.Series, correct: pd.Series, least: pd.Series,
                steps: pd.Series, critical: pd.Series) -> pd.DataFrame:
    """Joint forecast of a panel at a cut: every equation on the lagged changes of all members, cumulated back to levels.

    Moment columns are changes (k), 1, lagged changes (k per lag) and last levels (k), by class of rows; a cut uses the classes up to
    ``last``.  ``correct`` is 0, 1 or 2.  With 1 last period's deviation from the line of the first member on the others joins the equations: it is
    linear in the last levels, so its moments follow from theirs.  ``lines`` holds the moments of that line: first member, 1, others.  With 2
    the relations are the canonical vectors of changes and last levels, as many as the trace test finds against ``critical``; none, no path.
    """
    rows = []
    for parts, line, c, level, past, k, p, mode, need, h, bounds in zip(cells, lines, last, levels, recent, size, depth, correct, least, steps, critical):
        k, p = int(k), int(p)
        g, n = up_to_class(parts if parts is not None else [], c)
        if n < need:
            rows.append((None, n, f"needs {need} complete rows of the panel, has {n}"))
            continue
        x, weights, base = list(range(k, 2 * k + 1 + (p - 1) * k)), np.zeros((k, 0)), np.zeros(0)
        if mode == 1:
            beta = least_squares(up_to_class(line, c)[0], 0, list(range(1, k + 1)))[0]
            weights, base = np.r_[1.0, -beta[1:]][:, None], -beta[:1]
        elif mode == 2:
            roots, vectors = canonical(g, list(range(k)), list(range(x[-1] + 1, len(g))), x)
            rank = trace_rank(roots, n, bounds)
            if not rank:
                rows.append((None, n, "the trace test finds no relation between the members"))
                continue
            weights, base = vectors[:, :rank], np.zeros(rank)
        if len(base):
            kept, more = x[-1] + 1, len(base)
            to = np.zeros((len(g), kept + more))
            to[:kept, :kept] = np.eye(kept)
            to[kept:, kept:], to[k, kept:] = weights, base
            g, x = to.T @ g @ to, [*x, *range(kept, kept + more)]
        coef = np.column_stack([least_squares(g, i, x)[0] for i in range(k)])
        level, path = np.asarray(level, dtype=float), []
        changes = [np.asarray(v, dtype=float) for v in past]
        for _ in range(int(h)):
            z = np.concatenate([[1.0], *changes[:p], level @ weights + base])
            step = z @ coef
            level = level + step
            changes.insert(0, step)
            path.append(level.tolist())
        rows.append((path, n, None))
    return pd.DataFrame(rows, columns=["path", "n", "reason"])


# evaluated once per row: filters on their results are not pushed below and computed again
holt_winters_path, autoregressive_path, lag_order_scores, vector_path = (f.asNondeterministic() for f in (holt_winters_path, autoregressive_path, lag_order_scores, vector_path))
