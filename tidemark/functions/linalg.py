"""Moment matrices on Spark and the tiny solves that follow on one row per series, pair or panel."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDE = 12  # beyond this many columns the products are formed per Arrow batch instead of one SQL sum each


def _struct(**fields):
    return StructType([StructField(k, t) for k, t in fields.items()])


VECTOR = ArrayType(DoubleType())


def gram(rows: DataFrame, keys: list, cols: list) -> DataFrame:
    """Cross products of the columns per key: ``gram`` holds the upper triangle row by row, ``n`` the rows.

    Both ways combine before the shuffle, so a key with a third of all rows arrives as one small matrix per task.
    """
    if len(cols) <= WIDE:
        sums = ", ".join(f"sum({a} * {b})" for i, a in enumerate(cols) for b in cols[i:])
        return rows.groupBy(*keys).agg(F.expr(f"array({sums})").alias("gram"), F.count(F.lit(1)).alias("n"))
    schema = StructType([rows.schema[k] for k in keys]).add("g", VECTOR).add("m", LongType())
    upper = np.triu_indices(len(cols))

    def partial(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                z = part[cols].to_numpy(dtype=float)
                yield pd.DataFrame([[*key, (z.T @ z)[upper], len(z)]], columns=[*keys, "g", "m"])

    parts = rows.select(*keys, *cols).mapInPandas(partial, schema)
    flat = parts.select(*keys, "m", F.posexplode("g").alias("pos", "s"))
    sums = flat.groupBy(*keys, "pos").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"])
    return sums.groupBy(*keys).agg(packed.alias("gram"), F.max("m").alias("n"))


def square(flat) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    flat = np.asarray(flat, dtype=float)
    d = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = flat
    return out + np.triu(out, 1).T


def least_squares(g: np.ndarray, y: int, x: list):
    """(coefficients, inverse of X'X, residual sum of squares) from a moment matrix, columns scaled to unit length."""
    a, b = g[np.ix_(x, x)], g[x, y]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    inv = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    beta = inv @ b
    return beta, inv, max(float(g[y, y] - b @ beta), 0.0)


@F.pandas_udf(_struct(beta=VECTOR, se=VECTOR, sse=DoubleType(), sst=DoubleType()))
def ols(grams: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Least squares of the first column on the others; the second column is the constant."""
    rows = []
    for flat, count in zip(grams, n):
        g = square(flat)
        x = list(range(1, len(g)))
        beta, inv, sse = least_squares(g, 0, x)
        se = np.sqrt(np.maximum(np.diag(inv), 0.0) * sse / max(count - len(x), 1))
        rows.append((beta.tolist(), se.tolist(), sse, float(g[0, 0] - g[0, 1] ** 2 / g[1, 1])))
    return pd.DataFrame(rows, columns=["beta", "se", "sse", "sst"])


@F.pandas_udf(VECTOR)
def inflation(grams: pd.Series) -> pd.Series:
    """Variance inflation of each column after the constant (first column); null for a constant column."""
    out = []
    for flat in grams:
        g = square(flat)
        cov = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
        vary = np.where(np.diag(cov) > 1e-12 * np.diag(g)[1:])[0]
        vif = np.full(len(cov), np.nan)
        if len(vary):
            sd = np.sqrt(np.diag(cov)[vary])
            vif[vary] = np.diag(np.linalg.pinv(cov[np.ix_(vary, vary)] / np.outer(sd, sd), hermitian=True))
        out.append([None if np.isnan(v) else float(v) for v in vif])
    return pd.Series(out)


def suffix_sums(cells):
    """Moment matrices of 'all rows from class h on' out of the per-class ones: {h: (matrix, rows)}."""
    total, n, out = None, 0, {}
    for h, flat, m in sorted(((c["h"], c["gram"], c["n"]) for c in cells), key=lambda c: -c[0]):
        total = square(flat) if total is None else total + square(flat)
        n += m
        out[h] = (total.copy(), n)
    return out


def from_class(sums: dict, h: int):
    """The sums from class h on; a class without rows changes nothing."""
    later = [k for k in sums if k >= h]
    return sums[min(later)] if later else (None, 0)


@F.pandas_udf(ArrayType(_struct(lag=LongType(), f=DoubleType(), df1=LongType(), df2=LongType())))
def granger_lags(cells: pd.Series, depth: pd.Series, lags: pd.Series) -> pd.Series:
    """F test of 'the lags of x add nothing' for every lag; columns are y, 1, y lags, x lags."""
    out = []
    for parts, limit, width in zip(cells, depth, lags):
        sums, rows = suffix_sums(parts), []
        for p in range(1, int(limit) + 1):
            g, n = from_class(sums, p + 1)
            df2 = n - 2 * p - 1
            if g is None or df2 <= 0:
                continue
            own = [1] + list(range(2, 2 + p))
            both = own + list(range(2 + int(width), 2 + int(width) + p))
            full, short = least_squares(g, 0, both)[2], least_squares(g, 0, own)[2]
            if full > 0:
                rows.append({"lag": p, "f": max(short - full, 0.0) / full / p * df2, "df1": p, "df2": df2})
        out.append(rows)
    return pd.Series(out)


@F.pandas_udf(_struct(stat=DoubleType(), lags=LongType(), nobs=LongType()))
def unit_root(cells: pd.Series, n_obs: pd.Series, constant: pd.Series) -> pd.DataFrame:
    """Augmented Dickey-Fuller t value; columns are change, 1, lagged level, lagged changes.

    The number of lags has the lowest AIC on the rows all candidates share; the statistic uses every row of its own.
    """
    rows = []
    for parts, n, trend in zip(cells, n_obs, constant):
        sums = suffix_sums(parts)
        widest = square(parts[0]["gram"]).shape[0] - 3
        ntrend = int(bool(trend))
        limit = max(min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), int(n) // 2 - ntrend - 1, widest), 0)
        lead = [1] if trend else []
        g, m = from_class(sums, limit + 2)
        scores = []
        for p in range(limit + 1):
            x = lead + [2] + list(range(3, 3 + p))
            sse = least_squares(g, 0, x)[2] if g is not None else 0.0
            if sse > 0:
                scores.append((m * (np.log(2 * np.pi) + np.log(sse / m) + 1) + 2 * len(x), p))
        if not scores:
            rows.append((None, None, None))
            continue
        p = min(scores)[1]
        g, m = from_class(sums, p + 2)
        x = lead + [2] + list(range(3, 3 + p))
        beta, inv, sse = least_squares(g, 0, x)
        i = len(lead)
        rows.append((float(beta[i] / np.sqrt(inv[i, i] * sse / (m - len(x)))), p, m))
    return pd.DataFrame(rows, columns=["stat", "lags", "nobs"])


@F.pandas_udf(VECTOR)
def partial_autocorrelation(acfs: pd.Series) -> pd.Series:
    """Yule-Walker partial autocorrelations from autocorrelations 0..K by the Levinson recursion."""
    out = []
    for acf in acfs:
        rho = np.asarray(acf, dtype=float)
        phi, err, res = np.zeros(0), 1.0, [1.0]
        for k in range(1, len(rho)):
            refl = (rho[k] - phi @ rho[k - 1:0:-1]) / err if err > 0 else np.nan
            phi = np.append(phi - refl * phi[::-1], refl)
            err *= 1 - refl * refl
            res.append(float(refl))
        out.append(res)
    return pd.Series(out)


def canonical(g: np.ndarray, changes: list, levels: list, given: list):
    """Squared canonical correlations of changes and lagged levels given other columns, largest first, and the weights of the levels as
    columns, the first member's weight 1 (where it has one)."""
    cols = [*changes, *levels]
    a, b = g[np.ix_(given, given)], g[np.ix_(given, cols)]
    scale = np.sqrt(np.diag(a))
    s = g[np.ix_(cols, cols)] - b.T @ (np.linalg.pinv(a / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)) @ b
    k = len(changes)
    s00, s01, s11 = s[:k, :k], s[:k, k:], s[k:, k:]
    roots, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    order = np.argsort(-roots.real, kind="stable")
    vectors = vectors.real[:, order]
    first = np.where(np.abs(vectors[0]) > 1e-12 * np.abs(vectors).max(0), vectors[0], 1.0)
    return roots.real[order], vectors / first


def trace_rank(roots: np.ndarray, n: int, critical: list) -> int:
    """Number of relations by the trace test: the first rank that is not rejected.  ``critical[r]`` belongs to the null 'at most r'."""
    logs = -n * np.log(1 - roots)
    return next((r for r in range(len(roots)) if logs[r:].sum() <= critical[r]), len(roots))


@F.pandas_udf(_struct(roots=VECTOR, vectors=ArrayType(VECTOR)))
def johansen_vectors(grams: pd.Series, series: pd.Series) -> pd.DataFrame:
    """Roots, largest first, and one weight vector of the levels for each.  Columns are changes, lagged levels, lagged changes and 1."""
    rows = []
    for flat, k in zip(grams, series):
        k = int(k)
        roots, vectors = canonical(square(flat), list(range(k)), list(range(k, 2 * k)), list(range(2 * k, 3 * k + 1)))
        rows.append(([float(r) for r in roots], [[float(w) for w in v] for v in vectors.T]))
    return pd.DataFrame(rows, columns=["roots", "vectors"])
