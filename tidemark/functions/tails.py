"""Two-sided Student and upper F tail probabilities for reduced rows (one row per series, pair or lag).

The regularised incomplete beta function is evaluated with its continued fraction, a whole Arrow batch at a time.
"""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Ship these helpers with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _log_gamma(values):
    return np.array([math.lgamma(v) for v in values])


def _fraction(a, b, x, rounds=400):
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, rounds):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta, elementwise; null in, null out."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    a, b, x = a[ok], b[ok], np.clip(x[ok], 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) if x.size else z
    inner = np.where(z <= 0, 0.0, front * _fraction(p, q, z) / p) if x.size else z
    out[ok] = np.where(flip, 1 - inner, inner)
    return out


def student_tail(t, dof):
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def f_tail(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.maximum(f, 0.0)))


def _nullable(values) -> pd.Series:
    return pd.Series(values).astype(object).where(~np.isnan(values), None)


@pandas_udf(DoubleType())
def _student_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _nullable(student_tail(t, dof))


@pandas_udf(DoubleType())
def _f_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _nullable(f_tail(f, d1, d2))


def student_p(t, dof):
    return _student_udf(t.cast("double"), dof.cast("double"))


def f_p(f, d1, d2):
    return _f_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))
