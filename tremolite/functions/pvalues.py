"""Two-sided p-values of Student's t, vectorised over Arrow batches."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Coefficients of Stirling's series, 1 / (12 x) - 1 / (360 x^3) + ...
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of gamma for x > 0: Stirling's series for x + 12, and the product that leads back to x."""
    y = x + 12.0
    back = np.prod([x + k for k in range(12)], axis=0) if len(x) else np.ones(0)
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(back)


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for arrays of equal length, 0 <= x <= 1."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    a, b, x = a[inside], b[inside], x[inside]
    front = (
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)
        if x.size
        else np.zeros(0)
    )
    direct = x < (a + 1) / (a + b + 2)
    res = np.empty_like(x)
    res[direct] = np.exp(front[direct]) * _beta_fraction(a[direct], b[direct], x[direct]) / a[direct]
    flip = ~direct
    res[flip] = 1 - np.exp(front[flip]) * _beta_fraction(b[flip], a[flip], 1 - x[flip]) / b[flip]
    out[inside] = res
    return out


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for dof > 0; NaN elsewhere."""
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(dof) & (dof > 0) & ~np.isnan(t)
    x = dof[ok] / (dof[ok] + np.square(t[ok]))
    out[ok] = regularised_beta(dof[ok] / 2, np.full(x.shape, 0.5), x)
    return out


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Column form of `two_sided_p`; NULL where the test is undefined."""
    p = two_sided_p(t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).astype(object).where(~np.isnan(p), None)


# Ship this module's code with the function, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
