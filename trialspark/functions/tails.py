"""Tail probabilities and quantiles for the few result rows of a test.

Vectorised over Arrow batches with numpy; the input is one row per effect, pair
or grid point, never data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300
#: From here on log-gammas are taken apart by Stirling's formula, so that large ones cancel on paper.
_LARGE = 1e3


def _stirling_rest(x):
    """lgamma(x) less (x - 1/2) ln x - x + ln(2 pi) / 2, for large x."""
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _log_front(p, q, y, rest):
    """log of y^p rest^q / B(p, q), with y + rest = 1, both given so that neither loses digits."""
    with np.errstate(all="ignore"):
        log_y = np.where(rest < 0.5, np.log1p(-rest), np.log(y))
        log_rest = np.where(y < 0.5, np.log1p(-y), np.log(rest))
        plain = _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * log_y + q * log_rest
        small, big = np.minimum(p, q), np.maximum(p, q)
        ratio = small * np.log(p + q) + (big - 0.5) * np.log1p(small / big) - small
        ratio = ratio + _stirling_rest(p + q) - _stirling_rest(big)
        one = ratio - _lgamma(small) + p * log_y + q * log_rest
        gap = y * q - p * rest  # n y - p
        both = p * np.log1p(gap / p) + q * np.log1p(-gap / q) + 0.5 * np.log(p / (p + q) * q / (2 * math.pi))
        both = both + _stirling_rest(p + q) - _stirling_rest(p) - _stirling_rest(q)
    return np.where(big < _LARGE, plain, np.where(small < _LARGE, one, both))


def beta_tail(x, a, b, rest=None):
    """Regularised incomplete beta I_x(a, b), by a continued fraction. `rest` is 1 - x where it is known better."""
    rest = 1 - np.asarray(x, dtype=float) if rest is None else rest
    x, a, b, rest = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b, rest)))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    out[ok & (x == 0)] = 0.0
    out[ok & (rest == 0)] = 1.0
    todo = ok & (x > 0) & (rest > 0)
    if todo.any():
        xs, as_, bs, rs = x[todo], a[todo], b[todo], rest[todo]
        swap = as_ * rs < bs * xs
        p, q = np.where(swap, bs, as_), np.where(swap, as_, bs)
        y, z = np.where(swap, rs, xs), np.where(swap, xs, rs)
        # the even part of the usual fraction: its terms hold p z - q y, so nothing cancels when p is huge
        gap = p * z - q * y
        f = p * (gap + 1) / (p + 1)
        c, d = f.copy(), np.zeros_like(f)
        for m in range(1, 100_000):
            w = m * (q - m) * y / (p + 2 * m - 1)
            num = (p + m - 1) * (p + q + m - 1) / (p + 2 * m - 1) * w * y
            den = m + w + (p + m) / (p + 2 * m + 1) * (gap + 1 + m * (1 + z))
            d = den + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = den + num / np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            f = f * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        front, h = np.exp(_log_front(p, q, y, z)), 1 / f
        out[todo] = np.where(swap, 1 - front * h, front * h)
    return out


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        p = beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2, d1 * f / (d2 + d1 * f))
    return np.where(np.isposinf(f), 0.0, p)


def t_two_sided(t, df):
    t, df = (np.asarray(v, dtype=float) for v in (t, df))
    with np.errstate(all="ignore"):
        p = beta_tail(df / (df + t * t), df / 2, 0.5, t * t / (df + t * t))
    return np.where(np.isinf(t), 0.0, p)


def t_quantile(prob, df):
    """Upper quantile of Student's t for prob > 0.5, by bisection on the tail."""
    prob, df = np.broadcast_arrays(np.asarray(prob, dtype=float), np.asarray(df, dtype=float))
    tail = 2 * (1 - prob)
    lo, hi = np.zeros(prob.shape), np.ones(prob.shape)
    for _ in range(1100):
        grow = t_two_sided(hi, df) > tail
        if not grow.any():
            break
        hi = np.where(grow, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(np.isnan(df) | (df <= 0), np.nan, (lo + hi) / 2)


def chi2_upper(x, df):
    """Upper incomplete gamma Q(df/2, x/2): series below the mean, fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(df, dtype=float))
    out = np.full(x.shape, np.nan)
    out[(df > 0) & (x <= 0)] = 1.0
    todo = (df > 0) & (x > 0)
    if todo.any():
        a, z = df[todo] / 2, x[todo] / 2
        front = np.exp(-z + a * np.log(z) - _lgamma(a))
        term, total = 1 / a, 1 / a
        for n in range(1, 10_000):
            term = term * z / (a + n)
            total = total + term
            if np.all((term < total * 1e-16) | (z >= a + 1)):
                break
        b = z + 1 - a
        c, d = np.full_like(z, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
        h = d.copy()
        for n in range(1, 10_000):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * c * d
            if np.all((np.abs(c * d - 1) < 1e-15) | (z < a + 1)):
                break
        out[todo] = np.where(z < a + 1, 1 - front * total, front * h)
    return out


_Z, _ZW = np.polynomial.legendre.leggauss(128)
_S, _SW = np.polynomial.legendre.leggauss(64)


# The normal distribution on a fine grid; between its points a cubic with the density as slope is exact to 1e-13.
_STEP = 1 / 512
_GRID = np.arange(-12, 12 + _STEP, _STEP)
_PHI = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])
_DENSITY = np.exp(-_GRID * _GRID / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x):
    x = np.clip(np.asarray(x, dtype=float), _GRID[0], _GRID[-2])
    k = ((x - _GRID[0]) / _STEP).astype(np.int64)
    u = (x - _GRID[k]) / _STEP
    a, b = _PHI[k], _PHI[k + 1]
    da, db = _DENSITY[k] * _STEP, _DENSITY[k + 1] * _STEP
    return a + u * (da + u * (3 * (b - a) - 2 * da - db + u * (2 * (a - b) + da + db)))


_CDF = normal_cdf(8 * _Z)


def _range_cdf(w: np.ndarray, r: float) -> np.ndarray:
    """P(range of r standard normals <= w)."""
    z = 8 * _Z
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = np.clip(_CDF[None, :] - normal_cdf(z[None, :] - w[:, None]), 0, 1) ** (r - 1)
    return np.clip(r * 8 * np.sum(_ZW * density * inner, axis=1), 0, 1)


def _log_scale_density(w: np.ndarray, n: float) -> np.ndarray:
    """log density of s = sqrt(chi2_n / n) at s = 1 + w."""
    h = n / 2
    if n < _LARGE:
        s = 1 + w
        return math.log(2) + h * math.log(h) - math.lgamma(h) + (n - 1) * np.log(s) - n * s * s / 2
    rest = np.log1p(w) - w - w * w / 2
    return math.log(2) + 0.5 * math.log(h) - 0.5 * math.log(2 * math.pi) - _stirling_rest(h) - np.log1p(w) + n * rest


def range_upper(q, r, df):
    """Upper tail of the studentized range of r means with df error degrees.

    The scale s = sqrt(chi2_df / df) is integrated over all but a negligible
    part of its mass.
    """
    q, r, df = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (q, r, df)))
    out = np.full(q.shape, np.nan)
    for i in np.ndindex(q.shape):
        if not (q[i] >= 0 and r[i] >= 2 and df[i] >= 1):
            continue
        width = 12 / math.sqrt(2 * df[i])
        lo, hi = max(1e-8 - 1, -width), width
        w = lo + (hi - lo) * (_S + 1) / 2
        weight = _SW * np.exp(_log_scale_density(w, df[i])) * (hi - lo) / 2
        out[i] = np.clip(np.sum(weight * (1 - _range_cdf(q[i] * (1 + w), r[i]))), 0, 1)
    return out


def range_quantile(prob, r, df):
    prob, r, df = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (prob, r, df)))
    lo, hi = np.zeros(prob.shape), np.full(prob.shape, 8.0)
    for _ in range(60):
        grow = range_upper(hi, r, df) > 1 - prob
        if not grow.any():
            break
        hi = np.where(grow, hi * 2, hi)
    for _ in range(45):
        mid = (lo + hi) / 2
        above = range_upper(mid, r, df) > 1 - prob
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(np.isnan(df), np.nan, (lo + hi) / 2)


def _column(values) -> pd.Series:
    """NaN goes back as NULL."""
    s = pd.Series(values, dtype="float64")
    return s.astype(object).where(s.notna(), None)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _column(f_upper(f, d1, d2))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def t_q(prob: pd.Series, df: pd.Series) -> pd.Series:
    return _column(t_quantile(prob, df))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _column(chi2_upper(x, df))


def _once(value, *columns: pd.Series) -> pd.Series:
    """A function of several columns, computed for different arguments only."""
    key = pd.concat([c.astype("float64").rename(str(k)) for k, c in enumerate(columns)], axis=1)
    one = key.drop_duplicates()
    found = one.assign(value=value(*(one[c] for c in one.columns)))
    return _column(key.merge(found, on=list(key.columns), how="left")["value"])


@F.pandas_udf(T.DoubleType())
def range_p(q: pd.Series, r: pd.Series, df: pd.Series) -> pd.Series:
    return _once(range_upper, q, r, df)


@F.pandas_udf(T.DoubleType())
def range_q(prob: pd.Series, r: pd.Series, df: pd.Series) -> pd.Series:
    return _once(range_quantile, prob, r, df)
