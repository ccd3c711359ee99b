"""Tail probabilities. Spark has no incomplete beta or gamma function, so these are vectorised pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS, _EPS, _TINY = 400, 3e-16, 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function by the modified Lentz method, all rows at once."""
    guard = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    live = np.ones(len(x), dtype=bool)
    for m in range(1, _STEPS):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / guard(1.0 + num * d)
            c = guard(1.0 + num / c)
            out = np.where(live, out * c * d, out)
        live &= np.abs(c * d - 1.0) > _EPS
        if not live.any():
            break
    return out


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    a, b, x = a.ravel(), b.ravel(), x.ravel()
    inner = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, 0.0)
    if inner.any():
        p, q, t = a[inner], b[inner], x[inner]
        swap = t > (p + 1) / (p + q + 2)
        p2, q2, t2 = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - t, t)
        front = np.exp(_lgamma(p2 + q2) - _lgamma(p2) - _lgamma(q2) + p2 * np.log(t2) + q2 * np.log1p(-t2))
        value = front * _beta_fraction(p2, q2, t2) / p2
        out[inner] = np.where(swap, 1 - value, value)
    return out


def gammaincc(a, x) -> np.ndarray:
    """The regularised upper incomplete gamma function Q(a, x): by its series below a + 1, by its fraction above."""
    a, x = (v.ravel() for v in np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float)))
    out = np.ones_like(x)
    pos = x > 0
    small = pos & (x < a + 1)
    if small.any():
        p, t = a[small], x[small]
        term = total = 1.0 / p
        n = p.copy()
        for _ in range(_STEPS):
            n = n + 1
            term = term * t / n
            total = total + term
            if (np.abs(term) < np.abs(total) * _EPS).all():
                break
        out[small] = 1.0 - total * np.exp(-t + p * np.log(t) - _lgamma(p))
    large = pos & ~small
    if large.any():
        p, t = a[large], x[large]
        b = t + 1.0 - p
        c, d = np.full_like(t, 1.0 / _TINY), 1.0 / b
        h = d.copy()
        for i in range(1, _STEPS):
            an = -i * (i - p)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if (np.abs(d * c - 1.0) < _EPS).all():
                break
        out[large] = np.exp(-t + p * np.log(t) - _lgamma(p)) * h
    return out


def p_value(kind: np.ndarray, stat: np.ndarray, df1: np.ndarray, df2: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """p of each test (kinds t F r z chi2); NaN where it can't be computed. t, r and z take the given number of tails."""
    out = np.full(len(stat), np.nan)
    s = np.abs(stat)
    r = (kind == "r") & (df1 > 0) & (s < 1)
    t = ((kind == "t") & (df1 > 0)) | r
    with np.errstate(all="ignore"):
        tt = np.where(r, s * np.sqrt(df1 / (1 - s * s)), s)
    if t.any():
        out[t] = betainc(df1[t] / 2, 0.5, df1[t] / (df1[t] + tt[t] ** 2)) * tail[t] / 2
    f = (kind == "F") & (df1 > 0) & (df2 > 0)
    if f.any():
        out[f] = betainc(df2[f] / 2, df1[f] / 2, df2[f] / (df2[f] + df1[f] * s[f]))
    c = (kind == "chi2") & (df1 > 0)
    if c.any():
        out[c] = gammaincc(df1[c] / 2, s[c] / 2)
    z = kind == "z"
    if z.any():
        out[z] = gammaincc(0.5, s[z] ** 2 / 2) * tail[z] / 2
    return out


def p_of(kind: Column, stat: Column, df1: Column, df2: Column, tail: Column) -> Column:
    @F.pandas_udf("double")
    def run(k: pd.Series, s: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        num = lambda v: v.astype(float).to_numpy()
        p = p_value(k.astype(str).to_numpy(), num(s), np.nan_to_num(num(a)), np.nan_to_num(num(b)), num(n))
        return pd.Series([None if x != x else x for x in p], dtype=object)

    return run(kind, stat, df1, df2, tail)
