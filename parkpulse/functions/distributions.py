"""Tail probabilities of the F and the studentized range distribution, for result rows only."""

from __future__ import annotations

from math import erf, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TAIL_NODES, _RANGE_NODES, _SCALE_NODES = 400, 160, 96


def _log_beta(a: float, b: float) -> float:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def f_upper_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f): with t = tan(u)**2 the beta integral becomes smooth on a finite angle."""
    if not f > 0:
        return 1.0
    start = np.arctan(sqrt(df1 * f / df2))
    nodes, weights = np.polynomial.legendre.leggauss(_TAIL_NODES)
    # Beyond 40 standard widths of cos(u)**df2 nothing is left of the integrand.
    end = min(np.pi / 2, start + 40.0 / sqrt(df2))
    u = start + (nodes + 1) / 2 * (end - start)
    with np.errstate(divide="ignore"):
        log_term = (df1 - 1) * np.log(np.sin(u)) + (df2 - 1) * np.log(np.cos(u))
    total = np.sum(weights * np.exp(log_term - _log_beta(df1 / 2, df2 / 2))) * (end - start) / 2
    return float(min(1.0, 2 * total))


# The normal distribution at steps of 1/256, exact there; between two steps the cubic that also
# has the density as its slope at both is off by less than 1e-12.
_STEP = 1 / 256
_AT = np.arange(-10 * 256, 10 * 256 + 1) * _STEP
_CDF = np.array([0.5 * (1 + erf(z / sqrt(2))) for z in _AT])
_SLOPE = np.exp(-_AT * _AT / 2) / sqrt(2 * np.pi) * _STEP


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    place = np.clip((z - _AT[0]) / _STEP, 0, len(_AT) - 1.000001)
    i = place.astype(np.int64)
    t = place - i
    u = 1 - t
    return (
        _CDF[i] * u * u * (1 + 2 * t) + _CDF[i + 1] * t * t * (1 + 2 * u)
        + _SLOPE[i] * t * u * u - _SLOPE[i + 1] * t * t * u
    )


def range_upper_tail(q: float, groups: int, df: float) -> float:
    """P(Q > q) for the studentized range of `groups` means with `df` degrees of freedom."""
    if not q > 0:
        return 1.0
    nodes, weights = np.polynomial.legendre.leggauss(_RANGE_NODES)
    z, wz = 8.0 * nodes, 8.0 * weights
    density = np.exp(-z * z / 2) / sqrt(2 * np.pi)
    below = _normal_cdf(z)
    # Scale s = sqrt(chi2 / df) around 1, cut where its density has vanished.
    nodes, weights = np.polynomial.legendre.leggauss(_SCALE_NODES)
    half = 9.0 / sqrt(2 * df)
    lo, hi = max(1e-9, 1 - half), 1 + half
    s, ws = lo + (nodes + 1) / 2 * (hi - lo), weights * (hi - lo) / 2
    log_scale = log(2) + (df / 2) * log(df / 2) - lgamma(df / 2)
    scale = np.exp(log_scale + (df - 1) * np.log(s) - df * s * s / 2)
    spread = below[None, :] - _normal_cdf(z[None, :] - q * s[:, None])
    inside = groups * np.sum(wz * density * spread ** (groups - 1), axis=1)
    return float(min(1.0, max(0.0, 1 - np.sum(ws * scale * inside))))


def range_quantile(level: float, groups: int, df: float) -> float:
    """q with P(Q <= q) = level, by bisection."""
    lo, hi = 0.0, 1.0
    while range_upper_tail(hi, groups, df) > 1 - level and hi < 1e4:
        hi *= 2
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if range_upper_tail(mid, groups, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_upper_tail(*row) for row in zip(f, df1, df2)], dtype="float64")


@F.pandas_udf(DoubleType())
def range_p_value(q: pd.Series, groups: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [range_upper_tail(a, int(k), d) for a, k, d in zip(q, groups, df)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def range_critical_value(level: pd.Series, groups: pd.Series, df: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    for key in set(zip(level, groups, df)):
        known[key] = range_quantile(key[0], int(key[1]), key[2])
    return pd.Series([known[key] for key in zip(level, groups, df)], dtype="float64")
