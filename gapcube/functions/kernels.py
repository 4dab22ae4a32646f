"""Small distribution helpers for p-values and interval quantiles, applied to short result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t by composite Simpson over an arctangent scale (finite range, smooth integrand)."""
    if not (df > 0) or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    # P(|T| > |t|) = 2c * integral of cos(u)^(df-1) from atan(|t|/sqrt(df)) to pi/2
    a = math.atan(abs(t) / math.sqrt(df))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    if df < 3:
        # the integrand has a singular derivative at pi/2: with v = pi/2 - u and w = v^df it is (sin v / v)^(df-1) / df
        w = np.linspace(0.0, (math.pi / 2 - a) ** df, 4001)
        v = w ** (1 / df)
        y = np.sinc(v / math.pi) ** (df - 1.0) / df
        h = w[-1] / 4000
        return float(min(1.0, 2 * c * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())))
    u = np.linspace(a, math.pi / 2, 4001)
    y = np.cos(u).clip(0.0) ** (df - 1.0)
    h = (math.pi / 2 - a) / 4000
    area = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return float(min(1.0, 2 * c * area))


def t_cdf(t: float, df: float) -> float:
    half = t_sf2(t, df) / 2
    return 1 - half if t > 0 else half


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection on the tail area."""
    if not (df > 0) or math.isnan(p):
        return float("nan")
    target, lo, hi = 2 * min(p, 1 - p), 0.0, 1.0
    while t_sf2(hi, df) > target and hi < 1e8:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf2(mid, df) > target else (lo, mid)
        if hi - lo <= 1e-14 * max(1.0, hi):
            break
    q = (lo + hi) / 2
    return q if p >= 0.5 else -q


def wilcoxon_p(x: np.ndarray, exact_up_to: int = 50) -> float:
    """Two-sided signed-rank p-value: exact for at most `exact_up_to` non-zero values without ties, else normal."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    nonzero = x[x != 0]
    n = len(nonzero)
    if len(x) < 5 or n == 0:
        return float("nan")
    size = np.abs(nonzero)
    order = pd.Series(size).rank().to_numpy()
    w = float(order[nonzero > 0].sum())
    if n == len(x) and n <= exact_up_to and len(np.unique(size)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            shifted = np.zeros_like(ways)
            shifted[k:] = ways[:-k]
            ways = ways + shifted
        low = int(min(w, n * (n + 1) / 2 - w))
        return float(min(1.0, 2 * ways[: low + 1].sum() / 2.0 ** n))
    ties = pd.Series(size).value_counts().to_numpy(float)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties ** 3 - ties).sum() / 48
    return float(2 * NormalDist().cdf(-abs((w - n * (n + 1) / 4) / math.sqrt(var))))


def kendall_p(n: int, discordant: int) -> float:
    """Two-sided exact p-value of Kendall's tau without ties: inversions of a random order."""
    ways = np.ones(1)
    for k in range(2, n + 1):
        ways = np.convolve(ways, np.ones(k)) / k
    low = min(int(discordant), n * (n - 1) // 2 - int(discordant))
    return float(min(1.0, 2 * ways[: low + 1].sum()))


def kendall_p_of(x, y) -> float:
    """Two-sided p-value of Kendall's tau of paired values: exact without ties, else normal with the variance that ties
    on either side leave. NaN for fewer than two pairs or where one side is constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    pair = np.triu_indices(n, 1)
    s = np.sign(x[pair[0]] - x[pair[1]]) * np.sign(y[pair[0]] - y[pair[1]])
    tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    if n < 2 or len(tx) < 2 or len(ty) < 2:
        return float("nan")
    if len(tx) == n and len(ty) == n:
        return kendall_p(n, int((s < 0).sum()))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - sum((t * (t - 1) * (2 * t + 5)).sum() for t in (tx, ty))) / 18
    var += (tx * (tx - 1)).sum() * (ty * (ty - 1)).sum() / (2 * m)
    if n > 2:
        var += (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * m * (n - 2))
    return float(2 * NormalDist().cdf(-abs(s.sum()) / math.sqrt(var)))


@F.pandas_udf(T.DoubleType())
def t_sf2_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf2(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_cdf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_cdf(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_ppf_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_ppf(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(p, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def norm_cdf_udf(z: pd.Series) -> pd.Series:
    return z.map(NormalDist().cdf)


@F.pandas_udf(T.DoubleType())
def norm_ppf_udf(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf)


@F.pandas_udf(T.DoubleType())
def wilcoxon_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: wilcoxon_p(np.asarray(v, float)))


@F.pandas_udf(T.DoubleType())
def kendall_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    """Of two arrays of paired values."""
    return pd.Series([kendall_p_of(a, b) for a, b in zip(x, y)], dtype="float64")
