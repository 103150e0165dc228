"""Structural credit formulas: spread of a firm's debt from asset volatility, leverage and time, and the way back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal distribution function by Hart (1968).
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, in double precision up to |x| = 7.07, and with a continued fraction beyond."""
    z = F.abs(x)
    top, bottom = F.lit(HART_TOP[0]), F.lit(HART_BOTTOM[0])
    for c in HART_TOP[1:]:
        top = top * z + c
    for c in HART_BOTTOM[1:]:
        bottom = bottom * z + c
    e = F.exp(-z * z / 2)
    tail = F.when(z < 7.07106781186547, e * top / bottom).otherwise(e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631))
    tail = F.when(z > 37, 0.0).otherwise(tail)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def merton_d2(sigma: Column, lev: Column, tau: Column) -> Column:
    return (-F.log(lev) - sigma * sigma * tau / 2) / (sigma * F.sqrt(tau))


def merton_spread(sigma: Column, lev: Column, tau: Column) -> Column:
    """-ln(N(d2) + N(-d1) / L) / tau, not below 0; NULL unless sigma > 0, 0 < L < 1 and tau > 0."""
    d2 = merton_d2(sigma, lev, tau)
    d1 = d2 + sigma * F.sqrt(tau)
    value = normal_cdf(d2) + normal_cdf(-d1) / lev
    return F.when((sigma > 0) & (lev > 0) & (lev < 1) & (tau > 0), F.greatest(-F.log(F.greatest(value, F.lit(1e-300))) / tau, F.lit(0.0)))


def merton_vega(sigma: Column, lev: Column, tau: Column) -> Column:
    """Derivative of the spread by sigma."""
    d2 = merton_d2(sigma, lev, tau)
    d1 = d2 + sigma * F.sqrt(tau)
    density = F.exp(-d1 * d1 / 2) / 2.5066282746310002
    value = normal_cdf(d2) + normal_cdf(-d1) / lev
    return F.when((sigma > 0) & (lev > 0) & (lev < 1) & (tau > 0), density / (lev * F.sqrt(tau) * value))


def with_merton(df: DataFrame, sigma: str, lev: str, tau: str, spread: str = "spread", vega: str = "vega") -> DataFrame:
    """df with the spread and its derivative by sigma. d1, d2 and their probabilities are columns of their own, which the
    other expressions refer to, so that the code of a stage stays small."""
    s, k, t = F.col(sigma), F.col(lev), F.col(tau)
    ok = (s > 0) & (k > 0) & (k < 1) & (t > 0)
    out = df.withColumn("_d2", merton_d2(s, k, t)).withColumn("_d1", F.col("_d2") + s * F.sqrt(t))
    out = out.withColumn("_n2", normal_cdf(F.col("_d2"))).withColumn("_n1", normal_cdf(-F.col("_d1"))).withColumn("_v", F.col("_n2") + F.col("_n1") / k)
    out = out.withColumn(spread, F.when(ok, F.greatest(-F.log(F.greatest(F.col("_v"), F.lit(1e-300))) / t, F.lit(0.0))))
    density = F.exp(-F.col("_d1") * F.col("_d1") / 2) / 2.5066282746310002
    return out.withColumn(vega, F.when(ok, density / (k * F.sqrt(t) * F.col("_v")))).drop("_d1", "_d2", "_n1", "_n2", "_v")


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x)
    e = np.exp(-np.minimum(z, 38.0) ** 2 / 2)
    with np.errstate(all="ignore"):
        tail = np.where(z < 7.07106781186547, e * np.polyval(HART_TOP, z) / np.polyval(HART_BOTTOM, z), e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631))
    return np.where(x > 0, 1 - tail, tail)


def invert_spreads(spread: np.ndarray, lev: np.ndarray, tau: np.ndarray, rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """The asset volatility of each spread by damped Newton steps (start 0.25, steps within 0.5, values within 1e-6 and 10).

    NaN where inputs are invalid or the residual stays over 1e-5. Each row stops by itself.
    """
    out = np.full(len(spread), np.nan)
    at = np.flatnonzero((spread > 0) & (lev > 0) & (lev < 1) & (tau > 0) & np.isfinite(spread))
    s, k, t = spread[at], lev[at], tau[at]
    root, sigma, active = np.sqrt(t), np.full(len(at), 0.25), np.ones(len(at), bool)

    def priced(v, i):
        d1 = (-np.log(k[i]) + v * v * t[i] / 2) / (v * root[i])
        value = np.maximum(_cdf(d1 - v * root[i]) + _cdf(-d1) / k[i], 1e-300)
        return -np.log(value) / t[i] - s[i], np.exp(-d1 * d1 / 2) / 2.5066282746310002 / (k[i] * root[i] * value)

    for _ in range(rounds):
        i = np.flatnonzero(active)
        if not len(i):
            break
        miss, slope = priced(sigma[i], i)
        active[i[np.abs(miss) < tolerance]] = False
        sigma[i] = np.clip(sigma[i] - np.clip(miss / np.maximum(slope, 1e-12), -0.5, 0.5), 1e-6, 10)
    if len(at):
        good = np.abs(priced(sigma, np.arange(len(at)))[0]) <= 1e-5
        out[at[good]] = sigma[good]
    return out


def implied_volatility(spread: Column | str, lev: Column | str, tau: Column | str) -> Column:
    """invert_spreads on Arrow batches; NULL for NaN."""

    @F.pandas_udf("double")
    def inverted(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in parts:
            found = invert_spreads(*(x.to_numpy(float, na_value=np.nan) for x in batch))
            yield pd.Series(found).where(np.isfinite(found), None)

    return inverted(spread, lev, tau)
