"""Special functions: column expressions where a finite form exists, Arrow functions elsewhere (inventory C31-C39, C310-C312)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _horner(x: Column, *coefficients: float) -> Column:
    """A polynomial from its highest coefficient to its lowest."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erf(x: Column) -> Column:
    """Error function after Abramowitz and Stegun 7.1.26 (1.5e-7)."""
    # Fixed values of the approximation.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + p * F.abs(x))
    y = 1 - _horner(t, a5, a4, a3, a2, a1, 0.0) * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    """Normal distribution function by ``erf``; a step where sigma is not positive."""
    mu, sigma = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mu, sigma))
    z = F.try_divide(x - mu, sigma)
    return F.when(sigma <= 0, F.when(x < mu, 0.0).otherwise(1.0)).otherwise(0.5 * (1 + erf(z / math.sqrt(2))))


def normal_cdf_fine(z: Column) -> Column:
    """Normal distribution function after Abramowitz and Stegun 26.2.17 (7.5e-8)."""
    # Fixed values of the approximation.
    p, b1, b2, b3, b4, b5 = 0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429
    t = 1 / (1 + p * F.abs(z))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * _horner(t, b5, b4, b3, b2, b1, 0.0)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_inv_cdf(p: Column) -> Column:
    """Normal quantile by a rational approximation in three regions (1.15e-9); null outside (0, 1)."""
    # Fixed values of the approximation.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469672, 138.357751867269, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    low = 0.02425

    def tail(x: Column) -> Column:
        q = F.sqrt(-2 * F.log(x))
        return _horner(q, *c) / _horner(q, *d)

    q = p - 0.5
    r = q * q
    return F.when(~((p > 0) & (p < 1)), None).when(p < low, tail(p)).when(p > 1 - low, -tail(1 - p)).otherwise(q * _horner(r, *a) / _horner(r, *b))


def np_ln_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function: Stirling's series above 10, the recurrence below, reflection below 0.5."""
    x = np.asarray(x, dtype=float)
    low = x < 0.5
    y = np.where(low, 1 - x, x)
    steps = np.where(y < 10, np.ceil(10 - y), 0).astype(int)
    shift = np.zeros_like(y)
    for k in range(int(steps.max()) if steps.size else 0):
        shift += np.where(k < steps, np.log(np.where(k < steps, y + k, 1.0)), 0.0)
    z = y + steps
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(low, np.log(np.abs(math.pi / np.sin(math.pi * x))) - out, out)


def np_gamma_p(a: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Regularised lower incomplete gamma: a power series for small x, a continued fraction for large."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(np.where(x > 0, a * np.log(np.where(x > 0, x, 1)) - x, -np.inf) - np_ln_gamma(a))
    term = total = 1 / a
    for k in range(1, rounds):
        term = term * np.where(x < a + 1, x, 0) / (a + k)
        total = total + term
    frac = np.zeros_like(x)
    for k in range(rounds, 0, -1):  # from the inside out
        frac = k * (k - a) / (x + 2 * k + 1 - a - frac)
    with np.errstate(divide="ignore", invalid="ignore"):
        upper = front / (x + 1 - a - frac)
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - upper))


def np_beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, evaluated from the inside out."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = np.ones_like(y)
    for k in range(rounds, 0, -1):
        even = k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))
        inner = 1 + even / (1 + odd / inner)
    inner = 1 - (p + q) * y / (p + 1) / inner
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - np_ln_gamma(p) - np_ln_gamma(q) + np_ln_gamma(p + q)) / p
        value = np.where(y <= 0, 0.0, front / inner)
    return np.where(turn, 1 - value, value)


def np_student_t_cdf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    half = 0.5 * np_beta_inc(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - half, half)


def np_chi2_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Doubling, then bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    high = np.maximum(df, 1.0)
    while (short := np_gamma_p(df / 2, high / 2) < p).any():
        high = np.where(short, high * 2, high)
        if (high > 1e12).any():
            break
    low = np.zeros_like(high)
    for _ in range(60):
        mid = (low + high) / 2
        below = np_gamma_p(df / 2, mid / 2) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


@pandas_udf(DoubleType())
def ln_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(np_ln_gamma(x.to_numpy()))


@pandas_udf(DoubleType())
def gamma_p(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(np_gamma_p(a.to_numpy(), x.to_numpy()))


@pandas_udf(DoubleType())
def beta_inc(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(np_beta_inc(a.to_numpy(), b.to_numpy(), x.to_numpy()))


@pandas_udf(DoubleType())
def student_t_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np_student_t_cdf(x.to_numpy(), df.to_numpy()))


@pandas_udf(DoubleType())
def chi2_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np_chi2_quantile(p.to_numpy(), df.to_numpy()))


def gamma(x: Column) -> Column:
    return F.exp(ln_gamma(x))


def chi2_cdf(x: Column, df: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(gamma_p(df / 2, x / 2))
