"""Log densities as column expressions, and special functions as vectorised UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = math.log(2 * math.pi)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x > 0: Stirling's series at x + 8, carried back by the recurrence."""
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + LOG_2PI / 2 + series - F.log(product)


def normal(x: Column, mean: Column | float, sd: Column | float) -> Column:
    mean, sd = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sd))
    z = (x - mean) / sd
    return -0.5 * z * z - F.log(sd) - LOG_2PI / 2


def _open(ok: Column, value: Column) -> Column:
    """Minus infinity outside the support; never NaN."""
    return F.when(ok, value).otherwise(F.lit(float("-inf")))


def log_normal(x: Column, median: float, geometric_sd: float) -> Column:
    return _open(x > 0, normal(F.log(F.when(x > 0, x)), math.log(median), math.log(geometric_sd)) - F.log(F.when(x > 0, x)))


def log_normal_interval(low: float, high: float, mass: float = 0.95) -> tuple[float, float]:
    """Median and geometric deviation of the log-normal whose central interval of a mass is given."""
    z = NormalDist().inv_cdf(0.5 + mass / 2)
    return math.exp((math.log(low) + math.log(high)) / 2), math.exp((math.log(high) - math.log(low)) / (2 * z))


def logit_normal(x: Column, low: float, high: float, median: float, sd: float) -> Column:
    ok = (x > low) & (x < high)
    p = F.when(ok, (x - low) / (high - low))
    m = (median - low) / (high - low)
    return _open(ok, normal(F.log(p / (1 - p)), math.log(m / (1 - m)), sd) - F.log(p * (1 - p)) - math.log(high - low))


def softmax_normal(x: Column, center: list[float], sd: list[float]) -> Column:
    """Density of a simplex array by its log ratios to the last entry, over the first k - 1 entries."""
    k = len(center)
    ok = F.forall(x, lambda v: v > 0)
    out = F.lit(0.0)
    for i in range(k - 1):
        out = out + normal(F.log(F.element_at(x, i + 1) / F.element_at(x, k)), math.log(center[i] / center[-1]), sd[i]) - F.log(F.element_at(x, i + 1))
    return _open(ok, out - F.log(F.element_at(x, k)))


def gaussian_copula(scores: list[Column], correlation: list[list[float]]) -> Column:
    """Log density of a Gaussian copula at the normal scores of its marginals; add the marginals' own log densities."""
    matrix = np.array(correlation, float)
    sign, log_det = np.linalg.slogdet(matrix)
    if sign <= 0 or not np.allclose(matrix, matrix.T) or not np.allclose(np.diag(matrix), 1):
        raise ValueError("a correlation is symmetric and positive definite, with ones on its diagonal")
    inner = np.linalg.inv(matrix) - np.eye(len(matrix))
    out = F.lit(-log_det / 2)
    for i, a in enumerate(scores):
        for j, b in enumerate(scores):
            out = out - a * b * float(inner[i, j]) / 2
    return out


def inverse_gamma(v: Column, a: float, b: float) -> Column:
    return _open(v > 0, a * math.log(b) - math.lgamma(a) - (a + 1) * F.log(F.when(v > 0, v)) - b / v)


def student_group(n: Column, q: Column, log_det: Column, a: float, b: float) -> Column:
    """Density of a group of n residuals whose shared variance has an inverse-gamma law, q their quadratic form."""
    return log_gamma(a + n / 2) - math.lgamma(a) + a * math.log(b) - n / 2 * LOG_2PI - log_det / 2 - (a + n / 2) * F.log(b + q / 2)


def diagonal_gaussian(residual: Column, variance: Column) -> Column:
    """Aggregate: log density of a group's independent normal residuals."""
    return -0.5 * F.sum(residual * residual / variance + F.log(variance) + LOG_2PI)


def gaussian_block(residual: np.ndarray, covariance: np.ndarray) -> float:
    """Log density of one dense block, by its Cholesky factor."""
    factor = np.linalg.cholesky(covariance)
    z = np.linalg.solve(factor, residual)
    return float(-0.5 * (len(residual) * LOG_2PI + 2 * np.log(np.diag(factor)).sum() + z @ z))


def multi_log_gamma(x: float, p: int) -> float:
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - j / 2) for j in range(p))


def inverse_wishart(sigma: np.ndarray, psi: np.ndarray, nu: float) -> float:
    p = len(sigma)
    sign, log_det = np.linalg.slogdet(sigma)
    if sign <= 0:
        return -math.inf
    return float(nu / 2 * np.linalg.slogdet(psi)[1] - nu * p / 2 * math.log(2) - multi_log_gamma(nu / 2, p) - (nu + p + 1) / 2 * log_det - 0.5 * np.trace(psi @ np.linalg.inv(sigma)))


def matrix_student(rows: np.ndarray, psi: np.ndarray, nu: float, p: int) -> float:
    """Density of n rows of q residuals whose shared covariance has an inverse-Wishart law over p of which q are seen."""
    n, q = rows.shape
    free = nu - (p - q)
    return float(
        -n * q / 2 * math.log(math.pi)
        + multi_log_gamma((free + n) / 2, q)
        - multi_log_gamma(free / 2, q)
        + free / 2 * np.linalg.slogdet(psi)[1]
        - (free + n) / 2 * np.linalg.slogdet(psi + rows.T @ rows)[1]
    )


def chi_square_tail(x: float, k: float) -> float:
    """P(X > x) for a chi-square variable: the regularised upper incomplete gamma function by series or fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * lead)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, lead * h)


def chi_square_sf(x: Column, k: Column) -> Column:
    @F.pandas_udf("double")
    def tail(values: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) or pd.isna(f) else chi_square_tail(float(v), float(f)) for v, f in zip(values, freedom, strict=True)], dtype=float)

    return tail(x.cast("double"), k.cast("double"))


def discrepancy_kernel(gap: Column, short: tuple[float, float], long: tuple[float, float], periodic: tuple[float, float, float, float]) -> Column:
    """Covariance at a time gap: two exponentials and a periodic term that fades. Pairs are (sd, time scale); the periodic
    term is (sd, period, length, time scale)."""
    (s1, t1), (s2, t2), (sp, period, length, tp) = short, long, periodic
    wave = F.exp(-2 * F.pow(F.sin(math.pi * gap / period), 2) / length**2)
    return s1**2 * F.exp(-gap / t1) + s2**2 * F.exp(-gap / t2) + sp**2 * wave * F.exp(-gap / tp)
