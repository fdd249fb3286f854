"""Arithmetic, missing-value and binning columns."""

from __future__ import annotations

import math as _m

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    """NaN and +-Inf become NULL: the one missing-value contract of the library."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(a, b) -> Column:
    """Division that is NULL on a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_div(a, b, eps: float = 1e-10) -> Column:
    """Division with a small constant added to the divisor."""
    return _c(a).cast("double") / (_c(b).cast("double") + F.lit(eps))


def greater(a, b) -> Column:
    """Larger of two; NULL when either side is NULL."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def less(a, b) -> Column:
    """Smaller of two; NULL when either side is NULL."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sign(x: Column) -> Column:
    return F.signum(x)


def log(x: Column) -> Column:
    """Natural log, NULL outside the domain."""
    return F.when(x > 0, F.ln(x))


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.ln(x + 1))


def if_(c: Column, a, b) -> Column:
    return F.when(c, _c(a)).otherwise(_c(b))


def mask(x: Column, c: Column) -> Column:
    return F.when(c, x)


def zero_to_null(x: Column) -> Column:
    return F.when(x != 0, x)


def fill(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(finite(x), F.lit(value))


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins with the lowest edge included."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), labels[0])
    for lo, hi, lab in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((x > lo) & (x <= hi), lab)
    return out


def cap_group(cap: Column, large: float = 1e11, mid: float = 1e10) -> Column:
    return F.when(cap >= large, "large").when(cap >= mid, "mid").when(cap.isNotNull(), "small")


def alert_level(value: Column, limit, warning: float = 0.6, danger: float = 0.8, critical: float = 1.0) -> Column:
    """Band of value / limit."""
    r = div(value, limit)
    return (F.when(r >= critical, "critical").when(r >= danger, "danger")
            .when(r >= warning, "warning").when(r.isNotNull(), "normal"))


# Rational approximation of the inverse normal CDF (Abramowitz & Stegun 26.2.23).
PPF_C = (2.515517, 0.802853, 0.010328)
PPF_D = (1.432788, 0.189269, 0.001308)
# Error-function approximation (Abramowitz & Stegun 7.1.26).
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def norm_cdf(x: Column) -> Column:
    """Normal CDF from the error-function polynomial; stays inside codegen."""
    z = F.abs(x) / F.lit(_m.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.when(x >= 0, erf).otherwise(-erf))


def norm_ppf(p: Column) -> Column:
    """Inverse normal CDF; NULL outside (0, 1)."""
    tail = F.least(p, F.lit(1.0) - p)
    t = F.sqrt(F.lit(-2.0) * F.ln(tail))
    num = F.lit(PPF_C[0]) + t * (F.lit(PPF_C[1]) + t * F.lit(PPF_C[2]))
    den = F.lit(1.0) + t * (F.lit(PPF_D[0]) + t * (F.lit(PPF_D[1]) + t * F.lit(PPF_D[2])))
    z = t - num / den
    return (F.when((p <= 0) | (p >= 1), None).when(p == 0.5, 0.0)
            .when(p > 0.5, z).otherwise(-z))


def norm_ppf_value(p: float) -> float:
    """The same approximation for one constant known when the plan is built."""
    if p == 0.5:
        return 0.0
    t = _m.sqrt(-2.0 * _m.log(min(p, 1 - p)))
    c, d = PPF_C, PPF_D
    z = t - (c[0] + t * (c[1] + t * c[2])) / (1 + t * (d[0] + t * (d[1] + t * d[2])))
    return z if p > 0.5 else -z


def corr(x, y, over=None) -> Column:
    """Pearson correlation of complete pairs, NULL (not an error) when a side does not vary.

    Built from covariance and deviations because the built-in fails on a zero variance under ANSI rules.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    px, py = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    vx, vy = at(F.var_pop(px)), at(F.var_pop(py))
    return F.when((vx > 1e-18) & (vy > 1e-18), F.try_divide(at(F.covar_pop(px, py)), F.sqrt(vx) * F.sqrt(vy)))
