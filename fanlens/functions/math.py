"""Numeric helpers: zero-safe ratios and the logistic curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(num, den) -> Column:
    """``num / den`` as double (caller guarantees den != 0)."""
    return _c(num).cast("double") / _c(den).cast("double")


def safe_ratio(num, den) -> Column:
    """``num / nullif(den, 0)`` as double; null when the denominator is zero."""
    d = _c(den)
    return F.when(d != 0, _c(num).cast("double") / d.cast("double"))


def logistic(t, k, r, t0) -> Column:
    """K / (1 + exp(-r (t - t0)))."""
    return _c(k) / (F.lit(1.0) + F.exp(-_c(r) * (_c(t) - _c(t0))))


def logistic_slope(t, k, r, t0) -> Column:
    """Derivative of the logistic curve: K r e^{-r(t-t0)} / (1 + e^{-r(t-t0)})^2."""
    e = F.exp(-_c(r) * (_c(t) - _c(t0)))
    return _c(k) * _c(r) * e / F.pow(F.lit(1.0) + e, F.lit(2.0))
