"""Numeric expressions: correlation that is null when undefined, tolerant equality, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Missing values have one form here: null."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def both_present(x: str | Column, y: str | Column) -> Column:
    return nan_to_null(x).isNotNull() & nan_to_null(y).isNotNull()


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both values exist; null for a constant or one-row group.

    ``corr`` raises DIVIDE_BY_ZERO on constant groups under ANSI mode, so the quotient is
    written out. All three terms share one pass of mergeable moments.
    """
    ok = both_present(x, y)
    a, b = F.when(ok, col(x)), F.when(ok, col(y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def abs_error(x: str | Column, y: str | Column) -> Column:
    return F.abs(col(x) - col(y))


def squared_error(x: str | Column, y: str | Column) -> Column:
    return (col(x) - col(y)) * (col(x) - col(y))


def close_to(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerant equality; a missing value on either side is never close."""
    a, b = nan_to_null(a), nan_to_null(b)
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def value_bin(c: str | Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Class number of a value on [low, high], ties to even."""
    scaled = (col(c) - F.lit(low)) / F.lit(high - low) * F.lit(float(bins - 1))
    return F.rint(scaled).cast("bigint")


def min_max(c: str | Column, low: str | Column, high: str | Column) -> Column:
    return F.try_divide(col(c) - col(low), col(high) - col(low))


def edge_bin(c: str | Column, edges: str | Column) -> Column:
    """Number of edges at or below the value; equal edges give the upper bin."""
    c = col(c)
    return F.size(F.filter(col(edges), lambda e: e <= c))


def half_even_share(n: str | Column, share: float) -> Column:
    """``round(share * n)``, halves to even."""
    return F.rint(col(n) * F.lit(float(share))).cast("bigint")


def floor_share(n: str | Column, share: float) -> Column:
    return F.floor(col(n) * F.lit(float(share)))
