"""Special functions as expressions, inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number (error below 1e-10): Stirling's series after a shift by 8."""
    x = x.cast("double")
    y = x + SHIFT
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    shifted = sum((F.log(x + k) for k in range(1, SHIFT)), F.log(x))
    return F.when(x > 0, (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shifted)


def gaussian_kernel(squared_distance: Column, sigma: float) -> Column:
    return F.exp(-squared_distance / (2 * sigma * sigma))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def array_sum(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def array_scaled(a: str | Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def array_dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
