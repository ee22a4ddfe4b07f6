"""Closed-form statistics as Columns, and the percentile rule of the intervals."""
from __future__ import annotations

import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, confidence: float) -> tuple[Column, Column]:
    """Wilson score interval; the normal quantile is a driver constant."""
    z = statistics.NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    p, m = successes.cast("double") / n, n.cast("double")
    denom = F.lit(1.0) + F.lit(z * z) / m
    centre = (p + F.lit(z * z) / (F.lit(2.0) * m)) / denom
    spread = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / m + F.lit(z * z) / (F.lit(4.0) * m * m)) / denom
    return F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)


def index_percentile(values: Column, q: float) -> Column:
    """The value at index int(q * (n - 1)) of a sorted array: no interpolation."""
    n = F.size(values)
    at = F.floor(F.lit(q) * (n - F.lit(1)).cast("double")).cast("int") + F.lit(1)
    return F.when(n > 0, F.element_at(values, at))


def cohen_kappa(agree: Column, chance: Column) -> Column:
    """NULL where chance agreement is already certain."""
    return F.when(F.abs(F.lit(1.0) - chance) >= F.lit(1e-12), (agree - chance) / (F.lit(1.0) - chance))
