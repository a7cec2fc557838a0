"""Scalar functions over numbers, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean of values clipped at 0; 0 where both are."""
    x, y = F.greatest(F.lit(0.0), a), F.greatest(F.lit(0.0), b)
    return F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_life(confidence: Column, days: Column, half: float = 60.0) -> Column:
    """Exponential decay; negative ages count as 0."""
    return confidence * F.pow(F.lit(0.5), F.greatest(F.lit(0), days) / half)


def noisy_or(c: Column) -> Column:
    """Aggregate 1 - product(1 - x): partial sums of logarithms would lose x = 1, so the product is kept as one."""
    return 1 - F.product(1 - c)


def prefix(c: Column) -> Column:
    """The part of an id before its colon."""
    return F.split_part(c, F.lit(":"), F.lit(1))


def most_common(counts: Column) -> Column:
    """Entries of a map as an array by falling count, then key."""
    return F.array_sort(F.map_entries(counts), lambda x, y: F.when(x["value"] != y["value"], y["value"] - x["value"]).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
