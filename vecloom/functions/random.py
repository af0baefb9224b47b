"""Random columns, seeded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.vector import let


def gaussian(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


def uniform(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def digits(count: int, seed: int) -> Column:
    """A number of so many uniform decimal digits."""
    return F.floor(F.rand(seed) * 10**count).cast("long")


def bounded_digits(low: float, high: float, seed: int) -> Column:
    return digits(10, seed) / F.lit(9999999999) * (high - low) + low


def zipf(low: float, high: float, exponent: float, seed: int, values: int = 100) -> Column:
    """One of so many evenly spaced values of [low, high), the i-th with a share of i^-exponent, by its inverse."""
    shares = [i**-exponent for i in range(1, values + 1)]
    edges, total = [], 0.0
    for s in shares:
        total += s / sum(shares)
        edges.append(total)

    def below(at: Column, low: int, high: int) -> Column:
        """How many edges lie at or below at, known to be from low to high: a binary search, unrolled."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at < edges[middle], below(at, low, middle)).otherwise(below(at, middle + 1, high))

    # bound once: a random column inside the search would be drawn anew at every step
    place = let(F.rand(seed), lambda at: below(at, 0, values))
    return F.lit(low) + F.least(place, F.lit(values - 1)) * ((high - low) / values)
