"""Scalar formulas of p-stable hashing under L2, on the driver."""

from __future__ import annotations

import math

from vecloom.config import WIDTH


def normal_pdf(x: float, mean: float = 0.0, deviation: float = 1.0) -> float:
    return math.exp(-(((x - mean) / deviation) ** 2) / 2) / (deviation * math.sqrt(2 * math.pi))


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def collision_probability(x: float) -> float:
    """Of one projection, for two points whose distance is the bucket width over x."""
    return 1 - 2 * normal_cdf(-x) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def probabilities(ratio: int, width: float = WIDTH) -> tuple[float, float]:
    """p1 and p2: at distance 1 and at distance ratio."""
    return collision_probability(width), collision_probability(width / ratio)


def projections_needed(n: int, ratio: int, least: int = 0) -> int:
    """m, so that a far point shares a bucket about once in n."""
    return max(least, math.ceil(math.log(n) / math.log(1 / probabilities(ratio)[1]))) if n > 1 else least


def tables_needed(m: int, ratio: int) -> int:
    """L, so that a near point shares a bucket of some table."""
    return math.ceil(probabilities(ratio)[0] ** -m)


def radius_count(d: int, t: int, ratio: int) -> int:
    """Radii 1, c, c^2, ... up to the greatest not above sqrt(d) * t."""
    return 1 + math.floor(math.log(math.sqrt(d) * t) / math.log(ratio))


def domain_bits(d: int, t: int) -> int:
    """f: the bits of a projection's domain."""
    bits = math.ceil(math.log2(d) + math.log2(t))
    if bits > 30:
        raise ValueError("the data's domain is too large for 32-bit buckets")
    return bits
