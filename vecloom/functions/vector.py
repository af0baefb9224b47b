"""Column functions on integer vectors, bucket numbers and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.config import SCALE, WIDTH

#: 2^31 - 1, the modulus of the fold, and 2^32 - 5, by which negative sums are lifted.
MODULUS, LIFT = (1 << 31) - 1, (1 << 32) - 5
TOLERANCE = 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")))


def l2_squared(a: Column, b: Column) -> Column:
    """Exact, as a long."""
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("long") - y) * (x.cast("long") - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b).cast("double"))


def max_abs(coords: Column) -> Column:
    return F.array_max(F.transform(coords, F.abs))


def wrap32(x: Column) -> Column:
    """What a signed 32-bit register keeps of x."""
    return (x + F.lit(1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)


def fold(values: Column, coefficients: Column) -> Column:
    """One number in [0, 2^31 - 1) for a vector of them. Each product wraps at 32 bits before it is added."""

    def step(r: Column, x: Column) -> Column:
        return F.when(r + x >= 0, r + x).otherwise(r + x + F.lit(LIFT)) % F.lit(MODULUS)

    products = F.zip_with(values, coefficients, lambda v, s: wrap32(v.cast("long") * s.cast("long")))
    return F.aggregate(products, F.lit(0).cast("long"), step)


def base_values(coords: Column, projections: Column, half: Column | int) -> Column:
    """For each projection (struct of a: scaled vector, b: scaled shift) the unit-radius bucket number: the floor of
    the projection, shifted by half the domain, over WIDTH. Larger radii are whole divisions of it. Fails at run time
    for a vector outside the domain, whose number would not fit its bits."""
    half = F.lit(half) if isinstance(half, int) else half
    value = lambda p: F.floor((dot(p["a"], coords) + p["b"] + half * SCALE) / F.lit(WIDTH * SCALE)).cast("long")
    inside = lambda v: F.when((v >= 0) & (v * WIDTH < 2 * half), v).otherwise(F.raise_error(F.lit("a vector lies outside the domain of the hash parameters")).cast("long"))
    return F.transform(projections, lambda p: let(value(p), inside))


def at_radius(base: Column, radius: Column) -> Column:
    return F.transform(base, lambda v: F.floor(v / radius).cast("long"))


def compare_ints(a: Column, b: Column) -> Column:
    return F.signum((a - b).cast("double")).cast("int")


def compare_doubles(a: Column, b: Column) -> Column:
    """-1, 0 or 1; differences up to TOLERANCE count as none."""
    return F.when(a - b > TOLERANCE, 1).when(b - a > TOLERANCE, -1).otherwise(0)


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; hours grow beyond two digits."""
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    part = lambda by, of: F.floor(seconds / by) % of if of else F.floor(seconds / by)
    return F.concat_ws(":", two(part(3600, 0)), two(part(60, 60)), two(part(1, 60)))


def record_text(*fields: Column) -> Column:
    """Fields and arrays, blank separated."""
    return F.concat_ws(" ", *fields)


def block_of(table: Column, tables: int, blocks: int) -> Column:
    """The block of a table: equal blocks, the last takes the rest."""
    return F.least(F.floor(table / (tables // blocks)), F.lit(blocks - 1)).cast("int")


def partition_of(id_: Column, partitions: int) -> Column:
    """A multiplicative hash of the id that any SQL engine can compute."""
    return ((id_.cast("long") * F.lit(2654435761)).bitwiseAND(F.lit((1 << 32) - 1)) % partitions).cast("int")


def split_start(id_: Column, starts: list[int]) -> Column:
    """The greatest start not above id, null before the first: a binary search, unrolled, in a sorted list."""
    held = F.array(*(F.lit(x).cast("long") for x in sorted(starts)))
    at, step = F.lit(0), 1 << max(len(starts), 1).bit_length()
    while step := step >> 1:  # at: how many starts are known not to lie above id
        at = let(at, _stepped(held, id_, step))
    return F.get(held, at - 1)


def _stepped(held: Column, id_: Column, step: int) -> Callable[[Column], Column]:
    return lambda at: F.when(F.get(held, at + (step - 1)) <= id_, at + step).otherwise(at)


def record_equal(pairs: list[tuple[Column, Column]]) -> Column:
    """Null-safe equality of records."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out
