"""Arithmetic that must be exact or that is shared by checks: reachable means, intervals, Wilson bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def grim_verdict(unscaled: Column, decimals: Column, granularity: Column) -> Column:
    """Whether a mean (unscaled digits and decimals, as printed) is the average of ``granularity`` integers.

    A sum k is printed as M at d decimals, rounding halves up or to even, where |2k*10^d - 2Mg| < g, or at the tie below
    M, or at a tie above it if M is even. Integers only, so nothing is lost to floating point."""
    p = F.pow(F.lit(10), decimals).cast("long")
    g, m = granularity.cast("long"), unscaled.cast("long")
    low = F.floor(m * g / p).cast("long") - 1

    def reached(i: Column) -> Column:
        x = 2 * (low + i) * p - 2 * m * g
        return (F.abs(x) < g) | (x == -g) | ((F.abs(x) == g) & (F.pmod(m, F.lit(2)) == 0))

    some = F.exists(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), reached)
    return F.when((decimals < 1) | (g >= p), "no-power").when(some, "consistent").otherwise("inconsistent")


def grim_nearest(unscaled: Column, decimals: Column, granularity: Column) -> Column:
    """The two attainable means (unscaled, rounded half up) closest to the printed one, ascending."""
    p = F.pow(F.lit(10), decimals).cast("long")
    g, m = granularity.cast("long"), unscaled.cast("long")
    low = F.floor(m * g / p).cast("long") - 1
    means = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda i: F.floor((2 * (low + i) * p + g) / (2 * g)).cast("long")))
    near = F.array_sort(F.transform(means, lambda v: F.struct(F.abs(v - m).alias("d"), v.alias("v"))))
    return F.array_sort(F.transform(F.slice(near, 1, 2), lambda s: s["v"]))


def interval_of(value: Column, decimals: Column) -> tuple[Column, Column]:
    """What may have been rounded to the printed value."""
    half = 0.5 * F.pow(F.lit(10.0), -decimals)
    return value - half, value + half


def wilson(good: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without observations."""
    p, zz = good / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    low, high = (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high))


def relative_gap(value: Column, other: Column) -> Column:
    return F.when(other == 0, F.abs(value)).otherwise(F.abs(value - other) / F.abs(other))
