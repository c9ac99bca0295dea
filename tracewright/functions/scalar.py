"""Scalar expressions whose edge cases follow numeric arrays, not SQL.

Spark ranks NaN above all numbers and raises on division by zero; here a
comparison with NaN is false and a ratio has an explicit value for 0 / 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
NAN = float("nan")


def is_finite(c: Column) -> Column:
    """True for numbers, false for NaN, infinities and nulls."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INFINITY), F.lit(False))


def finite(c: Column) -> Column:
    """Null in place of what isn't a number, so that aggregates skip it."""
    return F.when(is_finite(c), c)


def above(c: Column, limit: Column | float) -> Column:
    """c > limit, false for NaN (which Spark takes for the greatest number)."""
    return F.coalesce(~F.isnan(c) & (c > limit), F.lit(False))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / F.nullif(b, F.lit(0)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def half_even(c: Column) -> Column:
    """Rounds halves to the even neighbour."""
    return F.rint(c)


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def frame_matches(frame: Column, seconds: Column, fps: Column, least: float = 1e-6) -> Column:
    """Whether a frame number and a time agree within half a frame."""
    return F.abs(frame / fps - seconds) <= F.greatest(F.lit(least), 0.5 / fps)


def mean_where(flag: Column, value: Column) -> Column:
    return F.avg(F.when(flag, value))


def share(flag: Column) -> Column:
    """The share of rows where flag holds; a null flag doesn't."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def tally(flag: Column) -> Column:
    return F.count(F.when(flag, True))


def slug(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
