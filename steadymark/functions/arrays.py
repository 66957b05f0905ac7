"""Array helpers that evaluate their input once.

Catalyst inlines a computed array into the lambda that reads it, so a chain of higher-order functions
would recompute the array for every element. :func:`let` binds the value to a lambda variable instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated exactly once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return let(values, lambda xs: F.try_divide(total(xs), F.size(xs)))


def stddev_pop(values: Column) -> Column:
    def spread(xs: Column) -> Column:
        return let(
            F.try_divide(total(xs), F.size(xs)),
            lambda mu: F.sqrt(
                F.try_divide(F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + (v - mu) * (v - mu)), F.size(xs))
            ),
        )

    return let(values, spread)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")
