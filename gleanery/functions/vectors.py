"""Vectors as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used there, lambdas included."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def normalized(v: Column) -> Column:
    return let(v, lambda u: let(F.sqrt(dot(u, u)), lambda length: F.transform(u, lambda x: x / length)))


def mirrored(v: Column, width: int) -> Column:
    """A raster, row by row, flipped left to right."""
    return let(v, lambda u: F.transform(F.sequence(F.lit(0), F.size(u) - 1), lambda i: F.get(u, i - i % width + (width - 1 - i % width))))


def mirror_invariant(v: Column, flipped: Column) -> Column:
    """The unit vector of an embedding and its mirror image's embedding together."""
    return normalized(F.zip_with(v, flipped, lambda x, y: x + y))
