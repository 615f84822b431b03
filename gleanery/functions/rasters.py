"""Small rasters as ``array<double>`` columns, row by row; no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, let, mean, total


def _reflect(i: Column, n: int) -> Column:
    """Index ``i`` mirrored at the outer pixels' centres."""
    return F.when(i < 0, -i).when(i >= n, F.lit(2 * n - 2) - i).otherwise(i)


def pixel(v: Column, y: Column, x: Column, height: int, width: int) -> Column:
    return F.get(v, _reflect(y, height) * width + _reflect(x, width))


def stencil(v: Column, height: int, width: int, taps: list[tuple[int, int, float]]) -> Column:
    """The raster convolved with ``(dy, dx, weight)`` taps, borders reflected."""

    def at(u: Column, i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), (i % width).cast("int")
        parts = [pixel(u, y + dy, x + dx, height, width) * w for dy, dx, w in taps]
        return sum(parts[1:], parts[0])

    return let(v, lambda u: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: at(u, i)))


LAPLACE = [(-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (0, 0, -4.0)]
SOBEL_X = [(dy, dx, dx * (2.0 if dy == 0 else 1.0)) for dy in (-1, 0, 1) for dx in (-1, 1)]
SOBEL_Y = [(dy, dx, dy * (2.0 if dx == 0 else 1.0)) for dx in (-1, 0, 1) for dy in (-1, 1)]


def variance(v: Column) -> Column:
    """Population variance."""
    centred = lambda u: let(mean(u), lambda m: F.transform(u, lambda x: x - m))
    return let(v, lambda u: let(centred(u), lambda c: dot(c, c) / F.size(c)))


def sharpness(v: Column, height: int, width: int) -> Column:
    """Variance of the Laplacian."""
    return variance(stencil(v, height, width, LAPLACE))


def mean_hash(v: Column, words: int = 1) -> Column:
    """A bit for each value, set where it reaches the mean, in ``words`` 64-bit numbers, first value lowest."""
    each = F.sequence(F.lit(0), F.lit(63))

    def word(bits: Column, k: int) -> Column:
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.get(bits, k * 64 + i), i)))

    bits = lambda u: let(mean(u), lambda m: F.transform(u, lambda x: (x >= m).cast("bigint")))
    return let(v, lambda u: let(bits(u), lambda b: F.array(*[word(b, k) for k in range(words)])))


def hash_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def changed_share(a: Column, b: Column, level: float) -> Column:
    """Share of pixels that differ by more than ``level``."""
    return total(F.zip_with(a, b, lambda x, y: (F.abs(x - y) > level).cast("double"))) / F.size(a)
