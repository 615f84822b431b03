"""Edits that make copies, perturbations that make shifts, and marks that make overlays, as columns over rasters.

A raster is an ``array<double>``, row by row, of a known height and width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rasters import stencil
from ..functions.vectors import let, mirrored


def _mapped(v: Column, height: int, width: int, source: Sequence[int]) -> Column:
    """The raster whose pixels are those at ``source``."""
    return let(v, lambda u: F.transform(F.array(*[F.lit(i) for i in source]), lambda i: F.get(u, i)))


def cropped(v: Column, height: int, width: int) -> Column:
    """The middle three quarters of each side, enlarged to the old size."""
    rows, columns = ([n // 8 + k * (n - 2 * (n // 8)) // n for k in range(n)] for n in (height, width))
    return _mapped(v, height, width, [y * width + x for y in rows for x in columns])


def quantised(v: Column, step: float) -> Column:
    return F.transform(v, lambda x: F.floor(x / step + 0.5) * step)


def recompressed(v: Column, height: int, width: int, step: float) -> Column:
    """Halved, and stored in coarse levels: means of 2 x 2 pixels in their place."""

    def mean(u: Column, i: Column) -> Column:
        at = (F.floor(i / (2 * width)) * 2 * width + F.floor(i % width / 2) * 2).cast("int")
        return (F.get(u, at) + F.get(u, at + 1) + F.get(u, at + width) + F.get(u, at + width + 1)) / 4

    return quantised(let(v, lambda u: F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: mean(u, i))), step)


def recoloured(v: Column, most: float) -> Column:
    """A seventh brighter, within the range."""
    return F.transform(v, lambda x: F.greatest(F.least(x * 1.15, F.lit(most)), F.lit(-most)))


#: Edits of a planted copy, in the order in which they are dealt out.
EDITS = ("exact", "recompressed", "cropped", "mirror", "recoloured", "composed")


def edited_raster(v: Column, kind: Column, height: int, width: int, most: float, step: float) -> Column:
    composed = recoloured(mirrored(cropped(v, height, width), width), most)
    return (
        F.when(kind == "recompressed", recompressed(v, height, width, step))
        .when(kind == "cropped", cropped(v, height, width))
        .when(kind == "mirror", mirrored(v, width))
        .when(kind == "recoloured", recoloured(v, most))
        .when(kind == "composed", composed)
        .otherwise(v)
    )


#: Taps of a 3 x 3 mean.
MEAN = [(dy, dx, 1 / 9) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def perturbed(g: Column, kind: str, height: int, width: int) -> Column:
    """A raster of 0..255 as another source would give it: ``darker``, ``flat`` (half the contrast), ``blurred`` or ``coarse``."""
    if kind == "darker":
        return F.transform(g, lambda x: F.pow(x / 255, F.lit(2.5)) * 255)
    if kind == "flat":
        return F.transform(g, lambda x: 127.5 + (x - 127.5) / 2)
    if kind == "blurred":
        return stencil(g, height, width, MEAN)
    if kind == "coarse":
        return quantised(g, 32.0)
    raise ValueError(f"no such perturbation: {kind}")


def mark(height: int, width: int, tiled: bool) -> list[int]:
    """A watermark's pixels: a block in the lower right corner, or stripes across the raster."""
    inside = (lambda y, x: (x + 2 * y) % 4 == 0) if tiled else (lambda y, x: y >= height * 3 // 4 and x >= width * 3 // 8)
    return [int(inside(y, x)) for y in range(height) for x in range(width)]


def stamped(g: Column, height: int, width: int, tiled: bool, alpha: float, white: float = 255.0) -> Column:
    """The raster under a white mark of some opacity."""
    weights = F.array(*[F.lit(alpha * m) for m in mark(height, width, tiled)])
    return F.zip_with(g, weights, lambda x, w: x * (1 - w) + white * w)


def plant_rasters(rasters: DataFrame, every: int, offset: int, height: int, width: int, most: float, step: float) -> DataFrame:
    """``(id, origin, kind, v)``: copies of every so-many-th raster ``(id, v)``, the edits in turn."""
    k = F.floor(F.col("id") / every) % len(EDITS)
    kind = F.element_at(F.array(*[F.lit(e) for e in EDITS]), (k + 1).cast("int"))
    chosen = rasters.where(F.col("id") % every == 0).select("id", kind.alias("kind"), "v")
    return chosen.select((F.col("id") + offset).alias("id"), F.col("id").alias("origin"), "kind", edited_raster(F.col("v"), F.col("kind"), height, width, most, step).alias("v"))
