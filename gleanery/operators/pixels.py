"""Per-image measures of decoded images, in one pass over the pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """A raster of 0..255; channels come as blue, green, red."""
    v = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return v[..., 0] if channels == 1 else v[..., :3] @ np.array([0.114, 0.587, 0.299])


def resized(v: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area means: running sums along each axis, read between pixels."""
    for axis, n in ((0, height), (1, width)):
        old = v.shape[axis]
        if old == n:
            continue
        sums = np.concatenate([np.zeros_like(np.take(v, [0], axis)), np.cumsum(v, axis)], axis)
        at = np.linspace(0, old, n + 1)
        lo = np.minimum(at.astype(int), old - 1)
        part = (at - lo).reshape([-1 if k == axis else 1 for k in range(v.ndim)])
        edge = np.take(sums, lo, axis) * (1 - part) + np.take(sums, lo + 1, axis) * part
        v = np.diff(edge, axis=axis) * n / old
    return v


def laplacian_variance(gray: np.ndarray) -> float:
    p = np.pad(gray, 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray).var())


def block_hash(gray: np.ndarray) -> list[int]:
    """256 bits: which of 16 x 16 blocks reach the mean; four signed 64-bit numbers, first block lowest."""
    blocks = resized(resized(gray, 256, 256), 16, 16)
    bits = (blocks >= blocks.mean()).reshape(4, 64)
    return [int(x) for x in np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1)]


def small_embedding(gray: np.ndarray) -> list[float]:
    """The built-in embedder: an 8 x 8 thumbnail and its mirror image, centred, as a unit vector.

    It stands in where no network's weights are at hand; any function from a raster to a vector can take its place.
    """
    v = resized(gray, 8, 8)
    v = v + v[:, ::-1]
    v = (v - v.mean()).reshape(-1)
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def edges(gray: np.ndarray, config: AuditConfig = DEFAULT) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """``(shape, height, width, gx, gy)``: Sobel edges of the slightly blurred photo at its shape's common size."""
    h, w = gray.shape
    key = int(np.rint(np.log(w / h) / config.aspect_step))
    aspect = np.exp(key * config.aspect_step)
    side = config.overlay_side
    width, height = (side, max(8, int(np.rint(side / aspect)))) if aspect >= 1 else (max(8, int(np.rint(side * aspect))), side)
    small = resized(gray, height, width)
    taps = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 0.8**2))
    taps /= taps.sum()
    p = np.pad(small, 2, mode="reflect")
    p = sum(t * p[:, k : k + width] for k, t in enumerate(taps))
    p = sum(t * p[k : k + height] for k, t in enumerate(taps))
    q = np.pad(p, 1, mode="reflect")
    gx = sum(s * (q[k : k + height, 2:] - q[k : k + height, :-2]) for k, s in enumerate((1, 2, 1))) / 4
    gy = sum(s * (q[2:, k : k + width] - q[:-2, k : k + width]) for k, s in enumerate((1, 2, 1))) / 4
    return key, height, width, gx, gy


def measured(images: DataFrame, config: AuditConfig = DEFAULT, embed=small_embedding) -> DataFrame:
    """``(name, ok, sharpness, hash, v, shape, eh, ew, gx, gy)`` from decoded images; the pixels go no further."""
    schema = "name string, ok boolean, sharpness double, hash array<long>, v array<double>, shape int, eh int, ew int, gx array<float>, gy array<float>"

    def run(parts):
        for rows in parts:
            out = []
            for r in rows.itertuples():
                if r.height <= 0:
                    out.append((r.name, False, None, None, None, None, None, None, None, None))
                    continue
                gray = to_gray(r.data, r.height, r.width, r.channels)
                key, h, w, gx, gy = edges(gray, config)
                out.append((r.name, True, laplacian_variance(gray), block_hash(gray), embed(gray), key, h, w, gx.astype(np.float32).reshape(-1), gy.astype(np.float32).reshape(-1)))
            yield pd.DataFrame(out, columns=["name", "ok", "sharpness", "hash", "v", "shape", "eh", "ew", "gx", "gy"])

    return images.select("name", "height", "width", "channels", "data").mapInPandas(run, schema)


def thumbnail(gray: np.ndarray, side: int) -> np.ndarray:
    """No side longer than ``side``; never enlarged."""
    scale = side / max(gray.shape)
    return gray if scale >= 1 else resized(gray, *(max(1, int(round(n * scale))) for n in gray.shape))


def cropped(raster: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The region of a valid box, at least one pixel."""
    h, w = raster.shape[:2]
    x1, y1, x2, y2 = box
    left, top = int(x1 * w), int(y1 * h)
    return raster[top : max(int(y2 * h), top + 1), left : max(int(x2 * w), left + 1)]


def contact_sheets(pairs: DataFrame, tiles: DataFrame, per_sheet: int = 20, columns: int = 4) -> DataFrame:
    """``(sheet, height, width, data)``: pairs ``(id, a, b)`` side by side, from ``tiles(name, side, data)``."""
    left, right = tiles.select(F.col("name").alias("a"), "side", F.col("data").alias("da")), tiles.select(F.col("name").alias("b"), F.col("data").alias("db"))
    rows = pairs.join(left, "a").join(right, "b").withColumn("sheet", F.floor(F.col("id") / per_sheet))

    def run(r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("id")
        s = int(r["side"].iloc[0])
        sheet = np.zeros((-(-len(r) // columns) * s, columns * 2 * s), np.uint8)
        for k, one in enumerate(r.itertuples()):
            y, x = k // columns * s, k % columns * 2 * s
            sheet[y : y + s, x : x + s] = np.frombuffer(one.da, np.uint8).reshape(s, s)
            sheet[y : y + s, x + s : x + 2 * s] = np.frombuffer(one.db, np.uint8).reshape(s, s)
        return pd.DataFrame({"sheet": [int(r["sheet"].iloc[0])], "height": [sheet.shape[0]], "width": [sheet.shape[1]], "data": [sheet.tobytes()]})

    return rows.groupBy("sheet").applyInPandas(run, "sheet long, height int, width int, data binary")
