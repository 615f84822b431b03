"""Pairs of photos: similarity joins, set operations on unordered pairs.

Every join here keys on a band, a block or a pair, so none plans as a nested
loop.  ``a`` and ``b`` are ids in order (``a < b``) within one set; across two
sets ``a`` is from the left one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rasters import hash_distance

#: Vectors of a group that a task holds; dot products that it works out at once; partitions that cells are dealt to.
LARGEST_GROUP, PRODUCTS, MOST_PARTS = 16_384, 1 << 20, 2048


def _bands(words: str, bits: int, bands: int) -> Column:
    """The hash cut into ``bands`` runs of bits, each with its number."""
    cuts = [round(k * bits / bands) for k in range(bands + 1)]
    out = []
    for k in range(bands):
        parts = []
        for w in range((bits + 63) // 64):
            lo, hi = max(cuts[k], 64 * w), min(cuts[k + 1], 64 * w + 64)
            if lo < hi:
                mask = (1 << (hi - lo)) - 1
                shifted = F.shiftrightunsigned(F.get(words, F.lit(w)), lo - 64 * w)
                parts.append(shifted if hi - lo == 64 else shifted.bitwiseAND(F.lit(mask)))
        out.append(F.struct(F.lit(k).alias("band"), F.array(*parts).alias("value")))
    return F.array(*out)


def hamming_join(left: DataFrame, right: DataFrame | None, radius: int, bits: int = 64) -> DataFrame:
    """``(a, b, distance)`` of all pairs of ``(id, hash)`` rows within ``radius`` bits; exact.

    With ``radius + 1`` bands, two hashes that differ in ``radius`` bits at most
    are equal in a band.  Bands join distinct hashes only, each pair of them in
    the first band that it shares, so that a hash which many photos have meets
    its band once; its photos come in by an equi-join on the hash at the end.
    """
    kinds = [df.groupBy("hash").agg(F.count("*").alias("copies")).drop("copies") for df in ([left] if right is None else [left, right])]
    cut = lambda df, n: df.select(F.col("hash").alias(f"h{n}"), _bands("hash", bits, radius + 1).alias(f"all{n}")).select(f"h{n}", f"all{n}", F.explode(f"all{n}").alias("band"))
    joined = cut(kinds[0], "a").join(cut(kinds[-1], "b"), "band")
    earlier = F.exists(F.arrays_zip("alla", "allb"), lambda z: (z["alla"] == z["allb"]) & (z["alla"]["band"] < F.col("band.band")))
    distance = hash_distance(F.col("ha"), F.col("hb"))
    near = joined.where((distance <= radius) & ~earlier).select("ha", "hb", distance.alias("distance"))
    x, y = left.select(F.col("hash").alias("ha"), F.col("id").alias("a")), (left if right is None else right).select(F.col("hash").alias("hb"), F.col("id").alias("b"))
    found = near.join(x, "ha").join(y, "hb").select("a", "b", "distance")
    return found.where("a < b") if right is None else found


def cosine_join(left: DataFrame, right: DataFrame | None, threshold: float, block: int = 4096) -> DataFrame:
    """``(a, b, similarity)`` of all pairs of ``(id, v)`` rows with a dot product of ``threshold`` or more; exact.

    Rows are dealt to groups of about ``block`` (more as tables grow, up to
    ``LARGEST_GROUP``), and two groups meet in a cell.  A row goes to each cell
    of its group, as it is: nothing is joined or broadcast, whatever Spark takes
    the sizes for.  A task holds a cell's right group and multiplies it with the
    left one as that streams by.
    """
    same = right is None
    counts = [df.count() for df in ([left] if same else [left, right])]
    group = min(max(block, math.isqrt(counts[0] * counts[-1]) // 32), max(block, LARGEST_GROUP))
    nx, ny = (max(1, -(-n // group)) for n in (counts[0], counts[-1]))
    cells = nx * (nx + 1) // 2 if same else nx * ny
    number = (lambda i, j: F.expr(f"{j} * ({j} + 1) div 2 + {i}")) if same else (lambda i, j: F.expr(f"{i} * {ny} + {j}"))

    def deal(df: DataFrame, n: int, side: int, meets: str, cell: Column) -> DataFrame:
        one = df.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("k"))
        return one.select("id", "v", "k", F.explode(F.expr(meets)).alias("other")).select(cell.alias("cell"), F.lit(side).alias("side"), "id", "v")

    x = deal(left, nx, 1, f"sequence({'k' if same else '0L'}, {ny - 1}L)", number("k", "other"))
    y = deal(left if same else right, ny, 0, f"sequence(0L, {'k' if same else f'{nx - 1}L'})", number("other", "k"))
    # Those of one group: in cells 0, 2, 5, ...
    alike = {j * (j + 3) // 2 for j in range(nx)} if same else set()
    products = PRODUCTS

    def matrix(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, c, v = None, [], None, None
        for b in batches:
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                cell, side = keys[lo].tolist()
                if cell != at:
                    at, held, c, v = cell, [], None, None
                ids, m = matrix(b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo))
                if side == 0:
                    held.append((ids, m))
                    continue
                if held:
                    c, v, held = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), []
                if c is None:
                    continue
                step = max(1, products // len(c))
                for k in range(0, len(ids), step):
                    a = ids[k : k + step]
                    sims = m[k : k + step] @ v.T
                    p, q = np.nonzero(sims >= threshold)
                    if cell in alike:
                        once = np.flatnonzero(a[p] < c[q])
                        p, q = p[once], q[once]
                    if len(p):
                        s, t = a[p], c[q]
                        if same:
                            s, t = np.minimum(s, t), np.maximum(s, t)
                        kind = b.schema.field(2).type
                        yield pa.RecordBatch.from_arrays([pa.array(s, kind), pa.array(t, kind), pa.array(sims[p, q])], names=["a", "b", "similarity"])

    both = x.unionAll(y)
    parts = min(cells, MOST_PARTS)
    id_type = both.schema["id"].dataType.simpleString()
    met = both.repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", "side")
    return met.mapInArrow(run, f"a {id_type}, b {id_type}, similarity double")


def canonical(pairs: DataFrame) -> DataFrame:
    """The pairs with ``a`` and ``b`` in order; other columns stay."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)


def minus_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that are not among the known ones, whatever the order in either."""
    k = canonical(known.select("a", "b")).toDF("_a", "_b")
    return pairs.join(k, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def confirm_hash_pairs(pairs: DataFrame, similarity: DataFrame, points: DataFrame, least_similarity: float, least_points: int) -> DataFrame:
    """Hash pairs that another look confirms.

    ``similarity(a, b, similarity)`` lacks pairs without embeddings;
    ``points(a, b, points, fixed_camera)`` tells what keypoints say.
    """
    both = pairs.join(similarity, ["a", "b"], "left").join(points, ["a", "b"], "left")
    alike = F.coalesce(F.col("similarity") >= least_similarity, F.lit(False)) & ~F.coalesce("fixed_camera", F.lit(False))
    return both.where(alike | F.coalesce(F.col("points") >= least_points, F.lit(False))).select(*pairs.columns)


def _packed(df: DataFrame, n: int) -> DataFrame:
    """``(k, all)``: the rows ``(id, v)`` dealt to ``n`` blocks."""
    one = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("k"), F.struct(F.col("id"), F.col("v").cast("array<double>").alias("v")).alias("one"))
    return one.groupBy("k").agg(F.collect_list("one").alias("all"))


def _meetings(queries: DataFrame, items: DataFrame, block: int) -> DataFrame:
    """``(x, y)``: every block of queries with every block of items."""
    nx, ny = (max(1, -(-df.count() // block)) for df in (queries, items))
    x = _packed(queries, nx).select(F.col("k").alias("i"), F.col("all").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("j"))
    y = _packed(items, ny).select(F.col("k").alias("j"), F.col("all").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"))
    return x.join(y, ["i", "j"]).select("x", "y")


def _block(cell: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
    ids, vectors = cell.values.field("id"), cell.values.field("v")
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def most_similar(queries: DataFrame, items: DataFrame, block: int = 512) -> DataFrame:
    """``(id, closest)``: each query's greatest dot product with an item; blocks of both meet, and a row a query comes of each meeting."""
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (q, u), (_, v) = _block(b.column(0)[r]), _block(b.column(1)[r])
                yield pa.RecordBatch.from_arrays([q, pa.array((u @ v.T).max(axis=1))], names=["id", "closest"])

    return _meetings(queries, items, block).mapInArrow(run, f"id {kind}, closest double").groupBy("id").agg(F.max("closest").alias("closest"))


def nearest(queries: DataFrame, items: DataFrame, k: int, block: int = 512) -> DataFrame:
    """``(q, id, distance, rank)``: each query's ``k`` nearest items of ``(id, v)``, by blocks; ties by id.

    Each block pair yields its own nearest ``k`` for every query, and a window
    takes the nearest of those.
    """
    from pyspark.sql.window import Window

    long = lambda df: df.select(F.col("id").cast("long").alias("id"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (q, u), (c, v) = ((ids.to_numpy(zero_copy_only=False), m) for ids, m in (_block(b.column(0)[r]), _block(b.column(1)[r])))
                order = np.argsort(c, kind="stable")
                c, v = c[order], v[order]
                d = np.stack([((x - v) ** 2).sum(axis=1) for x in u])
                top = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, top.shape[1])), pa.array(c[top].reshape(-1)), pa.array(np.take_along_axis(d, top, 1).reshape(-1))], names=["q", "id", "distance"])

    found = _meetings(long(queries), long(items), block).mapInArrow(run, "q long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def other_nearest(vectors: DataFrame, k: int, block: int = 512) -> DataFrame:
    """``(q, id, distance, rank)``: each row's ``k`` nearest other rows."""
    from pyspark.sql.window import Window

    others = nearest(vectors, vectors, k + 1, block).where("q <> id")
    return others.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("rank") <= k)
