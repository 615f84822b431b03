"""Matches that are mostly a printed template shared with unrelated photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, AuditConfig


def ranked_by_hash(photos: DataFrame) -> DataFrame:
    """``(ref, place, total)``: ``photos(id)`` numbered from 0 by ``md5(id)``, in two levels, so that no task sorts all of them."""
    h = F.md5(F.col("id").cast("string"))
    rows = photos.select(F.col("id").alias("ref"), h.alias("h"), F.substring(h, 1, 3).alias("part"))
    counts = rows.groupBy("part").agg(F.count("*").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of 4096 parts
    ahead = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"), F.sum("c").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("h", "ref")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(ahead), "part").select("ref", (F.col("ahead") + F.col("inside")).alias("place"), "total")


def reference_sample(pairs: DataFrame, photos: DataFrame, n: int) -> DataFrame:
    """``(a, b, ref)``: for each pair, ``n`` other photos (all of them, if there are fewer).

    ``photos(id)`` is the pool, laid out in a circle by hash.  A pair takes the
    photos in a row that begins at a hash of the pair, itself left out: an
    equi-join on places, whose rows are as many as are drawn.
    """
    placed = ranked_by_hash(photos)
    total = F.broadcast(placed.select("total").limit(1))  # one row
    key = F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")))
    start = F.conv(F.substring(key, 1, 12), 16, 10).cast("long")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n + 2).cast("long"), F.col("total")) - 1)).alias("k")
    drawn = pairs.select("a", "b").distinct().join(total).select("a", "b", "total", start.alias("start"), steps)
    drawn = drawn.select("a", "b", "k", F.pmod(F.col("start") + F.col("k"), F.col("total")).alias("place"))
    found = drawn.join(placed.select("ref", "place"), "place").where("ref <> a and ref <> b")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("k"))).where(F.col("r") <= n).select("a", "b", "ref")


def ratio_matches(neighbours: DataFrame, ratio: float) -> DataFrame:
    """``(q, matched)`` from ``(q, distance, rank)`` with ranks 1 and 2: whether the nearest is clearly nearer."""
    two = neighbours.groupBy("q").agg(F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.min(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return two.select("q", F.coalesce(F.col("d1") < ratio * F.col("d2"), F.lit(False)).alias("matched"))


def distinct_inliers(matches: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(a, b, distinct)`` from ``(a, b, keypoint, ref, matched)``: keypoints that few references have too."""
    seen = matches.groupBy("a", "b", "keypoint").agg(F.sum(F.col("matched").cast("int")).alias("seen"))
    return seen.groupBy("a", "b").agg(F.sum((F.col("seen") < config.template_matches).cast("long")).alias("distinct"))


def set_aside(pairs: DataFrame, distinct: DataFrame, photos: int, config: AuditConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(kept, look_alikes)``; below the least number of photos nothing is set aside."""
    told = pairs.join(distinct, ["a", "b"], "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    if photos < config.least_photos_for_templates:
        return pairs, told.where(F.lit(False))
    enough = F.col("distinct") >= config.least_distinct
    return told.where(enough).select(*pairs.columns), told.where(~enough)
