"""Photos that one camera took within moments of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, AuditConfig
from .pairs import canonical


def runs(shots: DataFrame, gap_seconds: float) -> DataFrame:
    """``shots(camera, taken_us, file)`` with ``run``: a new one begins after more than the gap."""
    w = Window.partitionBy("camera").orderBy("taken_us", "file")
    new = F.when(F.col("taken_us") - F.lag("taken_us").over(w) <= int(gap_seconds * 1_000_000), 0).otherwise(1)
    return shots.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def find_bursts(shots: DataFrame, known: DataFrame | None = None, config: AuditConfig = DEFAULT, limit: int | None = None) -> DataFrame:
    """``(camera, run, files, test_files, n, span)`` of runs of two or more.

    ``shots`` also has ``is_test``.  A run whose pairs of files are all among
    ``known(a, b)`` is left out.  Known pairs inside a run are counted against
    the number of pairs it has; its pairs are never listed.
    """
    all_runs = runs(shots, config.burst_gap_seconds)
    span = F.round((F.max("taken_us") - F.min("taken_us")) / 1_000_000, 1)
    ordered = F.array_sort(F.collect_list(F.struct("taken_us", "file", "is_test")))
    groups = all_runs.groupBy("camera", "run").agg(ordered.alias("_all"), F.count("*").alias("n"), span.alias("span")).where("n >= 2")
    if known is not None:
        at = all_runs.select("camera", "run", "file")
        a, b = at.toDF("ca", "ra", "a"), at.toDF("cb", "rb", "b")
        inside = canonical(known.select("a", "b")).distinct().join(a, "a").join(b, "b").where("ca = cb and ra = rb and a <> b")
        counts = inside.groupBy(F.col("ca").alias("camera"), F.col("ra").alias("run")).agg(F.count("*").alias("_known"))
        groups = groups.join(counts, ["camera", "run"], "left").where("2 * coalesce(_known, 0) < n * (n - 1)").drop("_known")
    files = F.transform("_all", lambda s: s["file"])
    tests = F.transform(F.filter("_all", lambda s: s["is_test"]), lambda s: s["file"])
    out = groups.select("camera", "run", files.alias("files"), tests.alias("test_files"), "n", "span")
    return out if limit is None else out.orderBy(F.desc("n"), "camera", "run").limit(limit)
