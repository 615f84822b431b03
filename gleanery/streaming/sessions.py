"""Streaming twins: sessions with watermarks, and scans of folders as they fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def burst_sessions(shots: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """``(camera, began, n, span)`` of each camera's sessions of ``shots(camera, taken timestamp)``; a gap of just ``gap`` stays in."""
    own = shots.withWatermark("taken", late).groupBy("camera", F.session_window("taken", gap))
    out = own.agg(F.count("*").alias("n"), F.min("taken").alias("began"), F.max("taken").alias("ended"))
    return out.where("n >= 2").select("camera", "began", "n", (F.unix_micros("ended") - F.unix_micros("began")).alias("span_us"))


def scan_new_files(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*.[pPjJ][nNpP]*[gG]"):
    """Hands files that no earlier run has seen to ``handle(files, batch)``, once, and stops when there are no more."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).load(folder)
    query = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
