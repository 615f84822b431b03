"""Evaluation tables and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(tables: dict[str, DataFrame], folder: str, scan: str) -> None:
    """Each table as Parquet under ``<folder>/<table>/scan=<scan>``; only this scan's partition is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/scan={scan}")


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, replaced if it is there, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_flagged(pairs: DataFrame, path: str) -> None:
    """Flagged pairs as CSV, those with the most matching points first."""
    pairs.orderBy(F.desc("inliers"), "a", "b").write.mode("overwrite").csv(path, header=True)


def class_of(path: Column) -> Column:
    """The folder that a photo is in."""
    return F.element_at(F.split(path, "/"), -2)


def ranked(hash_pairs: DataFrame, keypoint_pairs: DataFrame) -> DataFrame:
    """``(id, a, b, method, score, same_class)``: hash pairs by distance, then keypoint pairs by score."""
    from pyspark.sql.window import Window

    rows = hash_pairs.select("a", "b", F.lit("hash").alias("method"), F.col("distance").alias("score"), F.col("distance").alias("o"))
    rows = rows.union(keypoint_pairs.select("a", "b", F.lit("keypoints"), "score", -F.col("score")))
    first = F.when(F.col("method") == "hash", 0).otherwise(1)
    return rows.withColumn("id", F.row_number().over(Window.orderBy(first, "o", "a", "b")) - 1).select("id", "a", "b", "method", "score", class_of(F.col("a")).eqNullSafe(class_of(F.col("b"))).alias("same_class"))
