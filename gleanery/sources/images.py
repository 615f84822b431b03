"""Image files, their bytes and their pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions.names import base_name


def key_of(path: Column, split: str | None) -> Column:
    """What names a photo throughout: its split and its name in the split's folder, so that equal names in two folders differ."""
    return base_name(path) if split is None else F.concat(F.lit(f"{split}/"), base_name(path))


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...], split: str | None = None) -> DataFrame:
    """``(path, name, length, content)`` of a folder's own files with one of the suffixes, whatever their case."""
    every = "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", every).option("ignoreMissingFiles", "true").load(folder)
    return files.select("path", key_of(F.col("path"), split).alias("name"), "length", "content")


def list_images(spark: SparkSession, folder: str, config: AuditConfig = DEFAULT, split: str | None = None) -> DataFrame:
    return list_files(spark, folder, config.image_suffixes, split)


def list_label_files(spark: SparkSession, folder: str, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(path, name, file, text, error)``: label files without those that are none; ones too large are not read."""
    files = list_files(spark, folder, config.label_suffixes)
    files = files.where(~F.lower("name").isin(*config.not_labels))
    large = F.col("length") > config.max_label_bytes
    text = F.when(~large, F.decode("content", "UTF-8"))
    return files.select("path", "name", F.col("name").alias("file"), text.alias("text"), F.when(large, F.lit("file is too large to check")).alias("error"))


def pixels(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """``(name, height, width, channels, data)`` of decoded images; what can't be decoded has a height of -1."""
    read = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", "*.[pPjJ][nNpP]*[gG]").load(folder)
    i = F.col("image")
    return read.select(key_of(i["origin"], split).alias("name"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))
