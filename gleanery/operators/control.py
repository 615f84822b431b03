"""The upload service's rules, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import PHOTO_TYPES, local_name, owner_of, valid_session

MAX_PHOTOS, MAX_LABELS, MAX_KEPT = 20, 20, 20
LABEL_TYPES = ("text/plain", "text/xml", "application/json")
SPLITS = ("train", "test", "labels")
#: Days that objects stay, by the prefix of their keys.
LIFETIMES = {"uploads/": 1, "saved/": 30, "results/sessions/": 30, "scan-log/": 90}


def upload_errors(requests: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``(request, error)`` from ``(request, files array<struct<name,type,split>>, keep, guest)``; null if it is fine."""
    files = F.col("files")
    labels = F.size(F.filter(files, lambda f: f["split"].eqNullSafe("labels")))
    n = F.size(files)
    pick = F.lit(f"Pick between 1 and {MAX_PHOTOS} photos.")
    bad_label = F.exists(files, lambda f: f["split"].eqNullSafe("labels") & ~F.coalesce(f["type"].isin(*LABEL_TYPES), F.lit(False)))
    bad_photo = F.exists(files, lambda f: ~f["split"].eqNullSafe("labels") & ~F.coalesce(f["type"].isin(*PHOTO_TYPES), F.lit(False)))
    bad_split = F.exists(files, lambda f: f["split"].isNotNull() & ~f["split"].isin(*SPLITS))
    owner = owner_of(F.col("guest"))
    rows = requests.withColumn("_owner", owner)
    rows = rows.join(kept.groupBy(F.col("owner").alias("_owner")).agg(F.countDistinct("session").alias("_kept")), "_owner", "left") if kept is not None else rows.withColumn("_kept", F.lit(0))
    wants = F.coalesce(F.col("keep"), F.lit(False))
    error = (
        F.when(files.isNull() | (n < 1) | (n > MAX_PHOTOS + MAX_LABELS), pick)
        .when((n - labels < 1) | (n - labels > MAX_PHOTOS), pick)
        .when(labels > MAX_LABELS, F.lit(f"Pick at most {MAX_LABELS} label files."))
        .when(wants & F.col("_owner").isNull(), F.lit("Keeping photos needs a valid guest id."))
        .when(wants & (F.coalesce("_kept", F.lit(0)) >= MAX_KEPT), F.lit(f"You're keeping {MAX_KEPT} scans already. Delete one first."))
        .when(bad_label, F.lit("Label files must be .txt, .xml or .json."))
        .when(bad_photo, F.lit("Only JPEG and PNG photos are supported."))
        .when(bad_split, F.lit("Invalid split."))
    )
    return rows.select("request", error.alias("error"))


def library(objects: DataFrame, previews: int = 3) -> DataFrame:
    """``(owner, session, photos, saved, previews)`` of kept scans, from ``(key, modified)``.

    Keys read ``saved/<owner>/<session>/<folder>/<number>/<name>``.
    """
    parts = F.split("key", "/")
    rows = objects.where(F.startswith("key", F.lit("saved/")) & (F.size(parts) == 6)).select("key", "modified", F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("session"), F.get(parts, F.lit(3)).alias("folder"))
    rows = rows.where(F.col("folder").isin("images", "test"))
    shown = F.slice(F.array_sort(F.collect_list(F.when(F.col("folder") == "images", F.col("key")))), 1, previews)
    return rows.groupBy("owner", "session").agg(F.count("*").alias("photos"), F.max("modified").alias("saved"), shown.alias("previews"))


def newest_first(scans: DataFrame) -> DataFrame:
    """Kept scans with their ``place`` in the order in which their owner sees them."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("saved"), "session")) - 1
    return scans.withColumn("place", place.cast("long")).orderBy("owner", "place")


def photo_keys(objects: DataFrame, owner: str, session: str) -> DataFrame:
    """``(photo, key)`` of a kept scan's photos, ``<folder>/<number>``; a link to each is made outside."""
    prefix = f"saved/{owner}/{session}/"
    parts = F.split(F.col("key").substr(F.lit(len(prefix) + 1), F.char_length("key")), "/")
    rows = objects.where(F.startswith("key", F.lit(prefix))).select("key", parts.alias("p")).where((F.size("p") == 3) & F.col("p")[0].isin("images", "test"))
    return rows.groupBy(F.concat_ws("/", F.col("p")[0], F.col("p")[1]).alias("photo")).agg(F.max("key").alias("key"))


def scan_manifest(objects: DataFrame, prefix: str, alias: str | None = None) -> DataFrame:
    """``(key, local)`` of the objects below a prefix that a scan reads, folders' own keys left out, and their flat local names."""
    mine = objects.where(F.startswith("key", F.lit(prefix)) & ~F.endswith("key", F.lit("/")))
    return mine.select("key", local_name(F.col("key"), F.lit(prefix), F.lit(alias).cast("string")).alias("local"))


def quota(log: DataFrame, daily: int) -> DataFrame:
    """``(day, started, full)``: scans a day from ``(day, session)``, one a session and day."""
    return log.distinct().groupBy("day").agg(F.count("*").alias("started")).withColumn("full", F.col("started") >= daily)


def new_log_entries(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(day, session)`` with a valid session that the log lacks, each once."""
    return requests.where(valid_session(F.col("session"))).distinct().join(log, ["day", "session"], "left_anti")


def retained(objects: DataFrame, now) -> DataFrame:
    """Objects ``(key, modified)`` that have not outlived their prefix's days."""
    days = F.lit(None).cast("int")
    for prefix, n in LIFETIMES.items():
        days = F.when(F.startswith("key", F.lit(prefix)), F.lit(n)).otherwise(days)
    return objects.where(days.isNull() | (F.col("modified") > F.date_sub(F.lit(now), days).cast("timestamp_ntz")))


def forgotten(objects: DataFrame, owner: str, session: str) -> DataFrame:
    """The objects that a guest's request to forget a scan removes."""
    return objects.where(F.startswith("key", F.lit(f"saved/{owner}/{session}/")))
