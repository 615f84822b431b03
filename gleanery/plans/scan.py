"""The whole audit of a training folder, as tables."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from ..functions.boxes import risky_orientation, swaps_dimensions
from ..functions.markers import ai_marker, bytes_as_text, stock_marker
from ..operators import bursts, labels, overlay, pairs, pixels, shift, templates, verify
from ..sources import exif, images


class Audit:
    """``scan`` returns a dict of DataFrames (``shift`` is a dict); keys follow what was given.

    A photo is named by its split and file name (``train/a.png``), so that folders
    may share names.  The per-image measures and keypoints are computed once and kept (``work`` names a shared
    folder; without one they are persisted).  Checks that only report are run
    inside a guard, so that one that fails leaves its fallback and the rest stands.
    """

    def __init__(self, spark: SparkSession, config: AuditConfig = DEFAULT, embed: Callable = pixels.small_embedding, work: str | None = None):
        self.spark, self.config, self.embed, self.work = spark, config, embed, work
        self.failures: dict[str, str] = {}

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.work is None:
            return df.persist()
        df.write.mode("overwrite").parquet(f"{self.work}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.work}/{name}")

    def _advisory(self, name: str, check: Callable, fallback):
        """The check's result, forced here, or the fallback if it fails."""
        try:
            found = check()
            if isinstance(found, DataFrame):
                found = self._keep(found, name)
                found.count()
            return found
        except Exception as e:  # whatever is wrong with visitors' files
            self.failures[name] = f"{type(e).__name__}: {e}"
            print(f"{name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            return fallback

    def _load(self, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
        raw = self._keep(pixels.measured(images.pixels(self.spark, folder, split), self.config, self.embed), f"measures-{split}")
        files = images.list_images(self.spark, folder, self.config, split)
        text = bytes_as_text(F.col("content"), self.config.max_read_bytes)
        facts = exif.with_exif(files).select("name", "orientation", "camera", "taken_us", ai_marker(text).alias("ai"), stock_marker(text).alias("stock"))
        return raw, self._keep(facts, f"facts-{split}")

    def _near(self, left: DataFrame, right: DataFrame | None, name: str) -> DataFrame:
        """Pairs whose embeddings are alike enough to look at."""
        ids = lambda df: None if df is None else df.select(F.col("name").alias("id"), "v")
        return self._keep(pairs.cosine_join(ids(left), ids(right), self.config.candidate_similarity), f"near-{name}")

    def _hashes(self, left: DataFrame, right: DataFrame | None, name: str) -> DataFrame:
        """Pairs whose hashes are close."""
        cut = lambda df: None if df is None else df.select(F.col("name").alias("id"), "hash")
        return self._keep(pairs.hamming_join(cut(left), cut(right), self.config.hash_distance, bits=256), f"hashes-{name}")

    def _features(self, pixels_of: DataFrame, names: DataFrame, name: str) -> DataFrame:
        """The features of the photos in ``names(name)``: two detections each, whatever the number of pairs they are in."""
        return self._keep(verify.feature_table(pixels_of.join(names.distinct(), "name", "left_semi")), name)

    def _similar(self, near: DataFrame, known: DataFrame, features: DataFrame, name: str) -> DataFrame:
        candidates = pairs.minus_pairs(near, known).withColumn("similarity", F.round("similarity", 3))
        return self._keep(verify.verified(candidates, features, self.config).where(F.col("inliers") >= self.config.least_inliers), name)

    def _hashed(self, found: DataFrame, features: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
        c = self.config
        told = verify.verified(found, features, c).select("a", "b", F.col("inliers").alias("points"), "fixed_camera")
        va, vb = vectors.toDF("a", "va"), vectors.toDF("b", "vb")
        sims = found.join(va, "a").join(vb, "b").select("a", "b", F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("similarity"))
        return self._keep(pairs.confirm_hash_pairs(found, sims, told, c.confirm_similarity, c.confirm_points), name)

    def _split_templates(self, found: DataFrame, photos: DataFrame, pixels_of: DataFrame, features: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        n = photos.count()
        told = found.select("a", "b", "similarity", "inliers", "box_a", "box_b")
        if n < self.config.least_photos_for_templates:
            return told, told.withColumn("distinct", F.lit(0).cast("long")).where(F.lit(False))
        refs = self._keep(templates.reference_sample(found, photos, self.config.template_references), f"references-{name}")
        more = refs.select(F.col("ref").alias("name")).join(features.select("name"), "name", "left_anti")
        both = features.union(self._features(pixels_of, more, f"reference-features-{name}"))
        seen = verify.seen_in_references(found, refs, both, self.config)
        distinct = self._keep(templates.distinct_inliers(seen, self.config), f"distinct-{name}")
        return templates.set_aside(told, distinct, n, self.config)

    def scan(self, train: str, test: str | None = None, label_folder: str | None = None) -> dict:
        c = self.config
        measures, facts = self._load(train, "train")
        good = measures.where("ok")
        pixels_of = images.pixels(self.spark, train, "train").where("height > 0")
        vectors = good.select("name", "v")
        result: dict = {}
        test_good = test_facts = None
        if test:
            test_measures, test_facts = self._load(test, "test")
            test_good = test_measures.where("ok")
            pixels_of = pixels_of.union(images.pixels(self.spark, test, "test").where("height > 0"))
            vectors = vectors.union(test_good.select("name", "v"))
        splits = {"pairs": (None, "duplicate_pairs", "similar_pairs")} | ({"leaks": (test_good, "leaked_pairs", "similar_leaks")} if test else {})
        close = {k: self._hashes(good, other, k) for k, (other, _, _) in splits.items()}
        near = {k: self._near(good, other, k) for k, (other, _, _) in splits.items()}
        seen = [df.select(F.explode(F.array("a", "b")).alias("name")) for df in (*close.values(), *near.values())]
        features = self._features(pixels_of, reduce(DataFrame.union, seen), "features")
        readable = facts.join(good.select("name"), "name", "left_semi")
        result["duplicate_pairs"] = self._hashed(close["pairs"], features, vectors, "duplicate_pairs")
        result["blurry_images"] = good.where(F.col("sharpness") <= c.blur_limit).select("name", "sharpness")
        result["risky_orientation_images"] = readable.where(risky_orientation(F.col("orientation"))).select("name", "orientation", swaps_dimensions(F.col("orientation")).alias("swaps_dimensions"))
        result["unreadable_images"] = measures.where("not ok").select("name", F.lit("the image cannot be decoded").alias("error"))
        photos = vectors.select(F.col("name").alias("id"))
        aside = []
        for key, (_, hashed, similar) in splits.items():
            if hashed not in result:
                result[hashed] = self._hashed(close[key], features, vectors, hashed)
            found = self._similar(near[key], result[hashed], features, similar)
            fallback = (found.drop("keypoints", "fixed_camera"), None)
            result[similar], look = self._advisory(f"templates of {key}", partial(self._split_templates, found, photos, pixels_of, features, key), fallback)
            aside.append((look, "leak" if key == "leaks" else "duplicate"))
        if test:
            ids = lambda df: df.select(F.col("name").alias("id"), "v")
            result["shift"] = self._advisory("shift", lambda: shift.check_shift(ids(good), ids(test_good), c), None)
        empty = self.spark.createDataFrame([], "a string, b string, similarity double, inliers long, box_a array<double>, box_b array<double>, distinct long, kind string")
        for look, kind in aside:
            if look is not None:
                empty = empty.unionByName(look.withColumn("kind", F.lit(kind)))
        result["template_matches"] = empty
        known = None
        for key in ("duplicate_pairs", "similar_pairs", "leaked_pairs", "similar_leaks"):
            if key in result:
                part = result[key].select("a", "b")
                known = part if known is None else known.union(part)
        every = readable.withColumn("is_test", F.lit(False))
        if test:
            every = every.union(test_facts.withColumn("is_test", F.lit(True)))
        shots = every.where("camera is not null").select("camera", "taken_us", F.col("name").alias("file"), "is_test")
        result["bursts"] = self._advisory("bursts", lambda: bursts.find_bursts(shots, known, c, c.burst_groups), None)
        rasters = good if not test else good.union(test_good)
        flat = rasters.select("shape", F.col("name").alias("id"), F.col("eh").alias("height"), F.col("ew").alias("width"), "gx", "gy")
        result["overlays"] = self._advisory("overlays", lambda: overlay.find_overlays(flat, c), None)
        declared = every.join(vectors.select("name"), "name", "left_semi")
        result["ai_generated_images"] = declared.where("ai is not null").select("name", "ai")
        result["stock_images"] = declared.where("stock is not null").select("name", "stock")
        if label_folder:
            sizes = pixels_of.select(F.col("name").alias("photo"), F.col("width").alias("aw"), F.col("height").alias("ah"))
            told = sizes.join(every.select(F.col("name").alias("photo"), "orientation"), "photo")
            fallback = self.spark.createDataFrame([(label_folder, "unreadable", "the label check failed on these files")], "subject string, kind string, detail string")
            result["label_problems"] = self._advisory("labels", lambda: check_labels(told, images.list_label_files(self.spark, label_folder, c), c), fallback)
        return result


def check_labels(photos: DataFrame, files: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(subject, kind, detail)`` for ``photos(photo, aw, ah, orientation)`` and label files ``(file, text, error)``."""
    readable = files.where("error is null")
    kind = lambda ext: readable.where(F.lower("file").endswith(ext)).select("file", "text")
    none = F.lit(None)
    # One line a box and text file.
    yolo = labels.parse_yolo(kind(".txt"))
    owners = labels.photo_for(kind(".txt").select("file", none.cast("string").alias("file_name")), photos.select("photo"))
    bad = labels.malformed_lines(yolo).join(owners, "file").where("photo is not null")
    malformed = bad.select(F.col("photo").alias("subject"), F.lit("malformed").alias("kind"), F.format_string("%d lines aren't 'class x y w h' (first: line %d)", "bad", "first_bad").alias("detail"))
    size = photos.select("photo", F.col("aw").alias("fw"), F.col("ah").alias("fh"))
    yolo_boxes = yolo.where("not malformed").join(owners.where("photo is not null").select("file", "photo"), "file").join(size, "photo").select("file", "photo", "box_no", F.col("cls").cast("string").alias("cls"), "x1", "y1", "x2", "y2", "fw", "fh")
    # XML and JSON state frames of their own and boxes in pixels.
    voc = labels.parse_voc(kind(".xml"))
    xml = labels.photo_for(voc.where("not unreadable"), photos.select("photo"))
    coco = labels.parse_coco(kind(".json")).withColumn("_listed", F.lit(1))
    unique = labels.unique_photos(photos.select("photo"))
    from ..functions.names import stem

    listed = coco.withColumn("stem", stem(F.col("file_name"))).join(unique, "stem", "left")
    lost = listed.groupBy("file").agg(F.count_if(F.col("photo").isNull()).alias("lost"), F.count("*").alias("n")).where("lost > 0")
    coco_orphans = lost.select(F.col("file").alias("subject"), F.lit("orphan").alias("kind"), F.format_string("%d of the %d images it lists aren't among the photos", "lost", "n").alias("detail"))
    cut = ["file", "photo", "width", "height", "boxes"]
    framed = xml.where("photo is not null").select(*cut[:4], F.transform("boxes", lambda b: F.struct(b["no"].cast("int").alias("no"), b["cls"].cast("string").alias("cls"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"))).alias("boxes"))
    framed = framed.union(listed.where("photo is not null").select(*cut))
    declared = (F.col("width") > 0) & (F.col("height") > 0)
    framed = framed.join(photos, "photo").withColumn("fw", F.when(declared, F.col("width")).otherwise(F.col("aw"))).withColumn("fh", F.when(declared, F.col("height")).otherwise(F.col("ah")))
    sizes = labels.size_problems(framed.where(declared).select("photo", F.col("width").alias("dw"), F.col("height").alias("dh"), "aw", "ah", "orientation"))
    boxes = framed.select("file", "photo", "fw", "fh", F.inline("boxes")).select("file", "photo", (F.col("no") + 1).cast("long").alias("box_no"), "cls", (F.col("x1") / F.col("fw")).alias("x1"), (F.col("y1") / F.col("fh")).alias("y1"), (F.col("x2") / F.col("fw")).alias("x2"), (F.col("y2") / F.col("fh")).alias("y2"), "fw", "fh")
    problems = labels.problem_rows(labels.box_problems(yolo_boxes.unionByName(boxes), config))
    refused = voc.where("unreadable").select(F.col("file").alias("subject"), F.lit("unreadable").alias("kind"), F.lit("couldn't be read as a label file").alias("detail"))
    too_large = files.where("error is not null").select(F.col("file").alias("subject"), F.lit("unreadable").alias("kind"), F.concat(F.lit("couldn't be read as a label file ("), "error", F.lit(")")).alias("detail"))
    labeled = owners.select("photo").union(framed.select("photo"))
    parts = [malformed, labels.orphans(owners), labels.orphans(xml), coco_orphans, sizes, problems, refused, too_large, labels.missing_labels(photos.select("photo"), labeled, config)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
