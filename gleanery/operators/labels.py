"""Checks of box labels against the photos they should describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, AuditConfig
from ..functions.boxes import iou, size_problem
from ..functions.names import display_name, stem


def parse_yolo(files: DataFrame) -> DataFrame:
    """``(file, line, box_no, cls, x1, y1, x2, y2, malformed)``: a row for each line with text of ``files(file, text)``.

    A line of 4 or 5 values behind its class is a centre box, an even number of
    6 or more a polygon, whose extent counts; the rest is malformed, as are
    classes that are no number or, cut to a whole one, negative.
    """
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("at", "line_text"))
    parts = F.filter(F.split(F.btrim("line_text", F.lit(" \t\f\v")), r"\s+", -1), lambda s: s != "")
    told = lines.select("file", (F.col("at") + 1).cast("long").alias("line"), parts.alias("parts")).where(F.size("parts") > 0)
    values = F.transform("parts", lambda s: s.try_cast("double"))
    v = told.select("file", "line", values.alias("v"), F.size("parts").alias("n"))
    rest = F.slice("v", 2, F.greatest(F.col("n") - 1, F.lit(0)))
    numbers = ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    cls = F.element_at("v", 1)
    box, polygon = F.col("n").isin(5, 6), (F.col("n") >= 7) & (F.col("n") % 2 == 1)
    good = numbers & (cls > -1) & (box | polygon)
    x, y, w, h = (F.get("v", F.lit(k)) for k in range(1, 5))
    even = F.filter(rest, lambda _, i: i % 2 == 0)
    odd = F.filter(rest, lambda _, i: i % 2 == 1)
    pick = lambda a, b: F.when(~good, F.lit(None)).when(box, a).otherwise(b)
    out = v.select(
        "file", "line", F.when(good, cls).cast("long").alias("cls"),
        pick(x - w / 2, F.array_min(even)).alias("x1"), pick(y - h / 2, F.array_min(odd)).alias("y1"),
        pick(x + w / 2, F.array_max(even)).alias("x2"), pick(y + h / 2, F.array_max(odd)).alias("y2"),
        (~good).alias("malformed"),
    )
    number = F.row_number().over(Window.partitionBy("file").orderBy("malformed", "line"))
    return out.withColumn("box_no", F.when(~F.col("malformed"), number).cast("long"))


def malformed_lines(parsed: DataFrame) -> DataFrame:
    """``(file, bad, first_bad)`` of files with malformed lines."""
    return parsed.where("malformed").groupBy("file").agg(F.count("*").alias("bad"), F.min("line").alias("first_bad"))


def parse_coco(files: DataFrame) -> DataFrame:
    """``(file, image_id, file_name, width, height, boxes)`` of the images that JSON label files list."""
    schema = "images array<struct<id:string,file_name:string,width:int,height:int>>, annotations array<struct<image_id:string,category_id:string,bbox:array<double>>>"
    told = files.select("file", F.from_json("text", schema).alias("j"))
    images = told.select("file", F.explode("j.images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    notes = told.select("file", F.posexplode("j.annotations").alias("no", "a"))
    b = F.col("a.bbox")
    one = F.struct("no", F.col("a.category_id").alias("cls"), b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))
    boxes = notes.groupBy("file", F.col("a.image_id").alias("image_id")).agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    return images.join(boxes, ["file", "image_id"], "left")


def parse_voc(files: DataFrame) -> DataFrame:
    """``(file, file_name, width, height, boxes)`` of XML label files; ones with a DOCTYPE or entities are refused (null)."""
    safe = ~F.lower("text").contains("<!doctype") & ~F.lower("text").contains("<!entity")
    schema = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    told = files.select("file", F.when(safe, F.from_xml("text", schema)).alias("x"))
    box = lambda o, i: F.struct(i.alias("no"), o["name"].alias("cls"), o["bndbox"]["xmin"].alias("x1"), o["bndbox"]["ymin"].alias("y1"), o["bndbox"]["xmax"].alias("x2"), o["bndbox"]["ymax"].alias("y2"))
    return told.select("file", F.col("x.filename").alias("file_name"), F.col("x.size.width").alias("width"), F.col("x.size.height").alias("height"), F.transform("x.object", box).alias("boxes"), F.col("x").isNull().alias("unreadable"))


def unique_photos(photos: DataFrame) -> DataFrame:
    """``(stem, photo)`` of stems that a single one of ``photos(photo)`` has."""
    stems = photos.groupBy(stem(display_name(F.col("photo"))).alias("stem"))
    return stems.agg(F.count("*").alias("n"), F.first("photo").alias("photo")).where("n = 1").drop("n")


def photo_for(labels: DataFrame, photos: DataFrame) -> DataFrame:
    """``labels(file, file_name)`` with ``photo``: by the label file's own stem, else by the name it states."""
    unique = unique_photos(photos)
    named = labels.withColumn("_own", stem(display_name(F.col("file")))).withColumn("_told", stem(F.col("file_name")))
    first = named.join(unique.toDF("_own", "_p1"), "_own", "left").join(unique.toDF("_told", "_p2"), "_told", "left")
    return first.withColumn("photo", F.coalesce("_p1", "_p2")).drop("_own", "_told", "_p1", "_p2")


def box_problems(boxes: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(file, photo, total, outside, empty, repeated)`` from ``(file, photo, box_no, cls, x1..y2, fw, fh)`` fractions.

    ``fw, fh`` is the frame in pixels. Boxes beyond the limit on boxes a photo
    are not looked at. A box repeats if an earlier one that is not empty has its
    class and place; candidates share a class and are found by an equi-join.
    """
    seen = boxes.where(F.col("box_no") <= config.boxes_per_photo)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    empty = (w < 1e-9) | (h < 1e-9) | (w * F.col("fw") < 1) | (h * F.col("fh") < 1)
    tol = config.outside_tolerance
    outside = (F.least("x1", "y1") < -tol) | (F.greatest("x2", "y2") > 1 + tol)
    told = seen.withColumn("is_empty", empty).withColumn("is_outside", ~empty & outside)
    repeats = repeated_boxes(told.where("not is_empty"), config).withColumn("is_repeated", F.lit(True))
    full = told.join(repeats, ["file", "photo", "box_no"], "left")
    return full.groupBy("file", "photo").agg(
        F.count("*").alias("total"), F.count_if("is_outside").alias("outside"), F.count_if("is_empty").alias("empty"), F.count_if(F.coalesce("is_repeated", F.lit(False))).alias("repeated")
    )


def repeated_boxes(boxes: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(file, photo, box_no)`` of boxes that an earlier one of their photo and class covers."""
    keep = ["file", "photo", "cls", "box_no", F.struct("x1", "y1", "x2", "y2").alias("b")]
    x, y = boxes.select(*keep).alias("x"), boxes.select(*keep).alias("y")
    same = F.col("x.file").eqNullSafe(F.col("y.file")) & (F.col("x.photo") == F.col("y.photo")) & F.col("x.cls").eqNullSafe(F.col("y.cls"))
    earlier = (F.col("y.box_no") < F.col("x.box_no")) & (iou(F.col("x.b"), F.col("y.b")) >= config.repeated_iou)
    return x.join(y, same & earlier, "left_semi").select("file", "photo", "box_no")


def problem_rows(counts: DataFrame) -> DataFrame:
    """``(subject, kind, detail)`` from the counts of :func:`box_problems`."""
    say = {
        "outside": "%d of %d boxes extend outside the photo",
        "empty": "%d of %d boxes have no area",
        "repeated": "%d of %d boxes repeat another box (same class, same place)",
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("c"), F.format_string(text, F.col(k), F.col("total")).alias("detail")) for k, text in say.items()])
    return counts.select(F.col("photo").alias("subject"), F.inline(rows)).where("c > 0").drop("c")


def size_problems(declared: DataFrame) -> DataFrame:
    """``(subject, kind, detail)`` from ``(photo, dw, dh, aw, ah, orientation)``; sizes of 0 are not declared."""
    told = declared.where("least(dw, dh) > 0")
    detail = size_problem(*[F.col(c) for c in ("dw", "dh", "aw", "ah", "orientation")])
    return told.select(F.col("photo").alias("subject"), F.lit("size").alias("kind"), detail.alias("detail")).where("detail is not null")


def orphans(labels: DataFrame) -> DataFrame:
    """Problem rows of label files without a photo."""
    return labels.where("photo is null").select(F.col("file").alias("subject"), F.lit("orphan").alias("kind"), F.lit("no photo has this label file's name").alias("detail"))


def missing_labels(photos: DataFrame, labeled: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """The first photos, in order, without a label; none if nothing is labeled."""
    known = labeled.select("photo").where("photo is not null").distinct()
    some = known.limit(1).select(F.lit(True).alias("any"))
    rows = photos.join(known, "photo", "left_anti").orderBy("photo").limit(config.missing_shown).join(F.broadcast(some))  # one row at most
    return rows.select(F.col("photo").alias("subject"), F.lit("missing").alias("kind"), F.lit("no label for this photo (fine if it has nothing to label)").alias("detail"))
