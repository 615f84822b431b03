"""Findings, what of them to review, and what becomes of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, AuditConfig

#: Kinds in the order in which they are listed.
KINDS = ("train_test_leak", "train_test_leak_edited_copy", "duplicate", "edited_copy", "blurry", "risky_exif")
REVIEWED = ("train_test_leak_edited_copy", "edited_copy")
LEAKS = ("train_test_leak", "train_test_leak_edited_copy")
_FIELDS = {"distance": "long", "similarity": "double", "matching_keypoints": "long", "sharpness": "double", "orientation": "int", "swaps_dimensions": "boolean", "coverage": "double"}


def findings(tables: dict[str, DataFrame]) -> DataFrame:
    """The union of the kinds' tables, each with ``seq`` (its order), ``files`` and any of the fields."""
    out = None
    for rank, kind in enumerate(KINDS):
        if kind not in tables:
            continue
        df = tables[kind]
        fields = [(F.col(f) if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in _FIELDS.items()]
        rows = df.select(F.lit(rank).alias("type_rank"), F.lit(kind).alias("type"), F.col("seq").cast("long").alias("seq"), "files", *fields)
        out = rows if out is None else out.unionByName(rows)
    return out


def capped(all_findings: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """The first findings, with a number; ``truncated`` tells whether there were more."""
    some = all_findings.orderBy("type_rank", "seq").limit(config.max_findings + 1)
    w = Window.orderBy("type_rank", "seq")  # of one row more than the cap
    numbered = some.withColumn("finding", F.row_number().over(w) - 1)
    more = F.max("finding").over(Window.partitionBy()) >= config.max_findings
    return numbered.withColumn("truncated", more).where(F.col("finding") < config.max_findings)


def for_review(shown: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """Borderline pairs, leaks first, then by their inliers; none if there are many findings."""
    close = (F.col("matching_keypoints") < config.review_inliers) | F.coalesce(F.col("coverage") < config.review_coverage, F.lit(False))
    total = shown.agg(F.count("*").alias("_n"))
    rows = shown.where(F.col("type").isin(*REVIEWED) & close).join(F.broadcast(total))  # one row
    leak_first = (F.col("type") != "train_test_leak_edited_copy").cast("int")
    return rows.where(F.col("_n") <= config.review_if_at_most).drop("_n").orderBy(leak_first, "matching_keypoints", "type_rank", "seq").limit(config.review_pairs)


def removal_targets(pairs: DataFrame) -> DataFrame:
    """``pairs(type, files)`` with ``target``: of a leak the training photo (the first), else the second."""
    return pairs.withColumn("target", F.when(F.col("type").isin(*LEAKS), F.element_at("files", 1)).otherwise(F.element_at("files", 2)))


def photo_ids(shown: DataFrame) -> DataFrame:
    """``(file, image)``: short names for the files of the (capped) findings, in order."""
    files = shown.select(F.explode("files").alias("file")).distinct()
    return files.select("file", F.concat(F.lit("img"), (F.row_number().over(Window.orderBy("file")) - 1).cast("string")).alias("image"))


def resolve_verdicts(reviewed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(file, action, reason, verdict, disputed)`` of the files in reviewed pairs.

    ``reviewed(pair_no, a, b, target)`` and ``verdicts(pair_no, verdict, reason)``.
    A pair's target is quarantined whatever the verdict; a verdict other than
    ``same`` marks it disputed, until another pair confirms it.
    """
    told = reviewed.join(verdicts, "pair_no", "left")
    verdict, reason = F.coalesce("verdict", F.lit("unsure")), F.coalesce("reason", F.lit("The reviewer gave no verdict."))
    each = told.select("pair_no", "target", verdict.alias("verdict"), reason.alias("reason"), F.posexplode(F.array("a", "b")).alias("side", "file"))
    step = F.struct("pair_no", "side", (F.col("file") == F.col("target")).alias("is_target"), "verdict", "reason")
    ordered = each.groupBy("file").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    state = "struct<action:string,reason:string,verdict:string,disputed:boolean>"
    start = F.lit(None).cast(state)

    def go(acc, s):
        same = s["verdict"] == "same"
        first = F.struct(F.lit("keep").alias("action"), s["reason"].alias("reason"), s["verdict"].alias("verdict"), F.lit(False).alias("disputed")).cast(state)
        now = F.coalesce(acc, first)
        taken = F.struct(F.lit("quarantine").alias("action"), s["reason"].alias("reason"), s["verdict"].alias("verdict"), (~same).alias("disputed")).cast(state)
        return F.when(s["is_target"] & ((now["action"] != "quarantine") | same), taken).otherwise(now)

    return ordered.select("file", F.aggregate("steps", start, go).alias("d")).select("file", "d.*")


def decisions(shown_files: DataFrame, answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Answers ``(image, action, reason)`` on known files that no review settles, and the settled ones."""
    plain = answers.join(shown_files, "image").join(resolved.select("file"), "file", "left_anti")
    plain = plain.select("file", "action", "reason", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("disputed"))
    return plain.unionByName(resolved)


def quarantine_manifest(decided: DataFrame, keys: DataFrame, destination: str) -> DataFrame:
    """``(file, source, target)`` of files to copy away: decided so, and with a known key."""
    rows = decided.where("action = 'quarantine'").join(keys, "file")
    return rows.select("file", F.col("key").alias("source"), F.concat(F.lit(destination), F.element_at(F.split("key", "/"), -1)).alias("target"))


def severity(all_findings: DataFrame) -> DataFrame:
    """Findings with a rank: leaks before labels before duplicates before quality."""
    kind = F.col("type")
    rank = F.when(kind.isin(*LEAKS), 0).when(kind.isin("label_problem"), 1).when(kind.isin("duplicate", "edited_copy"), 2).otherwise(3)
    return all_findings.withColumn("severity", rank)
