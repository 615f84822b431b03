"""The review of borderline pairs: who looks, what they may ask to see, and what their word changes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, AuditConfig
from ..functions.boxes import clamped
from .findings import capped, decisions, for_review, photo_ids, removal_targets, resolve_verdicts


class Reviewer(Protocol):
    """Judges pairs, and whatever else was found; a remote one stays outside this package."""

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        """``(pair_no, verdict, reason)`` for ``pairs(pair_no, a, b, matching_keypoints, ...)``; verdicts are same, different or unsure."""

    def answers(self, shown: DataFrame, photos: DataFrame) -> DataFrame:
        """``(image, action, reason)`` for the findings ``shown``, whose files have the names in ``photos(file, image)``."""


class RuleReviewer:
    """The default: pairs with matches enough are the same, and every pair's target and leak goes."""

    def __init__(self, config: AuditConfig = DEFAULT):
        self.config = config

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        same = F.col("matching_keypoints") >= self.config.least_inliers
        return pairs.select("pair_no", F.when(same, "same").otherwise("unsure").alias("verdict"), F.format_string("%d matching keypoints", "matching_keypoints").alias("reason"))

    def answers(self, shown: DataFrame, photos: DataFrame) -> DataFrame:
        both = removal_targets(shown.where(F.size("files") == 2)).select(F.col("target").alias("file"), "type")
        first = both.groupBy("file").agg(F.min("type").alias("type"))
        return first.join(photos, "file").select("image", F.lit("quarantine").alias("action"), F.concat(F.lit("found as "), "type").alias("reason"))


def granted_zooms(requests: DataFrame, pairs: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """``requests(pair, seq, image, box)`` with ``granted``, ``error`` and the ``region`` that is shown.

    ``image`` is ``a`` or ``b``; ``box`` has ``x1, y1, x2, y2``.  A request for an
    unknown pair costs nothing.  Any other takes one from its pair's budget, and
    only then is it looked at: one with a wrong image or without a box is spent.
    """
    known = requests.join(pairs.select("pair", F.lit(True).alias("_known")).distinct(), "pair", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("pair", "_known").orderBy("seq"))
    left = known.withColumn("_left", F.lit(config.zooms_per_pair) >= nth)
    b = F.col("box")
    whole = b.isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull()
    valid = F.coalesce(F.col("image").isin("a", "b"), F.lit(False)) & whole
    error = F.when(~F.col("_known"), "unknown pair").when(~F.col("_left"), "no zooms left").when(~valid, "invalid request")
    out = left.withColumn("error", error).withColumn("granted", F.col("error").isNull())
    return out.withColumn("region", F.when(F.col("granted"), clamped(b, config))).drop("_known", "_left")


def reviewed_pairs(shown: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(pair_no, type, a, b, target, matching_keypoints)`` of the findings to look at, in their order."""
    chosen = removal_targets(for_review(shown, config))
    leak_first = (F.col("type") != "train_test_leak_edited_copy").cast("int")
    number = F.row_number().over(Window.orderBy(leak_first, "matching_keypoints", "type_rank", "seq")) - 1  # of a few pairs
    return chosen.select(number.cast("long").alias("pair_no"), "type", F.element_at("files", 1).alias("a"), F.element_at("files", 2).alias("b"), "target", "matching_keypoints")


def decide(all_findings: DataFrame, reviewer: Reviewer, config: AuditConfig = DEFAULT) -> DataFrame:
    """``(file, action, reason, verdict, disputed)``: the reviewer's answers, and the rule's for what was reviewed."""
    shown = capped(all_findings, config)
    photos, pairs = photo_ids(shown), reviewed_pairs(shown, config)
    settled = resolve_verdicts(pairs.select("pair_no", "a", "b", "target"), reviewer.verdicts(pairs))
    return decisions(photos, reviewer.answers(shown, photos), settled)
