"""From a scan to decisions: findings, review, quarantine, and a result that is always written."""

from __future__ import annotations

import datetime
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, AuditConfig
from ..operators import findings as fd
from ..operators.review import Reviewer, RuleReviewer, decide
from ..sources.tables import write_text

#: Where a report's tables go: their kind of finding, and what a row says.
TABLES = {
    "leaked_pairs": ("train_test_leak", ("distance",)),
    "similar_leaks": ("train_test_leak_edited_copy", ("similarity", "inliers")),
    "duplicate_pairs": ("duplicate", ("distance",)),
    "similar_pairs": ("edited_copy", ("similarity", "inliers")),
    "blurry_images": ("blurry", ("sharpness",)),
    "risky_orientation_images": ("risky_exif", ("orientation", "swaps_dimensions")),
}


def findings_of(report: dict) -> DataFrame | None:
    """A scan's findings as one table; pairs carry the share of the photo that their matches cover."""
    tables = {}
    for key, (kind, fields) in TABLES.items():
        df = report.get(key)
        if df is None:
            continue
        files = F.array("a", "b") if "a" in df.columns else F.array("name")
        extra = [F.col("inliers").alias("matching_keypoints") if f == "inliers" else F.col(f) for f in fields]
        if "box_a" in df.columns:
            covered = lambda box: (F.col(box)[2] - F.col(box)[0]) * (F.col(box)[3] - F.col(box)[1])
            extra.append(F.least(covered("box_a"), covered("box_b")).alias("coverage"))
        tables[kind] = df.select(F.xxhash64(files).alias("_h"), files.alias("files"), *extra).withColumn("seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("files"))).drop("_h")
    return fd.findings(tables) if tables else None


def decided(report: dict, reviewer: Reviewer | None = None, config: AuditConfig = DEFAULT) -> dict:
    """The report with ``findings``, ``decisions``, ``truncated`` and ``agent_error``.

    Whatever goes wrong in the review, the scan's own tables stand: the
    decisions are then missing and ``agent_error`` is set.
    """
    found = findings_of(report)
    out = dict(report) | {"findings": found, "decisions": None, "truncated": False, "agent_error": False}
    if found is None:
        return out
    out["truncated"] = found.limit(config.max_findings + 1).count() > config.max_findings
    try:
        told = decide(found, reviewer or RuleReviewer(config), config).persist()
        told.count()
        out["decisions"] = told
    except Exception as e:  # a reviewer may be anything
        out["agent_error"] = True
        print(f"the review failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    return out


def as_json(report: dict, rows: int = 1000) -> str:
    """A report for reading: at most so many rows of each table (the tables themselves are written whole elsewhere)."""
    plain = {k: [json.loads(r.j) for r in v.limit(rows).select(F.to_json(F.struct(*[c for c in v.columns if c not in ("keypoints",)])).alias("j")).collect()] if isinstance(v, DataFrame) else v for k, v in report.items()}
    return json.dumps(plain, default=str)


def result_paths(session: str | None, now: datetime.datetime) -> list[str]:
    """A session's own result, or one by time and the latest one."""
    return [f"results/sessions/{session}.json"] if session else [f"results/{now:%Y%m%dT%H%M%SZ}.json", "results/latest.json"]


def run_session(spark: SparkSession, scan: Callable[[], dict], root: str, session: str | None = None, reviewer: Reviewer | None = None, config: AuditConfig = DEFAULT, now: datetime.datetime | None = None) -> dict:
    """Scans, decides and writes the result under ``root``; a session whose scan fails gets a marker, and the error goes on."""
    paths = result_paths(session, now or datetime.datetime.now(datetime.timezone.utc))
    try:
        report = decided(scan(), reviewer, config)
        body = as_json(report)
    except Exception:
        if session:
            write_text(spark, json.dumps({"error": "scan failed"}), f"{root}/{paths[0]}")
        raise
    for path in paths:
        write_text(spark, body, f"{root}/{path}")
    return report
