"""Every threshold of the audit, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds of the checks; pass a changed copy (``dataclasses.replace``) to any operator."""

    # The defaults below equal those that results are compared with.

    image_suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg")
    label_suffixes: tuple[str, ...] = (".txt", ".xml", ".json")
    not_labels: tuple[str, ...] = ("classes.txt", "labels.txt", "obj.names", "readme.txt")
    max_read_bytes: int = 16 * 1024 * 1024
    max_label_bytes: int = 2 * 1024 * 1024

    hash_distance: int = 5
    candidate_similarity: float = 0.80
    least_inliers: int = 25
    confirm_similarity: float = 0.85
    confirm_points: int = 8
    blur_limit: float = 200.0

    template_references: int = 40
    template_matches: int = 3
    least_distinct: int = 20
    least_photos_for_templates: int = 100
    ratio: float = 0.75

    shift_least: int = 5
    shift_sample: int = 200
    shift_permutations: int = 2000
    shift_alpha: float = 0.05
    shift_outliers: int = 3

    burst_gap_seconds: float = 3.0
    burst_groups: int = 20

    overlay_least_photos: int = 8
    overlay_least_carrying: int = 7
    overlay_agree: float = 0.7
    overlay_side: int = 192
    overlay_edge: float = 10.0
    overlay_area: float = 0.002
    overlay_member: float = 0.7
    overlay_sample: int = 200
    overlay_groups: int = 10
    aspect_step: float = 0.05

    boxes_per_photo: int = 500
    missing_shown: int = 10
    outside_tolerance: float = 0.01
    repeated_iou: float = 0.95

    max_findings: int = 30
    review_inliers: int = 35
    review_coverage: float = 0.25
    review_pairs: int = 2
    review_if_at_most: int = 8
    zooms_per_pair: int = 2

    thumb_side: int = 384
    zoom_side: int = 512
    least_box: float = 0.05


DEFAULT = AuditConfig()
