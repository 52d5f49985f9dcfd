"""Image quality flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamwatch import constants as K


def metric_flags(
    width: Column, height: Column, mean: Column, dark: Column, bright: Column, edge: Column,
    readable: Column, limits: dict | None = None,
) -> Column:
    """Ordered flag array from the metrics of one image."""
    q = {**K.QC, **(limits or {})}
    flags = F.array(
        F.when(readable & ((width < q["min_width"]) | (height < q["min_height"])), "low_resolution"),
        F.when(readable & ((mean < q["dark_mean"]) | (dark >= q["dark_fraction"])), "too_dark"),
        F.when(readable & ((mean > q["bright_mean"]) | (bright >= q["bright_fraction"])), "too_bright"),
        F.when(readable & (edge < q["edge_variance"]), "possibly_blurry"),
        F.when(~readable, "unreadable_image"),
    )
    return F.array_compact(flags)


def all_flags(metric: Column, exact: Column, near: Column, no_metadata: Column, no_pose: Column) -> Column:
    """Metric flags followed by duplicate and metadata flags, in the reporting order."""
    rest = F.array(
        F.when(exact, "exact_duplicate"),
        F.when(near & ~exact, "near_duplicate"),
        F.when(no_metadata, "metadata_missing"),
        F.when(no_pose, "pose_missing"),
    )
    return F.concat(metric, F.array_compact(rest))


def image_payload_error(content: Column, max_bytes: int = K.MAX_IMAGE_BYTES) -> Column:
    """Size and signature check of an image payload, null when acceptable."""
    head = F.hex(F.substring(content, 1, 8))
    known = head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | head.startswith("424D")
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), F.lit("uploaded image is empty"))
        .when(size > max_bytes, F.lit(f"uploaded image exceeds {max_bytes} bytes"))
        .when(~known, F.lit("uploaded file is not a supported JPEG, PNG or BMP image"))
    )
