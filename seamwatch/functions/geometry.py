"""Bounding boxes.  A box is struct<x1,y1,x2,y2>; the helpers take and give such structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamwatch.functions.core import let

SIDES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_from_array(values: Column) -> Column:
    """Array of numbers or number texts -> box; null unless it is a valid box."""
    side = [F.get(values, F.lit(i)).cast("string").try_cast("double") for i in range(4)]
    candidate = box(*side)
    return F.when((F.size(values) == 4) & is_valid_box(candidate), candidate)


def box_error(values: Column) -> Column:
    """Why an array is no box, or null."""
    side = [F.get(values, F.lit(i)).cast("string").try_cast("double") for i in range(4)]
    missing = side[0].isNull() | side[1].isNull() | side[2].isNull() | side[3].isNull()
    return (
        F.when(values.isNull() | (F.size(values) != 4) | missing, F.lit("bbox_xyxy must contain four numbers"))
        .when(~_all_finite(*side), F.lit("bounding box values must be finite"))
        .when(
            (side[2] <= side[0]) | (side[3] <= side[1]),
            F.lit("bounding box must have positive width and height"),
        )
    )


def _all_finite(*values: Column) -> Column:
    check = F.lit(True)
    for value in values:
        check = check & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return check


def is_valid_box(b: Column) -> Column:
    """Four finite numbers with positive width and height (false on nulls)."""
    sides = [b[s] for s in SIDES]
    return F.coalesce(
        _all_finite(*sides) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), F.lit(False)
    )


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 when the boxes do not overlap."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = width * height
    return F.when(shared == 0, F.lit(0.0)).otherwise(shared / (area(a) + area(b) - shared))


def inside_image(b: Column, width: Column, height: Column) -> Column:
    return (
        (b["x1"] >= 0) & (b["x1"] < b["x2"]) & (b["x2"] <= width)
        & (b["y1"] >= 0) & (b["y1"] < b["y2"]) & (b["y2"] <= height)
    )


def _clamp(value: Column, top: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, top))


def integer_roi(b: Column, width: Column, height: Column) -> Column:
    """Outward rounded box cut to the image; null when nothing is left."""
    roi = box(
        _clamp(F.floor(b["x1"]).cast("int"), width), _clamp(F.floor(b["y1"]).cast("int"), height),
        _clamp(F.ceil(b["x2"]).cast("int"), width), _clamp(F.ceil(b["y2"]).cast("int"), height),
    )
    return F.when((roi["x2"] > roi["x1"]) & (roi["y2"] > roi["y1"]), roi)


def expand_box(b: Column, width: Column, height: Column, fraction: float) -> Column:
    """Integer box grown by max(2, round(longest side * fraction)), cut to the image."""
    longest = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    pad = F.greatest(F.lit(2), F.bround(longest * F.lit(fraction), 0).cast("int"))
    return box(
        F.greatest(F.lit(0), b["x1"] - pad), F.greatest(F.lit(0), b["y1"] - pad),
        F.least(width, b["x2"] + pad), F.least(height, b["y2"] + pad),
    )


def translate_box(b: Column, dx: Column, dy: Column) -> Column:
    return F.when(b.isNotNull(), box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy))


def area_fraction(b: Column, width: Column, height: Column) -> Column:
    return F.bround(area(b).cast("double") / (width * height), 6)


def clipped(b: Column, width: Column, height: Column) -> Column:
    """Box cut to the image as doubles; null when it falls outside."""
    w, h = width.cast("double"), height.cast("double")
    zero = F.lit(0.0)
    cut = box(
        F.least(F.greatest(b["x1"], zero), w), F.least(F.greatest(b["y1"], zero), h),
        F.least(F.greatest(b["x2"], zero), w), F.least(F.greatest(b["y2"], zero), h),
    )
    return let(cut, lambda c: F.when((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), c))


def normalized(b: Column, width: Column, height: Column) -> Column:
    """Centre and size as fractions of the image."""
    return F.struct(
        ((b["x1"] + b["x2"]) / 2.0 / width).alias("cx"),
        ((b["y1"] + b["y2"]) / 2.0 / height).alias("cy"),
        ((b["x2"] - b["x1"]) / width).alias("w"),
        ((b["y2"] - b["y1"]) / height).alias("h"),
    )


def label_line(index: Column, b: Column, width: Column, height: Column, clip: bool = True) -> Column:
    """Label text ``<class> <cx> <cy> <w> <h>``.

    With ``clip`` the box is cut to the image and printed with 8 places (null
    when nothing is left); without it the box must already lie inside and 6
    places are printed (null otherwise).
    """
    places = 8 if clip else 6
    layout = "%d " + " ".join([f"%.{places}f"] * 4)

    def text(n: Column) -> Column:
        inside = F.lit(True)
        for part in ("cx", "cy", "w", "h"):
            inside = inside & n[part].between(0.0, 1.0)
        return F.when(inside, F.format_string(layout, index, n["cx"], n["cy"], n["w"], n["h"]))

    source = clipped(b, width, height) if clip else b
    return let(let(source, lambda c: normalized(c, width, height)), text)
