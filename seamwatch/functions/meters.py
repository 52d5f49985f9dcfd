"""Meter expressions: circular angles, pointer status, segments, confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions.text import lookup


def circular_distance(a: Column, b: Column) -> Column:
    """Shortest distance between two angles in degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def pointer_status(
    angle: Column, reference: Column, tolerance: Column, confidence: Column,
    min_confidence: Column | float = K.POINTER_MIN_CONFIDENCE,
) -> Column:
    """Pointer verdict struct; rows with a tolerance of zero or less get an error status."""
    floor = min_confidence if isinstance(min_confidence, Column) else F.lit(min_confidence)
    unsure = angle.isNull() | (confidence < floor)
    delta = circular_distance(angle, reference)
    bad = ~unsure & (tolerance <= 0)
    near = delta <= tolerance
    return F.struct(
        F.when(unsure, "uncertain").when(bad, "invalid").when(near, "normal").otherwise("abnormal").alias("status"),
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 6).alias("confidence"),
        F.bround(angle, 4).alias("angle_deg"),
        F.bround(reference, 4).alias("reference_angle_deg"),
        F.when(~unsure & ~bad, F.bround(delta, 4)).alias("delta_deg"),
        F.when(unsure, "pointer_not_reliably_detected")
        .when(bad, "tolerance_deg must be positive")
        .when(near, "pointer_angle_within_tolerance")
        .otherwise("pointer_angle_delta_exceeds_tolerance")
        .alias("reason"),
    )


def segments_to_digit(active: Column) -> Column:
    """Lit segment names (any order, repeats allowed) -> digit text, null when unknown."""
    return lookup(K.SEGMENT_DIGITS, F.array_join(F.array_sort(F.array_distinct(active)), ""))


def meter_text(digits: Column, decimal_places: Column, negative: Column) -> Column:
    """Digits -> reading text with point and sign; null for an impossible point position."""
    size = F.length(digits)
    places = decimal_places
    body = F.when(places == 0, digits).otherwise(
        F.concat(
            F.substr(digits, F.lit(1), size - places), F.lit("."),
            F.substr(digits, size - places + 1, places),
        )
    )
    usable = (size > 0) & (places >= 0) & (places < size)
    return F.when(usable, F.concat(F.when(negative, "-").otherwise(""), body))


def normal_confidence(value: Column) -> Column:
    """Number in [0, 1] rounded to 6 places, else null."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), F.bround(number, 6))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
