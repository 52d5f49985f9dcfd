"""Thermal frames as arrays: all expressions stay inside the row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions.core import let


def frame_error(values: Column, pixels: int) -> Column:
    """Why a frame is unusable, or null."""
    finite = F.forall(
        values, lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    )
    return (
        F.when(values.isNull() | (F.size(values) != pixels), F.concat(
            F.lit(f"frame must hold {pixels} pixels, got "), F.coalesce(F.size(values), F.lit(0)).cast("string")))
        .when(~finite, F.lit("frame may only hold finite values"))
    )


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, t: total + t) / F.size(values)


def array_percentile(values: Column, fraction: float) -> Column:
    """Percentile with linear interpolation between the two nearest ranks."""
    return let(F.sort_array(values), lambda ordered: sorted_percentile(ordered, fraction))


def sorted_percentile(ordered: Column, fraction: float) -> Column:
    position = (F.size(ordered) - 1) * F.lit(fraction)
    low = F.floor(position).cast("int")
    high = F.ceil(position).cast("int")
    ratio = position - low
    return F.when(low == high, F.get(ordered, low)).otherwise(
        F.get(ordered, low) * (1.0 - ratio) + F.get(ordered, high) * ratio
    )


def _middle(ordered: Column) -> Column:
    size = F.size(ordered)
    middle = F.floor((size - 1) / 2).cast("int")
    return F.when(size % 2 == 1, F.get(ordered, middle)).otherwise(
        (F.get(ordered, middle) + F.get(ordered, middle + 1)) / 2.0
    )


def array_median(values: Column) -> Column:
    return let(F.sort_array(values), _middle)


def median3x3(values: Column, width: int = K.THERMAL_WIDTH, height: int = K.THERMAL_HEIGHT) -> Column:
    """3x3 median of a row-major frame; windows shrink to 6 or 4 values at edges and corners."""

    def neighbourhood(index: Column) -> Column:
        y = F.floor(index / width).cast("int")
        x = index % width
        left = F.greatest(F.lit(0), x - 1)
        span = F.least(F.lit(width - 1), x + 1) - left + 1
        rows = [
            F.when(
                (y + dy >= 0) & (y + dy < height),
                F.slice(values, (y + dy) * width + left + 1, span),
            ).otherwise(F.array().cast("array<double>"))
            for dy in (-1, 0, 1)
        ]
        return array_median(F.concat(*rows))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), neighbourhood)


def display_target(values: Column) -> Column:
    """Percentile bounds of one frame, widened to the minimum span around their middle."""
    def widen(bounds: Column) -> Column:
        low, high = bounds["low"], bounds["high"]
        middle, half = (low + high) / 2.0, K.DISPLAY_MIN_SPAN / 2.0
        narrow = high - low < K.DISPLAY_MIN_SPAN
        return F.struct(
            F.when(narrow, middle - half).otherwise(low).alias("low"),
            F.when(narrow, middle + half).otherwise(high).alias("high"),
        )
    raw = let(F.sort_array(values), lambda o: F.struct(
        sorted_percentile(o, K.DISPLAY_LOW).alias("low"), sorted_percentile(o, K.DISPLAY_HIGH).alias("high")))
    return let(raw, widen)


def normalized_field(values: Column, low: Column, high: Column) -> Column:
    """Frame values as positions inside the display bounds."""
    return F.transform(values, lambda t: (t - low) / (high - low))
