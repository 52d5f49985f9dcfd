"""Evaluation reports over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, correct ones, accuracy and detection recall (confirmed share)."""
    hit = F.col("expected").eqNullSafe(F.col("predicted"))
    grouped = predictions.groupBy(*by) if by else predictions.groupBy()
    out = grouped.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"),
        F.count_if(F.col("status") == "confirmed").alias("detected"),
    )
    return out.select(
        *by, "total", "correct", "detected",
        _share(F.col("correct"), F.col("total")).alias("accuracy"), _share(F.col("detected"), F.col("total")).alias("recall"),
    )


def digit_accuracy(predictions: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """String accuracy and per-digit accuracy; sign and point are ignored for digits."""
    def digits(name: str) -> Column:
        clean = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"^-+|\.", "")
        return F.filter(F.split(clean, ""), lambda c: c != "")
    rows = predictions.select(
        expected, predicted, digits(expected).alias("_e"), digits(predicted).alias("_p")
    )
    hits = F.size(F.filter(F.zip_with("_e", "_p", lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False))))
    out = rows.agg(
        F.count(F.lit(1)).alias("samples"), F.sum(hits).alias("digits_correct"), F.sum(F.size("_e")).alias("digits_total"),
        F.count_if(F.col(expected).eqNullSafe(F.col(predicted))).alias("strings_correct"),
    )
    return out.select(
        "samples", F.coalesce("digits_correct", F.lit(0)).alias("digits_correct"), F.coalesce("digits_total", F.lit(0)).alias("digits_total"),
        "strings_correct", _share(F.col("digits_correct"), F.col("digits_total")).alias("digit_accuracy"),
        _share(F.col("strings_correct"), F.col("samples")).alias("string_accuracy"),
    )


def variant_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy per perturbation variant."""
    return accuracy(predictions, ["variant"])


def failures(predictions: DataFrame) -> DataFrame:
    return predictions.where(~F.col("expected").eqNullSafe(F.col("predicted")))


def unvalidated_classes(samples: DataFrame, label: str = "expected", minimum: int = 2) -> DataFrame:
    """Classes with too few samples for leave-one-out validation."""
    return samples.groupBy(label).agg(F.count(F.lit(1)).alias("samples")).where(F.col("samples") < minimum)


def gates(report: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row per gate: measured value, threshold and verdict."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))
        for name, limit in thresholds.items()
    ])
    return report.select(F.explode(entries).alias("g")).select("g.*").withColumn("passed", F.col("value") >= F.col("threshold"))
