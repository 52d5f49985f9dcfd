"""Export batches: registration, item log, counts, status and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch.functions.text import truncate_error

SENSOR_SCOPES = ("sensors", "gas", "thermal")


def register_batches(discovered: DataFrame, registered: DataFrame) -> DataFrame:
    """Headers of batches that are not registered yet."""
    return discovered.join(registered.select("batch_id"), "batch_id", "left_anti")


def initial_items(items: DataFrame) -> DataFrame:
    """Item rows of a new batch: an item with a preflight error starts failed."""
    return items.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("pending")).withColumn(
        "error", truncate_error(F.col("error"))
    )


def current_items(log: DataFrame, version: str = "version") -> DataFrame:
    """Latest status per item; a capture id once known is kept, the error is the latest one."""
    keys = ["batch_id", "relative_path"]
    latest = log.groupBy(*keys).agg(
        F.max_by(F.struct("status", "error"), F.col(version)).alias("_s"),
        F.max_by("capture_id", F.when(F.col("capture_id").isNotNull(), F.col(version))).alias("capture_id"),
    )
    return latest.select(*keys, "capture_id", F.col("_s.status").alias("status"), F.col("_s.error").alias("error"))


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("capture_total"),
        F.count_if(F.col("status") == "succeeded").alias("capture_succeeded"),
        F.count_if(F.col("status") == "failed").alias("capture_failed"),
    )


def first_item_error(items: DataFrame) -> DataFrame:
    """Error of the first failed item of a batch in path order."""
    failed = items.where((F.col("status") == "failed") & F.col("error").isNotNull())
    return failed.groupBy("batch_id").agg(F.min_by("error", "relative_path").alias("first_item_error"))


def progress(counts: DataFrame) -> DataFrame:
    """Pending items and percentage done."""
    done = F.col("capture_succeeded") + F.col("capture_failed")
    total = F.col("capture_total")
    return counts.withColumn("capture_pending", F.greatest(F.lit(0), total - done).cast("bigint")).withColumn(
        "progress_percent", F.when(total > 0, F.bround(done * 100 / total, 1)).otherwise(F.lit(0.0)).cast("double")
    )


def final_status(succeeded: Column, failed: Column, sensor_failed: Column, warnings: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull() | ((succeeded == 0) & (failed > 0)), "failed")
        .when((failed > 0) | sensor_failed | (warnings > 0), "completed_with_errors")
        .otherwise("completed")
    )


def finish_batches(items: DataFrame, diagnostics: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Counts, warning count and final status per batch.

    ``headers`` may carry batch_id, sensor_status and error.  Diagnostics stay
    rows; only their count is attached to a batch.
    """
    warnings = diagnostics.groupBy("batch_id").agg(F.count(F.lit(1)).alias("warning_count"))
    out = item_counts(items).join(warnings, "batch_id", "left").withColumn(
        "warning_count", F.coalesce("warning_count", F.lit(0))
    )
    if headers is not None:
        out = out.join(headers.select("batch_id", "sensor_status", "error"), "batch_id", "left")
    else:
        out = out.withColumn("sensor_status", F.lit("completed")).withColumn("error", F.lit(None).cast("string"))
    status = final_status(
        F.col("capture_succeeded"), F.col("capture_failed"),
        F.coalesce(F.col("sensor_status") == "failed", F.lit(False)), F.col("warning_count"), F.col("error"),
    )
    return out.withColumn("status", status)


def batch_overview(headers: DataFrame, items: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Batch list, newest first, with counts, progress and first item error."""
    counts = progress(item_counts(items)).join(first_item_error(items), "batch_id", "left")
    warnings = diagnostics.groupBy("batch_id").agg(F.count(F.lit(1)).alias("warning_count"))
    out = headers.join(counts, "batch_id", "left").join(warnings, "batch_id", "left")
    zeros = ["capture_total", "capture_succeeded", "capture_failed", "capture_pending", "warning_count", "progress_percent"]
    return out.fillna(0, zeros).orderBy(F.desc("discovered_at"), "batch_id")


def pending_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "pending").orderBy("batch_id", "relative_path")


def oldest_queued(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("status") == "queued").orderBy("queued_at", "batch_id").limit(1)


def reset_interrupted(items: DataFrame) -> DataFrame:
    """Items left running by an interrupted run return to pending."""
    return items.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def retry_failed(items: DataFrame) -> DataFrame:
    """Failed items become pending again without their error; the others are untouched."""
    failed = F.col("status") == "failed"
    return items.withColumn("error", F.when(~failed, F.col("error"))).withColumn(
        "status", F.when(failed, "pending").otherwise(F.col("status"))
    )


def retry_diagnostics(diagnostics: DataFrame, headers: DataFrame) -> DataFrame:
    """Sensor diagnostics are dropped only for batches whose sensor import had failed."""
    failed = headers.where(F.col("sensor_status") == "failed").select("batch_id", F.lit(True).alias("_failed"))
    joined = diagnostics.join(failed, "batch_id", "left")
    return joined.where(~(F.col("_failed").isNotNull() & F.col("scope").isin(*SENSOR_SCOPES))).drop("_failed")


def health(captures: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: capture totals by status and queue length (zeros for empty tables)."""
    c = captures.agg(
        F.count(F.lit(1)).alias("captures_total"),
        F.count_if(F.col("status") == "processed").alias("captures_processed"),
        F.count_if(F.col("status") == "failed").alias("captures_failed"),
    ).withColumn("_k", F.lit(1))
    b = batches.agg(
        F.count_if(F.col("status") == "queued").alias("batches_queued"),
        F.count_if(F.col("status") == "running").alias("batches_running"),
    ).withColumn("_k", F.lit(1))
    return c.join(b, "_k").drop("_k")


def discover(listing: DataFrame, registered: DataFrame) -> DataFrame:
    """Inbox listing (batch_id, counts) merged with registered batches, newest id first."""
    found = listing.withColumn("_found", F.lit(True))
    known = registered.withColumn("_known", F.lit(True))
    shared = [c for c in known.columns if c in found.columns and c not in ("batch_id",)]
    for name in shared:
        found = found.withColumnRenamed(name, f"_l_{name}")
    joined = found.join(known, "batch_id", "full_outer")
    for name in shared:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.col(f"_l_{name}"))).drop(f"_l_{name}")
    return joined.withColumn("status", F.when(F.col("_known").isNull(), "discovered").otherwise(F.col("status"))).withColumn(
        "source_available", F.col("_found").isNotNull()
    ).drop("_found", "_known").orderBy(F.desc("batch_id"))


def pending_packages(packages: DataFrame, receipts: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(packages without a receipt, packages skipped because they have one)."""
    done = receipts.select(path)
    return packages.join(done, path, "left_anti"), packages.join(done, path, "left_semi")
