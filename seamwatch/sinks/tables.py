"""Writers.  Tables are append-only Parquet; replacing one batch overwrites only its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions.text import truncate_error, zero_pad
from seamwatch.operators import batches as B
from seamwatch.operators import captures as C
from seamwatch.operators import curation as D


def gas_day_rows(wide: DataFrame, ts: str = "ts") -> DataFrame:
    """Wide gas rows in the seven-column layout, with the day of their file."""
    zh = K.GAS_HEADER_ZH
    return wide.select(
        F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias(zh[0]),
        zero_pad(F.col("sample_id").cast("string")).alias(zh[1]),
        *[F.col(f"{c}_value").cast("string").alias(n) for c, n in zip(K.CHANNELS, zh[2:6])],
        F.col("status").alias(zh[6]),
    )


def write_gas_days(wide: DataFrame, path: str, ts: str = "ts") -> None:
    """Wide gas rows as CSV in the seven-column layout, one folder per day.

    Rows whose day, time and sample are there already are left out, so a rerun adds nothing.  A
    target with other columns (an older layout) is refused.
    """
    zh = K.GAS_HEADER_ZH
    rows = gas_day_rows(wide, ts)
    spark = wide.sparkSession
    if _folders(spark, path):
        there = spark.read.option("header", True).csv(path)
        if [c for c in there.columns if c != "day"] != list(zh):
            raise ValueError("gas table has a legacy header")
        known = there.select(F.col("day").cast("string").alias("day"), F.col(f"`{zh[0]}`").cast("string").alias(zh[0]), F.col(f"`{zh[1]}`").cast("string").alias(zh[1]))
        rows = rows.join(known, ["day", zh[0], zh[1]], "left_anti").select("day", *[F.col(f"`{n}`") for n in zh])
    writer = rows.repartitionByRange(F.col("day"), F.col(f"`{zh[1]}`")).sortWithinPartitions("day", f"`{zh[0]}`", f"`{zh[1]}`")
    writer.write.mode("append").partitionBy("day").option("header", True).csv(path)


def replace_batch_samples(samples: DataFrame, path: str, batches: Sequence[str]) -> None:
    """Replace the samples of the given batches and of no others.

    A batch of the list that has no samples now loses those it had; rows of batches that are not
    on the list are refused.
    """
    spark = samples.sparkSession
    wanted = {str(b) for b in batches}
    counts = {str(r["batch_id"]) for r in samples.where(F.col("batch_id").cast("string").isin(*wanted)).select("batch_id").distinct().collect()}
    if not samples.where(~F.coalesce(F.col("batch_id").cast("string").isin(*wanted), F.lit(False))).isEmpty():
        raise ValueError("samples of a batch that is not replaced")
    (samples.repartition("batch_id", F.pmod(F.xxhash64("sample_key"), F.lit(64))).write
        .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    for folder in _folders(spark, path):
        if folder.getName() in {f"batch_id={b}" for b in wanted - counts}:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _folders(spark: SparkSession, path: str) -> list:
    """Partition folders below a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(target)] if system.exists(target) else []
    return [p for p in found if "=" in p.getName()]


def merge_diagnostics(stored: DataFrame, new: DataFrame, scope: str, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, counts): of the given batches, the diagnostics of ``scope`` are replaced by the new ones.

    ``batches`` lists batch_id; every one has a count, 0 included.
    """
    stale = batches.select("batch_id", F.lit(scope).alias("scope"))
    merged = stored.join(stale, ["batch_id", "scope"], "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))
    counts = batches.select("batch_id").join(merged.groupBy("batch_id").agg(F.count(F.lit(1)).alias("warning_count")), "batch_id", "left")
    return merged, counts.fillna(0, ["warning_count"])


def append(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with nested values as JSON text (no byte-order mark is written)."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name)
        for f in rows.schema.fields
    ]
    rows.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def write_dataset_reports(records: DataFrame, path: str) -> None:
    """Manifest (JSON lines), summary tables and the issues CSV below one folder."""
    records.write.mode("errorifexists").json(f"{path}/manifest")
    for name, table in summary_tables(records).items():
        table.write.mode("errorifexists").json(f"{path}/summary/{name}")
    D.quality_issues(records).write.mode("errorifexists").option("header", True).csv(f"{path}/issues")


def summary_tables(records: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": D.dataset_totals(records), "split_counts": D.split_counts(records),
        "empty_splits": D.empty_splits(records), "flag_counts": D.flag_counts(records),
        "odd_captures": D.odd_captures(records),
    }



def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


# --- logs -----------------------------------------------------------------------------------------------

def result_log_rows(results: DataFrame, version: str = "version") -> DataFrame:
    """Successful results as log rows: processed, error cleared."""
    return results.withColumn("status", F.lit("processed")).withColumn("error", F.lit(None).cast("string"))


def failure_log_rows(failures: DataFrame) -> DataFrame:
    """Failures as log rows: status failed, error cut to 2000 characters."""
    return failures.withColumn("status", F.lit("failed")).withColumn("error", truncate_error(F.col("error")))



def result_objects(current: DataFrame) -> DataFrame:
    """Object rows rebuilt from the latest result documents."""
    return current.select("capture_id", F.posexplode("objects").alias("object_index", "object")).select(
        "capture_id", "object_index", F.col("object.type").alias("object_type"), F.col("object.class").alias("class_id"),
        F.col("object.confidence").try_cast("double").alias("confidence"), F.to_json("object").alias("data_json"))


def item_status_rows(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid item log rows, rows with an unknown status)."""
    known = F.coalesce(F.col("status").isin(*K.ITEM_STATUSES), F.lit(False))
    return updates.where(known), updates.where(~known)


def register_batches(discovered: DataFrame, items: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new headers, their initial items); already registered batches add nothing."""
    headers = B.register_batches(discovered, registered).withColumn("status", F.lit("queued"))
    fresh = B.initial_items(items).join(headers.select("batch_id"), "batch_id", "left_semi")
    return headers, fresh
