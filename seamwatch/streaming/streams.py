"""Structured Streaming jobs over the same operators.

Sources are file folders with explicit schemas; progress lives in the
checkpoint, and every sink step is idempotent, so a restarted stream continues
where it stopped.  Streams that need event time take timestamp columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamwatch import constants as K
from seamwatch.operators.captures import replay_conflicts
from seamwatch.skew import first_per_key
from seamwatch.streaming.keyindex import FAN, KeyIndex, without
from seamwatch.streaming.ordered import PAGE_SECONDS, bounds_fold, fold_in_time_order, gap_fold


def inbox_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int = 1000, **options: str) -> DataFrame:
    """New files below a folder as an unbounded table; the folder is never changed."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def text_inbox_stream(spark: SparkSession, path: str, pattern: str = "*.csv", files_per_trigger: int = 1000) -> DataFrame:
    """Whole text files as (path, content)."""
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def binary_inbox_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Start a foreachBatch query: everything available once, or continuously with an interval."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# --- exactly-once writes ----------------------------------------------------------------------------------

def append_once(path: str, keys: list[str], fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """Batch step appending only rows whose key is not stored yet.

    Each micro-batch writes its own partition (``batch=<id>``) in overwrite mode: a replayed
    micro-batch replaces its own output, and keys stored by other batches are left out.  Which keys
    are stored is asked of the table's key index, so a step reads a few small files however many
    batches there are.  Nulls in keys equal each other.
    """
    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        index = KeyIndex(spark, path, keys, fan)
        unique = first_per_key(rows, keys, sorted(rows.columns)).persist()
        fresh = without(unique, index.stored(unique, batch), keys)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        unique.unpersist()
        index.add(batch, spark.read.schema(fresh.schema).parquet(f"{path}/batch={batch}"))
    return step


def pending_once(receipts: str, done: str, path: str = "path") -> Callable[[DataFrame, int], None]:
    """Pending-package watch: packages that have neither a receipt nor an earlier entry are recorded."""
    keep = append_once(done, [path])

    def step(packages: DataFrame, batch: int) -> None:
        spark = packages.sparkSession
        known = spark.read.schema(f"{path} string").json(receipts)
        keep(packages.join(known, path, "left_anti"), batch)
    return step


def resume_items(items_path: str) -> Callable[[DataFrame, int], None]:
    """Item log step: finished items are not redone when their batch shows up again."""
    return append_once(items_path, ["batch_id", "relative_path"])


def ingest_captures(captures_path: str, conflicts_path: str, metadata: list[str], arrival: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Captures once; repeats with other metadata or images go to the conflict table.

    Rows carry images as array<struct<position,sha256>>.  Of rows of one id the first by
    ``arrival`` stays, and by their content where that is equal or not given, so a replayed
    micro-batch keeps the same row.
    """
    key = ["capture_id"]

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        index = KeyIndex(spark, captures_path, key)
        first = first_per_key(rows, key, [*(arrival or []), *metadata, "images", *sorted(set(rows.columns) - {"capture_id", "images", *metadata})]).persist()
        known = index.stored(first, batch).persist()
        without(first, known, key).write.mode("overwrite").parquet(f"{captures_path}/batch={batch}")
        kept = spark.read.schema(rows.schema).parquet(f"{captures_path}/batch={batch}")
        content = F.struct(*metadata, "images")
        found = rows.join(kept.select("capture_id", content.alias("_first")), "capture_id").where(content != F.col("_first")).select(
            "capture_id", F.lit("different content inside one micro-batch").alias("conflict"), F.lit(None).cast("int").alias("position"))
        holders = sorted(r["batch"] for r in known.select("batch").distinct().collect())
        if holders:
            before = spark.read.schema(rows.schema).parquet(*[f"{captures_path}/batch={b}" for b in holders]).join(known.select(*key).distinct(), key, "left_semi")
            found = found.unionByName(replay_conflicts(first, before, _image_rows(first), _image_rows(before), metadata))
        found.write.mode("overwrite").parquet(f"{conflicts_path}/batch={batch}")
        first.unpersist()
        known.unpersist()
        index.add(batch, kept)
    return step


def _image_rows(captures: DataFrame) -> DataFrame:
    return captures.select("capture_id", F.inline("images"))


def unique_captures(stream: DataFrame, ts: str = "received", delay: str = "1 hour") -> DataFrame:
    """First row per capture id inside the watermark; state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["capture_id"])


# --- stateful sensors -------------------------------------------------------------------------------------

def display_bounds_stream(frames: DataFrame, device: str, ts: str, low: str, high: str, alpha: float = K.DISPLAY_ALPHA, delay: str = "10 minutes",
                          page_seconds: float = PAGE_SECONDS) -> DataFrame:
    """Running display bounds per device in event-time order, as the batch operator gives them.

    A row appears once the watermark has passed its page of time, so rows that arrive up to ``delay``
    late, in a later micro-batch too, take their place.
    """
    return fold_in_time_order(frames, device, ts, [low, high], {"display_low": "double", "display_high": "double"}, bounds_fold(alpha), delay, page_seconds)


def gap_monitor(samples: DataFrame, device: str, ts: str, interval: float, delay: str = "10 minutes", page_seconds: float = PAGE_SECONDS) -> DataFrame:
    """Missed sampling slots per device and sample, in event-time order as above."""
    return fold_in_time_order(samples, device, ts, [], {"missed_slots": "bigint"}, gap_fold(interval), delay, page_seconds)


def align_streams(gas: DataFrame, thermal: DataFrame, keys: list[str], arrival: str | None = None, keep: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Gas/thermal alignment on streams, by key alone.

    ``arrival`` names a timestamp column of both sides (when the row came, such as its file's time);
    a null arrival counts as now.  A row waits for its partner for ``keep``: both sides are state that
    the watermark of arrival (``delay`` behind the newest) releases, and an unmatched side then
    appears with its warning.  Keys may be of any form.  On static tables all rows are there, so keys
    meet whatever their arrival, which need not be given.  Null keys meet nothing.
    """
    streaming = gas.isStreaming or thermal.isStreaming
    if streaming and arrival is None:
        raise ValueError("streams are aligned by the time of arrival")

    def side(rows: DataFrame, short: str, name: str) -> DataFrame:
        columns = [F.lit(True).alias(f"{short}_here"), *[F.col(k).alias(f"{short}_{k}") for k in keys], *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in keys]]
        if not streaming:
            return rows.select(*columns)
        timed = rows.withColumn("_arrived", F.coalesce(F.col(arrival), F.current_timestamp()))
        return timed.select(F.col("_arrived").alias(f"{short}_arrived"), *columns).withWatermark(f"{short}_arrived", delay)

    same = [f"g_{k} = t_{k}" for k in keys]
    if streaming:
        same += [f"t_arrived >= g_arrived - interval {keep}", f"t_arrived <= g_arrived + interval {keep}"]
    joined = side(gas, "g", "gas").join(side(thermal, "t", "thermal"), F.expr(" AND ".join(same)), "full_outer")
    warning = F.when(F.col("g_here").isNull(), "missing_gas_row").when(F.col("t_here").isNull(), "missing_thermal_frame")
    return joined.select(
        *[F.coalesce(f"g_{k}", f"t_{k}").alias(k) for k in keys],
        *[c for c in joined.columns if c.startswith(("gas_", "thermal_"))], warning.alias("warning"))


def alarm_windows(readings: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Readings and alarms per channel and event-time window."""
    alarm = F.col("status").isin("low_alarm", "high_alarm", "stel_alarm", "twa_alarm", "over_range")
    return readings.withWatermark(ts, delay).groupBy(F.window(ts, window), "channel").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(alarm).alias("alarms"), F.max("value").alias("peak"))


def alarm_sessions(readings: DataFrame, ts: str = "ts", gap: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of alarms per channel closed by a quiet gap."""
    alarms = readings.where(F.col("status").isin("low_alarm", "high_alarm", "stel_alarm", "twa_alarm", "over_range"))
    return alarms.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), "channel").agg(
        F.count(F.lit(1)).alias("alarms"), F.max("value").alias("peak"))
