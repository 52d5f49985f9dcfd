"""Domain tables derived from the synthetic star-schema tables (whole tables, never subsets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch.functions.geometry import box
from seamwatch.functions.text import zero_pad
from seamwatch.skew import number_rows

#: Order of the objects of one capture.
OBJECT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
EVENT_CHANNELS = {"view": "ch4", "click": "o2", "purchase": "co", "signup": "h2s", "error": "co"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(
        F.col("o_orderstatus") == "P", "failed"
    ).otherwise("received")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("capture_id"),
        F.col("o_orderdate").cast("string").alias("capture_time"),
        F.col("o_orderpriority").alias("received_at"),
        (F.col("o_custkey") % 10 + 1).cast("string").alias("station_id"),
        F.lit("go2_front").alias("camera_id"),
        status.alias("status"),
        F.when(status == "failed", F.concat(F.lit("error "), F.col("o_orderpriority"))).alias("error"),
        (F.col("o_totalprice") / 1000.0).alias("x_m"),
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """One to five images per capture, derived from the order itself."""
    count = (F.col("o_custkey") % 5 + 1).cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("capture_id"), F.explode(F.sequence(F.lit(1), count)).alias("position"),
    ).select(
        "capture_id", "position",
        F.sha2(F.concat_ws(":", F.col("capture_id").cast("string"), F.col("position").cast("string")), 256).alias("sha256"),
    )


def raw_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects without an ordinal; ``l_*`` order columns are kept."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("capture_id"),
        F.col("l_returnflag").alias("object_type"),
        F.col("l_linestatus").alias("class_id"),
        F.round(F.col("l_discount") * 10, 4).alias("confidence"),
        box(
            F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_quantity") + 20, F.col("l_tax") * 1000 + 30
        ).alias("bbox"),
        *OBJECT_ORDER,
    )


def objects(spark: SparkSession, folder: str, slice_by: str | None = None) -> DataFrame:
    """Objects with their ordinal inside the capture (line numbers slice a hot capture, or a sample of the rows does)."""
    return number_rows(
        raw_objects(spark, folder), ["capture_id"], OBJECT_ORDER, "object_index", slice_by=slice_by or F.col("l_linenumber")
    ).withColumn("object_index", F.col("object_index").cast("bigint"))


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") + 1).alias("capture_id"),
        F.col("ts").alias("created_at"),
        (F.col("event_type") != "error").alias("active"),
        F.col("event_type").alias("operator"),
        F.col("props").alias("corrected_json"),
        (F.col("value") % 4).cast("bigint").alias("corrected_objects"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the day and the minute-free sample id used as sensor keys."""
    return table(spark, folder, "events").withColumn("day", F.date_trunc("day", F.col("ts")).cast("date"))


def gas_long(spark: SparkSession, folder: str) -> DataFrame:
    channel = F.create_map(*[F.lit(x) for pair in EVENT_CHANNELS.items() for x in pair])
    status = F.when(F.col("event_type") == "error", "read_error").when(F.col("value") > 80, "high_alarm").when(F.col("value") < 5, "low_alarm").otherwise("normal")
    return events(spark, folder).select(
        F.col("user_id").alias("device"), "day", "event_id", "ts",
        F.try_element_at(channel, F.col("event_type")).alias("channel"),
        F.col("value"), status.alias("status"),
    )


def batch_items(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("succeeded")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("batch_id"),
        zero_pad(F.col("event_id").cast("string"), 12).alias("relative_path"),
        (F.col("event_id") % 1000 + 1).alias("capture_id"),
        F.col("ts"),
        status.alias("status"),
        F.when(kind == "error", F.col("props")).alias("error"),
    )


def frame_readings(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "user_id", "day", "ts", "event_id",
        F.col("event_type").alias("raw_text"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
        F.when(F.col("value") >= 20, "confirmed").otherwise("unreadable").alias("status"),
    )


def angles(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "user_id", "day", "ts", "event_id",
        F.round(F.pmod(F.col("value") * 3.6, F.lit(360.0)), 4).alias("angle"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
    )


def image_records(spark: SparkSession, folder: str) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, folder, "documents").select(
        zero_pad(F.col("doc_id").cast("string"), 12).alias("relative_path"),
        F.col("doc_id").alias("capture_id"),
        F.col("source").alias("batch_id"),
        F.sha2(F.col("text"), 256).alias("sha256"),
        F.sha2(letters, 256).alias("perceptual_hash"),
        F.col("n_chars"), F.col("lang"),
    )


def thermal_frames(spark: SparkSession, folder: str) -> DataFrame:
    """8x8 frames in degrees: 25 + 40 * component."""
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("device"), F.col("vec_id").alias("sample_id"),
        F.transform("embedding", lambda v: F.round(v.cast("double") * 40.0 + 25.0, 4)).alias("temperatures"),
    )


def sign_bits(spark: SparkSession, folder: str) -> DataFrame:
    """64 sign bits of every vector as two 32-bit halves (bit 0 = first component, high half)."""
    def half(start: int):
        return F.aggregate(
            F.slice("embedding", start, 32), F.lit(0).cast("bigint"),
            lambda bits, v: bits * 2 + F.when(v > 0, 1).otherwise(0),
        )
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", half(1).alias("hi"), half(33).alias("lo"),
        F.when(F.col("vec_id") % 3 == 0, "train").when(F.col("vec_id") % 3 == 1, "val").otherwise("test").alias("split"),
    )
