"""Row validators.  Each returns (good rows, diagnostics rows) or adds an error column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch import schemas as S
from seamwatch.functions import geometry as G
from seamwatch.functions import quality as Q
from seamwatch.functions import text as X
from seamwatch.functions.core import compute_once


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def diagnostics(
    df: DataFrame, scope: str, level: str, message: Column, batch: str | None = "batch_id",
    path: str | None = None, row: str | None = None, key: str | None = None,
) -> DataFrame:
    """Rows in the diagnostics layout (batch_id, scope, level, path, row, sample_key, message)."""
    def pick(name: str | None, kind: str) -> Column:
        return (F.col(name) if name else F.lit(None)).cast(kind)
    return df.select(
        pick(batch, "string").alias("batch_id"), F.lit(scope).alias("scope"), F.lit(level).alias("level"),
        pick(path, "string").alias("path"), pick(row, "bigint").alias("row"),
        pick(key, "string").alias("sample_key"), message.alias("message"),
    )


# --- capture metadata -----------------------------------------------------------------------

def _pose_number(pose: Column, name: str) -> Column:
    return X.finite_double(pose[name])


def pose_error(pose: Column) -> Column:
    """Error of a raw pose (struct of texts), or null."""
    frame = X.blank_to_null(pose["frame"])
    error = F.when(F.length(frame) > 32, F.lit("robot_pose.frame is too long"))
    for name in ("x_m", "y_m", "yaw_deg"):
        raw = pose[name]
        number = raw.try_cast("double")
        error = error.when(raw.isNotNull() & number.isNull(), F.lit(f"robot_pose.{name} must be a number or null"))
        error = error.when(raw.isNotNull() & X.finite_double(raw).isNull(), F.lit(f"robot_pose.{name} must be finite"))
    return error


def pose(raw: Column) -> Column:
    """Raw pose -> struct<frame,x_m,y_m,yaw_deg> with the default frame."""
    return F.struct(
        F.coalesce(X.blank_to_null(raw["frame"]), F.lit("map")).alias("frame"),
        *[_pose_number(raw, n).alias(n) for n in ("x_m", "y_m", "yaw_deg")],
    )


def image_names(raw: Column) -> Column:
    """Trimmed, non-blank image names in order."""
    return F.filter(F.transform(raw, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))


def metadata_error(m: Column) -> Column:
    """First broken metadata rule, or null.  ``m`` has the fields of RAW_METADATA."""
    capture_id, time = F.trim(m["capture_id"]), F.trim(m["capture_time"])
    station, camera = X.blank_to_null(m["station_id"]), F.trim(F.coalesce(m["camera_id"], F.lit(K.DEFAULT_CAMERA)))
    batch, names = X.blank_to_null(m["batch_id"]), image_names(m["images"])
    return (
        F.when(m.isNull(), F.lit("metadata must be valid JSON"))
        .when(~F.coalesce(capture_id.rlike(K.CAPTURE_ID_PATTERN), F.lit(False)),
              F.lit("capture_id must be 1-128 characters using letters, digits, '.', '_' or '-'"))
        .when(F.coalesce(time, F.lit("")) == "", F.lit("capture_time is required"))
        .when(X.iso_wall_clock(time).isNull(), F.lit("capture_time must be ISO-8601"))
        .when(station.isNull() | (F.length(station) > 64),
              F.lit("station_id is required and must be at most 64 characters"))
        .when((camera == "") | (F.length(camera) > 64), F.lit("camera_id must be 1-64 characters"))
        .when(F.length(batch) > 128, F.lit("batch_id must be at most 128 characters"))
        .when(names.isNull() | (F.size(names) < 1) | (F.size(names) > 5),
              F.lit("images must contain between 1 and 5 file names"))
        .when(F.size(F.array_distinct(names)) != F.size(names), F.lit("images must not contain duplicate file names"))
        .otherwise(pose_error(m["robot_pose"]))
    )


def parse_metadata(packages: DataFrame, json: str = "metadata_json") -> DataFrame:
    """Metadata JSON -> normalised capture columns plus ``error`` (null for good rows)."""
    raw = compute_once(packages, _m=F.from_json(F.col(json), S.RAW_METADATA))
    m = F.col("_m")
    raw = compute_once(raw, error=metadata_error(m))
    return raw.select(
        *packages.columns,
        F.trim(m["capture_id"]).alias("capture_id"), F.trim(m["capture_time"]).alias("capture_time"),
        F.trim(m["station_id"]).alias("station_id"), pose(m["robot_pose"]).alias("robot_pose"),
        F.trim(F.coalesce(m["camera_id"], F.lit(K.DEFAULT_CAMERA))).alias("camera_id"),
        image_names(m["images"]).alias("images"), X.blank_to_null(m["batch_id"]).alias("batch_id"),
        "error",
    )


# --- detections and corrections ----------------------------------------------------------------

def detection_error(kind: Column, class_id: Column, confidence: Column, bbox: Column) -> Column:
    return (
        F.when((F.coalesce(kind, F.lit("")) == "") | (F.coalesce(class_id, F.lit("")) == ""),
               F.lit("detection type and class_id are required"))
        .when(~F.coalesce(confidence.between(0.0, 1.0) & ~F.isnan(confidence), F.lit(False)),
              F.lit("detection confidence must be in [0, 1]"))
        .when(~G.is_valid_box(bbox), F.lit("bounding box must be finite with positive width and height"))
    )


def validate_detections(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = compute_once(
        detections, error=detection_error(F.col("type"), F.col("class_id"), F.col("confidence"), F.col("bbox"))
    )
    return split_errors(checked)


def corrected_object_error(o: Column) -> Column:
    """Error of one corrected object (fields of RAW_OBJECT), or null."""
    number = o["confidence"].try_cast("double")
    return (
        F.when(X.blank_to_null(o["type"]).isNull() | X.blank_to_null(o["class"]).isNull(), F.lit("requires type and class"))
        .when(o["bbox_xyxy"].isNotNull(), G.box_error(o["bbox_xyxy"]))
    ), (
        F.when(o["confidence"].isNotNull() & number.isNull(), F.lit("confidence must be numeric"))
        .when(o["confidence"].isNotNull() & ~(number.between(0.0, 1.0) & ~F.isnan(number)),
              F.lit("confidence must be in [0, 1]"))
    )


def correction_error(c: Column, objects: Column, has_result: Column) -> Column:
    """First broken rule of a correction request; ``objects`` is array<RAW_OBJECT>."""
    operator, reason = F.trim(c["operator"]), F.trim(c["reason"])

    def first_bad(item: Column, index: Column) -> Column:
        shape, confidence = corrected_object_error(item)
        error = F.coalesce(shape, confidence)
        return F.when(error.isNotNull(), F.concat(F.lit("correction.objects["), index.cast("string"), F.lit("] "), error))

    bad = F.array_compact(F.transform(objects, first_bad))
    return (
        F.when(~has_result, F.lit("capture has no result to correct"))
        .when((F.coalesce(operator, F.lit("")) == "") | (F.length(operator) > 100),
              F.lit("operator is required and must be at most 100 characters"))
        .when(F.length(reason) > 1000, F.lit("reason must be at most 1000 characters"))
        .when(objects.isNull(), F.lit("correction.objects is required"))
        .otherwise(F.get(bad, F.lit(0)))
    )


def merge_correction(result_objects: Column, warnings: Column) -> Column:
    """Corrected result: replaced objects, warnings extended by ``manually_corrected``."""
    return F.struct(
        result_objects.alias("objects"),
        F.concat(F.coalesce(warnings, F.array().cast("array<string>")), F.array(F.lit("manually_corrected"))).alias("warnings"),
    )


# --- packages and batches ------------------------------------------------------------------------

def validate_images(files: DataFrame, content: str = "content", max_bytes: int = K.MAX_IMAGE_BYTES) -> DataFrame:
    return files.withColumn("error", Q.image_payload_error(F.col(content), max_bytes))


def path_error(path: Column, what: str = "capture package path") -> Column:
    return (
        F.when(~X.is_relative_path(path), F.lit(f"{what} must be relative"))
        .when(~X.stays_inside(path), F.lit(f"{what} escapes its root"))
    )


def compare_uploads(declared: DataFrame, uploaded: DataFrame, key: str = "capture_id") -> DataFrame:
    """Declared (key, position, name) vs uploaded (key, position, name): one row per faulty key."""
    left = declared.select(key, "position", X.portable_name(F.col("name")).alias("want"))
    right = uploaded.select(key, "position", X.portable_name(F.col("name")).alias("have"))
    pairs = left.join(right, [key, "position"], "full_outer")
    verdict = pairs.groupBy(key).agg(
        F.count("want").alias("declared"), F.count("have").alias("uploaded"),
        F.min(F.when(~F.col("want").eqNullSafe(F.col("have")), F.col("position"))).alias("first_mismatch"),
    )
    error = F.when(
        F.col("declared") != F.col("uploaded"),
        F.format_string("metadata declares %d images but %d were uploaded", "declared", "uploaded"),
    ).when(
        F.col("first_mismatch").isNotNull(),
        F.format_string("uploaded image name at position %d does not match metadata", "first_mismatch"),
    )
    return verdict.withColumn("error", error).where(F.col("error").isNotNull())


def stored_names(images: DataFrame, key: str = "capture_id") -> DataFrame:
    """Safe file name of every image; a name already used by an earlier position gets ``NN_``,
    its position with two digits or more."""
    nn = X.zero_pad(F.col("position").cast("string"), 2)
    named = images.withColumn("_safe", X.safe_name(F.col("name"), F.concat(F.lit("frame_"), nn, F.lit(".jpg"))))
    owner = named.groupBy(key, "_safe").agg(F.min("position").alias("_owner"))
    out = named.join(owner, [key, "_safe"])
    return out.withColumn(
        "file_name", F.when(F.col("position") == F.col("_owner"), F.col("_safe")).otherwise(F.concat(nn, F.lit("_"), F.col("_safe")))
    ).drop("_safe", "_owner")


def preflight(items: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(importable items, fatal batch errors).

    ``items``: batch_id, relative_path, capture_id, error; ``folders``: batch_id, folder.
    Missing folders, no items, escaping paths and repeated capture ids reject a
    whole batch; any other item error stays with its item.
    """
    present = folders.groupBy("batch_id").agg(
        *[F.max(F.when(F.col("folder") == f, 1)).alias(f) for f in K.REQUIRED_FOLDERS]
    )
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in K.REQUIRED_FOLDERS]))
    missing = present.where(F.size(absent) > 0).select(
        "batch_id",
        F.concat(F.lit("offline batch is missing required directories: "), F.array_join(absent, ", ")).alias("message"),
    )
    empty = present.join(items.select("batch_id").distinct(), "batch_id", "left_anti").select(
        "batch_id", F.lit("offline batch contains no visible captures").alias("message")
    )
    escaping = items.where(F.col("error").contains("escapes") | F.col("error").contains("relative")).select(
        "batch_id", F.concat_ws(": ", "relative_path", "error").alias("message")
    )
    known = items.where(F.col("capture_id").isNotNull())
    twice = known.groupBy("batch_id", "capture_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("relative_path").alias("first"), F.max("relative_path").alias("last")
    ).where("n > 1").select(
        "batch_id",
        F.concat(F.lit("duplicate capture_id "), F.col("capture_id").cast("string"), F.lit(": "), F.col("first"), F.lit(", "), F.col("last")).alias("message"),
    )
    fatal = missing.unionByName(empty).unionByName(escaping).unionByName(twice)
    return items.join(fatal.select("batch_id").distinct(), "batch_id", "left_anti"), fatal


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a uniqueness rule: key and number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


# --- dimensions ------------------------------------------------------------------------------------

def reference_gaps(references: DataFrame) -> DataFrame:
    """Pointer references lacking a required field, one row per gap."""
    gaps = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in ("station_id", "normal_angle_deg", "tolerance_deg")
    ]))
    return references.select("name", F.explode(gaps).alias("missing_field"))


def dimension_readiness(classes: DataFrame, stations: DataFrame, references: DataFrame, train: str = "train", image_there: Column | None = None) -> DataFrame:
    """(name, status, count) of the three dimension tables before any data comes.

    Classes count unless their ``train`` is false and block if none is left; stations block if there
    are none; references block if one lacks a field, warn if one's image is missing or there are none.
    """
    def status(value: Column) -> Column:
        return value.alias("status")

    counted = classes.agg(F.count_if(F.coalesce(F.col(train), F.lit(True))).alias("count"))
    placed = stations.agg(F.count(F.lit(1)).alias("count"))
    lacking = F.lit(False)
    for c in ("station_id", "normal_angle_deg", "tolerance_deg"):
        lacking = lacking | F.col(c).isNull()
    absent = ~image_there if image_there is not None else F.lit(False)
    measured = references.agg(F.count(F.lit(1)).alias("n"), F.count_if(lacking).alias("lacking"), F.count_if(absent).alias("absent"))
    return counted.select(F.lit("classes").alias("name"), status(F.when(F.col("count") > 0, "ok").otherwise("blocker")), "count").unionByName(
        placed.select(F.lit("stations").alias("name"), status(F.when(F.col("count") > 0, "ok").otherwise("blocker")), "count")).unionByName(
        measured.select(F.lit("analog_references").alias("name"),
                        status(F.when(F.col("lacking") > 0, "blocker").when((F.col("absent") > 0) | (F.col("n") == 0), "warning").otherwise("ok")),
                        F.when(F.col("lacking") > 0, F.col("lacking")).when(F.col("absent") > 0, F.col("absent")).otherwise(F.col("n")).alias("count")))
