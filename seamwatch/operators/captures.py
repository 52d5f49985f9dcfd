"""Captures, their images, objects and corrections: append-only logs and derived views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.skew import spread_join


# --- ingest ---------------------------------------------------------------------------------------

def new_captures(incoming: DataFrame, stored: DataFrame, key: str = "capture_id") -> DataFrame:
    """Incoming captures that are not stored yet."""
    return incoming.join(stored.select(key), key, "left_anti")


def replayed_captures(incoming: DataFrame, stored: DataFrame, key: str = "capture_id") -> DataFrame:
    """Incoming captures that are stored already; they are acknowledged, not processed again."""
    return incoming.join(stored.select(key), key, "left_semi")


def replay_conflicts(
    incoming: DataFrame, stored: DataFrame, incoming_images: DataFrame, stored_images: DataFrame,
    metadata: list[str], key: str = "capture_id",
) -> DataFrame:
    """Replays that differ from what is stored: metadata, image count or image content."""
    same = F.lit(True)
    for name in metadata:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    known = incoming.alias("a").join(stored.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).select(
        F.col(f"a.{key}").alias(key), same.alias("_same")
    )
    a = incoming_images.select(key, "position", F.col("sha256").alias("_a"))
    b = stored_images.select(key, "position", F.col("sha256").alias("_b"))
    pairs = a.join(b, [key, "position"], "full_outer").groupBy(key).agg(
        F.count("_a").alias("_na"), F.count("_b").alias("_nb"),
        F.min(F.when(F.col("_a") != F.col("_b"), F.col("position"))).alias("position"),
    )
    joined = known.join(pairs, key, "left")
    conflict = (
        F.when(~F.col("_same"), F.lit("different metadata"))
        .when(F.coalesce(F.col("_na"), F.lit(0)) != F.coalesce(F.col("_nb"), F.lit(0)), F.lit("different number of images"))
        .when(F.col("position").isNotNull(), F.lit("different image content"))
    )
    return joined.withColumn("conflict", conflict).where(F.col("conflict").isNotNull()).select(
        key, "conflict",
        F.when(F.col("conflict") == "different image content", F.col("position")).alias("position"),
    )


def delete_captures(rows: DataFrame, tombstones: DataFrame, key: str = "capture_id") -> DataFrame:
    """Rows of captures that were not deleted; used for captures, images, objects and corrections."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


# --- results and corrections -----------------------------------------------------------------------

def current_results(results_log: DataFrame, version: str = "version", key: str = "capture_id") -> DataFrame:
    """Latest entry of the results log per capture."""
    values = [c for c in results_log.columns if c not in (key, version)]
    latest = results_log.groupBy(key).agg(
        F.max(version).alias(version), F.max_by(F.struct(*values), F.col(version)).alias("_r")
    )
    return latest.select(key, version, *[F.col(f"_r.{c}").alias(c) for c in values])


def active_corrections(
    corrections: DataFrame, reprocessed: DataFrame | None = None, key: str = "capture_id",
) -> DataFrame:
    """Correction log with ``active`` derived: newest per capture and later than the last reprocessing.

    The audit keeps every row.  ``reprocessed`` (capture_id, at) lists reprocessing events.
    """
    newest = corrections.groupBy(key).agg(F.max("id").alias("_newest"), F.count(F.lit(1)).alias("_n"))
    if reprocessed is not None:
        last = reprocessed.groupBy(key).agg(F.max("at").alias("_at"))
        newest = newest.join(last, key, "left")
    else:
        newest = newest.withColumn("_at", F.lit(None).cast("timestamp_ntz"))
    marked = spread_join(corrections, newest, [key], "_n")
    fresh = F.col("_at").isNull() | (F.col("created_at") > F.col("_at"))
    return marked.withColumn("active", (F.col("id") == F.col("_newest")) & fresh).drop("_newest", "_n", "_at")


def latest_correction(corrections: DataFrame, values: list[str], key: str = "capture_id") -> DataFrame:
    """Newest active correction per capture (one aggregate, no window)."""
    active = corrections.where(F.col("active"))
    picked = active.groupBy(key).agg(
        F.max("id").alias("correction_id"), F.max_by(F.struct(*values), F.col("id")).alias("_v")
    )
    return picked.select(key, "correction_id", *[F.col(f"_v.{v}").alias(v) for v in values])


def effective_result(
    captures: DataFrame, corrections: DataFrame, original: str, corrected: str, key: str = "capture_id",
) -> DataFrame:
    """Corrected result where an active correction exists, the model result otherwise."""
    chosen = latest_correction(corrections, [corrected], key)
    joined = captures.join(chosen, key, "left")
    return joined.withColumn("effective", F.coalesce(F.col(corrected), F.col(original))).withColumn(
        "manually_corrected", F.col("correction_id").isNotNull()
    )


# --- listing ----------------------------------------------------------------------------------------

def source_batch(items: DataFrame, key: str = "capture_id") -> DataFrame:
    """Smallest batch id among the succeeded items of a capture; orphan items are tolerated."""
    return items.where(F.col("status") == "succeeded").groupBy(key).agg(F.min("batch_id").alias("source_batch_id"))


def in_batch(captures: DataFrame, items: DataFrame, batch_id=None, key: str = "capture_id") -> DataFrame:
    """Captures with a succeeded item (of one batch when given)."""
    members = items.where(F.col("status") == "succeeded")
    if batch_id is not None:
        members = members.where(F.col("batch_id") == batch_id)
    return captures.join(members.select(key), key, "left_semi")


def filter_captures(
    captures: DataFrame, items: DataFrame | None = None, *, status: str | None = None,
    station_id: str | None = None, capture_id: str | None = None, source_batch_id=None,
) -> DataFrame:
    """Optional predicates of the listing; a blank value means no filter."""
    if status and status not in K.CAPTURE_STATUSES:
        raise ValueError("status must be received, processed or failed")
    out = captures
    if status:
        out = out.where(F.col("status") == status)
    if station_id:
        out = out.where(F.col("station_id") == station_id)
    if capture_id:
        out = out.where(F.contains(F.lower(F.col("capture_id").cast("string")), F.lit(capture_id.lower())))
    if source_batch_id not in (None, ""):
        if items is None:
            raise ValueError("batch filter needs the batch items")
        out = in_batch(out, items, source_batch_id)
    return out


def capture_summary(
    captures: DataFrame, images: DataFrame, objects: DataFrame, corrections: DataFrame, items: DataFrame,
    corrected_objects: str | None = None, key: str = "capture_id",
) -> DataFrame:
    """Captures with image count, object count, correction flag and source batch.

    Every side is reduced to one row per capture before it is joined, so no
    join fans out.  With ``corrected_objects`` (a column of the corrections)
    the object count of a corrected capture is the corrected one.
    """
    n_images = images.groupBy(key).agg(F.count(F.lit(1)).alias("image_count"))
    n_objects = objects.groupBy(key).agg(F.count(F.lit(1)).alias("object_count"))
    fixes = latest_correction(corrections, [corrected_objects] if corrected_objects else ["id"], key)
    fixes = fixes.select(key, F.lit(True).alias("manually_corrected"), *([corrected_objects] if corrected_objects else []))
    out = (
        captures.join(n_images, key, "left").join(n_objects, key, "left")
        .join(fixes, key, "left").join(source_batch(items, key), key, "left")
    )
    count = F.coalesce("object_count", F.lit(0))
    if corrected_objects:
        count = F.when(F.col("manually_corrected"), F.coalesce(F.col(corrected_objects), F.lit(0))).otherwise(count)
    return out.select(
        *captures.columns, "source_batch_id",
        F.coalesce("image_count", F.lit(0)).cast("bigint").alias("image_count"),
        count.cast("bigint").alias("object_count"),
        F.coalesce("manually_corrected", F.lit(False)).alias("manually_corrected"),
    )


def capture_page(listing: DataFrame, limit: int = 50, offset: int = 0, key: str = "capture_id") -> DataFrame:
    """One page, newest first by the *text* of the capture time (id breaks the remaining ties)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if offset < 0:
        raise ValueError("offset cannot be negative")
    ordered = listing.orderBy(F.desc("capture_time"), F.desc("received_at"), F.asc(key))
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def listing_page(
    captures: DataFrame, images: DataFrame, objects: DataFrame, corrections: DataFrame, items: DataFrame,
    limit: int = 50, offset: int = 0, corrected_objects: str | None = None, key: str = "capture_id",
) -> DataFrame:
    """One page of the listing: the page is taken first, then only its captures are summarised.

    The sort columns belong to the captures alone, and a page has 500 rows at most, so its keys
    are broadcast to the other sides, whose rows of other captures are dropped before any shuffle.
    """
    page = capture_page(captures, limit, offset, key)
    keys = F.broadcast(page.select(key))
    sides = [side.join(keys, key, "left_semi") for side in (images, objects, corrections, items)]
    return capture_page(capture_summary(page, *sides, corrected_objects=corrected_objects, key=key), limit, 0, key)


def capture_total(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("total"))



# --- export and documents ---------------------------------------------------------------------------

def export_rows(captures: DataFrame, objects: DataFrame, key: str = "capture_id") -> DataFrame:
    """One row per object with its capture columns; a capture without objects keeps one row.

    The objects are the row side of the join, so a capture holding very many
    of them is spread instead of being matched on one reducer.
    """
    sizes = objects.groupBy(key).agg(F.count(F.lit(1)).alias("_objects"))
    owners = captures.join(sizes, key, "left")
    with_objects = spread_join(objects, owners.where(F.col("_objects") > 0), [key], "_objects", how="inner")
    empty = owners.where(F.col("_objects").isNull()).drop("_objects")
    return with_objects.drop("_objects").unionByName(empty, allowMissingColumns=True)


def export_documents(results: DataFrame, *extra: str) -> DataFrame:
    """Flattened export from result documents: effective objects exploded, pose flattened, ``extra`` columns last."""
    exploded = results.select("*", F.posexplode_outer("objects").alias("object_index", "object"))
    return exploded.select(
        "capture_id", "capture_time", "received_at", "station_id", "camera_id", "source_batch_id", "status",
        F.col("robot_pose.frame").alias("pose_frame"), F.col("robot_pose.x_m").alias("pose_x_m"),
        F.col("robot_pose.y_m").alias("pose_y_m"), F.col("robot_pose.yaw_deg").alias("pose_yaw_deg"),
        "manually_corrected", "object_index",
        F.col("object.type").alias("object_type"), F.col("object.class").alias("class"),
        F.col("object.class_cn").alias("class_cn"), F.col("object.confidence").alias("confidence"),
        F.col("object.bbox_xyxy").alias("bbox_xyxy"), F.to_json("object").alias("object_json"), "error", *extra,
    )


def document_rows(captures: DataFrame, images: DataFrame, corrections: DataFrame, key: str = "capture_id") -> DataFrame:
    """All capture documents as rows (key, part, ordinal, payload): header, images, correction audit.

    The row form never gathers a capture's audit in one place; sorted by
    (key, part, ordinal) it reads like the nested document.
    """
    def rows(df: DataFrame, part: str, ordinal: Column) -> DataFrame:
        payload = F.to_json(F.struct(*[c for c in df.columns if c != key]))
        return df.select(key, F.lit(part).alias("part"), ordinal.cast("bigint").alias("ordinal"), payload.alias("payload"))
    return (
        rows(captures, "capture", F.lit(0))
        .unionByName(rows(images, "image", F.col("position")))
        .unionByName(rows(corrections, "correction", F.col("id")))
    )


def get_capture(
    capture_id, captures: DataFrame, images: DataFrame, corrections: DataFrame, items: DataFrame, key: str = "capture_id",
) -> DataFrame:
    """Nested document of one requested capture; the key filter reaches every scan."""
    def one(df: DataFrame) -> DataFrame:
        return df.where(F.col(key) == capture_id)
    pictures = one(images).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *[
        c for c in images.columns if c not in (key, "position")]))).alias("images"))
    audit = one(corrections).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", *[
        c for c in corrections.columns if c not in (key, "id")]))).alias("corrections"))
    return (
        one(captures).join(pictures, key, "left").join(audit, key, "left")
        .join(source_batch(one(items), key), key, "left")
    )


# --- keyed lookups ------------------------------------------------------------------------------------

def lookup_rows(df: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values; parquet statistics prune the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def ordered_image_paths(images: DataFrame, capture_id, path: str = "path") -> DataFrame:
    return lookup_rows(images, capture_id=capture_id).orderBy("position").select("position", path)


# --- dimension lookups ----------------------------------------------------------------------------------

def with_location(captures: DataFrame, stations: DataFrame) -> DataFrame:
    """Configured location name, default ``<id>号区段``; the station table is tiny and auto-broadcast."""
    names = stations.select("station_id", "location_name")
    return captures.join(names, "station_id", "left").withColumn(
        "location_text", F.coalesce("location_name", F.concat(F.col("station_id"), F.lit("号区段")))
    ).drop("location_name")


def with_pointer_reference(meters: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Reference of a meter: first exact class at its station, else the last class-less entry.

    ``references`` has station_id, class, ord (configuration order) and payload
    columns; it is reduced to one entry per (station, class) before the joins.
    """
    payload = [c for c in references.columns if c not in ("station_id", "class", "ord")]
    body = F.struct(*payload)
    exact = references.where(F.col("class").isNotNull()).groupBy("station_id", F.col("class").alias("class_id")).agg(
        F.min_by(body, F.col("ord")).alias("_exact")
    )
    general = references.where(F.col("class").isNull()).groupBy("station_id").agg(
        F.max_by(body, F.col("ord")).alias("_general")
    )
    joined = meters.join(exact, ["station_id", "class_id"], "left").join(general, "station_id", "left")
    picked = joined.withColumn("_ref", F.coalesce("_exact", "_general"))
    return picked.select(
        *keys, *[c for c in meters.columns if c not in keys],
        *[F.col(f"_ref.{c}").alias(c) for c in payload], F.col("_ref").isNotNull().alias("has_reference"),
    )
