"""Recognition modules and the capture summary.

Two shapes are offered: expressions over the object array of one stored result
document (no shuffle), and relational forms over object rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions.meters import normal_confidence
from seamwatch.functions.text import lookup
from seamwatch.skew import small_side

TOOL_TYPES = ("tool", "safety_sign")


def module_result(**values: Column) -> Column:
    """Module result struct; unnamed fields are null."""
    kinds = {
        "enabled": "boolean", "status": "string", "number": "int", "raw_text": "string", "value": "double",
        "present": "boolean", "labels": "array<string>", "meters": "int", "confidence": "double",
        "votes": "bigint", "source": "string", "reason": "string",
    }
    return F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _disabled() -> Column:
    return module_result(enabled=F.lit(False), status=F.lit("disabled"))


# --- document form ------------------------------------------------------------------------------

def coal_presence(objects: Column, configured: Column, enabled: bool = True) -> Column:
    """Presence of a coal pile; without a detector the answer is unknown, never "absent"."""
    if not enabled:
        return _disabled()
    found = F.exists(objects, lambda o: o["type"] == "coal_pile")
    return F.when(
        configured, module_result(enabled=F.lit(True), status=F.lit("confirmed"), present=found)
    ).otherwise(module_result(enabled=F.lit(True), status=F.lit("unavailable"), reason=F.lit("coal_detector_not_configured")))


def tool_and_safety_sign(objects: Column, enabled: bool = True) -> Column:
    if not enabled:
        return _disabled()
    hits = F.filter(objects, lambda o: o["type"].isin(*TOOL_TYPES))
    labels = F.transform(hits, lambda o: F.coalesce(
        F.nullif(o["class_cn"], F.lit("")), F.nullif(o["class"], F.lit("")), o["type"]))
    return module_result(enabled=F.lit(True), status=F.lit("confirmed"), labels=labels)


def analog_meter(objects: Column, enabled: bool = True) -> Column:
    if not enabled:
        return _disabled()
    hits = F.filter(objects, lambda o: o["type"] == "analog_meter")
    return module_result(enabled=F.lit(True), status=F.lit("confirmed"), meters=F.size(hits))


def station_from_metadata(station_id: Column, allowed: Sequence[int] = K.ALLOWED_STATIONS, enabled: bool = True) -> Column:
    """Station number taken from the capture metadata."""
    if not enabled:
        return _disabled()
    number = F.trim(station_id).try_cast("int")
    yes = F.lit(True)
    return (
        F.when(number.isNull(), module_result(enabled=yes, status=F.lit("unavailable"), reason=F.lit("station_id_is_not_numeric")))
        .when(~number.isin(*allowed), module_result(enabled=yes, status=F.lit("unavailable"), reason=F.lit("station_number_outside_allowed_range")))
        .otherwise(module_result(enabled=yes, status=F.lit("confirmed"), number=number, source=F.lit("capture_metadata")))
    )


def best_marker(objects: Column) -> Column:
    """Box of the most confident valid station marker of a document (first one on ties), or null."""
    valid = F.filter(
        objects,
        lambda o: ((o["type"] == "station_marker") | (o["class"] == "station_marker"))
        & (o["bbox"]["x2"] > o["bbox"]["x1"]) & (o["bbox"]["y2"] > o["bbox"]["y1"]),
    )
    best = F.aggregate(
        valid, F.get(valid, F.lit(0)),
        lambda top, o: F.when(
            F.coalesce(o["confidence"], F.lit(0.0)) > F.coalesce(top["confidence"], F.lit(0.0)), o
        ).otherwise(top),
    )
    return best["bbox"]


def best_marker_rows(objects: DataFrame, order: Sequence[str], key: str = "capture_id") -> DataFrame:
    """Relational form of :func:`best_marker`."""
    valid = objects.where(
        ((F.col("object_type") == "station_marker") | (F.col("class_id") == "station_marker"))
        & (F.col("bbox.x2") > F.col("bbox.x1")) & (F.col("bbox.y2") > F.col("bbox.y1"))
    )
    rank = F.struct(-F.coalesce(F.col("confidence"), F.lit(0.0)), *[F.col(o) for o in order])
    return valid.groupBy(key).agg(F.min_by("bbox", rank).alias("bbox"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def run_modules(document: DataFrame, modules: Mapping[str, Column]) -> DataFrame:
    """Module results of a document as an ordered array of (module_id, result)."""
    entries = [F.struct(F.lit(name).alias("module_id"), result.alias("result")) for name, result in modules.items()]
    return document.withColumn("modules", F.array(*entries))


def describe_modules(
    spark: SparkSession, config: Mapping[str, Mapping], detector_configured: bool, trained: Sequence[str] = (),
) -> DataFrame:
    """Readiness of every module as rows, in the fixed module order."""
    rows = []
    for order, name in enumerate(K.MODULE_NAMES):
        entry = config.get(name, {})
        enabled = bool(entry.get("enabled", True))
        rows.append((
            order, name, enabled, entry.get("reason"), entry.get("recognition_mode", "image_classifier"), name in trained,
        ))
    table = spark.createDataFrame(
        rows, "ord int, module_id string, enabled boolean, note string, mode string, trained boolean"
    )
    return readiness(table, F.lit(detector_configured)).orderBy("ord").drop("ord")


def readiness(table: DataFrame, detector_configured: Column) -> DataFrame:
    """Status and reason per configured module row (module_id, enabled, note, mode, trained)."""
    m = F.col("module_id")
    noted = m.isin("tool_and_safety_sign", "analog_meter") & F.col("note").isNotNull()
    untrained_meter = (m == "digital_meter") & ~F.col("trained")
    no_coal = (m == "coal_presence") & ~detector_configured
    classifier = F.col("mode") == "image_classifier"
    untrained_station = (m == "station_number") & classifier & ~F.col("trained")
    metadata_only = (m == "station_number") & ~classifier
    status = (
        F.when(~F.col("enabled"), "disabled")
        .when(noted | untrained_meter | no_coal | untrained_station, "unavailable")
        .when(metadata_only, "metadata_only").otherwise("ready")
    )
    reason = (
        F.when(~F.col("enabled"), F.coalesce("note", F.lit("disabled_by_configuration")))
        .when(noted, F.col("note")).when(untrained_meter, "digital_meter_model_not_trained")
        .when(no_coal, "coal_detector_not_configured")
        .when(untrained_station, "station_image_classifier_not_trained")
        .when(metadata_only, "station_number_uses_capture_metadata")
    )
    keep = [c for c in table.columns if c not in ("note", "mode", "trained", "status", "reason")]
    return table.select(*keep, status.alias("status"), reason.alias("reason"))


# --- relational form -------------------------------------------------------------------------------

def presence_rows(captures: DataFrame, objects: DataFrame, key: str = "capture_id", configured: bool = True) -> DataFrame:
    """Coal, tool/sign and analog-meter module verdicts for every capture from object rows."""
    kind = F.col("object_type")
    counts = objects.groupBy(key).agg(
        F.count_if(kind == "coal_pile").alias("coal"), F.count_if(kind.isin(*TOOL_TYPES)).alias("tools"),
        F.count_if(kind == "analog_meter").alias("analog"),
    )
    out = captures.join(counts, key, "left")
    coal = F.coalesce("coal", F.lit(0)) > 0
    return out.select(
        *captures.columns,
        F.lit("confirmed" if configured else "unavailable").alias("coal_status"),
        (coal if configured else F.lit(None).cast("boolean")).alias("coal_present"),
        F.coalesce("tools", F.lit(0)).cast("bigint").alias("tool_count"),
        F.coalesce("analog", F.lit(0)).cast("bigint").alias("analog_count"),
    )


# --- class mapping -----------------------------------------------------------------------------------

def map_classes(detections: DataFrame, classes: DataFrame, label: str = "model_label") -> DataFrame:
    """Model label -> type, class id, display name; unsure tools become ``unknown_tool``.

    ``classes``: label, id, type, name_cn, min_confidence - a configuration
    table, broadcast after a check of its size.
    """
    table = classes.select(
        F.col("label").alias(label), F.col("id").alias("_id"), F.col("type").alias("_type"),
        F.col("name_cn").alias("_name"), F.col("min_confidence").alias("_min"),
    )
    joined = detections.join(small_side(table), label, "left")
    prefix = F.substring_index(F.col(label), "_", 1)
    kind = F.coalesce("_type", prefix)
    class_id = F.coalesce("_id", F.col(label))
    unsure = (kind == "tool") & (F.col("confidence") < F.coalesce("_min", F.lit(0.0)))
    return joined.select(
        *detections.columns,
        kind.alias("type"),
        F.when(unsure, "unknown_tool").otherwise(class_id).alias("class_id"),
        F.when(unsure, "未知工具").otherwise(F.coalesce("_name", class_id)).alias("class_cn"),
        F.when(unsure, class_id).alias("predicted_class"),
    )


# --- summary --------------------------------------------------------------------------------------------

def detector_source(mode: Column, corrected: Column) -> Column:
    """Source id of the detected objects."""
    return (
        F.when(corrected, "manual_review").when(mode == "gpu", "yolo")
        .when(mode == "json_replay", "json_replay").otherwise("detector")
    )


def module_display(module_id: Column, r: Column) -> Column:
    """Text shown for a confirmed module result."""
    tools = F.coalesce(r["labels"], F.array().cast("array<string>"))
    meters = F.coalesce(r["meters"], F.lit(0))
    reading = F.coalesce(r["raw_text"], r["value"].cast("string"))
    return (
        F.when(module_id == "station_number", F.coalesce(F.concat(r["number"].cast("string"), F.lit(" 号")), F.lit(K.NOT_RECOGNIZED)))
        .when(module_id == "digital_meter", F.coalesce(reading, F.lit(K.NOT_RECOGNIZED)))
        .when(module_id == "coal_presence", F.when(r["present"], "检测到煤堆").otherwise("未检测到煤堆"))
        .when(module_id == "tool_and_safety_sign", F.when(F.size(tools) > 0, F.array_join(tools, "、")).otherwise("未检测到工具 / 安全标牌"))
        .when(module_id == "analog_meter", F.when(meters > 0, F.concat(F.lit("识别到 "), meters.cast("string"), F.lit(" 个指针表"))).otherwise("未检测到指针表"))
        .otherwise(F.coalesce(r["raw_text"], r["number"].cast("string"), r["value"].cast("string"), r["present"].cast("string"), F.lit("识别完成")))
    )


def object_items(objects: Column, source: Column, corrected: Column) -> Column:
    """Summary items of the objects of a document."""
    def item(o: Column, i: Column) -> Column:
        empty = F.lit("")
        kind, cls = F.nullif(o["type"], empty), F.nullif(o["class"], empty)
        label = F.coalesce(F.nullif(o["class_cn"], empty), cls, kind, F.concat(F.lit("目标 "), (i + 1).cast("string")))
        class_id = F.coalesce(cls, kind, F.lit("unknown"))
        return _item(
            source, F.when(corrected, "recognized").otherwise("detected"),
            F.when(corrected, "manually_confirmed").otherwise("detected"),
            F.coalesce(kind, class_id), label, label, normal_confidence(o["confidence"]), F.lit(None).cast("string"),
        )
    return F.transform(objects, item)


def module_items(modules: Column) -> Column:
    """Summary items of the enabled modules of a document, in module order."""
    shown = F.filter(modules, lambda m: ~((m["result"]["status"] == "disabled") | (m["result"]["enabled"] == F.lit(False))))

    def item(m: Column) -> Column:
        r, mid = m["result"], m["module_id"]
        ok = r["status"] == "confirmed"
        name = F.coalesce(lookup(K.MODULE_NAMES, mid), mid)
        return _item(
            mid, F.when(ok, "recognized").otherwise("unrecognized"), F.coalesce(r["status"], F.lit("unknown")), mid, name,
            F.when(ok, module_display(mid, r)).otherwise(K.NOT_RECOGNIZED), normal_confidence(r["confidence"]), r["reason"],
        )
    return F.transform(shown, item)


def _item(source, status, raw_status, result_type, label, display, confidence, reason) -> Column:
    names = ("source_id", "status", "raw_status", "result_type", "label", "display_value", "confidence", "reason")
    return F.struct(*[v.alias(n) for n, v in zip(names, (source, status, raw_status, result_type, label, display, confidence, reason))])


def summarize_documents(documents: DataFrame) -> DataFrame:
    """Summary of result documents (status, error, objects, modules, detector_mode, manually_corrected)."""
    source = detector_source(F.col("detector_mode"), F.col("manually_corrected"))
    items = F.concat(
        object_items(F.col("objects"), source, F.col("manually_corrected")), module_items(F.col("modules"))
    )
    open_ = F.col("status").isin("received", "failed")
    with_items = documents.withColumn("items", F.when(~open_, items))
    good = F.filter("items", lambda i: i["status"] != "unrecognized")
    bad = F.filter("items", lambda i: i["status"] == "unrecognized")
    first = F.aggregate(
        good, F.get(good, F.lit(0)),
        lambda top, i: F.when(source_priority(i["source_id"]) < source_priority(top["source_id"]), i).otherwise(top),
    )
    return with_items.withColumn("summary_status", summary_status(F.col("status"), F.size(good), F.size(bad))).withColumn(
        "primary", F.when(~open_, first)
    )


def source_priority(source_id: Column) -> Column:
    return F.coalesce(lookup(K.PRIMARY_PRIORITY, source_id), F.lit(K.OTHER_PRIORITY))


def summary_status(capture_status: Column, good: Column, bad: Column) -> Column:
    return (
        F.when(capture_status == "received", "processing").when(capture_status == "failed", "failed")
        .when((good > 0) & (bad > 0), "partial").when(good > 0, "recognized").otherwise("unrecognized")
    )


def summarize_rows(captures: DataFrame, items: DataFrame, key: str = "capture_id") -> DataFrame:
    """Relational summary: captures (key, status, ...) and item rows (key, kind, ord, source_id, status, display_value, confidence).

    ``ord`` is any orderable value; objects (kind 0) come before modules (kind 1).
    One aggregate per capture, partial on the map side.
    """
    good = F.col("status") != "unrecognized"
    rank = F.struct(source_priority(F.col("source_id")).alias("p"), F.col("kind"), F.col("ord"))
    stats = items.groupBy(key).agg(
        F.count_if(good).alias("_good"), F.count_if(~good).alias("_bad"),
        F.min_by(F.struct("source_id", "display_value", "confidence"), F.when(good, rank)).alias("_p"),
    )
    joined = captures.join(stats, key, "left")
    closed = ~F.col("status").isin("received", "failed")
    zero = F.lit(0)
    g, b = F.coalesce("_good", zero), F.coalesce("_bad", zero)
    return joined.select(
        *captures.columns, summary_status(F.col("status"), g, b).alias("summary_status"),
        F.when(closed, g + b).otherwise(zero).cast("bigint").alias("item_count"),
        F.when(closed, F.col("_p.source_id")).alias("primary_source"),
        F.when(closed, F.col("_p.display_value")).alias("primary_value"),
        F.when(closed, F.col("_p.confidence")).alias("primary_confidence"),
    )
