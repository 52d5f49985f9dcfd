"""Queries over captures, results, corrections and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch import adapters as A
from seamwatch.functions import text as X
from seamwatch.operators import batches as B
from seamwatch.operators import captures as C
from seamwatch.operators import validate as V
from seamwatch.plans.registry import CAPTURES_SQL, CORRECTIONS_SQL, ITEMS_SQL, OBJECTS_SQL, query
from seamwatch.sinks import tables as sinks
from seamwatch.skew import number_rows

_LISTING_SQL = f"""WITH {CAPTURES_SQL}, {OBJECTS_SQL}, {CORRECTIONS_SQL}, {ITEMS_SQL},
n_objects AS (SELECT capture_id, count(*) AS n FROM objects GROUP BY 1),
fixes AS (SELECT capture_id, arg_max(corrected_objects, id) AS corrected_objects FROM corrections WHERE active GROUP BY 1),
source AS (SELECT capture_id, min(batch_id) AS source_batch_id FROM items WHERE status = 'succeeded' GROUP BY 1),
listing AS (
  SELECT c.capture_id, capture_time, received_at, station_id, status, source_batch_id,
         CAST(o_custkey % 5 + 1 AS BIGINT) AS image_count,
         CAST(CASE WHEN f.capture_id IS NOT NULL THEN f.corrected_objects ELSE coalesce(n.n, 0) END AS BIGINT) AS object_count,
         f.capture_id IS NOT NULL AS manually_corrected
  FROM captures c LEFT JOIN n_objects n USING (capture_id) LEFT JOIN fixes f USING (capture_id) LEFT JOIN source USING (capture_id))
"""
_LISTED = ("capture_id", "capture_time", "received_at", "station_id", "status", "source_batch_id",
           "image_count", "object_count", "manually_corrected")


def _sides(spark: SparkSession, d: str) -> list[DataFrame]:
    return [side(spark, d) for side in (A.images, A.raw_objects, A.corrections, A.batch_items)]


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return C.capture_summary(A.captures(spark, d), *_sides(spark, d), corrected_objects="corrected_objects").select(*_LISTED)


@query(_LISTING_SQL + "SELECT * FROM listing ORDER BY capture_time DESC, received_at DESC, capture_id LIMIT 50")
def capture_list(spark: SparkSession, d: str) -> DataFrame:
    return C.listing_page(A.captures(spark, d), *_sides(spark, d), corrected_objects="corrected_objects").select(*_LISTED)


@query(_LISTING_SQL + "SELECT * FROM listing")
def capture_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d)


@query(_LISTING_SQL + """SELECT * FROM listing WHERE status = 'processed' AND station_id = '3'
ORDER BY capture_time DESC, received_at DESC, capture_id LIMIT 25 OFFSET 10""")
def capture_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    captures = C.filter_captures(A.captures(spark, d), status="processed", station_id="3")
    return C.listing_page(captures, *_sides(spark, d), limit=25, offset=10, corrected_objects="corrected_objects").select(*_LISTED)


@query(f"WITH {CAPTURES_SQL} SELECT count(*) AS total FROM captures WHERE contains(lower(CAST(capture_id AS VARCHAR)), '77')")
def capture_search_total(spark: SparkSession, d: str) -> DataFrame:
    return C.capture_total(C.filter_captures(A.captures(spark, d), capture_id="77"))


@query(f"""WITH {CAPTURES_SQL}, {CORRECTIONS_SQL},
latest AS (SELECT capture_id, max(id) AS correction_id, arg_max(corrected_json, id) AS corrected_json FROM corrections WHERE active GROUP BY 1)
SELECT c.capture_id, coalesce(corrected_json, 'model:' || status) AS effective, correction_id IS NOT NULL AS manually_corrected
FROM captures c LEFT JOIN latest USING (capture_id)""")
def effective_result(spark: SparkSession, d: str) -> DataFrame:
    captures = A.captures(spark, d).withColumn("result", F.concat(F.lit("model:"), F.col("status")))
    return C.effective_result(captures, A.corrections(spark, d), "result", "corrected_json").select(
        "capture_id", "effective", "manually_corrected")


@query(f"""WITH {CORRECTIONS_SQL},
newest AS (SELECT capture_id, max(id) AS newest FROM corrections GROUP BY 1),
reprocessed AS (SELECT user_id + 1 AS capture_id, max(ts) AS redone FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT id, c.capture_id, (id = newest AND (redone IS NULL OR created_at > redone)) AS active
FROM corrections c JOIN newest USING (capture_id) LEFT JOIN reprocessed USING (capture_id)""")
def correction_activity(spark: SparkSession, d: str) -> DataFrame:
    log = A.corrections(spark, d)
    reprocessed = log.where(~F.col("active")).select("capture_id", F.col("created_at").alias("at"))
    return C.active_corrections(log, reprocessed).select("id", "capture_id", "active")


@query(f"""WITH {CAPTURES_SQL}, {OBJECTS_SQL}
SELECT c.capture_id, capture_time, station_id, status, object_index, object_type, class_id, confidence
FROM captures c LEFT JOIN objects o USING (capture_id)""")
def export_flat(spark: SparkSession, d: str) -> DataFrame:
    captures = A.captures(spark, d).select("capture_id", "capture_time", "station_id", "status")
    objects = A.objects(spark, d).select("capture_id", "object_index", "object_type", "class_id", "confidence")
    return C.export_rows(captures, objects)


@query(f"""WITH {CAPTURES_SQL}, {OBJECTS_SQL}, {CORRECTIONS_SQL}, {ITEMS_SQL},
fix AS (SELECT capture_id, arg_max(corrected_objects, id) AS n FROM corrections WHERE active GROUP BY 1),
source AS (SELECT capture_id, min(batch_id) AS source_batch_id FROM items WHERE status = 'succeeded' GROUP BY 1),
effective AS (
  SELECT capture_id, CAST(object_index AS INTEGER) AS object_index, object_type, class_id AS class, confidence, x1
  FROM objects WHERE capture_id NOT IN (SELECT capture_id FROM fix)
  UNION ALL
  SELECT capture_id, CAST(i AS INTEGER), 'manual', 'c' || i, 1.0, i * 10.0 FROM (SELECT capture_id, unnest(range(n)) AS i FROM fix))
SELECT capture_id, source_batch_id, status, 'map' AS pose_frame, x_m AS pose_x_m, fix.capture_id IS NOT NULL AS manually_corrected,
  object_index, object_type, class, confidence, x1,
  CASE WHEN fix.capture_id IS NOT NULL THEN 'low_light,manually_corrected' ELSE 'low_light' END AS warnings
FROM captures LEFT JOIN fix USING (capture_id) LEFT JOIN source USING (capture_id) LEFT JOIN effective USING (capture_id)""")
def export_effective(spark: SparkSession, d: str) -> DataFrame:
    """The flat export of effective results: corrected objects in place of detected ones, pose flattened."""
    key = "capture_id"
    found = F.struct(
        F.col("object_type").alias("type"), F.col("class_id").alias("class"), F.lit(None).cast("string").alias("class_cn"), "confidence",
        F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2").alias("bbox_xyxy"))
    detected = A.objects(spark, d).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("object_index", found.alias("o")))).alias("found"))
    manual = F.transform(F.sequence(F.lit(1), F.col("corrected_objects")), lambda i: F.struct(
        F.lit("manual").alias("type"), F.concat(F.lit("c"), (i - 1).cast("string")).alias("class"), F.lit(None).cast("string").alias("class_cn"),
        F.lit(1.0).alias("confidence"), F.array((i - 1) * 10.0, F.lit(0.0), i * 10.0, F.lit(9.0)).alias("bbox_xyxy")))
    fixes = C.latest_correction(A.corrections(spark, d), ["corrected_objects"]).select(key, "corrected_objects", F.lit(True).alias("fixed"))
    rows = (A.captures(spark, d).join(detected, key, "left").join(fixes, key, "left")
            .join(C.source_batch(A.batch_items(spark, d)), key, "left"))
    plain = F.struct(F.transform("found", lambda x: x["o"]).alias("objects"), F.array(F.lit("low_light")).alias("warnings"))
    corrected = V.merge_correction(F.when(F.col("corrected_objects") > 0, manual).otherwise(F.slice(manual, 1, 0)), F.array(F.lit("low_light")))
    results = rows.withColumn("result", F.when(F.col("fixed"), corrected).otherwise(plain)).select(
        *rows.columns, F.struct(F.lit("map").alias("frame"), "x_m", F.lit(None).cast("double").alias("y_m"), F.lit(None).cast("double").alias("yaw_deg")).alias("robot_pose"),
        F.coalesce("fixed", F.lit(False)).alias("manually_corrected"), "result.objects", "result.warnings")
    return C.export_documents(results, "warnings").select(
        key, "source_batch_id", "status", "pose_frame", "pose_x_m", "manually_corrected", "object_index", "object_type", "class", "confidence",
        F.get("bbox_xyxy", F.lit(0)).alias("x1"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {OBJECTS_SQL} SELECT capture_id, l_linenumber AS line, l_partkey AS part, CAST(object_index AS BIGINT) AS object_index FROM objects""")
def object_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return A.objects(spark, d, "sampled").select("capture_id", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "object_index")


@query(f"""WITH {CAPTURES_SQL}, {ITEMS_SQL}
SELECT c.capture_id, min(i.batch_id) AS source_batch_id FROM captures c JOIN items i USING (capture_id)
WHERE i.status = 'succeeded' GROUP BY 1""")
def capture_source_batch(spark: SparkSession, d: str) -> DataFrame:
    return A.captures(spark, d).select("capture_id").join(C.source_batch(A.batch_items(spark, d)), "capture_id")


@query(f"""WITH {CAPTURES_SQL}, {ITEMS_SQL}
SELECT capture_id, status FROM captures c
WHERE EXISTS (SELECT 1 FROM items i WHERE i.capture_id = c.capture_id AND i.batch_id = 7 AND i.status = 'succeeded')""")
def captures_of_batch(spark: SparkSession, d: str) -> DataFrame:
    return C.in_batch(A.captures(spark, d), A.batch_items(spark, d), 7).select("capture_id", "status")


@query("SELECT DISTINCT l_orderkey AS capture_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def new_captures(spark: SparkSession, d: str) -> DataFrame:
    incoming = A.raw_objects(spark, d).select("capture_id").distinct()
    return C.new_captures(incoming, A.captures(spark, d).where("status = 'processed'"))


@query("SELECT DISTINCT l_orderkey AS capture_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def replayed_captures(spark: SparkSession, d: str) -> DataFrame:
    incoming = A.raw_objects(spark, d).select("capture_id").distinct()
    return C.replayed_captures(incoming, A.captures(spark, d).where("status = 'processed'"))


@query("""WITH img AS (SELECT o_orderkey AS capture_id, o_orderpriority, unnest(range(1, o_custkey % 5 + 2)) AS position, o_custkey % 5 + 1 AS n FROM orders),
new AS (SELECT o_orderkey AS capture_id,
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' ELSE 'go2_front' END AS camera,
   CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS drop_last,
   CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_custkey % 5 + 1 END AS changed, o_custkey % 5 + 1 AS n FROM orders)
SELECT capture_id,
  CASE WHEN camera <> 'go2_front' THEN 'different metadata' WHEN drop_last = 1 THEN 'different number of images'
       WHEN changed IS NOT NULL THEN 'different image content' END AS conflict,
  CAST(CASE WHEN camera = 'go2_front' AND drop_last = 0 THEN changed END AS INTEGER) AS position
FROM new WHERE camera <> 'go2_front' OR drop_last = 1 OR changed IS NOT NULL""")
def replay_conflicts(spark: SparkSession, d: str) -> DataFrame:
    stored = A.captures(spark, d)
    images = A.images(spark, d)
    p = F.col("received_at")
    incoming = stored.withColumn("camera_id", F.when(p == "1-URGENT", "x").otherwise(F.col("camera_id")))
    counts = images.groupBy("capture_id").agg(F.max("position").alias("n"))
    sent = images.join(stored.select("capture_id", "received_at"), "capture_id").join(counts, "capture_id")
    last = F.col("position") == F.col("n")
    sent = sent.where(~((p == "2-HIGH") & last)).withColumn(
        "sha256", F.when((p == "3-MEDIUM") & last, "changed").otherwise(F.col("sha256")))
    return C.replay_conflicts(incoming, stored, sent, images, ["capture_time", "station_id", "camera_id"])


@query("""SELECT o_orderkey AS capture_id, o_orderdate AS t FROM orders
WHERE o_orderkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def surviving_captures(spark: SparkSession, d: str) -> DataFrame:
    tombstones = A.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("capture_id"))
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_orderdate").alias("t"))
    return C.delete_captures(rows, tombstones)


@query(f"""WITH {CAPTURES_SQL}, {CORRECTIONS_SQL},
img AS (SELECT o_orderkey AS capture_id, unnest(range(1, o_custkey % 5 + 2)) AS position FROM orders)
SELECT capture_id, 'capture' AS part, CAST(0 AS BIGINT) AS ordinal,
  '{{"capture_time":"' || capture_time || '","received_at":"' || received_at || '","station_id":"' || station_id || '","camera_id":"go2_front","status":"' || status || '"'
  || CASE WHEN status = 'failed' THEN ',"error":"error ' || received_at || '"' ELSE '' END || '}}' AS payload FROM captures
UNION ALL SELECT capture_id, 'image', position, '{{"position":' || position || ',"sha256":"' || sha256(capture_id || ':' || position) || '"}}' FROM img
UNION ALL SELECT capture_id, 'correction', id, '{{"id":' || id || ',"active":' || active || ',"operator":"' || operator || '","corrected_json":"'
  || replace(replace(corrected_json, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '","corrected_objects":' || corrected_objects || '}}' FROM corrections""")
def capture_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.document_rows(A.captures(spark, d).drop("x_m"), A.images(spark, d), A.corrections(spark, d).drop("created_at"))


@query("""SELECT o_orderkey AS capture_id, CAST(position AS INTEGER) AS position, sha256(o_orderkey || ':' || position) AS sha256
FROM (SELECT o_orderkey, unnest(range(1, o_custkey % 5 + 2)) AS position FROM orders WHERE o_orderkey = 42)""")
def image_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_image_paths(A.images(spark, d), 42, "sha256").withColumn("capture_id", F.lit(42).cast("bigint"))


@query(f"""WITH {CAPTURES_SQL} SELECT capture_id, coalesce(CASE station_id WHEN '7' THEN '07号区段' WHEN '8' THEN '08号区段' END, station_id || '号区段') AS location_text FROM captures""")
def station_location(spark: SparkSession, d: str) -> DataFrame:
    stations = spark.createDataFrame([("7", "07号区段"), ("8", "08号区段")], "station_id string, location_name string")
    return C.with_location(A.captures(spark, d), stations).select("capture_id", "location_text")


# --- results log and batches -----------------------------------------------------------------------------

@query("""SELECT user_id AS capture_id, max(event_id) AS version,
  arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'processed' END, event_id) AS status,
  arg_max(CASE WHEN event_type = 'error' THEN substr(props, 1, 2000) ELSE '' END, event_id) AS error
FROM events GROUP BY 1""")
def current_results(spark: SparkSession, d: str) -> DataFrame:
    log = A.table(spark, d, "events").select(
        F.col("user_id").alias("capture_id"), F.col("event_id").alias("version"), F.col("event_type"), F.col("props").alias("error"))
    failed = F.col("event_type") == "error"
    rows = sinks.result_log_rows(log.where(~failed)).unionByName(sinks.failure_log_rows(log.where(failed))).drop("event_type")
    return C.current_results(rows).withColumn("error", F.coalesce("error", F.lit("")))


@query("""SELECT user_id AS batch_id, lpad(CAST(event_id // 10 AS VARCHAR), CAST(greatest(12, length(CAST(event_id // 10 AS VARCHAR))) AS INTEGER), '0') AS relative_path,
  arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END, event_id) AS status,
  arg_max(CASE WHEN event_type = 'purchase' THEN event_id END, CASE WHEN event_type = 'purchase' THEN event_id END) AS capture_id
FROM events GROUP BY 1, 2""")
def item_status(spark: SparkSession, d: str) -> DataFrame:
    log = A.batch_items(spark, d).select(
        "batch_id", X.zero_pad(F.floor(F.col("relative_path").cast("bigint") / 10).cast("string"), 12).alias("relative_path"),
        F.col("relative_path").cast("bigint").alias("version"), "status", "error")
    kinds = A.table(spark, d, "events").select(F.col("event_id").alias("version"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("capture_id"))
    valid, _ = sinks.item_status_rows(log.join(kinds, "version"))
    return B.current_items(valid).drop("error")


@query(f"""WITH {ITEMS_SQL}, heads AS (SELECT DISTINCT batch_id FROM items WHERE batch_id NOT IN (SELECT s_suppkey FROM supplier))
SELECT batch_id, relative_path, CASE WHEN error IS NOT NULL THEN 'failed' ELSE 'pending' END AS status
FROM items WHERE batch_id IN (SELECT batch_id FROM heads)""")
def batch_registration(spark: SparkSession, d: str) -> DataFrame:
    items = A.batch_items(spark, d)
    registered = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("batch_id"))
    _, fresh = sinks.register_batches(items.select("batch_id").distinct(), items, registered)
    return fresh.select("batch_id", "relative_path", "status")


@query(f"""WITH {ITEMS_SQL} SELECT batch_id, count(*) AS capture_total,
  count(*) FILTER (status = 'succeeded') AS capture_succeeded, count(*) FILTER (status = 'failed') AS capture_failed
FROM items GROUP BY 1""")
def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.item_counts(A.batch_items(spark, d))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT batch_id, count(*) AS t, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'failed') AS f FROM items GROUP BY 1)
SELECT batch_id, t AS capture_total, s AS capture_succeeded, f AS capture_failed, CAST(greatest(0, t - s - f) AS BIGINT) AS capture_pending,
  CAST(round_even((s + f) * 100.0 / t, 1) AS DOUBLE) AS progress_percent FROM c""")
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return B.progress(B.item_counts(A.batch_items(spark, d)))


_WARN_SQL = "warn AS (SELECT user_id AS batch_id, count(*) AS w FROM events WHERE value > 95 GROUP BY 1)"


@query(f"""WITH {ITEMS_SQL}, {_WARN_SQL},
c AS (SELECT batch_id, count(*) AS t, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'failed') AS f FROM items GROUP BY 1)
SELECT batch_id, coalesce(w, 0) AS warning_count,
  CASE WHEN s = 0 AND f > 0 THEN 'failed' WHEN f > 0 OR coalesce(w, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
FROM c LEFT JOIN warn USING (batch_id)""")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    noise = A.table(spark, d, "events").where("value > 95").select(F.col("user_id").alias("batch_id"))
    return B.finish_batches(A.batch_items(spark, d), noise).select("batch_id", "warning_count", "status")


@query(f"""WITH {ITEMS_SQL} SELECT batch_id, arg_min(error, relative_path) AS first_item_error
FROM items WHERE status = 'failed' AND error IS NOT NULL GROUP BY 1""")
def first_item_error(spark: SparkSession, d: str) -> DataFrame:
    return B.first_item_error(A.batch_items(spark, d))


@query(f"""WITH {ITEMS_SQL}, {_WARN_SQL}, h AS (SELECT s_suppkey AS batch_id, s_name AS discovered_at FROM supplier),
c AS (SELECT batch_id, count(*) AS t, count(*) FILTER (status = 'succeeded') AS s, count(*) FILTER (status = 'failed') AS f,
        arg_min(error, relative_path) FILTER (status = 'failed' AND error IS NOT NULL) AS e FROM items GROUP BY 1)
SELECT batch_id, discovered_at, coalesce(t, 0) AS capture_total, coalesce(s, 0) AS capture_succeeded, coalesce(f, 0) AS capture_failed,
  CAST(coalesce(t - s - f, 0) AS BIGINT) AS capture_pending, coalesce(w, 0) AS warning_count, e AS first_item_error,
  CAST(coalesce(round_even((s + f) * 100.0 / t, 1), 0) AS DOUBLE) AS progress_percent
FROM h LEFT JOIN c USING (batch_id) LEFT JOIN warn USING (batch_id)""")
def batch_overview(spark: SparkSession, d: str) -> DataFrame:
    headers = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("batch_id"), F.col("s_name").alias("discovered_at"))
    noise = A.table(spark, d, "events").where("value > 95").select(F.col("user_id").alias("batch_id"))
    return B.batch_overview(headers, A.batch_items(spark, d), noise)


@query(f"WITH {ITEMS_SQL} SELECT batch_id, relative_path, capture_id FROM items WHERE status = 'pending'")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    return B.pending_items(A.batch_items(spark, d)).select("batch_id", "relative_path", "capture_id")


@query(f"""WITH {ITEMS_SQL} SELECT batch_id, relative_path, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
  CASE WHEN status <> 'failed' THEN error END AS error FROM items""")
def retry_items(spark: SparkSession, d: str) -> DataFrame:
    return B.retry_failed(A.batch_items(spark, d)).select("batch_id", "relative_path", "status", "error")


@query("""SELECT event_id AS row, e.user_id AS batch_id, scope FROM (
  SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'sensors' WHEN 'click' THEN 'gas' WHEN 'purchase' THEN 'thermal' ELSE 'items' END AS scope FROM events) e
JOIN supplier s ON s.s_suppkey = e.user_id
WHERE NOT (s_nationkey % 2 = 0 AND scope IN ('sensors', 'gas', 'thermal'))""")
def retry_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    scope = F.when(kind == "view", "sensors").when(kind == "click", "gas").when(kind == "purchase", "thermal").otherwise("items")
    headers = A.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("batch_id"), F.when(F.col("s_nationkey") % 2 == 0, "failed").otherwise("completed").alias("sensor_status"))
    notes = A.table(spark, d, "events").select(F.col("event_id").alias("row"), F.col("user_id").alias("batch_id"), scope.alias("scope"))
    return B.retry_diagnostics(notes.join(headers.select("batch_id"), "batch_id", "left_semi"), headers).select("row", "batch_id", "scope")


@query("""SELECT o_orderkey AS batch_id, o_orderdate AS queued_at FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def oldest_queued(spark: SparkSession, d: str) -> DataFrame:
    batches = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("queued_at"),
        F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"))
    return B.oldest_queued(batches).select("batch_id", "queued_at")


@query(f"""WITH {CAPTURES_SQL} SELECT count(*) AS captures_total, count(*) FILTER (status = 'processed') AS captures_processed,
  count(*) FILTER (status = 'failed') AS captures_failed,
  (SELECT count(*) FROM supplier WHERE s_nationkey % 3 = 0) AS batches_queued,
  (SELECT count(*) FROM supplier WHERE s_nationkey % 3 = 1) AS batches_running FROM captures""")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey") % 3
    batches = A.table(spark, d, "supplier").select(F.when(n == 0, "queued").when(n == 1, "running").otherwise("completed").alias("status"))
    return B.health(A.captures(spark, d), batches)


@query("""WITH found AS (SELECT user_id AS batch_id, count(*) AS capture_total FROM events GROUP BY 1),
reg AS (SELECT s_suppkey AS batch_id, 'completed' AS status FROM supplier)
SELECT coalesce(f.batch_id, r.batch_id) AS batch_id, CASE WHEN r.batch_id IS NULL THEN 'discovered' ELSE r.status END AS status,
  f.batch_id IS NOT NULL AS source_available, f.capture_total FROM found f FULL JOIN reg r ON f.batch_id = r.batch_id""")
def inbox_discovery(spark: SparkSession, d: str) -> DataFrame:
    listing = A.table(spark, d, "events").groupBy(F.col("user_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("capture_total"))
    registered = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("batch_id"), F.lit("completed").alias("status"))
    return B.discover(listing, registered)


@query("""SELECT page_id, url AS path FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""")
def pending_packages(spark: SparkSession, d: str) -> DataFrame:
    packages = A.table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    receipts = A.table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))
    return B.pending_packages(packages, receipts, path="page_id")[0]


# --- validation -----------------------------------------------------------------------------------------------

@query("""WITH item AS (SELECT user_id AS batch_id, event_id, 'visible/' || event_id AS relative_path,
   CASE WHEN event_type = 'signup' THEN user_id * 1000 + event_id % 50 ELSE event_id + 1000000 END AS capture_id,
   CASE WHEN event_type = 'error' AND value > 97 THEN 'capture path escapes batch' WHEN event_type = 'error' THEN 'metadata.json is missing' END AS error FROM events),
folder AS (SELECT DISTINCT user_id AS batch_id, CASE event_type WHEN 'view' THEN 'gas' WHEN 'click' THEN 'thermal' ELSE 'visible' END AS folder FROM events WHERE NOT (user_id % 10 = 3 AND event_type = 'click')),
fatal AS (
  SELECT batch_id FROM folder GROUP BY 1 HAVING count(*) FILTER (folder = 'gas') = 0 OR count(*) FILTER (folder = 'thermal') = 0 OR count(*) FILTER (folder = 'visible') = 0
  UNION SELECT batch_id FROM item WHERE contains(error, 'escapes')
  UNION SELECT batch_id FROM item GROUP BY batch_id, capture_id HAVING count(*) > 1)
SELECT batch_id, relative_path, capture_id, error FROM item WHERE batch_id NOT IN (SELECT batch_id FROM fatal)""")
def batch_preflight(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = A.table(spark, d, "events")
    items = e.select(
        F.col("user_id").alias("batch_id"), F.concat(F.lit("visible/"), F.col("event_id").cast("string")).alias("relative_path"),
        F.when(kind == "signup", F.col("user_id") * 1000 + F.col("event_id") % 50).otherwise(F.col("event_id") + 1000000).alias("capture_id"),
        F.when((kind == "error") & (F.col("value") > 97), "capture path escapes batch").when(kind == "error", "metadata.json is missing").alias("error"))
    folders = e.where(~((F.col("user_id") % 10 == 3) & (kind == "click"))).select(
        F.col("user_id").alias("batch_id"), F.when(kind == "view", "gas").when(kind == "click", "thermal").otherwise("visible").alias("folder"))
    return V.preflight(items, folders)[0]


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders)
SELECT o_orderkey AS row_id, CASE
  WHEN o_orderpriority = '1-URGENT' THEN 'capture_id must be 1-128 characters using letters, digits, ''.'', ''_'' or ''-'''
  WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 'capture_time must be ISO-8601'
  WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'station_id is required and must be at most 64 characters'
  WHEN o_custkey % 7 = 0 THEN 'images must contain between 1 and 5 file names'
  WHEN o_custkey % 7 = 1 THEN 'images must not contain duplicate file names'
  WHEN o_custkey % 7 = 2 THEN 'robot_pose.x_m must be a number or null' END AS error FROM p""")
def metadata_validation(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    p, s, c = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey") % 7
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    metadata = F.to_json(F.struct(
        F.when(p == "1-URGENT", F.lit(" .bad id")).otherwise(F.concat(F.lit("cap-"), F.col("o_orderkey").cast("string"))).alias("capture_id"),
        F.when((p == "2-HIGH") & (s == "P"), F.lit("yesterday")).otherwise(F.concat(day, F.lit("T08:00:00+08:00"))).alias("capture_time"),
        F.when((p == "3-MEDIUM") & (s == "P"), F.lit("  ")).otherwise(F.lit("08")).alias("station_id"),
        F.struct(F.lit("map").alias("frame"), F.when(c == 2, "abc").otherwise("1.5").alias("x_m")).alias("robot_pose"),
        F.when(c == 0, F.array(F.lit(" "))).when(c == 1, F.array(F.lit("a.jpg"), F.lit("a.jpg"))).otherwise(F.array(F.lit("a.jpg"), F.lit("b.jpg"))).alias("images"),
    ))
    rows = o.select(F.col("o_orderkey").alias("row_id"), metadata.alias("metadata_json"))
    return V.parse_metadata(rows).select("row_id", "error")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE
  WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'detection type and class_id are required'
  WHEN l_quantity > 45 THEN 'detection confidence must be in [0, 1]'
  WHEN l_tax = 0 THEN 'bounding box must be finite with positive width and height' END AS error
FROM lineitem WHERE (l_returnflag = 'R' AND l_linestatus = 'O') OR l_quantity > 45 OR l_tax = 0""")
def detection_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "").otherwise(F.col("l_returnflag")).alias("type"),
        F.col("l_linestatus").alias("class_id"), (F.col("l_quantity") / 45.0).alias("confidence"),
        F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_tax").alias("x2"), F.lit(1.0).alias("y2")).alias("bbox"))
    return V.validate_detections(rows)[1].select("l_orderkey", "l_linenumber", "l_partkey", "error")


@query("""SELECT event_id, CASE
  WHEN event_type = 'error' THEN 'capture has no result to correct'
  WHEN event_type = 'signup' AND value < 50 THEN 'operator is required and must be at most 100 characters'
  WHEN event_type = 'view' AND value < 10 THEN 'correction.objects is required'
  WHEN value > 90 THEN 'correction.objects[1] confidence must be in [0, 1]'
  WHEN value > 80 THEN 'correction.objects[0] requires type and class'
  WHEN value > 70 THEN 'correction.objects[1] bounding box must have positive width and height' END AS error FROM events""")
def correction_validation(spark: SparkSession, d: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    def entry(type_, conf, x2):
        return F.struct(
            type_.alias("type"), F.lit("wrench").alias("class"), F.lit(None).cast("string").alias("class_cn"),
            F.array(F.lit("1"), F.lit("1"), x2, F.lit("9")).alias("bbox_xyxy"), conf.alias("confidence"))
    good = F.lit("0.5")
    objects = F.when(~((kind == "view") & (v < 10)), F.array(
        entry(F.when((v > 80) & (v <= 90), " ").otherwise("tool"), good, F.lit("9")),
        entry(F.lit("tool"), F.when(v > 90, "1.5").otherwise(good), F.when((v > 70) & (v <= 80), "1").otherwise("9"))))
    rows = A.table(spark, d, "events").select("event_id", "event_type", F.struct(
        F.when((kind == "signup") & (v < 50), " ").otherwise("li").alias("operator"), F.lit("r").alias("reason")).alias("c"), objects.alias("o"))
    return rows.select("event_id", V.correction_error(F.col("c"), F.col("o"), kind != "error").alias("error"))


@query("""SELECT page_id, CASE WHEN octet_length(encode(html)) > 4000 THEN 'uploaded image exceeds 4000 bytes'
  WHEN starts_with(html, 'BM') THEN NULL ELSE 'uploaded file is not a supported JPEG, PNG or BMP image' END AS error
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'BM' || html ELSE html END AS html FROM pages)""")
def image_payloads(spark: SparkSession, d: str) -> DataFrame:
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("BM"), F.col("html"))).otherwise(F.col("html"))
    rows = A.table(spark, d, "pages").select("page_id", html.cast("binary").alias("content"))
    return V.validate_images(rows, max_bytes=4000).select("page_id", "error")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'capture package path must be relative'
  WHEN page_id % 4 = 1 THEN 'capture package path must be relative'
  WHEN page_id % 4 = 2 THEN 'capture package path escapes its root' END AS error FROM pages""")
def path_containment(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("page_id") % 4
    path = (
        F.when(m == 0, F.col("url")).when(m == 1, F.concat(F.lit("\\"), F.col("url")))
        .when(m == 2, F.concat(F.lit("a/../../b/"), F.col("page_id").cast("string"))).otherwise(F.lit("a/../b/./c")))
    return A.table(spark, d, "pages").select("page_id", V.path_error(path).alias("error"))


@query("""WITH up AS (SELECT o_orderkey AS capture_id, o_custkey % 5 + 1 AS n, o_orderpriority AS p FROM orders)
SELECT capture_id, CASE WHEN p = '1-URGENT' THEN format('metadata declares {} images but {} were uploaded', n, n - 1)
  ELSE 'uploaded image name at position 1 does not match metadata' END AS error
FROM up WHERE p IN ('1-URGENT', '2-HIGH')""")
def upload_check(spark: SparkSession, d: str) -> DataFrame:
    images = A.images(spark, d).join(A.captures(spark, d).select("capture_id", "received_at", F.lit(0).alias("_k")), "capture_id")
    sizes = images.groupBy("capture_id").agg(F.max("position").alias("n"))
    full = images.join(sizes, "capture_id").withColumn("name", F.format_string("dir/frame_%02d.jpg", "position"))
    p = F.col("received_at")
    sent = full.where(~((p == "1-URGENT") & (F.col("position") == F.col("n")))).withColumn(
        "name", F.when((p == "2-HIGH") & (F.col("position") == 1), "other.jpg").otherwise(F.format_string("C:\\up\\frame_%02d.jpg", "position")))
    return V.compare_uploads(full, sent).select("capture_id", "error")


@query("""WITH n AS (SELECT o_orderkey AS capture_id, unnest(range(1, o_custkey % 5 + 2)) AS position FROM orders)
SELECT capture_id, CAST(position AS INTEGER) AS position,
  CASE WHEN position = 1 THEN 'img_0.jpg' WHEN position % 2 = 1 THEN '0' || position || '_img_0.jpg'
       WHEN position = 2 THEN 'frame_02.jpg' ELSE 'photo.jpg' END AS file_name FROM n""")
def stored_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("position")
    named = A.images(spark, d).withColumn(
        "name", F.when(p % 2 == 1, "a/img 0.jpg").when(p == 2, "..__").otherwise("x\\..photo.jpg_"))
    return V.stored_names(named).select("capture_id", "position", "file_name")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicate_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT p_partkey AS name, 'tolerance_deg' AS missing_field FROM part WHERE p_size % 5 = 0
UNION ALL SELECT p_partkey, 'normal_angle_deg' FROM part WHERE p_size % 7 = 0""")
def reference_gaps(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    refs = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("name"), F.lit("08").alias("station_id"),
        F.when(size % 7 != 0, F.col("p_retailprice")).alias("normal_angle_deg"), F.when(size % 5 != 0, F.lit(5.0)).alias("tolerance_deg"))
    return V.reference_gaps(refs)


@query("""SELECT 'classes' AS name, CASE WHEN count(*) FILTER (p_size % 3 <> 0) > 0 THEN 'ok' ELSE 'blocker' END AS status, count(*) FILTER (p_size % 3 <> 0) AS count FROM part
UNION ALL SELECT 'stations', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'blocker' END, count(*) FROM nation
UNION ALL SELECT 'analog_references', CASE WHEN count(*) FILTER (s_suppkey % 4 = 0) > 0 THEN 'warning' WHEN count(*) = 0 THEN 'warning' ELSE 'ok' END,
  CASE WHEN count(*) FILTER (s_suppkey % 4 = 0) > 0 THEN count(*) FILTER (s_suppkey % 4 = 0) ELSE count(*) END FROM supplier""")
def dimension_readiness(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    classes = A.table(spark, d, "part").select(F.when(size % 3 == 0, False).when(size % 3 == 1, True).alias("train"))
    refs = A.table(spark, d, "supplier").select("s_suppkey", F.lit("1").alias("station_id"), F.col("s_acctbal").alias("normal_angle_deg"), F.lit(5.0).alias("tolerance_deg"))
    return V.dimension_readiness(classes, A.table(spark, d, "nation"), refs, image_there=F.col("s_suppkey") % 4 != 0)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT event_id, strftime(ts, '%Y%m%d_%H%M') || CASE WHEN k = 0 THEN '' ELSE '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(k AS VARCHAR))) AS INTEGER), '0') END AS name FROM n""")
def collision_names(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").withColumn("minute", F.date_trunc("minute", F.col("ts")))
    ranked = number_rows(e, ["user_id", "minute"], ["ts", "event_id"], "k", slice_by=F.col("ts"))
    suffix = F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("_"), X.zero_pad(F.col("k").cast("string"), 2)))
    return ranked.select("event_id", F.concat(F.date_format("ts", "yyyyMMdd_HHmm"), suffix).alias("name"))
