"""Queries over detections, readings, modules, templates and image tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch import adapters as A
from seamwatch import constants as K
from seamwatch.functions import geometry as G
from seamwatch.functions import meters as M
from seamwatch.operators import captures as C
from seamwatch.operators import evaluation as E
from seamwatch.operators import fusion as U
from seamwatch.operators import isolation as ISO
from seamwatch.operators import modules as MOD
from seamwatch.operators import plugins as P
from seamwatch.operators import templates as T
from seamwatch.operators import vision as VIS
from seamwatch.operators import voting as VOTE
from seamwatch.plans.registry import BITS_SQL, CAPTURES_SQL, CORRECTIONS_SQL, OBJECTS_SQL, READINGS_SQL, query
from seamwatch.skew import first_per_key, spread_join
from seamwatch.sources import files as SRC

_KEYS = ["user_id", "day"]
_ORDER = ["ts", "event_id"]


# --- votes ------------------------------------------------------------------------------------------------

@query(f"""WITH {READINGS_SQL},
r AS (SELECT user_id, day, ts, event_id, CASE WHEN raw_text = 'signup' THEN NULL ELSE raw_text END AS txt FROM readings),
v AS (SELECT user_id, day, txt, count(*) AS votes, min(struct_pack(a := ts, b := event_id)) AS seen FROM r WHERE txt IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY votes DESC, seen) AS k, sum(votes) OVER (PARTITION BY user_id, day) AS total FROM v),
g AS (SELECT DISTINCT user_id, day FROM r)
SELECT g.user_id, g.day, CASE WHEN votes >= 2 THEN 'confirmed' ELSE 'unreadable' END AS status, CASE WHEN votes >= 2 THEN txt END AS raw_text,
  CASE WHEN votes IS NULL THEN 0.0 ELSE CAST(votes AS DOUBLE) / CAST(total AS DOUBLE) END AS confidence, coalesce(votes, 0) AS votes
FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.day = g.day AND k = 1""")
def vote_readings(spark: SparkSession, d: str) -> DataFrame:
    rows = A.frame_readings(spark, d).withColumn("raw_text", F.when(F.col("raw_text") == "signup", " ").otherwise(F.col("raw_text")))
    return VOTE.majority_vote(rows, _KEYS, _ORDER, "raw_text").drop("value")


_CONFIRMED_SQL = """v AS (SELECT user_id, day, {value} AS txt, count(*) AS votes, min(struct_pack(a := ts, b := event_id)) AS seen, min(confidence) AS conf
  FROM readings WHERE status = 'confirmed' {extra} GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY votes DESC, seen) AS k FROM v),
g AS (SELECT user_id, day, count(*) AS n FROM readings GROUP BY 1, 2),
j AS (SELECT g.user_id, g.day, n, txt, votes, conf, votes >= CASE WHEN n >= 2 THEN 2 ELSE 1 END AS won FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.day = g.day AND k = 1)"""


@query(f"""WITH {READINGS_SQL}, {_CONFIRMED_SQL.format(value="raw_text", extra="")}
SELECT user_id, day, CASE WHEN won THEN 'confirmed' ELSE 'unreadable' END AS status, CASE WHEN won THEN txt END AS raw_text,
  coalesce(conf, 0.0) AS confidence, coalesce(votes, 0) AS votes,
  CASE WHEN votes IS NULL THEN 'no_confirmed_frame_readings' WHEN won THEN 'multi_frame_majority_confirmed' ELSE 'multi_frame_readings_do_not_agree' END AS reason FROM j""")
def vote_confirmed(spark: SparkSession, d: str) -> DataFrame:
    return VOTE.meter_vote(A.frame_readings(spark, d), _KEYS, _ORDER).drop("value")


@query(f"""WITH {READINGS_SQL}, {_CONFIRMED_SQL.format(value="event_id % 13", extra="AND event_id % 13 BETWEEN 1 AND 10")}
SELECT user_id, day, CASE WHEN won THEN 'confirmed' ELSE 'unreadable' END AS status, CAST(CASE WHEN won THEN txt END AS INTEGER) AS number,
  coalesce(conf, 0.0) AS confidence, coalesce(votes, 0) AS votes,
  CASE WHEN votes IS NULL THEN 'no_confirmed_station_number_readings' WHEN won THEN 'multi_frame_majority_confirmed' ELSE 'multi_frame_station_numbers_do_not_agree' END AS reason,
  CAST(CASE WHEN won THEN user_id END AS INTEGER) AS metadata_number, CASE WHEN won THEN user_id = txt END AS metadata_matches FROM j""")
def station_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = A.frame_readings(spark, d).withColumn("number", (F.col("event_id") % 13).cast("int"))
    return VOTE.station_vote(rows, _KEYS, _ORDER, station_id="user_id")


_ANGLES_SQL = """a AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, ts, event_id,
  round((value * 3.6) % 360, 4) AS angle, least(value / 100.0, 1.0) AS confidence FROM events),
u AS (SELECT *, CAST(round(angle * 1000000) AS BIGINT) AS m FROM a),
s AS (SELECT x.user_id, x.day, x.ts, x.event_id, any_value(x.angle) AS angle, any_value(x.confidence) AS confidence,
   sum(least(abs(x.m - y.m), 360000000 - abs(x.m - y.m))) AS total, count(*) AS n
  FROM u x JOIN u y ON x.user_id = y.user_id AND x.day = y.day GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY total, ts, event_id) AS k FROM s),
medoid AS (SELECT user_id, day, angle, confidence, CAST(total AS DOUBLE) / 1000000 AS total_distance, n AS measurements FROM k WHERE k = 1)"""


@query(f"WITH {_ANGLES_SQL} SELECT user_id, day, angle, confidence, total_distance, measurements FROM medoid")
def angle_medoid(spark: SparkSession, d: str) -> DataFrame:
    return VOTE.angle_medoid(A.angles(spark, d), _KEYS, _ORDER)


@query(f"""WITH {_ANGLES_SQL}, p AS (SELECT *, abs((angle - 42 + 180 + 360) % 360 - 180) AS delta FROM medoid)
SELECT user_id, day, CASE WHEN confidence < 0.55 THEN 'uncertain' WHEN delta <= 30 THEN 'normal' ELSE 'abnormal' END AS status,
  CASE WHEN confidence >= 0.55 THEN round(delta, 4) END AS delta_deg,
  CASE WHEN confidence < 0.55 THEN 'pointer_not_reliably_detected' WHEN delta <= 30 THEN 'pointer_angle_within_tolerance' ELSE 'pointer_angle_delta_exceeds_tolerance' END AS reason
FROM p""")
def pointer_status(spark: SparkSession, d: str) -> DataFrame:
    medoids = VOTE.angle_medoid(A.angles(spark, d), _KEYS, _ORDER)
    return VOTE.pointer_verdicts(medoids, F.lit(42.0), F.lit(30.0)).select("user_id", "day", "status", "delta_deg", "reason")


# --- boxes and fusion -----------------------------------------------------------------------------------------

@query(f"""WITH {OBJECTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, object_index) AS k FROM objects)
SELECT capture_id, x1, y1, x2, y2, confidence FROM b WHERE k = 1""")
def best_marker(spark: SparkSession, d: str) -> DataFrame:
    rows = A.raw_objects(spark, d).withColumn("class_id", F.lit("station_marker"))
    out = MOD.best_marker_rows(rows, A.OBJECT_ORDER)
    return out.select("capture_id", *[F.col(f"bbox.{s}").alias(s) for s in G.SIDES], "confidence")


@query(f"""WITH {OBJECTS_SQL}, best AS (SELECT capture_id, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, object_index) AS k FROM objects) WHERE k = 1),
o AS (SELECT o.*, a1, b1, a2, b2, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS i FROM objects o JOIN best USING (capture_id))
SELECT capture_id, l_linenumber, l_partkey, l_extendedprice,
  round(CASE WHEN i = 0 THEN 0 ELSE i / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - i) END, 8) AS iou FROM o""")
def iou_to_best(spark: SparkSession, d: str) -> DataFrame:
    rows = A.raw_objects(spark, d)
    best = first_per_key(rows, ["capture_id"], [-F.col("confidence"), *A.OBJECT_ORDER], ["bbox"], count="_n").withColumnRenamed("bbox", "best")
    out = spread_join(rows, best, ["capture_id"], "_n")
    return out.select("capture_id", "l_linenumber", "l_partkey", "l_extendedprice", F.round(G.iou(F.col("bbox"), F.col("best")), 8).alias("iou"))


_FUSE_ORDER = ["frame_index", "l_linenumber", "l_suppkey", "l_orderkey", "l_extendedprice"]
_BOX = "struct_pack(x1 := x1, y1 := y1, x2 := x1 + 40, y2 := y1 + 30, c := confidence)"
_FUSE_SQL = f"""d AS (
  SELECT l_partkey AS capture_id, l_returnflag AS type, l_linestatus AS class_id, l_linenumber % 3 AS frame_index,
    round(l_discount * 10, 4) AS confidence, floor(l_quantity / 25) * 60 + l_suppkey * 7 % 13 AS x1, CAST(l_orderkey * 3 % 7 AS DOUBLE) AS y1,
    l_linenumber, l_suppkey, l_orderkey, l_extendedprice FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY capture_id, type, class_id ORDER BY {', '.join(_FUSE_ORDER)}) AS n FROM d),
f AS (
  SELECT capture_id, type, class_id, n, [{_BOX}] AS open, CAST(1 AS BIGINT) AS hit, frame_index, x1, y1, confidence FROM o WHERE n = 1
  UNION ALL
  SELECT capture_id, type, class_id, n, CASE WHEN best IS NULL THEN list_append(open, own)
      ELSE list_transform(open, lambda k, i: CASE WHEN i = list_position(ious, best) AND own.c > k.c THEN own ELSE k END) END,
    CASE WHEN best IS NULL THEN len(open) + 1 ELSE list_position(ious, best) END, frame_index, x1, y1, confidence
  FROM (SELECT *, list_max(list_filter(ious, lambda v: v >= 0.45)) AS best
    FROM (SELECT *, list_transform(open, lambda k: CASE WHEN least(k.x2, own.x2) > greatest(k.x1, own.x1) AND least(k.y2, own.y2) > greatest(k.y1, own.y1) THEN
        (least(k.x2, own.x2) - greatest(k.x1, own.x1)) * (least(k.y2, own.y2) - greatest(k.y1, own.y1))
        / ((k.x2 - k.x1) * (k.y2 - k.y1) + (own.x2 - own.x1) * (own.y2 - own.y1)
           - (least(k.x2, own.x2) - greatest(k.x1, own.x1)) * (least(k.y2, own.y2) - greatest(k.y1, own.y1))) ELSE 0.0 END) AS ious
      FROM (SELECT o.*, f.open, struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x1 + 40, y2 := o.y1 + 30, c := o.confidence) AS own
        FROM f JOIN o ON o.capture_id = f.capture_id AND o.type = f.type AND o.class_id = f.class_id AND o.n = f.n + 1)))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id, type, class_id, hit ORDER BY confidence DESC, n) AS place FROM f),
seen AS (SELECT capture_id, type, class_id, hit, count(DISTINCT frame_index) AS observations, min(n) AS first FROM f GROUP BY 1, 2, 3, 4)"""


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """A part's line items as boxes on a few shelves, so that boxes of several frames overlap."""
    rows = A.table(spark, d, "lineitem")
    x1 = (F.floor(F.col("l_quantity") / 25) * 60 + F.col("l_suppkey") * 7 % 13).cast("double")
    y1 = (F.col("l_orderkey") * 3 % 7).cast("double")
    return rows.select(
        F.col("l_partkey").alias("capture_id"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("class_id"),
        (F.col("l_linenumber") % 3).alias("frame_index"), F.round(F.col("l_discount") * 10, 4).alias("confidence"),
        G.box(x1, y1, x1 + 40, y1 + 30).alias("bbox"), "l_linenumber", "l_suppkey", "l_orderkey", "l_extendedprice")


@query(f"""WITH RECURSIVE {_FUSE_SQL}
SELECT capture_id, type, class_id, x1, y1, x1 + 40 AS x2, y1 + 30 AS y2, confidence, observations
FROM ranked JOIN seen USING (capture_id, type, class_id, hit) WHERE place = 1""")
def fuse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent association of boxes over frames; SQL folds each group's list."""
    clustered = U.assign_clusters(_detections(spark, d), order=_FUSE_ORDER)
    fused = U.fused_objects(clustered, order=_FUSE_ORDER)
    return fused.select(
        "capture_id", "type", "class_id", *[F.col(f"bbox.{s}").alias(s) for s in G.SIDES], "confidence", "observations")


@query(f"""WITH RECURSIVE {_FUSE_SQL},
best AS (SELECT capture_id, type, class_id, confidence, observations, first, hit FROM ranked JOIN seen USING (capture_id, type, class_id, hit) WHERE place = 1),
opened AS (SELECT b.*, o.frame_index, o.l_linenumber, o.l_suppkey, o.l_orderkey, o.l_extendedprice FROM best b
  JOIN o ON o.capture_id = b.capture_id AND o.type = b.type AND o.class_id = b.class_id AND o.n = b.first)
SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, {', '.join(_FUSE_ORDER)}, type, class_id) AS position, type, class_id, confidence, observations
FROM opened""")
def fused_order(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a capture in the order they are listed: by falling confidence, equal ones in cluster order."""
    clustered = U.assign_clusters(_detections(spark, d), order=_FUSE_ORDER)
    fused = U.fused_objects(clustered, order=_FUSE_ORDER)
    place = W.partitionBy("capture_id").orderBy(*U.object_order())
    return fused.select("capture_id", F.row_number().over(place).cast("bigint").alias("position"), "type", "class_id", "confidence", "observations")


@query(f"""WITH RECURSIVE {_FUSE_SQL},
v AS (SELECT capture_id, type, class_id, hit, CAST(CAST(floor(x1 / 10) AS BIGINT) AS VARCHAR) AS txt, count(*) AS votes, min(n) AS since FROM f GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT *, row_number() OVER (PARTITION BY capture_id, type, class_id, hit ORDER BY votes DESC, since) AS k,
  sum(votes) OVER (PARTITION BY capture_id, type, class_id, hit) AS total FROM v),
w AS (SELECT b.*, votes >= CASE WHEN total >= 2 THEN 2 ELSE 1 END AS good, first FROM b JOIN seen USING (capture_id, type, class_id, hit) WHERE k = 1)
SELECT w.capture_id, w.class_id, o.frame_index AS frame, o.l_orderkey AS first_order, CASE WHEN good THEN 'confirmed' ELSE 'unreadable' END AS status,
  CASE WHEN good THEN txt END AS raw_text, CAST(votes AS DOUBLE) / CAST(total AS DOUBLE) AS confidence, votes
FROM w JOIN o ON o.capture_id = w.capture_id AND o.type = w.type AND o.class_id = w.class_id AND o.n = w.first""")
def cluster_readings(spark: SparkSession, d: str) -> DataFrame:
    """Voted reading per cluster: every object reads its rounded quantity."""
    clustered = U.assign_clusters(_detections(spark, d), order=_FUSE_ORDER)
    meters = clustered.withColumn("type", F.lit("digital_meter")).withColumn("digital_text", F.floor(F.col("bbox.x1") / 10).cast("string"))
    out = U.cluster_meter_votes(meters, order=_FUSE_ORDER)
    return out.select("capture_id", "class_id", F.col("cluster.frame_index").alias("frame"), F.col("cluster.l_orderkey").alias("first_order"), "status", "raw_text", "confidence", "votes")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'tool' WHEN l_returnflag = 'N' THEN 'coal_pile' ELSE 'mystery' END AS type,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_discount * 10 < 0.55 THEN 'unknown_tool' ELSE 'wrench' END WHEN l_returnflag = 'N' THEN 'coal_pile' ELSE 'mystery_thing' END AS class_id,
  CASE WHEN l_returnflag = 'A' AND l_discount * 10 < 0.55 THEN 'wrench' END AS predicted_class,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_discount * 10 < 0.55 THEN '未知工具' ELSE '扳手' END WHEN l_returnflag = 'N' THEN '煤堆' ELSE 'mystery_thing' END AS class_cn
FROM lineitem""")
def class_map(spark: SparkSession, d: str) -> DataFrame:
    config = '{"tool_wrench":{"id":"wrench","type":"tool","name_cn":"扳手","train":false,"min_confidence":0.55},"coal_pile":{"id":"coal_pile","type":"coal_pile","name_cn":"煤堆"}}'
    classes = SRC.classes(spark.createDataFrame([(config,)], "content string")).withColumnRenamed("class", "label")
    flag = F.col("l_returnflag")
    rows = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("confidence"),
        F.when(flag == "A", "tool_wrench").when(flag == "N", "coal_pile").otherwise("mystery_thing").alias("model_label"))
    return MOD.map_classes(rows, classes).select("l_orderkey", "l_linenumber", "l_partkey", "type", "class_id", "predicted_class", "class_cn")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'shape:round' ELSE 'color:' || user_id || '|shape:round' END AS attributes FROM events""")
def public_attributes(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "_color").otherwise("color")
    rows = A.table(spark, d, "events").withColumn("a", F.create_map(name, F.col("user_id").cast("string"), F.lit("shape"), F.lit("round"), F.lit("_raw"), F.lit("x")))
    entries = F.transform(F.array_sort(F.map_entries(U.strip_private(F.col("a")))), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return rows.select("event_id", F.array_join(entries, "|").alias("attributes"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(0 AS INTEGER) AS pos, 'tool' AS type, l_returnflag AS class_id, l_returnflag AS class_cn,
  l_quantity AS x1, l_discount AS confidence, 'red' AS surface FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, 'sign', 'stop', '停', l_quantity + 1, l_discount, NULL FROM lineitem WHERE l_linestatus = 'F'""")
def replay_detections(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem")
    q, c = F.col("l_quantity"), F.col("l_discount")
    def found(kind, cls, cn, x, attributes):
        return F.struct(kind.alias("type"), cls.alias("class"), cn.alias("class_cn"), F.array(x, F.lit(0.0), x + 5, F.lit(9.0)).alias("bbox_xyxy"), c.alias("confidence"), attributes.alias("attributes"))
    none = F.lit(None).cast("map<string,string>")
    text = F.to_json(F.array(
        found(F.lit("tool"), F.col("l_returnflag"), F.lit(None).cast("string"), q, F.create_map(F.lit("surface"), F.lit("red"))),
        found(F.lit("sign"), F.lit("stop"), F.lit("停"), q + 1, none)))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    folder = [*keys, "l_linestatus"]
    images = rows.select(*keys, F.concat_ws("/", *folder, F.lit("a.jpg")).alias("path"))
    sidecars = rows.where("l_linestatus = 'F'").select(F.concat_ws("/", *folder, F.lit("a.jpg.detections.json")).alias("path"), text.alias("content")).dropDuplicates(["path"])
    out = P.replay_detector(images, sidecars, keys)
    return out.select(*keys, "pos", "type", "class_id", "class_cn", F.col("bbox.x1").alias("x1"), "confidence", F.try_element_at("attributes", F.lit("surface")).alias("surface"))


@query("""SELECT doc_id, 'word' AS type, n_chars AS confidence_source, length(text) AS chars FROM documents""")
def detector_job(spark: SparkSession, d: str) -> DataFrame:
    """The detector plug-in on a table: one detection per row."""
    def factory():
        def detect(rows):
            box = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}
            return rows.assign(row=range(len(rows)), type="word", class_id=rows["text"].str.len().astype(str), class_cn="w", bbox=[box] * len(rows), confidence=1.0)
        return detect
    rows = A.table(spark, d, "documents").select("doc_id", "n_chars", "text")
    out = P.run_detector(rows, ["doc_id", "n_chars"], factory, batched=True)
    return out.select("doc_id", "type", F.col("n_chars").alias("confidence_source"), F.col("class_id").cast("bigint").alias("chars"))


@query("""SELECT doc_id, CAST(0.35 AS DOUBLE) AS confidence_threshold, 640 AS image_size, 'noop' AS provider FROM documents""")
def processing_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Results carry the parameters of the job that made them."""
    rows = A.table(spark, d, "documents").select("doc_id")
    out = P.with_parameters(rows, {"provider": "noop", "image_size": 640, "confidence_threshold": 0.35})
    return out.select("doc_id", "processing_parameters.*")


# --- modules and summary -----------------------------------------------------------------------------------------

_KIND_SQL = "CASE object_type WHEN 'A' THEN 'coal_pile' WHEN 'N' THEN 'tool' ELSE 'analog_meter' END"


@query(f"""WITH {CAPTURES_SQL}, {OBJECTS_SQL}, n AS (SELECT capture_id, count(*) FILTER (object_type = 'A') AS coal, count(*) FILTER (object_type = 'N') AS tools, count(*) FILTER (object_type = 'R') AS analog FROM objects GROUP BY 1)
SELECT c.capture_id, 'confirmed' AS coal_status, coalesce(coal, 0) > 0 AS coal_present, coalesce(tools, 0) AS tool_count, coalesce(analog, 0) AS analog_count
FROM captures c LEFT JOIN n USING (capture_id)""")
def module_presence(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("object_type")
    kinds = A.raw_objects(spark, d).select("capture_id", F.when(t == "A", "coal_pile").when(t == "N", "tool").otherwise("analog_meter").alias("object_type"))
    return MOD.presence_rows(A.captures(spark, d).select("capture_id"), kinds)


@query("""SELECT o_orderkey AS capture_id, CASE WHEN o_custkey % 13 BETWEEN 1 AND 10 THEN 'confirmed' ELSE 'unavailable' END AS status,
  CAST(CASE WHEN o_custkey % 13 BETWEEN 1 AND 10 THEN o_custkey % 13 END AS INTEGER) AS number,
  CASE WHEN o_custkey % 13 = 11 THEN 'station_id_is_not_numeric' WHEN o_custkey % 13 IN (0, 12) THEN 'station_number_outside_allowed_range' END AS reason FROM orders""")
def station_from_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") % 13
    station = F.when(n == 11, "gate").otherwise(F.lpad(n.cast("string"), 2, "0"))
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("capture_id"), MOD.station_from_metadata(station).alias("r"))
    return rows.select("capture_id", "r.status", "r.number", "r.reason")


@query(f"""WITH {CAPTURES_SQL}, {OBJECTS_SQL}, {CORRECTIONS_SQL},
fixed AS (SELECT DISTINCT capture_id FROM corrections WHERE active),
item AS (
  SELECT capture_id, 0 AS kind, struct_pack(a := CAST(l_linenumber AS BIGINT), b := l_partkey, c := l_suppkey, e := l_extendedprice) AS ord,
     CASE WHEN f.capture_id IS NULL THEN 'yolo' ELSE 'manual_review' END AS source_id,
     CASE WHEN f.capture_id IS NULL THEN 'detected' ELSE 'recognized' END AS status, class_id AS display_value, confidence
  FROM objects o LEFT JOIN fixed f USING (capture_id)
  UNION ALL SELECT capture_id, 1, struct_pack(a := CAST(0 AS BIGINT), b := CAST(0 AS BIGINT), c := CAST(0 AS BIGINT), e := CAST(0 AS DOUBLE)), 'station_number',
     CASE WHEN o_custkey % 3 = 0 THEN 'recognized' ELSE 'unrecognized' END, CASE WHEN o_custkey % 3 = 0 THEN station_id || ' 号' ELSE '未识别成功' END, NULL FROM captures),
p AS (SELECT *, CASE source_id WHEN 'station_number' THEN 0 WHEN 'manual_review' THEN 5 ELSE 6 END AS pr FROM item),
s AS (SELECT capture_id, count(*) FILTER (status <> 'unrecognized') AS good, count(*) FILTER (status = 'unrecognized') AS bad FROM p GROUP BY 1),
b AS (SELECT capture_id, source_id, display_value, confidence, row_number() OVER (PARTITION BY capture_id ORDER BY pr, kind, ord) AS k FROM p WHERE status <> 'unrecognized')
SELECT c.capture_id, CASE WHEN c.status = 'received' THEN 'processing' WHEN c.status = 'failed' THEN 'failed' WHEN good > 0 AND bad > 0 THEN 'partial'
   WHEN good > 0 THEN 'recognized' ELSE 'unrecognized' END AS summary_status,
  CAST(CASE WHEN c.status = 'processed' THEN coalesce(good + bad, 0) ELSE 0 END AS BIGINT) AS item_count,
  CASE WHEN c.status = 'processed' THEN source_id END AS primary_source, CASE WHEN c.status = 'processed' THEN display_value END AS primary_value,
  CASE WHEN c.status = 'processed' THEN confidence END AS primary_confidence
FROM captures c LEFT JOIN s USING (capture_id) LEFT JOIN b ON b.capture_id = c.capture_id AND k = 1""")
def recognition_summary(spark: SparkSession, d: str) -> DataFrame:
    fixed = C.latest_correction(A.corrections(spark, d), ["id"]).select("capture_id", F.lit(True).alias("fixed"))
    captures = A.captures(spark, d).withColumn("third", F.col("station_id"))
    o = A.raw_objects(spark, d)
    sizes = o.groupBy("capture_id").agg(F.count(F.lit(1)).alias("_n"))
    objects = spread_join(o, fixed.join(sizes, "capture_id"), ["capture_id"], "_n")
    zero = F.lit(0).cast("bigint")
    order = F.struct(F.col("l_linenumber").cast("bigint").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_extendedprice").alias("e"))
    corrected = F.coalesce("fixed", F.lit(False))
    items = objects.select(
        "capture_id", F.lit(0).alias("kind"), order.alias("ord"), MOD.detector_source(F.lit("gpu"), corrected).alias("source_id"),
        F.when(corrected, "recognized").otherwise("detected").alias("status"), F.col("class_id").alias("display_value"), M.normal_confidence(F.col("confidence")).alias("confidence"))
    ok = F.col("o_custkey") % 3 == 0
    stations = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("capture_id"), F.lit(1).alias("kind"),
        F.struct(zero.alias("a"), zero.alias("b"), zero.alias("c"), F.lit(0.0).alias("e")).alias("ord"), F.lit("station_number").alias("source_id"),
        F.when(ok, "recognized").otherwise("unrecognized").alias("status"),
        F.when(ok, F.concat((F.col("o_custkey") % 10 + 1).cast("string"), F.lit(" 号"))).otherwise(K.NOT_RECOGNIZED).alias("display_value"),
        F.lit(None).cast("double").alias("confidence"))
    out = MOD.summarize_rows(captures.select("capture_id", "status"), items.unionByName(stations))
    return out.drop("status")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity < 10 THEN NULL ELSE substr(printf('%04d', l_partkey), 1, 3) || '.' || substr(printf('%04d', l_partkey), 4) END
       WHEN l_returnflag = 'N' THEN '-' || printf('%04d', l_partkey) ELSE substr(printf('%04d', l_partkey), 1, 2) || '.' || substr(printf('%04d', l_partkey), 3) END AS txt
FROM lineitem""")
def meter_texts(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    places = F.when(flag == "A", F.when(F.col("l_quantity") < 10, F.length(F.lpad(F.col("l_partkey").cast("string"), F.greatest(F.lit(4), F.length(F.col("l_partkey").cast("string"))), F.lit("0")))).otherwise(
        F.greatest(F.lit(4), F.length(F.col("l_partkey").cast("string"))) - 3)).when(flag == "N", 0).otherwise(F.greatest(F.lit(4), F.length(F.col("l_partkey").cast("string"))) - 2)
    digits = F.format_string("%04d", F.col("l_partkey"))
    return A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.meter_text(digits, places, flag == "N").alias("txt"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS digit FROM lineitem""")
def segment_digits(spark: SparkSession, d: str) -> DataFrame:
    shapes = {v: k for k, v in K.SEGMENT_DIGITS.items()}
    names = F.create_map(*[F.lit(x) for pair in shapes.items() for x in pair])
    lit = F.coalesce(F.try_element_at(names, F.col("l_quantity").cast("int").cast("string")), F.lit("ag"))
    rows = A.table(spark, d, "lineitem").withColumn("lit", F.reverse(F.filter(F.split(F.concat(lit, F.substring(lit, 1, 1)), ""), lambda c: c != "")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.segments_to_digit(F.col("lit")).alias("digit"))


@query("""SELECT c_custkey, CASE WHEN s < 3 THEN 'fallback' WHEN s < 5 THEN 'exact' END AS reference, s < 5 AS has_reference
FROM (SELECT c_custkey, c_nationkey % 10 AS n, CASE WHEN c_nationkey % 10 < 3 AND c_mktsegment <> 'BUILDING' THEN 0 WHEN c_nationkey % 10 < 3 THEN 3 WHEN c_nationkey % 10 = 3 AND c_mktsegment = 'BUILDING' THEN 4 ELSE 9 END AS s FROM customer)""")
def pointer_references(spark: SparkSession, d: str) -> DataFrame:
    refs = spark.createDataFrame(
        [(str(i), None, 10 + i, "old") for i in range(3)] + [(str(i), None, 20 + i, "fallback") for i in range(3)]
        + [(str(i), "BUILDING", 30 + i, "exact") for i in range(4)] + [("0", "BUILDING", 90, "late")],
        "station_id string, class string, ord int, reference string")
    meters = A.table(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 10).cast("string").alias("station_id"), F.col("c_mktsegment").alias("class_id"))
    return C.with_pointer_reference(meters, refs, ["c_custkey"]).select("c_custkey", "reference", "has_reference")


@query("""SELECT c_custkey AS row_id, module_id, CASE WHEN NOT enabled THEN 'disabled' WHEN module_id = 'coal_presence' AND c_custkey % 3 = 0 THEN 'unavailable'
  WHEN module_id = 'digital_meter' AND c_custkey % 2 = 1 THEN 'unavailable' ELSE 'ready' END AS status
FROM (SELECT c_custkey, c_acctbal > 0 AS enabled, unnest(['coal_presence', 'digital_meter']) AS module_id FROM customer)""")
def module_readiness(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") > 0).alias("enabled"), F.lit(None).cast("string").alias("note"),
        F.lit("image_classifier").alias("mode"), (F.col("c_custkey") % 2 == 0).alias("trained"),
        F.explode(F.array(F.lit("coal_presence"), F.lit("digital_meter"))).alias("module_id"))
    return MOD.readiness(rows, F.col("row_id") % 3 != 0).select("row_id", "module_id", "status")


_ISOLATED_SQL = """SELECT o_orderkey AS capture_id, 0 AS module_order, 'station_number' AS module_id,
  CASE WHEN o_custkey % 13 = 11 THEN 'failed' ELSE 'confirmed' END AS status, CAST(CASE WHEN o_custkey % 13 <> 11 THEN o_custkey % 13 END AS INTEGER) AS number, CAST(NULL AS DOUBLE) AS value,
  CASE WHEN o_custkey % 13 = 11 THEN 'no station in gate ' || o_orderkey END AS reason FROM orders
UNION ALL SELECT o_orderkey, 1, 'coal_presence', 'failed', NULL, NULL, 'no model is there' FROM orders
UNION ALL SELECT o_orderkey, 2, 'digital_meter', CASE WHEN o_custkey % 100 = 0 THEN 'failed' ELSE 'confirmed' END, NULL,
  CASE WHEN o_custkey % 100 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) // (o_custkey % 100) END, CASE WHEN o_custkey % 100 = 0 THEN 'no scale' END FROM orders
UNION ALL SELECT o_orderkey, 3, 'analog_meter', 'disabled', NULL, NULL, NULL FROM orders"""


def _stations():
    def run(row):
        if row["o_custkey"] is None:
            return {"status": "confirmed"}
        station = row["o_custkey"] % 13
        if station == 11:
            raise ValueError(f"no station in gate {row['o_orderkey']}")
        return {"status": "confirmed", "number": station}
    return run


def _no_model():
    raise FileNotFoundError("no model is there")


def _scales():
    def run(row):
        if row["o_custkey"] is None:
            return {"status": "confirmed"}
        scale = row["o_custkey"] % 100
        if scale == 0:
            raise ZeroDivisionError("no scale")
        return {"status": "confirmed", "value": None if row["whole"] is None else row["whole"] // scale}
    return run


def _isolated(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("bigint").alias("whole"))
    modules = [ISO.Module("station_number", _stations, by_row=True), ISO.Module("coal_presence", _no_model), ISO.Module("digital_meter", _scales, by_row=True),
               ISO.Module("analog_meter", _scales, False, by_row=True)]
    return ISO.run_isolated(rows, ["o_orderkey"], modules).withColumnRenamed("o_orderkey", "capture_id")


@query(_ISOLATED_SQL)
def isolated_modules(spark: SparkSession, d: str) -> DataFrame:
    """One module cannot start, two fail on single rows; every other row has its result."""
    return _isolated(spark, d).select("capture_id", "module_order", "module_id", "status", "number", "value", "reason")


@query(f"""SELECT module_id, count(*) AS rows, count(*) FILTER (status = 'failed') AS failed, min(reason) FILTER (status = 'failed') AS first_reason FROM ({_ISOLATED_SQL}) GROUP BY 1""")
def module_failures(spark: SparkSession, d: str) -> DataFrame:
    return ISO.module_health(_isolated(spark, d))


@query(f"""WITH {READINGS_SQL}, {_CONFIRMED_SQL.format(value="event_id % 13", extra="AND event_id % 13 BETWEEN 1 AND 10")},
a AS (SELECT *, user_id % 7 <> 0 AS ready, user_id % 3 <> 0 AS marked FROM j)
SELECT user_id, day, CASE WHEN NOT ready THEN 'unavailable' WHEN marked AND won THEN 'confirmed' ELSE 'unreadable' END AS status,
  CAST(CASE WHEN ready AND marked AND won THEN txt END AS INTEGER) AS number, CASE WHEN ready THEN CASE WHEN marked THEN coalesce(conf, 0.0) ELSE 0.0 END END AS confidence,
  CASE WHEN ready THEN CASE WHEN marked THEN coalesce(votes, 0) ELSE 0 END END AS votes,
  CASE WHEN NOT ready THEN 'station_image_classifier_not_trained' WHEN NOT marked THEN 'station_marker_not_detected' WHEN votes IS NULL THEN 'no_confirmed_station_number_readings'
    WHEN won THEN 'multi_frame_majority_confirmed' ELSE 'multi_frame_station_numbers_do_not_agree' END AS reason,
  CASE WHEN ready THEN 'yolo_station_marker' END AS roi_source, CAST(CASE WHEN ready AND marked THEN user_id % 50 END AS DOUBLE) AS x1,
  CASE WHEN ready AND marked AND won THEN user_id = txt END AS metadata_matches FROM a""")
def station_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = A.frame_readings(spark, d).withColumn("number", (F.col("event_id") % 13).cast("int"))
    captures = rows.select(*_KEYS).distinct()
    x = (F.col("user_id") % 50).cast("double")
    markers = captures.where("user_id % 3 <> 0").select(*_KEYS, F.struct(x.alias("x1"), x.alias("y1"), (x + 9).alias("x2"), (x + 9).alias("y2")).alias("bbox"))
    out = VOTE.station_verdicts(captures, rows, markers, _KEYS, _ORDER, F.col("user_id") % 7 != 0, True, False, "user_id")
    return out.select(*_KEYS, "status", "number", "confidence", "votes", "reason", "roi_source", F.col("station_marker_bbox.x1").alias("x1"), "metadata_matches")


# --- templates ------------------------------------------------------------------------------------------------------
#
# Queries are the sign bits of all vectors (masks of 2 x 32 cells); the library
# holds one majority mask per label and fold, so it is bounded by labels x folds
# and still made from the whole table.

_FOLDS = 8


def _mask_rows(spark: SparkSession, d: str) -> DataFrame:
    b = A.sign_bits(spark, d)
    return b.select("vec_id", F.col("label").cast("string").alias("label"), (F.col("vec_id") % _FOLDS).cast("string").alias("source"), F.array("hi", "lo").alias("bits"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("label"), (F.col("vec_id") % _FOLDS).cast("string").alias("source"), F.posexplode("embedding").alias("i", "v"))
    votes = e.groupBy("label", "source", "i").agg((F.count_if(F.col("v") > 0) * 2 > F.count(F.lit(1))).alias("on"))
    word = lambda lo: F.coalesce(F.sum(F.when(F.col("on") & F.col("i").between(lo, lo + 31), F.call_function("shiftleft", F.lit(1).cast("bigint"), (31 + lo) - F.col("i")))), F.lit(0))
    packed = votes.groupBy("label", "source").agg(F.array(word(0), word(32)).alias("bits"))
    return packed.withColumn("template_id", F.col("label").cast("bigint") * _FOLDS + F.col("source").cast("bigint"))


_SHIFT_SQL = {
    (0, 0): ("qh", "ql"), (-1, 0): ("ql", "0"), (1, 0): ("0", "qh"),
    (0, -1): ("(qh << 1) & 4294967295", "(ql << 1) & 4294967295"), (0, 1): ("qh >> 1", "ql >> 1"),
}
_SHIFTS = tuple(_SHIFT_SQL)


def _dice_sql(recount: bool) -> str:
    parts = []
    for high, low in _SHIFT_SQL.values():
        own = f"bit_count({high}) + bit_count({low})" if recount else "bit_count(qh) + bit_count(ql)"
        total = f"({own} + bit_count(th) + bit_count(tl))"
        parts.append(f"(CASE WHEN {total} > 0 THEN 1.0 - 2.0 * (bit_count(({high}) & th) + bit_count(({low}) & tl)) / {total} ELSE 1.0 END)")
    return "least(1.0, " + ", ".join(parts) + ")"


_TEMPLATE_SQL = f"""{BITS_SQL},
e AS (SELECT CAST(label AS VARCHAR) AS label, vec_id % {_FOLDS} AS source, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
votes AS (SELECT label, source, i, count(*) FILTER (v > 0) * 2 > count(*) AS lit FROM e GROUP BY 1, 2, 3),
lib AS (SELECT label, source, CAST(label AS BIGINT) * {_FOLDS} + source AS template_id,
   CAST(coalesce(sum(CASE WHEN lit AND i < 32 THEN CAST(1 AS BIGINT) << greatest(0, 31 - i) END), 0) AS BIGINT) AS th, CAST(coalesce(sum(CASE WHEN lit AND i >= 32 THEN CAST(1 AS BIGINT) << least(31, 63 - i) END), 0) AS BIGINT) AS tl FROM votes GROUP BY 1, 2),
q AS (SELECT vec_id, CAST(label AS VARCHAR) AS truth, vec_id % {_FOLDS} AS fold, hi AS qh, lo AS ql FROM bits),
pair AS (SELECT vec_id, truth, lib.label, template_id, {{dice}} AS dist FROM q JOIN lib ON lib.source <> q.fold)"""


@query(f"""WITH {_TEMPLATE_SQL.format(dice=_dice_sql(True))},
best AS (SELECT vec_id, truth, label, min(dist) AS d1, arg_min(template_id, struct_pack(a := dist, b := template_id)) AS t FROM pair GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d1, t) AS k FROM best)
SELECT a.vec_id, a.label, a.label = a.truth AS correct, round(a.d1, 8) AS best_distance, round(coalesce(b.d1, 1.0), 8) AS second_distance,
  round(greatest(0, least(1, 0.65 * (1 - a.d1) + 0.35 * greatest(0, coalesce(b.d1, 1.0) - a.d1))), 8) AS confidence
FROM r a LEFT JOIN r b ON b.vec_id = a.vec_id AND b.k = 2 WHERE a.k = 1""")
def template_digits(spark: SparkSession, d: str) -> DataFrame:
    rows = _mask_rows(spark, d).withColumnRenamed("label", "truth")
    out = T.match_digits(rows, _library(spark, d), ["vec_id", "truth"], source="source", shape=(2, 32), shifts=_SHIFTS)
    return out.select("vec_id", "label", (F.col("label") == F.col("truth")).alias("correct"),
                      *[F.round(c, 8).alias(c) for c in ("best_distance", "second_distance", "confidence")])


@query(f"""WITH {_TEMPLATE_SQL.format(dice=_dice_sql(False))},
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY dist, template_id) AS n FROM pair),
best AS (SELECT vec_id, truth, label, avg(dist) AS d1 FROM near WHERE n <= 4 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d1, 12), label) AS k FROM best)
SELECT a.vec_id, a.label, round(a.d1, 8) AS best_distance, round(coalesce(b.d1, 1.0), 8) AS second_distance,
  round(greatest(0, least(1, 0.70 * (1 - a.d1) + 0.30 * least(1, 2 * greatest(0, coalesce(b.d1, 1.0) - a.d1)))), 8) AS confidence
FROM r a LEFT JOIN r b ON b.vec_id = a.vec_id AND b.k = 2 WHERE a.k = 1""")
def template_stations(spark: SparkSession, d: str) -> DataFrame:
    rows = _mask_rows(spark, d)
    out = T.match_stations(rows.drop("label"), _library(spark, d), ["vec_id"], source="source", shape=(2, 32), shifts=_SHIFTS)
    return out.select("vec_id", "label", *[F.round(c, 8).alias(c) for c in ("best_distance", "second_distance", "confidence")])


@query(f"""WITH {_TEMPLATE_SQL.format(dice=_dice_sql(True))},
best AS (SELECT vec_id, truth, label, min(dist) AS d1, arg_min(template_id, struct_pack(a := dist, b := template_id)) AS t FROM pair GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d1, t) AS k FROM best)
SELECT truth, count(*) AS total, count(*) FILTER (label = truth) AS correct, count(*) FILTER (label = truth) / count(*) AS accuracy FROM r WHERE k = 1 GROUP BY 1""")
def template_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _mask_rows(spark, d).withColumnRenamed("label", "truth")
    out = T.match_digits(rows, _library(spark, d), ["vec_id", "truth"], source="source", shape=(2, 32), shifts=_SHIFTS)
    graded = out.select("truth", F.col("truth").alias("expected"), F.col("label").alias("predicted"), F.lit("confirmed").alias("status"))
    return E.accuracy(graded, ["truth"]).select("truth", "total", "correct", "accuracy")


# --- images -----------------------------------------------------------------------------------------------------------
#
# 9 x 8 grey images made of the vector components (the first eight repeat to fill 72 pixels).

_PIXEL_SQL = """px AS (SELECT vec_id, list_transform(range(72), lambda i: CAST(greatest(0, least(255, floor(128 + 400 * CAST(embedding[i % 64 + 1] AS DOUBLE)))) AS BIGINT)) AS p FROM embeddings)"""


def vector_images(spark: SparkSession, d: str) -> DataFrame:
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 128)))
    cells = F.transform(F.concat("embedding", F.slice("embedding", 1, 8)), lambda v: F.lpad(F.hex(level(v)), 2, "0"))
    return A.table(spark, d, "embeddings").select(
        "vec_id", F.lit(8).alias("height"), F.lit(9).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(cells, "")).alias("data"))


@query(f"""WITH {_PIXEL_SQL},
edge AS (SELECT vec_id, p, list_transform(range(72), lambda i: CASE WHEN i < 9 OR i >= 63 OR i % 9 IN (0, 8) THEN p[i + 1] ELSE
   greatest(0, least(255, 8 * p[i + 1] - p[i - 9] - p[i - 8] - p[i - 7] - p[i] - p[i + 2] - p[i + 9] - p[i + 10] - p[i + 11])) END) AS e FROM px)
SELECT vec_id, round(list_sum(p) / 72, 4) AS brightness_mean, round(len(list_filter(p, lambda v: v < 32)) / 72, 6) AS dark_fraction,
  round(len(list_filter(p, lambda v: v >= 224)) / 72, 6) AS bright_fraction,
  round(list_sum(list_transform(e, lambda v: CAST(v * v AS DOUBLE))) / 72 - pow(list_sum(e) / 72, 2), 4) AS edge_variance FROM edge""")
def image_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = VIS.quality_metrics(vector_images(spark, d), ["vec_id"])
    return out.select("vec_id", "brightness_mean", "dark_fraction", "bright_fraction", "edge_variance")


@query(f"""WITH {_PIXEL_SQL},
b AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN p[i // 8 * 9 + i % 8 + 1] > p[i // 8 * 9 + i % 8 + 2] THEN 1 ELSE 0 END) AS f,
  list_transform(range(64), lambda i: CASE WHEN p[i // 8 * 9 + i % 8 + 1] < p[i // 8 * 9 + i % 8 + 2] THEN 1 ELSE 0 END) AS r FROM px)
SELECT vec_id, array_to_string(list_transform(range(16), lambda n: substr('0123456789abcdef', CAST(f[n*4+1] * 8 + f[n*4+2] * 4 + f[n*4+3] * 2 + f[n*4+4] + 1 AS INTEGER), 1)), '') AS perceptual_hash,
  array_to_string(list_transform(range(16), lambda n: substr('0123456789abcdef', CAST(r[n*4+1] * 8 + r[n*4+2] * 4 + r[n*4+3] * 2 + r[n*4+4] + 1 AS INTEGER), 1)), '') AS dhash FROM b""")
def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    return VIS.quality_metrics(vector_images(spark, d), ["vec_id"]).select("vec_id", "perceptual_hash", "dhash")


# --- evaluation --------------------------------------------------------------------------------------------------------

def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "labels").select(
        F.col("doc_id"), F.col("quality").alias("expected"), F.col("toxic").alias("predicted"),
        (F.col("doc_id") % 4).alias("variant"), F.when(F.col("doc_id") % 5 == 0, "unreadable").otherwise("confirmed").alias("status"))


@query("""SELECT count(*) AS total, count(*) FILTER (quality = toxic) AS correct, count(*) FILTER (doc_id % 5 <> 0) AS detected,
  count(*) FILTER (quality = toxic) / count(*) AS accuracy, count(*) FILTER (doc_id % 5 <> 0) / count(*) AS recall FROM labels""")
def accuracy_report(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(_predictions(spark, d))


@query("""SELECT doc_id % 4 AS variant, count(*) AS total, count(*) FILTER (quality = toxic) AS correct, count(*) FILTER (doc_id % 5 <> 0) AS detected,
  count(*) FILTER (quality = toxic) / count(*) AS accuracy, count(*) FILTER (doc_id % 5 <> 0) / count(*) AS recall FROM labels GROUP BY 1""")
def variant_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.variant_accuracy(_predictions(spark, d))


@query("""SELECT gate, value, threshold, value >= threshold AS passed FROM (
  SELECT 'accuracy' AS gate, count(*) FILTER (quality = toxic) / count(*) AS value, CAST(0.5 AS DOUBLE) AS threshold FROM labels
  UNION ALL SELECT 'recall', count(*) FILTER (doc_id % 5 <> 0) / count(*), 0.75 FROM labels)""")
def accuracy_gates(spark: SparkSession, d: str) -> DataFrame:
    return E.gates(E.accuracy(_predictions(spark, d)), {"accuracy": 0.5, "recall": 0.75})


@query("SELECT doc_id FROM labels WHERE quality <> toxic")
def failed_predictions(spark: SparkSession, d: str) -> DataFrame:
    return E.failures(_predictions(spark, d)).select("doc_id")


@query("""WITH p AS (SELECT printf('%04d', p_partkey) AS e, CASE WHEN p_size % 3 = 0 THEN '9' || substr(printf('%04d', p_partkey), 2) ELSE printf('%04d', p_partkey) END AS g FROM part),
h AS (SELECT e, g, len(list_filter(range(length(e)), lambda i: substr(e, CAST(i + 1 AS INTEGER), 1) = substr(g, CAST(i + 1 AS INTEGER), 1))) AS ok FROM p)
SELECT count(*) AS samples, CAST(sum(ok) AS BIGINT) AS digits_correct, CAST(sum(length(e)) AS BIGINT) AS digits_total, count(*) FILTER (e = g) AS strings_correct,
  sum(ok) / sum(length(e)) AS digit_accuracy, count(*) FILTER (e = g) / count(*) AS string_accuracy FROM h""")
def digit_accuracy(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("%04d", F.col("p_partkey"))
    def meter(t):
        return F.concat(F.lit("-"), F.substring(t, 1, 3), F.lit("."), t.substr(F.lit(4), F.length(t)))
    wrong = F.concat(F.lit("9"), text.substr(F.lit(2), F.length(text)))
    rows = A.table(spark, d, "part").select(meter(text).alias("expected"), meter(F.when(F.col("p_size") % 3 == 0, wrong).otherwise(text)).alias("predicted"))
    return E.digit_accuracy(rows)


@query("""SELECT p_brand || '/' || p_size AS expected, count(*) AS samples FROM part GROUP BY 1 HAVING count(*) < 2""")
def unvalidated_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("expected"))
    return E.unvalidated_classes(rows)
