import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seamwatch.operators import batches as B
from seamwatch.operators import captures as C
from seamwatch.operators import validate as V
from seamwatch.sinks import tables as sinks
from seamwatch.sources import files as SRC


def test_metadata_rules(spark):
    good = {"capture_id": "c-1", "capture_time": "2026-08-04T15:30:05Z", "station_id": " 08 ", "images": ["a.jpg", " ", "b.jpg"], "batch_id": " "}
    bad = [
        {**good, "capture_id": "-x"}, {**good, "capture_time": ""}, {**good, "capture_time": "now"}, {**good, "station_id": None}, {**good, "camera_id": " "},
        {**good, "batch_id": "b" * 129}, {**good, "images": ["a"] * 6}, {**good, "images": ["a", "a"]}, {**good, "robot_pose": {"yaw_deg": "Infinity"}},
        {**good, "robot_pose": {"frame": "f" * 33}},
    ]
    rows = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate([good, *bad])] + [(99, "[oops")], "i int, metadata_json string")
    out = {r.i: r for r in V.parse_metadata(rows).collect()}
    assert out[0].error is None and out[0].images == ["a.jpg", "b.jpg"] and out[0].camera_id == "go2_front"
    assert out[0].station_id == "08" and out[0].batch_id is None and out[0].robot_pose.frame == "map"
    assert all(out[i].error for i in range(1, len(bad) + 1)) and out[99].error
    assert out[9].error == "robot_pose.yaw_deg must be finite"


def test_listing_correction_and_reprocessing(spark):
    captures = spark.createDataFrame([("a", "2026-01-02", "r1", "8", "processed"), ("b", "2026-01-03", "r2", "8", "failed")],
                                     "capture_id string, capture_time string, received_at string, station_id string, status string")
    images = spark.createDataFrame([("a", 1), ("a", 2)], "capture_id string, position int")
    objects = spark.createDataFrame([("a",), ("a",), ("a",)], "capture_id string")
    t = dt.datetime(2026, 1, 5)
    log = spark.createDataFrame([(1, "a", t, 9), (2, "a", t + dt.timedelta(hours=1), 1)], "id long, capture_id string, created_at timestamp, n int")
    items = spark.createDataFrame([("b2", "a", "succeeded"), ("b1", "a", "succeeded"), ("b0", "a", "failed"), ("b0", "gone", "succeeded")],
                                  "batch_id string, capture_id string, status string")
    fixes = C.active_corrections(log, log.select("capture_id", F.lit(t - dt.timedelta(days=1)).alias("at")))
    page = C.capture_page(C.capture_summary(captures, images, objects, fixes, items, "n")).collect()
    assert [r.capture_id for r in page] == ["b", "a"]
    assert (page[1].image_count, page[1].object_count, page[1].manually_corrected, page[1].source_batch_id) == (2, 1, True, "b1")
    redone = C.active_corrections(log, log.select("capture_id", F.lit(t + dt.timedelta(days=1)).alias("at")))
    assert redone.count() == 2 and redone.where("active").count() == 0
    again = C.capture_summary(captures, images, objects, redone, items, "n").where("capture_id = 'a'").first()
    assert (again.object_count, again.manually_corrected) == (3, False)
    document = C.get_capture("a", captures, images, redone, items).first()
    assert [i.position for i in document.images] == [1, 2] and len(document.corrections) == 2 and document.source_batch_id == "b1"
    with pytest.raises(ValueError):
        C.capture_page(captures, limit=501)


def test_export_keeps_empty_captures(spark, tmp_path):
    schema = ("capture_id string, capture_time string, received_at string, station_id string, camera_id string, source_batch_id string, status string, "
              "robot_pose struct<frame:string,x_m:double,y_m:double,yaw_deg:double>, manually_corrected boolean, error string, "
              "objects array<struct<type:string,class:string,class_cn:string,confidence:string,bbox_xyxy:array<double>>>")
    base = ("t", "r", "8", "cam", None, "processed", ("map", 1.0, None, None), False, None)
    rows = spark.createDataFrame([("a", *base, [("tool", "wrench", "扳手", "0.9", [1.0, 2.0, 3.0, 4.0])] * 2), ("b", *base, [])], schema)
    flat = C.export_documents(rows)
    assert sorted((r.capture_id, r.object_index) for r in flat.collect() if r.capture_id == "a") == [("a", 0), ("a", 1)]
    assert flat.where("capture_id = 'b'").first().object_index is None
    sinks.export_csv(flat, str(tmp_path / "csv"))
    sinks.export_json(flat, str(tmp_path / "json"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == flat.columns and back.count() == 3 and spark.read.json(str(tmp_path / "json")).count() == 3
    objects = sinks.result_objects(rows).orderBy("object_index").collect()
    assert [(o.object_index, o.confidence) for o in objects] == [(0, 0.9), (1, 0.9)]


def test_batch_life_cycle(spark):
    """import with one bad item -> failed item -> retry -> completed with a warning."""
    header = spark.createDataFrame([("b",)], "batch_id string")
    items = spark.createDataFrame([("b", "p1", "c1", None), ("b", "p2", "c2", "x" * 3000), ("old", "p", "c", None)],
                                  "batch_id string, relative_path string, capture_id string, error string")
    heads, start = sinks.register_batches(header, items, spark.createDataFrame([("old",)], "batch_id string"))
    assert heads.count() == 1 and {r.status for r in start.collect()} == {"pending", "failed"} and start.where("length(error) = 2000").count() == 1
    log = start.withColumn("version", F.lit(0)).unionByName(spark.createDataFrame(
        [("b", "p1", None, None, "succeeded", 1)], "batch_id string, relative_path string, capture_id string, error string, status string, version int"))
    now = B.current_items(log)
    assert now.where("relative_path = 'p1'").first().capture_id == "c1"
    notes = spark.createDataFrame([("b", "items"), ("b", "gas")], "batch_id string, scope string")
    assert B.finish_batches(now, notes).first().status == "completed_with_errors"
    retried = B.retry_failed(now)
    assert {r.status for r in retried.collect()} == {"succeeded", "pending"}
    heads = spark.createDataFrame([("b", "failed", None)], "batch_id string, sensor_status string, error string")
    assert [r.scope for r in B.retry_diagnostics(notes, heads).collect()] == ["items"]
    done = retried.withColumn("status", F.lit("succeeded"))
    assert B.finish_batches(done, notes.limit(0)).first().status == "completed"
    assert B.finish_batches(done, notes.limit(0), heads).first().status == "completed_with_errors"
    lost = done.withColumn("status", F.lit("failed"))
    assert B.finish_batches(lost, notes.limit(0)).first().status == "failed"
    assert B.progress(B.item_counts(now)).first().progress_percent == 100.0
    interrupted = now.withColumn("status", F.lit("running"))
    assert {r.status for r in B.reset_interrupted(interrupted).collect()} == {"pending"}


def test_preflight_is_fatal_for_duplicates_and_escapes(spark):
    items = spark.createDataFrame(
        [("ok", "a", "c1", "bad image"), ("dup", "a", "c1", None), ("dup", "b", "c1", None), ("esc", "a", "c", "capture path escapes batch"), ("few", "a", "c", None)],
        "batch_id string, relative_path string, capture_id string, error string")
    folders = spark.createDataFrame([(b, f) for b in ("ok", "dup", "esc", "none") for f in ("gas", "thermal", "visible")] + [("few", "gas")], "batch_id string, folder string")
    good, fatal = V.preflight(items, folders)
    assert [r.batch_id for r in good.collect()] == ["ok"]
    messages = {r.batch_id: r.message for r in fatal.collect()}
    assert messages["dup"] == "duplicate capture_id c1: a, b" and messages["few"].endswith("thermal, visible") and "no visible" in messages["none"]


def test_packages(spark):
    meta = {"capture_id": "c", "capture_time": "2026-08-04", "station_id": "8", "images": ["1.png", "2.png", "3.png"]}
    rows = spark.createDataFrame([("b", "visible/p", json.dumps(meta)), ("b", "visible/q", json.dumps({**meta, "images": ["1.png"]}))],
                                 "batch_id string, relative_path string, metadata_json string")
    files = spark.createDataFrame([("b", f"visible/p/{i}.png", None if i < 3 else "uploaded image is empty") for i in (1, 2, 3)],
                                  "batch_id string, relative_path string, image_error string")
    out = {r.relative_path: r for r in SRC.load_packages(rows, files).collect()}
    assert out["visible/p"].error == "uploaded image is empty" and "exactly 3" in out["visible/q"].error
