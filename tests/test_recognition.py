import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamwatch.operators import fusion as U
from seamwatch.operators import modules as M
from seamwatch.operators import plugins as P
from seamwatch.operators import templates as T
from seamwatch.operators import vision as V
from seamwatch.operators import voting as VOTE
from tests.helpers import IMAGE_ROW, image_row

DETECTION = ("capture_id string, frame_index int, pos int, type string, class_id string, "
             "bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double, digital_text string, pointer_angle double, pointer_confidence double")


def detection(c, f, p, kind, box, conf, text=None, angle=None, angle_conf=None):
    return (c, f, p, kind, "k", tuple(float(v) for v in box), conf, text, angle, angle_conf)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def plain_fusion(rows, threshold=0.45):
    clusters = []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        scored = [(overlap(max(c, key=lambda m: m[6])[5], r[5]), -i) for i, c in enumerate(clusters) if c[0][3] == r[3]]
        best = max((s for s in scored if s[0] >= threshold and s[0] > 0), default=None)
        clusters[-best[1]].append(r) if best else clusters.append([r])
    return sorted((max(c, key=lambda m: m[6])[5], len({m[1] for m in c})) for c in clusters)


def test_three_frames_become_one_object(spark):
    rows = [detection("c", i, 0, "tool", (10 + i, 20, 100 + i, 120), 0.9 + i / 100) for i in range(3)]
    fused = U.fused_objects(U.assign_clusters(spark.createDataFrame(rows, DETECTION))).collect()
    assert len(fused) == 1 and fused[0].observations == 3 and fused[0].confidence == pytest.approx(0.92)


@pytest.mark.parametrize("batch,hot_rows", [("10000", 1000), ("7", 1000), ("10000", 25)])
def test_fusion_equals_a_plain_loop(spark, batch, hot_rows):
    """Crowded captures; islands that span Arrow batches and groups cut in stripes included."""
    rnd = random.Random(5)
    rows = []
    for c in range(12):
        for p in range(60):
            x, y = rnd.uniform(0, 400), rnd.uniform(0, 30)
            rows.append(detection(f"c{c}", p % 3, p, rnd.choice(["tool", "sign"]), (x, y, x + rnd.uniform(10, 30), y + rnd.uniform(10, 30)), round(rnd.random(), 3)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        fused = U.fused_objects(U.assign_clusters(spark.createDataFrame(rows, DETECTION), hot_rows=hot_rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c in range(12):
        got = sorted((tuple(r.bbox), r.observations) for r in fused if r.capture_id == f"c{c}")
        assert got == plain_fusion([r for r in rows if r[0] == f"c{c}"])


def test_groups_that_are_not_hot_take_two_shuffles_and_one_window(spark):
    rows = [detection(f"c{i % 40}", i % 3, i, "tool", (i % 7, 0, 30 + i % 7, 30), 0.5) for i in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fused = U.fused_objects(U.assign_clusters(spark.createDataFrame(rows, DETECTION), hot_rows=400))
        assert fused.count() and len(fused.collect()) == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = fused._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    assert final.count("REPARTITION_BY_COL") == 2 and final.count("Window [") == 1
    assert "SortMergeJoin" not in final and "ShuffledHashJoin" not in final


@pytest.mark.parametrize("hot_rows", [100_000, 500])
def test_scattered_boxes_of_all_sizes_equal_a_plain_loop(spark, hot_rows):
    """Many open clusters in one group, wide and flat boxes, boxes that cannot overlap; a key without a value is a group too."""
    rnd = random.Random(9)
    rows = []
    for c in ("a", None):
        for p in range(600):
            x, y, w = rnd.uniform(-500, 2000), rnd.uniform(-500, 500), rnd.choice([12, 25, 25, 30, 900])
            box = (x, y, x + w, y + rnd.choice([20, 25, 30, 0, -5, 700]))
            rows.append(detection(c, p % 4, p, "tool", rows[-1][5] if p % 3 == 2 else box, round(rnd.random(), 3)))
    fused = U.fused_objects(U.assign_clusters(spark.createDataFrame(rows, DETECTION), hot_rows=hot_rows)).collect()
    for c in ("a", None):
        assert sorted((tuple(r.bbox), r.observations) for r in fused if r.capture_id == c) == plain_fusion([r for r in rows if r[0] == c])


def test_a_grid_keeps_a_fold_with_many_open_clusters_short():
    boxes = [[i % 300 * 40.0, i // 300 * 40.0, i % 300 * 40.0 + 30, i // 300 * 40.0 + 30] for i in range(30_000)]
    clusters = [[*b, 0.5, n] for n, b in enumerate(boxes)]
    grid = U._Grid(clusters)
    assert all(grid.near(b) == [n] or len(grid.near(b)) <= 9 and n in grid.near(b) for n, b in enumerate(boxes))
    moved = [b + 1 for b in boxes[70]]
    assert U._join_cluster(clusters, moved, 0.9, 30_000, 0.45, grid) == 70 and clusters[70][:5] == [*moved, 0.9]
    assert 70 in grid.near(moved) and grid.near([1e6, 0, 1e6 + 9, 9]) == [] == grid.near([0, 0, float("nan"), 9])
    assert U._join_cluster(clusters, [1e6, 0, 1e6 + 9, 9], 0.9, 30_001, 0.45, grid) == 30_001 and grid.near([1e6, 0, 1e6 + 5, 5]) == [30_000]


def test_meter_clusters(spark):
    box = (0, 0, 10, 10)
    rows = [detection("d", i, 0, "digital_meter", box, 0.9, t) for i, t in enumerate(["600.0", "600.0", "600.8"])]
    rows += [detection("a", i, 0, "analog_meter", box, 0.9, None, a, 0.9) for i, a in enumerate([359.0, 0.0, 1.0])]
    rows += [detection("n", 0, 0, "analog_meter", box, 0.9, None, 5.0, 0.9)]
    clustered = U.assign_clusters(spark.createDataFrame(rows, DETECTION))
    vote = U.cluster_meter_votes(clustered).first()
    assert (vote.status, vote.raw_text, vote.value, vote.votes) == ("confirmed", "600.0", 600.0, 2)
    reference = clustered.where("capture_id = 'a'").select("capture_id", "type", "class_id", "cluster").distinct().withColumn(
        "normal_angle_deg", F.lit(0.0)).withColumn("tolerance_deg", F.lit(5.0)).withColumn("min_confidence", F.lit(0.55))
    out = {r.capture_id: r for r in U.cluster_pointer_status(clustered, reference).collect()}
    assert (out["a"].status, out["a"].angle_deg, out["a"].delta_deg) == ("normal", 0.0, 0.0)
    assert (out["n"].status, out["n"].reason) == ("uncertain", "analog_reference_missing")


def test_votes(spark):
    def vote(values):
        rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, t string")
        return VOTE.majority_vote(rows, ["g"], ["i"], "t").first()
    assert (vote(["600.0", "600.0", "600.8"]).raw_text, vote(["1.0", "2.0", "3.0"]).status) == ("600.0", "unreadable")
    assert (vote([None, " "]).votes, vote(["b", "a", "a", "b"]).raw_text) == (0, "b")
    rows = spark.createDataFrame([("g", 0, "5", "confirmed", 0.9), ("g", 1, "5", "confirmed", 0.7), ("g", 2, "7", "unreadable", 0.1),
                                  ("single", 0, "5", "confirmed", 0.6), ("split", 0, "5", "confirmed", 0.6), ("split", 1, "6", "confirmed", 0.7)],
                                 "g string, i int, t string, status string, confidence double")
    out = {r.g: r for r in VOTE.meter_vote(rows, ["g"], ["i"], "t").collect()}
    assert (out["g"].confidence, out["g"].votes, out["single"].status) == (0.7, 2, "confirmed")
    assert (out["split"].status, out["split"].reason) == ("unreadable", "multi_frame_readings_do_not_agree")


DOC = ("capture_id string, status string, detector_mode string, manually_corrected boolean, "
       "objects array<struct<type:string,class:string,class_cn:string,confidence:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>")


def test_document_summary(spark):
    marker = ("station_marker", "station_marker", "区段编号牌", "0.91", (0.0, 0.0, 5.0, 5.0))
    docs = spark.createDataFrame([
        ("partial", "processed", "gpu", False, [marker]), ("fixed", "processed", "gpu", True, [marker]), ("failed", "failed", None, False, []),
        ("new", "received", None, False, []), ("none", "processed", None, False, [])], DOC)
    unread = M.module_result(enabled=F.lit(True), status=F.lit("unreadable"), reason=F.lit("r"))
    read = M.module_result(enabled=F.lit(True), status=F.lit("confirmed"), number=F.lit(8), confidence=F.lit(0.8))
    modules = {"station_number": F.when(F.col("capture_id") == "fixed", read).otherwise(unread), "analog_meter": M.analog_meter(F.col("objects"), enabled=False)}
    out = {r.capture_id: r for r in M.summarize_documents(M.run_modules(docs, modules)).collect()}
    assert (out["partial"].summary_status, out["partial"].primary.source_id) == ("partial", "yolo")
    assert (out["fixed"].summary_status, out["fixed"].primary.display_value) == ("recognized", "8 号")
    assert out["fixed"].items[0].source_id == "manual_review" and len(out["fixed"].items) == 2
    assert (out["failed"].summary_status, out["failed"].items, out["new"].summary_status) == ("failed", None, "processing")
    assert (out["none"].summary_status, out["none"].primary) == ("unrecognized", None)


def test_modules(spark):
    docs = spark.createDataFrame([("a", "processed", None, False, [("coal_pile", "coal_pile", "煤堆", "0.9", None), ("tool", "wrench", "", "0.5", None),
                                  ("x", "station_marker", "", "0.5", (0.0, 0.0, 1.0, 1.0)), ("station_marker", "y", "", "0.7", (0.0, 0.0, 2.0, 1.0)),
                                  ("station_marker", "z", "", "0.9", (3.0, 0.0, 2.0, 1.0))])], DOC)
    o = F.transform("objects", lambda x: x.withField("confidence", x["confidence"].cast("double")))
    row = docs.select(
        M.coal_presence(o, F.lit(True)).alias("coal"), M.coal_presence(o, F.lit(False)).alias("blind"), M.tool_and_safety_sign(o).alias("tool"),
        M.station_from_metadata(F.lit("11")).alias("s"), M.best_marker(o).alias("box")).first()
    assert row.coal.present is True and row.blind.present is None and row.blind.status == "unavailable"
    assert row.tool.labels == ["wrench"] and row.s.reason == "station_number_outside_allowed_range" and row.box.x2 == 2.0
    table = {r.module_id: r for r in M.describe_modules(spark, {"analog_meter": {"enabled": False, "reason": "no images"}, "station_number": {"recognition_mode": "capture_metadata"}}, False, ["digital_meter"]).collect()}
    assert table["analog_meter"].reason == "no images" and table["digital_meter"].status == "ready"
    assert table["coal_presence"].status == "unavailable" and table["station_number"].status == "metadata_only"


def test_detector_plugin(spark):
    images = spark.createDataFrame([(1, "/a/b.jpg"), (2, "/a/c.jpg")], "id int, path string")
    assert P.no_detector(images, ["id"]).count() == 0 and P.detector_warnings(False)
    side = spark.createDataFrame([("/a/b.jpg.detections.json", '[{"type":"tool","class":"w","bbox_xyxy":[0,0,1,1],"confidence":0.5,"attributes":{"_x":"1"}}]')], "path string, content string")
    found = P.replay_detector(images, side, ["id"]).collect()
    assert len(found) == 1 and found[0].class_cn == "w" and found[0].bbox.x2 == 1.0
    carried = P.with_parameters(images, {"iou": 0.45, "mode": "gpu"}).first()
    assert carried.processing_parameters.mode == "gpu"


# --- templates and images ---------------------------------------------------------------------------------------

def dice(query, template, shifts, recount):
    best = 1.0
    h, w = query.shape
    for dy, dx in shifts:
        moved = np.zeros_like(query)
        ys, xs = np.nonzero(query)
        keep = (ys + dy >= 0) & (ys + dy < h) & (xs + dx >= 0) & (xs + dx < w)
        moved[ys[keep] + dy, xs[keep] + dx] = 1
        total = (moved if recount else query).sum() + template.sum()
        best = min(best, 1 - (2 * (moved & template).sum() / total if total else 0))
    return best


def words(mask):
    return np.packbits(mask.astype(np.uint8).ravel()).view(">u4").astype(np.int64).tolist()


@pytest.mark.parametrize("recount,block,limit", [(True, 512, 1 << 24), (False, 2, 1 << 24), (False, 2, 0), (True, 3, 0)])
def test_template_distances_equal_pairwise_dice(spark, monkeypatch, recount, block, limit):
    from seamwatch import constants as K
    monkeypatch.setattr(T, "LIBRARY_BYTES", limit)
    rng = np.random.default_rng(1)
    masks = rng.integers(0, 2, size=(7, 96, 64)).astype(np.uint8)
    shifts = K.DIGIT_SHIFTS if recount else K.STATION_SHIFTS
    rows = spark.createDataFrame([(i, str(i % 3), f"s{i % 2}", words(m)) for i, m in enumerate(masks)], "template_id int, label string, source string, bits array<long>")
    queries = spark.createDataFrame([(9, "s1", words(np.roll(masks[2], 2, axis=0)))], "q int, source string, bits array<long>")
    got = {r.label: r.distance for r in T.score_templates(queries, rows, ["q"], shifts, (96, 64), recount, source="source", nearest=2, block=block).collect()}
    query = np.roll(masks[2], 2, axis=0)
    for label in got:
        near = sorted(dice(query, m, shifts, recount) for i, m in enumerate(masks) if str(i % 3) == label and i % 2 == 0)[:2]
        assert got[label] == pytest.approx(sum(near) / len(near))


def test_quality(spark):
    rng = np.random.default_rng(3)
    images = spark.createDataFrame([image_row("noise", rng.integers(0, 256, (700, 900, 3))), image_row("dark", np.zeros((300, 400, 3))), image_row("light", np.full((300, 400, 3), 255))], IMAGE_ROW).union(
        spark.createDataFrame([("broken", -1, -1, -1, bytearray()), ("none", None, None, None, None)], IMAGE_ROW))
    metrics = {r.name: r for r in V.quality_metrics(images, ["name"]).collect()}
    assert (metrics["dark"].brightness_mean, metrics["dark"].dark_fraction, metrics["dark"].edge_variance) == (0.0, 1.0, 0.0)
    assert metrics["light"].bright_fraction == 1.0 and 120 < metrics["noise"].brightness_mean < 135
    assert metrics["dark"].perceptual_hash == metrics["dark"].dhash == "0" * 16
    assert metrics["broken"].brightness_mean is None and metrics["none"].dhash is None


@pytest.mark.parametrize("buckets", [2, 4, 36, 3600])
def test_medoid_by_buckets_equals_brute_force(spark, buckets):
    rng = random.Random(buckets)
    kinds = {
        "spread": [rng.uniform(0, 360) for _ in range(150)], "near zero": [rng.gauss(0, 3) % 360 for _ in range(80)],
        "two ends": [90.0] * 20 + [270.0] * 20, "one": [359.999999], "ties": [0.0, 120.0, 240.0] * 5, "edge": [0.0, 359.9999999, 180.0, 0.1, 180.1],
        "hot": [round(rng.gauss(77, 0.02), 6) for _ in range(300)] + [257.0] * 40, "negative": [-10.0, 350.0, 710.0, 5.5]}
    rows = [(k, i, a, i / 1000) for k, v in kinds.items() for i, a in enumerate(v)] + [("spread", 999, None, 1.0)]
    got = VOTE.angle_medoid(spark.createDataFrame(rows, "k string, i int, angle double, confidence double").repartition(5), ["k"], ["i"], buckets=buckets)
    got = {r.k: (r.angle, r.confidence, r.total_distance, r.measurements) for r in got.collect()}
    for k, v in kinds.items():
        micro = [round(a * 1_000_000) % 360_000_000 for a in v]
        total = [sum(min(abs(x - y), 360_000_000 - abs(x - y)) for y in micro) for x in micro]
        i = min(range(len(v)), key=lambda j: (total[j], j))
        assert got[k] == (v[i], i / 1000, total[i] / 1_000_000, len(v)), k
