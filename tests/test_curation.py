import itertools
import random

import pytest
from pyspark.sql import functions as F

from seamwatch.operators import curation as D
from seamwatch.operators import neardup as N
from seamwatch.sinks import tables as sinks
from seamwatch.sources import files as SRC


def test_golden_report(spark, tmp_path):
    """Nine equal images of three captures: eight duplicates, one group per split."""
    captures = ["http_smoke_station10", "smoke_fig_station10", "validation_http_20260729_v2"]
    rows = [(f"{c}/{i}.jpg", c, c, "s", "p") for c in captures for i in range(3)]
    records = spark.createDataFrame(rows, "relative_path string, capture_id string, batch_id string, sha256 string, perceptual_hash string")
    flagged = D.duplicate_flags(records)
    assert flagged.where("exact_duplicate").count() == 8 and flagged.where("near_duplicate").count() == 0
    done = D.assign_splits(flagged).withColumn("qc_flags", F.array_compact(F.array(F.when(F.col("exact_duplicate"), "exact_duplicate"))))
    splits = {r.capture_id: r.split for r in done.collect()}
    assert splits == {"smoke_fig_station10": "train", "http_smoke_station10": "val", "validation_http_20260729_v2": "test"}
    sinks.write_dataset_reports(done, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/summary/totals")).first().asDict() == {"images_total": 9, "captures_total": 3}
    assert spark.read.option("header", True).csv(str(tmp_path / "report/issues")).count() == 8
    assert D.odd_captures(done).count() == 0 and D.empty_splits(done).count() == 0


def test_near_duplicate_is_never_exact(spark):
    rows = [("b", "1", "p"), ("A", "1", "p"), ("c", "2", "p"), ("d", "3", None)]
    out = {r.relative_path: (r.exact_duplicate, r.near_duplicate) for r in D.duplicate_flags(spark.createDataFrame(rows, "relative_path string, sha256 string, perceptual_hash string")).collect()}
    assert out == {"A": (False, False), "b": (True, False), "c": (False, True), "d": (False, False)}


def test_groups_never_leak(spark):
    rnd = random.Random(2)
    rows = [(f"{i}", f"c{rnd.randint(0, 40)}", rnd.choice([None, "b1", "b2"])) for i in range(400)]
    out = D.assign_splits(spark.createDataFrame(rows, "relative_path string, capture_id string, batch_id string"))
    assert out.count() == 400
    assert out.groupBy(F.coalesce("batch_id", "capture_id")).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("bucket_limit", [1024, 1])
def test_near_pairs_equal_brute_force(spark, bucket_limit):
    """With a bucket limit of one every pair goes through the balls of crowded buckets."""
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    hashes = []
    for i in range(90):
        value = rnd.choice(seeds)
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            value ^= 1 << bit
        hashes.append((i, "abc"[i % 3], value))
    rows = spark.createDataFrame([(i, s, v >> 32, v & 0xFFFFFFFF) for i, s, v in hashes], "id long, split string, hi long, lo long")
    got = {((r.left_split, r.left_hi << 32 | r.left_lo), (r.right_split, r.right_hi << 32 | r.right_lo), r.distance) for r in N.cross_split_pairs(rows, bucket_limit=bucket_limit).collect()}
    want = set()
    for (_, s, a), (_, t, b) in itertools.product(hashes, hashes):
        if s < t and (a ^ b).bit_count() <= 4:
            want.add(((s, a), (t, b), (a ^ b).bit_count()))
    assert got == want and want


def test_labels(spark):
    classes = SRC.classes(spark.createDataFrame([('{"dot":{"train":false},"coal":{},"meter":{"train":true}}',)], "content string")).select("class", "class_index")
    assert {r["class"]: r.class_index for r in classes.collect()} == {"dot": None, "coal": 0, "meter": 1}
    images = spark.createDataFrame([("i1", '[{"class":"meter","bbox_xyxy":[0,0,50,50]},{"class":"dot","bbox_xyxy":[0,0,1,1]},{"class":"coal","bbox_xyxy":[10,10,20,20]}]'), ("i2", "[]"), ("i3", None), ("i4", "{}")],
                                   "image string, annotation_json string")
    boxes, bad = SRC.annotation_boxes(images, ["image"])
    assert [r.image for r in bad.collect()] == ["i4"]
    rows = D.annotation_rows(boxes.withColumn("width", F.lit(100)).withColumn("height", F.lit(100)), classes)
    annotated = images.where("image IN ('i1', 'i2')").select("image")
    texts = {r.image: r.text for r in D.label_texts(rows, annotated, "image", ["pos"]).collect()}
    assert texts == {"i1": "1 0.25000000 0.25000000 0.50000000 0.50000000\n0 0.15000000 0.15000000 0.10000000 0.10000000\n", "i2": ""}


def test_label_text_of_a_crowded_image_is_whole(spark):
    rows = spark.range(5000).select(F.lit("i").alias("image"), F.col("id").alias("pos"), F.lit("kept").alias("outcome"), F.col("id").cast("string").alias("line"))
    got = D.label_texts(rows.repartition(7), spark.createDataFrame([("i",)], "image string"), "image", ["pos"]).collect()
    assert [r.text for r in got] == ["".join(f"{i}\n" for i in range(5000))]


def test_crops_by_content(spark):
    samples = spark.createDataFrame([("4/a.png", "ab", 4, 400, 400), ("4/b.png", "cd", 4, 400, 400)], "path string, sha256 string, label int, width int, height int")
    boxes = spark.createDataFrame([("AB", 0, (0, 0, 40, 40)), ("AB", 1, (80, 80, 340, 340))], "sha256 string, pos int, bbox struct<x1:int,y1:int,x2:int,y2:int>")
    notes = D.largest_boxes(boxes, ["sha256"], ["pos"]).withColumn("annotation_label", F.lit(3))
    good, skipped = D.crop_boxes(D.match_annotations(samples, notes))
    row = good.first()
    assert tuple(row.crop) == (59, 59, 361, 361) and row.label_corrected and skipped.first().path == "4/b.png"


@pytest.mark.parametrize(("bands", "bucket_limit"), [(5, 1024), (6, 1024), (7, 1024), (5, 2)])
def test_pairs_at_every_distance_whatever_the_bands(spark, bands, bucket_limit):
    rng = random.Random(bands)
    base = [rng.getrandbits(64) for _ in range(25)]
    rows, n = [], 0
    for h in base:
        for flips in range(7):
            x = h
            for bit in rng.sample(range(64), flips):
                x ^= 1 << bit
            for split in rng.sample(["train", "val", "test"], 2):
                rows.append((n, split, x >> 32, x & 0xFFFFFFFF))
                n += 1
    got = [((r.left_split, r.left_hi << 32 | r.left_lo), (r.right_split, r.right_hi << 32 | r.right_lo), r.distance)
           for r in N.cross_split_pairs(spark.createDataFrame(rows, "id int, split string, hi long, lo long"), bands=bands, bucket_limit=bucket_limit).collect()]
    classes = {(s, hi << 32 | lo) for _, s, hi, lo in rows}
    want = {(a, b, (a[1] ^ b[1]).bit_count()) for a in classes for b in classes if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want
    assert {d for _, _, d in want} == {0, 1, 2, 3, 4}


def test_bands_follow_the_number_of_hashes():
    assert [N.bands_for(n, 4) for n in (0, 200_000, 10**7, 10**9, 10**11, 10**13)] == [5, 5, 6, 7, 8, 9]
    assert all(sum(N.band_widths(m)) == 64 for m in range(1, 13))
    assert N.bands_for(10**9, 0) == 1


def test_dataset_images_and_their_summary(spark):
    rows = [(1, True, "train", True, 9, 9), (2, True, "val", True, 9, 9), (3, True, "train", False, 9, 9), (4, False, "train", True, 9, 9), (5, True, "", True, 9, 9),
            (6, True, None, False, 9, 9), (7, True, "test", True, 0, 9), (8, True, "test", True, None, 9), (9, None, None, None, None, None), (10, True, "test", None, None, None)]
    images = D.dataset_images(spark.createDataFrame(rows, "i int, there boolean, split string, labelled boolean, width int, height int"), F.col("there"), F.col("labelled"))
    assert {r.i: r.outcome for r in images.collect()} == {
        1: "converted", 2: "converted", 3: "skipped", 4: "missing", 5: "invalid_split", 6: "invalid_split", 7: "missing_size", 8: "missing_size", 9: "missing", 10: "skipped"}
    assert {(r.part, r.name): r.images for r in D.dataset_summary(images).collect()} == {
        ("images", "converted"): 2, ("images", "skipped_unlabelled"): 2, ("split", "train"): 1, ("split", "val"): 1, ("split", "test"): 0,
        ("violation", "missing"): 2, ("violation", "invalid_split"): 2, ("violation", "missing_size"): 2}
    assert {r.images for r in D.dataset_summary(images.limit(0)).collect()} == {0}
