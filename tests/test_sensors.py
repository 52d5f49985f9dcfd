import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions import thermal as T
from seamwatch.operators import sensors as S
from seamwatch.sinks import tables as sinks
from seamwatch.skew import global_rank, number_rows, previous_value, spread_join
from seamwatch.sources import files as SRC
from tests.helpers import png

EN_ROW = '2026-08-04T15:30:05+08:00,000001,1.25,%LEL,ok,20.9,%VOL,ok,2,ppm,ok,0,ppm,ok,"two\nlines"'
ZH_ROW = "2026-02-11T07:30:25+08:00,000001,0,19.5,2,0,O2状态：low_alarm"


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    batch = root / "inspection-export-1"
    for name in ("gas", "thermal", "visible/p1", "visible/.hidden"):
        (batch / name).mkdir(parents=True)
    (batch / "gas/en.csv").write_text("\n".join([",".join(K.GAS_HEADER_EN), EN_ROW, "", EN_ROW, "bad,1" + "," * 13]) + "\n", "utf-8")
    (batch / "gas/zh.csv").write_text("\ufeff" + ",".join(K.GAS_HEADER_ZH) + "\r\n" + ZH_ROW + "\r\n", "utf-8")
    (batch / "gas/old.csv").write_text("a,b\n1,2\n")
    good = png(np.zeros((24, 32, 3)))
    (batch / "thermal/thermal_20260804_153005_000001.png").write_bytes(good)
    (batch / "thermal/THERMAL_20260804_153010_000002.PNG").write_bytes(good)
    (batch / "thermal/thermal_20260804_153015_000003.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (batch / "thermal/heat.png").write_bytes(good)
    (batch / "visible/p1/metadata.json").write_text("{}")
    (batch / "visible/.hidden/metadata.json").write_text("{}")
    (batch / "visible/color_20260211_073025_706675.jpg").write_bytes(b"\xff\xd8\xff0")
    (root / "other").mkdir()
    (root / "other/x.csv").write_text("x")
    return str(root)


def test_gas_files(spark, inbox):
    files = SRC.with_batch(SRC.read_texts(spark, inbox), inbox)
    records = SRC.csv_records(files.select("batch_id", "path", "content"))
    assert SRC.count_gas_rows(records, ["batch_id"]).collect()[0].gas_rows == 5
    samples, notes = SRC.normalize_gas(records)
    rows = {r.sample_key: r for r in samples.collect()}
    english, chinese = rows["20260804_153005_000001"], rows["20260211_073025_000001"]
    assert (english.ch4_value, english.o2_unit, english.ch4_status, english.gas_error) == (1.25, "%VOL", "ok", "two\nlines")
    assert (chinese.o2_value, chinese.o2_unit, chinese.o2_status, chinese.gas_error) == (19.5, "%VOL", None, "O2状态：low_alarm")
    messages = sorted((r.row or 0, r.message) for r in notes.collect())
    assert messages == [(0, "invalid gas CSV header: old.csv"), (3, "duplicate sensor sample: 20260804_153005_000001"), (4, "gas timestamp must be ISO-8601")]


def test_thermal_files(spark, inbox):
    files = SRC.with_batch(SRC.read_files(spark, inbox, "*.[pP][nN][gG]"), inbox)
    images = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(inbox)
    images = images.withColumn("image", F.col("image").withField("origin", F.regexp_replace("image.origin", "^file:/+", "file:/")))
    samples, notes = SRC.normalize_thermal(SRC.mark_decodable(files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), images))
    assert sorted(r.sample_key for r in samples.collect()) == ["20260804_153005_000001", "20260804_153010_000002"]
    assert sorted(r.message for r in notes.collect()) == ["invalid thermal file name", "thermal file cannot be decoded"]


def test_inbox(spark, inbox):
    files = SRC.with_batch(SRC.read_files(spark, inbox, content=False), inbox)
    assert [r.item for r in SRC.visible_items(files.where("area = 'visible'")).collect()] == ["color_20260211_073025_706675.jpg", "p1"]
    row = SRC.inbox_listing(files).first()
    assert (row.batch_id, row.capture_total, row.thermal_frame_count) == ("inspection-export-1", 2, 4)
    photo = SRC.load_photos(files.where("relative_path LIKE 'color%'")).first()
    assert (photo.capture_id, photo.capture_time, photo.station_id) == ("color_20260211_073025_706675", "2026-02-11T07:30:25.706675+08:00", "")


def test_alignment(spark):
    gas = spark.createDataFrame([("b", "k1", "1", "t1"), ("b", "k2", "2", "t2")], "batch_id string, sample_key string, sample_id string, captured_at string")
    thermal = spark.createDataFrame([("b", "k2", "9", "x"), ("b", "k3", "3", "t3")], gas.schema)
    rows = {r.sample_key: r for r in S.align_sensors(gas, thermal).collect()}
    assert [rows[k].warning for k in ("k1", "k2", "k3")] == ["missing_thermal_frame", None, "missing_gas_row"]
    assert rows["k2"].sample_id == "2" and rows["k3"].captured_at == "t3"


def test_wide_rows_and_day_files(spark, tmp_path):
    t = dt.datetime(2026, 8, 4, 15, 30)
    rows = [(t, 1, "ch4", 0, "0.00", "normal", None), (t, 1, "o2", 1, "20.9", "low_alarm", None), (t, 1, "co", 2, None, "read_error", "co 读取失败"),
            (t + dt.timedelta(days=1), 2, "ch4", 0, "1", "normal", None)]
    long = spark.createDataFrame(rows, "ts timestamp, sample_id int, channel string, ord int, value string, status string, error string")
    wide = S.gas_wide(long, ["ts", "sample_id"], ["ord"])
    first = wide.where("sample_id = 1").first()
    assert first.status == "O2状态：low_alarm；CO：co 读取失败；H2S缺少读数" and first.co_value is None
    sinks.write_gas_days(wide, str(tmp_path / "gas"))
    back = spark.read.option("header", True).csv(str(tmp_path / "gas"))
    assert back.columns == [*K.GAS_HEADER_ZH, "day"] and {str(r.day) for r in back.collect()} == {"2026-08-04", "2026-08-05"}
    n = back.count()
    sinks.write_gas_days(wide.withColumn("sample_id", F.when(F.col("sample_id") == 1, 1234567).otherwise(F.col("sample_id"))), str(tmp_path / "gas"))
    ids = sorted(r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "gas")).select(F.col(f"`{K.GAS_HEADER_ZH[1]}`").cast("int")).collect())
    assert len(ids) == n + 1 and ids[-1] == 1234567
    spark.createDataFrame([("2026-08-04", "x")], "day string, old string").write.partitionBy("day").option("header", True).csv(str(tmp_path / "legacy"))
    with pytest.raises(ValueError, match="legacy header"):
        sinks.write_gas_days(wide, str(tmp_path / "legacy"))


def test_replace_one_batch(spark, tmp_path):
    path = str(tmp_path / "samples")
    def rows(values):
        return spark.createDataFrame(values, "batch_id string, sample_key string, v int")
    sinks.replace_batch_samples(rows([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)]), path, ["a", "b", "c"])
    sinks.replace_batch_samples(rows([("a", "9", 2)]), path, ["a"])
    assert sorted((r.batch_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1), ("c", 1)]
    sinks.replace_batch_samples(rows([]), path, ["b"])
    assert sorted((r.batch_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("c", 1)]
    with pytest.raises(ValueError):
        sinks.replace_batch_samples(rows([("c", "1", 3)]), path, ["a"])


def test_oversized_values_are_whole(spark):
    from seamwatch.operators.validate import stored_names
    from seamwatch.sources import files
    names = spark.createDataFrame([(1, 7, "a.jpg"), (1, 107, "a.jpg"), (1, 1007, "a.jpg")], "capture_id int, position int, name string")
    assert sorted(r.file_name for r in stored_names(names).collect()) == ["1007_a.jpg", "107_a.jpg", "a.jpg"]
    deep = "/root/" + "d/" * 4000 + "f.txt"
    assert spark.createDataFrame([(deep,)], "p string").select(files.below(F.col("p"), "/root")).first()[0] == deep[6:]


def plain_bounds(data):
    low = high = device = None
    for d, t, lo, hi in data:
        if d != device:
            device, low, high = d, lo, hi
        else:
            low = lo if lo < low else low * 0.75 + lo * 0.25
            high = hi if hi > high else high * 0.75 + hi * 0.25
        yield d, t, low, high


@pytest.mark.parametrize(("step", "block"), [(1, 8), (1_000_003, 8), (1_000_003, 256), (40, 3)])
def test_display_bounds_choose_their_levels(spark, step, block):
    rnd = random.Random(step)
    data = [(d, i * step + (i * i) % step, rnd.uniform(10, 20), rnd.uniform(25, 40)) for d, n in ((1, 700), (2, 30), (3, 1)) for i in range(n)]
    frames = spark.createDataFrame(data, "device int, t bigint, lo double, hi double")
    got = {(r.device, r.t): (r.display_low, r.display_high) for r in S.display_bounds(frames.repartition(5), "device", "t", "lo", "hi", block=block).collect()}
    assert len(got) == len(data)
    for d, t, low, high in plain_bounds(data):
        assert got[d, t] == pytest.approx((low, high), abs=1e-9)


def test_block_levels_bound_every_group():
    for span in (0, 1, 200, 254, 255, 256, 70_000, 3 * 10**13):
        for block in (3, 8, 256):
            levels = S._block_levels(span, block)
            assert span // block**levels + 2 <= block and (levels == 0 or span // block ** (levels - 1) + 2 > block)


def test_display_bounds_of_nothing(spark):
    assert S.display_bounds(spark.createDataFrame([], "device int, t bigint, lo double, hi double"), "device", "t", "lo", "hi").collect() == []


@pytest.mark.parametrize("block,levels", [(4, 3), (16, 2), (256, 1)])
def test_display_bounds_equal_a_plain_loop(spark, block, levels):
    rnd = random.Random(block)
    data = [(d, i * 2 + d, rnd.uniform(10, 20), rnd.uniform(25, 40)) for d in (1, 2) for i in range(300)]
    frames = spark.createDataFrame(data, "device int, t bigint, lo double, hi double")
    got = {(r.device, r.t): (r.display_low, r.display_high) for r in S.display_bounds(frames, "device", "t", "lo", "hi", block=block, levels=levels).collect()}
    low = high = device = None
    for d, t, lo, hi in data:
        if d != device:
            device, low, high = d, lo, hi
        else:
            low = lo if lo < low else low * 0.75 + lo * 0.25
            high = hi if hi > high else high * 0.75 + hi * 0.25
        assert got[(d, t)] == pytest.approx((low, high), abs=1e-9)


def test_thermal_statistics(spark):
    frames = spark.createDataFrame(
        [("ok", [0.0, 10.0, 20.0]), ("short", [1.0]), ("nan", [1.0, float("nan"), 2.0])], "n string, temperatures array<double>")
    rows = {r.n: r for r in S.frame_statistics(frames, pixels=3).collect()}
    assert (rows["ok"].t_min, rows["ok"].t_max, rows["ok"].t_mean, rows["ok"].t_low) == (0.0, 20.0, 10.0, pytest.approx(0.4))
    assert rows["short"].frame_error and rows["nan"].frame_error and rows["nan"].t_min is None


def test_median_filter_both_ways(spark):
    rng = np.random.default_rng(3)
    stack = rng.normal(size=(3, 24, 32))
    stack[0, 5, 5] = 900.0
    frames = spark.createDataFrame([(i, [float(v) for v in f.ravel()]) for i, f in enumerate(stack)], "i int, temperatures array<double>")
    fast = {r.i: r.smoothed for r in S.smooth_frames(frames, 32, 24).collect()}
    slow = frames.where("i = 0").select(T.median3x3(F.col("temperatures"))).first()[0]
    assert fast[0] == pytest.approx(slow) and max(fast[0]) < 900
    want = statistics.median(float(v) for v in stack[1][0:2, 0:2].ravel())
    assert fast[1][0] == pytest.approx(want)


def test_first_valid_attempt(spark):
    rows = [("a", 1, False, None, "t1"), ("a", 2, True, 5.0, None), ("b", 1, False, None, "e1"), ("b", 2, False, None, "e2"), ("b", 3, False, None, "e3"), ("b", 4, True, 9.0, None)]
    df = spark.createDataFrame(rows, "k string, n int, ok boolean, v double, e string")
    out = {r.k: r for r in S.first_valid_attempt(df, ["k"], ["n"], F.col("ok"), "v", "e").collect()}
    assert (out["a"].value, out["a"].status) == (5.0, "ok")
    assert (out["b"].value, out["b"].status, out["b"].error) == (None, "read_error", "e3")


def test_missed_slots(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [("d", start + dt.timedelta(seconds=s)) for s in (0, 5, 10, 26, 31, 86_400 * 2)]
    out = S.missed_slots(spark.createDataFrame(rows, "d string, ts timestamp"), ["d"], "ts", [], 5.0).orderBy("ts").collect()
    assert [r.missed_slots for r in out] == [0, 0, 0, math.ceil(11 / 5), 0, math.ceil((86_400 * 2 - 31 - 5) / 5)]


def test_skew_helpers_match_plain_results(spark):
    """A key with most of the rows takes the spread path and gives the same join."""
    rows = spark.range(2000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), F.col("id"))
    rows = rows.withColumn("k", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("k")))
    sizes = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1 OR k % 2 = 0")
    spread = spread_join(rows, sizes, ["k"], "n", hot_rows=100)
    plain = rows.join(sizes, "k", "left").select(*spread.columns)
    assert sorted(map(tuple, spread.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    numbered = number_rows(rows, ["k"], ["id"], "i", slice_by=F.floor(F.col("id") / 100)).where("k = 0").orderBy("id").collect()
    assert [r.i for r in numbered] == list(range(len(numbered)))
    lagged = previous_value(rows, ["k"], ["id"], "id", "p", F.floor(F.col("id") / 100)).where("k = 0").orderBy("id").collect()
    assert [r.p for r in lagged[1:]] == [r.id for r in lagged[:-1]] and lagged[0].p is None
    ranked = global_rank(rows.select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")), "h", "pos", "total").orderBy("pos").collect()
    assert [r.pos for r in ranked] == list(range(1, 2001)) and sorted(r.h for r in ranked) == [r.h for r in ranked]


@pytest.mark.parametrize("bound", [64, 2, 0])
def test_pixel_medians_on_arrays_and_on_pixels(spark, monkeypatch, bound):
    monkeypatch.setattr(S, "_READING_FRAMES", bound)
    rnd = random.Random(bound)
    frames = [("a", [rnd.uniform(0, 9) for _ in range(6)]) for _ in range(3)] + [("b", [1.0, None, 3.0]), ("b", [2.0, 5.0]), (None, [4.0]), ("c", None), ("d", [])]
    df = spark.createDataFrame(frames, "k string, temperatures array<double>").repartition(4)
    want = {}
    for k, f in frames:
        for i, t in enumerate(f or []):
            want.setdefault((k, i), []).append(t)
    want = {at: (np.median([t for t in v if t is not None]) if any(t is not None for t in v) else None) for at, v in want.items()}
    got = {(r.k, r.pixel): r.t for r in S.pixel_median(df, ["k"]).collect()}
    assert got == pytest.approx(want)
    arrays = {r.k: r.temperatures for r in S.median_frames(df, ["k"]).collect()}
    assert arrays == {k: [pytest.approx(want[k, i]) for i in range(sum(x == k for x, _ in want))] for k in ("a", "b", None)}


def test_detectors_of_single_images_and_of_batches(spark):
    from seamwatch.operators import plugins as P

    images = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id int, name string").repartition(2)
    box = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}

    def single():
        return lambda image: [{"type": "t", "class_id": f"{image['name']}{n}", "bbox": box, "confidence": 0.5, "attributes": {"a": "b"}} for n in range(image["id"] % 3)]

    def batch():
        detect = single()

        def run(rows):
            import pandas as pd
            return pd.DataFrame([{**d, "row": i} for i, image in enumerate(rows.to_dict("records")) for d in detect(image)])
        return run

    one = sorted(tuple(map(str, r)) for r in P.run_detector(images, ["id"], single).collect())
    assert len(one) == 9 and one == sorted(tuple(map(str, r)) for r in P.run_detector(images, ["id"], batch, batched=True).collect())
