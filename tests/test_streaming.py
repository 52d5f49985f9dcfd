import datetime as dt

import pytest
from pyspark.sql import functions as F

from seamwatch.operators import sensors as S
from seamwatch.streaming import streams as ST

T0 = dt.datetime(2026, 1, 1)


def drain(stream, tmp, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp / f"ck_{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_items_resume_from_checkpoint(spark, tmp_path):
    schema = "batch_id string, relative_path string, v int"
    put(spark, tmp_path / "in", [("b", "p1", 1), ("b", "p2", 2)], schema)
    def go():
        stream = ST.inbox_stream(spark, str(tmp_path / "in"), schema)
        ST.run_available(stream, ST.resume_items(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))
    assert go().count() == 2
    assert go().count() == 2
    put(spark, tmp_path / "in", [("b", "p2", 9), ("b", "p3", 3)], schema)
    assert sorted((r.relative_path, r.v) for r in go().collect()) == [("p1", 1), ("p2", 2), ("p3", 3)]


def test_capture_conflicts_are_reported(spark, tmp_path):
    schema = "capture_id string, station_id string, images array<struct<position:int,sha256:string>>"
    def go(rows):
        put(spark, tmp_path / "in", rows, schema)
        stream = ST.inbox_stream(spark, str(tmp_path / "in"), schema)
        ST.run_available(stream, ST.ingest_captures(str(tmp_path / "cap"), str(tmp_path / "bad"), ["station_id"]), str(tmp_path / "ck")).awaitTermination(120)
    go([("a", "8", [(1, "x")]), ("b", "8", [(1, "y")])])
    go([("a", "8", [(1, "x")]), ("b", "8", [(1, "z")]), ("c", "9", [(1, "q")])])
    assert sorted(r.capture_id for r in spark.read.parquet(str(tmp_path / "cap")).collect()) == ["a", "b", "c"]
    assert [(r.capture_id, r.conflict) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("b", "different image content")]


def test_conflicting_duplicates_keep_one_winner_on_replay(spark, tmp_path):
    schema = "capture_id string, station_id string, images array<struct<position:int,sha256:string>>, seen int"
    rows = spark.createDataFrame([("a", "9", [(1, "z")], 2), ("a", "8", [(1, "y")], 1), ("a", "8", [(1, "y")], 3)], schema).repartition(3)
    step = ST.ingest_captures(str(tmp_path / "cap"), str(tmp_path / "bad"), ["station_id"], ["seen"])
    for _ in range(2):
        step(rows, 0)
        assert [(r.station_id, r.seen) for r in spark.read.parquet(str(tmp_path / "cap")).collect()] == [("8", 1)]
        assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_pending_packages(spark, tmp_path):
    (tmp_path / "receipts").mkdir()
    (tmp_path / "receipts/r.json").write_text('{"path": "p1"}\n')
    put(spark, tmp_path / "in", [("p1",), ("p2",)], "path string")
    stream = ST.inbox_stream(spark, str(tmp_path / "in"), "path string")
    ST.run_available(stream, ST.pending_once(str(tmp_path / "receipts"), str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["p2"]


def test_bounds_and_gaps_come_in_time_order_across_batches(spark, tmp_path):
    schema = "device int, ts timestamp, i long, lo double, hi double"
    rows = [(d, T0 + dt.timedelta(seconds=s), s, 10.0 + (s * 7 + d) % 5, 30.0 - s * 3 % 4) for d in (1, 2) for s in range(0, 300, 5) if s % 35]
    late = [r for r in rows if r[2] % 3 == 1]  # a later micro-batch brings these
    for part in ([r for r in rows if r not in late], late, [(d, T0 + dt.timedelta(days=1), 86_400, 0.0, 0.0) for d in (1, 2)]):
        put(spark, tmp_path / "in", part, schema)
    stream = ST.inbox_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    bounds = ST.display_bounds_stream(stream, "device", "ts", "lo", "hi", page_seconds=20)
    got = [(r.device, r.ts, r.display_low, r.display_high) for r in drain(bounds, tmp_path, "bounds")]
    batch = S.display_bounds(spark.createDataFrame(rows, schema), "device", "i", "lo", "hi").orderBy("device", "i").collect()
    assert sorted(got) == [(r.device, r.ts, pytest.approx(r.display_low), pytest.approx(r.display_high)) for r in batch]
    for device in (1, 2):
        times = [g[1] for g in got if g[0] == device]
        assert times == sorted(times), "pages come out in time order"
    gaps = drain(ST.gap_monitor(stream.select("device", "ts"), "device", "ts", 5.0, page_seconds=20), tmp_path, "gaps")
    want = S.missed_slots(spark.createDataFrame(rows, schema), ["device"], "ts", [], 5.0)
    assert sorted((r.device, r.ts, r.missed_slots) for r in gaps) == sorted((r.device, r.ts, r.missed_slots) for r in want.collect())


def test_bounds_of_missing_values_keep_the_last(spark, tmp_path):
    schema = "device string, ts timestamp, lo double, hi double"
    rows = [("a", T0, None, 5.0), ("a", T0 + dt.timedelta(seconds=1), 2.0, None), ("a", None, 1.0, 1.0), ("a", T0 + dt.timedelta(days=1), 0.0, 0.0)]
    put(spark, tmp_path / "in", rows, schema)
    put(spark, tmp_path / "in", [("b", T0 + dt.timedelta(days=2), 0.0, 0.0)], schema)
    stream = ST.inbox_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    got = [(r.device, r.display_low, r.display_high) for r in drain(ST.display_bounds_stream(stream, "device", "ts", "lo", "hi"), tmp_path, "missing")]
    assert got[:2] == [("a", None, 5.0), ("a", 2.0, 5.0)]


def test_stream_alignment_by_key_alone(spark, tmp_path):
    schema = "b string, k string, arrived timestamp, v int"
    hour = dt.timedelta(hours=1)
    put(spark, tmp_path / "g", [("b", "k1", T0, 1), ("b", "20260101_000000_2", T0, 2), ("b", None, T0, 4)], schema)
    put(spark, tmp_path / "t", [("b", "20260101_000000_3", T0, 6)], schema)
    put(spark, tmp_path / "t", [("b", "k1", T0 + 5 * hour, 5), ("b", "20260101_000000_2", T0 + 7 * hour, 8)], schema)
    for n in "gt":
        put(spark, tmp_path / n, [("b", f"last {n}", T0 + 40 * hour, 0)], schema)
        put(spark, tmp_path / n, [("b", f"end {n}", T0 + 90 * hour, 0)], schema)

    def side(n):
        return ST.inbox_stream(spark, str(tmp_path / n), schema, files_per_trigger=1)

    keys, two = ["b", "k"], "20260101_000000_2"
    rows = drain(ST.align_streams(side("g"), side("t"), keys, "arrived", "6 hours"), tmp_path, "aligned")
    out = sorted(((str(r.k), r.gas_v, r.thermal_v, r.warning) for r in rows if not str(r.k).startswith(("last", "end"))), key=repr)
    assert out == [(two, 2, None, "missing_thermal_frame"), (two, None, 8, "missing_gas_row"), ("20260101_000000_3", None, 6, "missing_gas_row"),
                   ("None", 4, None, "missing_thermal_frame"), ("k1", 1, 5, None)], "k1 waits five hours of six, the other seven"
    gas, thermal = (spark.read.schema(schema).parquet(str(tmp_path / n)) for n in "gt")
    static = {r.k: r.warning for r in ST.align_streams(gas, thermal, keys).collect() if r.k}
    batch = {r.k: r.warning for r in S.align_sensors(gas, thermal, keys).collect() if r.k}
    assert static == batch and static["k1"] is None and static[two] is None
    with pytest.raises(ValueError, match="arrival"):
        ST.align_streams(side("g"), side("t"), keys)


def test_windows_sessions_and_duplicates(spark, tmp_path):
    schema = "capture_id string, ts timestamp, channel string, status string, value double"
    rows = [("a", T0, "co", "high_alarm", 5.0), ("a", T0 + dt.timedelta(seconds=30), "co", "high_alarm", 7.0), ("b", T0 + dt.timedelta(minutes=4), "co", "low_alarm", 2.0)]
    put(spark, tmp_path / "in", rows, schema)
    put(spark, tmp_path / "in", [("z", T0 + dt.timedelta(days=2), "co", "normal", 0.0)], schema)
    stream = ST.inbox_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    windows = drain(ST.alarm_windows(stream), tmp_path, "windows")
    assert [(r.readings, r.alarms, r.peak) for r in windows] == [(3, 3, 7.0)]
    put(spark, tmp_path / "in", [("y", T0 + dt.timedelta(days=4), "co", "high_alarm", 0.0)], schema)
    sessions = drain(ST.alarm_sessions(stream), tmp_path, "sessions")
    assert sorted(r.alarms for r in sessions) == [1, 2]
    unique = drain(ST.unique_captures(stream, "ts"), tmp_path, "unique")
    assert sorted(r.capture_id for r in unique) == ["a", "b", "y", "z"]


def test_text_and_binary_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("h\n1\n")
    (tmp_path / "in/b.png").write_bytes(b"\x89PNG")
    texts = drain(ST.text_inbox_stream(spark, str(tmp_path / "in")), tmp_path, "texts")
    assert [r.content for r in texts] == ["h\n1\n"]
    files = drain(ST.binary_inbox_stream(spark, str(tmp_path / "in"), "*.png").select("path", F.col("length").alias("n")), tmp_path, "files")
    assert [r.n for r in files] == [4]
