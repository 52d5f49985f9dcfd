"""Modules that fail next to modules that do not."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seamwatch.operators import isolation as ISO
from seamwatch.operators import voting as VOTE
from seamwatch.plans import QUERIES


def counting(bad, calls):
    def build():
        def run(rows):
            calls.append(len(rows))
            if rows["v"].isin(bad).any():
                raise ValueError(f"bad {rows['v'][rows['v'].isin(bad)].iloc[0]}")
            return pd.DataFrame({"status": "confirmed", "value": rows["v"] * 2.0})
        return run
    return build


def test_single_bad_rows_fail_alone_and_cheaply():
    rows = pd.DataFrame({"v": range(1024)})
    calls = []
    out = pd.concat(ISO._guarded(counting({7, 900}, calls)(), rows, ["status", "value"]), ignore_index=True)
    assert list(out["value"].fillna(-1)) == [v * 2.0 if v not in (7, 900) else -1 for v in range(1024)]
    assert list(out.loc[out["status"] == "failed", "reason"]) == ["bad 7", "bad 900"]
    assert len(calls) <= 2 * 2 * 11


def test_many_bad_rows_need_fewer_calls_than_rows():
    rows = pd.DataFrame({"v": range(2_000)})
    for bad, most in ((set(range(5, 2_000, 13)), 1_000), (set(range(2_000)), 2_030)):
        calls = []
        out = pd.concat(ISO._guarded(counting(bad, calls)(), rows, ["status", "value"]), ignore_index=True)
        assert list(out["status"]) == ["failed" if v in bad else "confirmed" for v in range(2_000)]
        assert list(out["reason"].dropna()) == [f"bad {v}" for v in sorted(bad)]
        assert len(calls) <= most


def test_rows_of_one_file_are_spread_and_results_of_changing_kinds_kept(spark):
    def changing():
        def run(rows):
            if len(rows) > 2 or rows["v"].isin([4]).any():
                raise ValueError("too much")
            odd = rows["v"].iloc[0] % 2
            return pd.DataFrame({"status": ["confirmed"] * len(rows), "number": rows["v"] * (1.0 if odd else 1), "enabled": True} | ({"raw_text": rows["v"].astype(str)} if odd else {}))
        return run

    out = ISO.run_isolated(spark.range(2_000).coalesce(1).selectExpr("id k", "id v"), ["k"], [ISO.Module("changing", changing)])
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    got = {r.k: r for r in out.collect()}
    assert len(got) == 2_000 and [k for k, r in got.items() if r.status == "failed"] == [4]
    assert all(r.enabled and r.number == (k if k != 4 else None) and r.raw_text in (None, str(k)) for k, r in got.items())


def test_module_failures_spreads_the_rows_of_one_file(spark, tmp_path):
    """A station and a scale fail on some orders; null customers are no failure."""
    orders = [(k, None if k % 50 == 49 else k % 130, 1000.5 + k) for k in range(3_000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.module_id: (r.rows, r.failed, r.first_reason) for r in QUERIES["module_failures"](spark, str(tmp_path)).collect()}
    gates = [k for k, c, _ in orders if c is not None and c % 13 == 11]
    assert got["station_number"] == (3_000, len(gates), min(f"no station in gate {k}" for k in gates))
    assert got["coal_presence"] == (3_000, 3_000, "no model is there")
    assert got["digital_meter"] == (3_000, sum(c in (0, 100) for _, c, _ in orders), "no scale")
    assert got["analog_meter"] == (3_000, 0, None)
    rows = QUERIES["isolated_modules"](spark, str(tmp_path))
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_row_modules_are_called_once_for_each_row(spark):
    def odd():
        def run(row):
            v = row["v"]
            if v % 10 == 1:
                raise ValueError(f"bad {v}")
            return {2: {"status": "confirmed", "number": v + 0.5}, 3: {"colour": "red"}, 4: None, 5: {"status": None, "enabled": None, "value": float("nan")},
                    6: {"number": v, "labels": ["a", "b"]}}.get(v % 10, {"status": "confirmed", "number": v, "value": 2 * v})
        return run

    calls, fields = [], to_arrow_schema(StructType.fromDDL(ISO.RESULT))
    run = odd()
    ISO._each(lambda row: calls.append(row["v"]) or run(row), [{"v": v} for v in range(2_000)], list(fields))
    assert calls == list(range(2_000))

    rows = spark.range(2_000).coalesce(1).selectExpr("id k", "id v")
    got = {r.k: r for r in ISO.run_isolated(rows, ["k"], [ISO.Module("odd", odd, by_row=True)]).collect()}
    assert len(got) == 2_000
    for k, r in got.items():
        end = k % 10
        assert r.status == (None if end in (5, 6) else "failed" if end in (1, 2, 3, 4) else "confirmed")
        assert (r.reason is not None) == (end in (1, 2, 3, 4)) and r.enabled is (None if end == 5 else True)
        assert r.number == (k if end in (0, 6, 7, 8, 9) else None) and r.value == (2 * k if end in (0, 7, 8, 9) else None)
        assert r.labels == (["a", "b"] if end == 6 else None)
    assert got[11].reason == "bad 11" and got[13].reason == "unknown result columns: colour"


def test_failing_orders_cost_no_more_calls_than_others(spark, tmp_path, monkeypatch):
    found, real = {}, ISO.run_isolated
    monkeypatch.setattr(ISO, "run_isolated", lambda rows, keys, modules: found.update({m.name: m for m in modules}) or real(rows, keys, modules))
    orders = [(k, 11 if k % 2 else 100, 1000.5) for k in range(100)] + [(100, None, 5.0), (101, 7, None), (102, 100, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.capture_id, r.module_id): r for r in QUERIES["isolated_modules"](spark, str(tmp_path)).collect()}
    fields = list(to_arrow_schema(StructType.fromDDL(ISO.RESULT)))
    for name in ("station_number", "digital_meter"):
        calls, own = [], found[name].build()
        statuses = dict(zip([f.name for f in fields], ISO._each(lambda row: calls.append(row) or own(row), [  # noqa: B023
            {"o_orderkey": k, "o_custkey": c, "whole": None if p is None else int(p)} for k, c, p in orders], fields)))["status"].to_pylist()
        assert len(calls) == len(orders) and statuses == [got[k, name].status for k, *_ in orders]
    assert [got[k, "station_number"].reason for k in (0, 1, 100)] == [None, "no station in gate 1", None]
    assert [(got[k, "digital_meter"].status, got[k, "digital_meter"].value) for k in (0, 1, 100, 101, 102)] == [
        ("failed", None), ("confirmed", 90.0), ("confirmed", None), ("confirmed", None), ("failed", None)]


def test_only_distinct_reasons_are_sorted(spark):
    results = spark.range(100).selectExpr("0 module_order", "'a' module_id", "if(id % 10 < 3, 'failed', if(id % 10 = 3, null, 'confirmed')) status", "if(id % 10 = 0, null, concat('bad ', id)) reason")
    out = ISO.module_health(results)
    aggregates = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(" in line]
    assert "HashAggregate(" in aggregates[-1]  # the one next to the results
    assert [tuple(r) for r in out.collect()] == [("a", 100, 30, "bad 1")]
    assert out.schema.simpleString() == "struct<module_id:string,rows:bigint,failed:bigint,first_reason:string>"


def test_other_modules_run(spark):
    def broken():
        raise RuntimeError("no weights")

    def short():
        return lambda rows: pd.DataFrame({"status": ["confirmed"] * (len(rows) - 1)})

    def wrong():
        return lambda rows: pd.DataFrame({"colour": ["red"] * len(rows)})

    def lists():
        return lambda rows: pd.DataFrame({"status": ["confirmed"] * len(rows), "labels": [["a", "b"]] * len(rows), "enabled": True})

    modules = [ISO.Module("good", counting(set(), [])), ISO.Module("broken", broken), ISO.Module("some", counting({3}, [])), ISO.Module("off", broken, False),
               ISO.Module("short", short), ISO.Module("wrong", wrong), ISO.Module("lists", lists)]
    rows = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"), F.lit("x").alias("status")).repartition(3)
    out = ISO.run_isolated(rows, ["k"], modules)
    got = {(r.k, r.module_id): r for r in out.collect()}
    assert len(got) == 70
    assert all(got[k, "good"].status == "confirmed" and got[k, "good"].value == 2.0 * k for k in range(10))
    assert all(got[k, "broken"].status == "failed" and got[k, "broken"].reason == "no weights" for k in range(10))
    assert [k for k in range(10) if got[k, "some"].status == "failed"] == [3] and got[3, "some"].reason == "bad 3"
    assert all(got[k, "off"].status == "disabled" and got[k, "off"].enabled is False for k in range(10))
    assert all(got[k, "short"].status == "failed" and got[k, "short"].reason == "0 results for 1 rows" for k in range(10))
    assert all(got[k, "wrong"].reason == "unknown result columns: colour" for k in range(10))
    assert got[0, "lists"].labels == ["a", "b"]
    health = {r.module_id: (r.rows, r.failed, r.first_reason) for r in ISO.module_health(out).collect()}
    assert health["some"] == (10, 1, "bad 3") and health["good"] == (10, 0, None)
    document = ISO.as_modules(out, ["k"]).where("k = 3").first()["modules"]
    assert [(m.module_id, m.result.status) for m in document] == [
        ("good", "confirmed"), ("broken", "failed"), ("some", "failed"), ("off", "disabled"), ("short", "failed"), ("wrong", "failed"), ("lists", "confirmed")]


def test_nothing_in_nothing_out(spark):
    rows = spark.createDataFrame([], "k long, v long")
    assert ISO.run_isolated(rows, ["k"], [ISO.Module("good", counting(set(), []))]).collect() == []


def test_station_verdicts_without_marker_frames_or_training(spark):
    captures = spark.createDataFrame([(1, "3"), (2, "x"), (3, "5")], "c int, station string")
    frames = spark.createDataFrame([(1, "3", i, 3, "confirmed", 0.9) for i in range(2)] + [(3, "5", 0, 5, "confirmed", 0.8)], "c int, station string, pos int, number int, status string, confidence double")
    markers = spark.createDataFrame([(1, "3", (0.0, 0.0, 9.0, 9.0))], "c int, station string, bbox struct<x1:double,y1:double,x2:double,y2:double>")

    def run(**options):
        out = VOTE.station_verdicts(captures, frames, markers, ["c", "station"], ["pos"], station_id="station", **options)
        return {r.c: (r.status, r.number, r.votes, r.reason, r.roi_source, r.metadata_matches) for r in out.collect()}

    strict = run(full_frame=False)
    assert strict[1] == ("confirmed", 3, 2, "multi_frame_majority_confirmed", "yolo_station_marker", True)
    assert strict[3] == ("unreadable", None, 0, "station_marker_not_detected", "yolo_station_marker", None)
    loose = run()
    assert loose[3][:5] == ("confirmed", 5, 1, "multi_frame_majority_confirmed", "full_frame")
    assert loose[2][:5] == ("unreadable", None, 0, "no_confirmed_station_number_readings", "full_frame")
    assert run(trained=False)[1] == ("unavailable", None, None, "station_image_classifier_not_trained", None, None)
    assert run(use_roi=False)[1][4] == "full_frame"
