"""Exactly-once writes through the key index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamwatch.streaming import keyindex
from seamwatch.streaming import streams as ST
from seamwatch.streaming.keyindex import KeyIndex


def files_below(folders):
    from pathlib import Path

    return [p for f in folders for p in Path(f).rglob("*.parquet")]


def test_filters_have_no_false_negatives():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    filter_ = keyindex.bloom(hashes)
    assert keyindex.may_hold(filter_, hashes).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert keyindex.may_hold(filter_, others).mean() < 0.03


def test_runs_merge_like_a_counter_and_lookups_stay_exact(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), ["k"], fan=2, bucket_keys=8)
    for batch in range(9):
        index.add(batch, spark.range(batch * 20, batch * 20 + 20).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k")))
    assert [r[:3] for r in index.runs()] == [(0, 7, 8), (8, 8, 1)]
    asked = spark.createDataFrame([("k00003",), ("k00165",), ("k00500",), ("k00021",), (None,)], "k string")
    assert sorted(tuple(r) for r in index.stored(asked, 99).collect()) == [("k00003", 0), ("k00021", 1), ("k00165", 8)]
    assert sorted(tuple(r) for r in index.stored(asked, 1).collect()) == [("k00003", 0), ("k00165", 8)], "a replayed batch does not find itself in a merged run"
    fresh = spark.range(1000, 1020).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    assert index.candidates(fresh) == [], "keys above all spans read no file"


def test_new_keys_read_a_fixed_number_of_files_over_200_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(20_000).select(F.concat(F.lit("c"), F.xxhash64("id").cast("string")).alias("k"), F.col("id").alias("v"), (F.col("id") % 200).cast("int").alias("batch"))
    rows.repartition("batch").write.partitionBy("batch").parquet(path)
    step = ST.append_once(path, ["k"])
    read = []
    for batch in range(200, 203):
        incoming = spark.range(20_000 + batch * 10, 20_000 + batch * 10 + 10).select(F.concat(F.lit("c"), F.xxhash64("id").cast("string")).alias("k"), F.col("id").alias("v"))
        again = rows.where(f"v IN (7, {batch})").select("k", F.lit(-1).cast("long").alias("v"))
        index = KeyIndex(spark, path, ["k"])
        read.append(len(files_below(index.candidates(incoming.unionByName(again)))) + sum(len(files_below([f"{index._folder(r)}/filters", f"{index._folder(r)}/span"])) for r in index.runs()))
        step(incoming.unionByName(again), batch)
    assert max(read) <= 12
    table = spark.read.parquet(path)
    assert table.count() == table.select("k").distinct().count() == 20_000 + 30
    assert table.where("v = -1").count() == 0


def test_replays_keep_the_first_row(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, g int, v int"
    step = ST.append_once(path, ["k", "g"], fan=2)
    batches = [[("a", 1, 5), ("a", 1, 3), (None, 1, 1)], [("a", 1, 9), ("b", None, 2)], [("b", None, 7), (None, 1, 8), ("c", 3, 4)], []]
    want = {("a", 1, 3), (None, 1, 1), ("b", None, 2), ("c", 3, 4)}
    for order in (range(4), (3, 3), (2, 3)):
        for batch in order:
            step(spark.createDataFrame(batches[batch], schema), batch)
    assert sorted(map(repr, ((r.k, r.g, r.v) for r in spark.read.parquet(path).collect()))) == sorted(map(repr, want))


def test_an_unfinished_run_does_not_count(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), ["k"])
    index.add(0, spark.createDataFrame([("x",)], "k string"))
    run = index.runs()[0]
    index.system.delete(index._hadoop(f"{index._folder(run)}/span"), True)
    assert index.runs() == []
    index.add(0, spark.createDataFrame([("x",)], "k string"))
    assert [r["k"] for r in index.stored(spark.createDataFrame([("x",), ("y",)], "k string"), 1).collect()] == ["x"]


@pytest.mark.parametrize("kind", ["long", "date", "timestamp", "double"])
def test_keys_of_other_types(spark, tmp_path, kind):
    index = KeyIndex(spark, str(tmp_path / kind), ["k"])
    rows = spark.range(1, 40).select((F.col("id") * 86_400).alias("s")).select({
        "long": F.col("s"), "date": F.timestamp_seconds("s").cast("date"), "timestamp": F.timestamp_seconds("s"), "double": F.col("s").cast("double")}[kind].alias("k"))
    index.add(0, rows)
    assert index.stored(rows.unionByName(rows.limit(1)), 1).count() == 39
