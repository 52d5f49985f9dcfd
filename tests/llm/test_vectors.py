"""Exact top-k against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seamwatch.llm import topk


def brute(data, k, every):
    live = []
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((i, [math.floor(256 * x) for x in v]))
    sizes = [len(v) for _, v in live]
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    live = [(i, v) for i, v in live if len(v) == usual]
    out = []
    for n_query, (i, q) in enumerate(live):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for n_other, (j, v) in enumerate(live) if n_other != n_query)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows", [3, 300])
def test_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = random.Random(rows)
    common = [rng.uniform(-1, 1) for _ in range(8)]
    data = [(i, common if i % 3 == 0 else [rng.gauss(0, 0.4) for _ in range(8)]) for i in range(rows)]
    data += [(1000, None), (1010, [0.1] * 7 + [None]), (1020, [float("nan")] * 8), (1030, [float("inf")] * 8), (None, common), (1040, [0.5] * 3), (1050, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("label", F.lit(0))
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(exact, 5, 10)
    assert dict(got.dtypes)["rank"] == "int"


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_wide_values_are_exact(spark):
    rng = random.Random(9)
    data = [(i, [rng.uniform(-4000, 4000) for _ in range(6)]) for i in range(60)]
    got = topk.top_k(topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>")), F.col("vec_id") % 10 == 0, 3)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 3, 10)


def test_repeated_ids_are_queries_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = random.Random(2)
    data = [(i % 30, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(80)] + [(0, [0.5] * 4), (0, [0.5] * 4)]
    got = topk.top_k(topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>")), F.col("vec_id") % 10 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 5, 10)
