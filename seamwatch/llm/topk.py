"""Exact top-k by inner product on a bit-sliced index.

Every component is quantised to floor(scale * x).  Blocks of rows keep each component's bits as
bitmaps, one slice a bit.  A query's score is a weighted sum of components, so its bits come from
adding slices with carry-save bitmap arithmetic.  Only the most significant slices of each
component are added; what they leave out is bounded.  The sum's slices are walked from the most
significant one downward to the k-th largest sum, every row that the bound lets reach it is a
boundary row, and boundary rows are scored exactly.

Vectors that are null, hold null or non-finite components, have no id, or have another length than
most vectors take no part.  A query's own row is no candidate for it; other rows of its id are.  Rows
of one id are queries and candidates of their own, so an id that repeats among the queries has as many
lists of ranks from 1.  Ties go to the smaller id, an empty table gives an empty result.  Scores are exact
as long as they fit 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch.llm.common import durable

SCALE = 256
BLOCK_ROWS = 16_384
QUERY_ROWS = 256
#: Slices of a component that are added; the rest goes into the bound.
TOP_SLICES = 5

_INDEX = "block int, ids binary, numbers binary, kind string, cells binary, low long, bits int, slices binary"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that take part; q holds longs."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    sound = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("d")).where(
        F.col("vec_id").isNotNull() & F.col("d").isNotNull() & F.forall("d", finite))
    rows = sound.select("vec_id", F.transform("d", lambda x: F.floor(x * scale)).alias("q"))
    usual = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("q") == (usual["n"] if usual else 0))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(rows, -1)


def _build(group: pa.Table) -> pa.Table:
    rows = group.num_rows
    values = _matrix(group["q"], rows)
    ids = np.asarray(group["vec_id"].combine_chunks())
    numbers = np.asarray(group["number"].combine_chunks())
    order = np.lexsort((numbers, ids))
    ids, numbers, values = ids[order], numbers[order], values[order]
    low = int(values.min()) if values.size else 0
    bits = max(1, int(values.max() - low).bit_length()) if values.size else 1
    kind = next(k for k in ("int16", "int32", "int64") if not values.size or np.iinfo(k).min <= low and values.max() <= np.iinfo(k).max)
    shifted = (values - low).astype(np.uint64)
    padded = np.zeros((math.ceil(rows / 64) * 64, values.shape[1]), np.uint64)
    padded[:rows] = shifted
    planes = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little") for b in range(bits)]
    return pa.table({
        "block": pa.array([group["block"][0].as_py()], pa.int32()), "ids": [ids.tobytes()], "numbers": [numbers.tobytes()], "kind": [kind],
        "cells": [values.astype(kind).tobytes()], "low": pa.array([low], pa.int64()), "bits": pa.array([bits], pa.int32()),
        "slices": [np.stack(planes).tobytes()]})


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row a block: ids, cells and the slices of each component."""
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInArrow(_build, _INDEX)


def add_slices(stacks: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bits of the rows' sums: ``stacks[w]`` holds bitmaps of weight 2^w, lowest weight first out."""
    out = []
    w = 0
    while stacks:
        rows = stacks.pop(w, None)
        if rows is None:
            out.append(None)
            w += 1
            continue
        left = np.concatenate(rows)
        carries = []
        while len(left) > 1:
            k = len(left) // 3
            if k:
                a, b, c = left[:k], left[k : 2 * k], left[2 * k : 3 * k]
                half = a ^ b
                carries.append((a & b) | (half & c))
                left = np.concatenate([half ^ c, left[3 * k :]])
            else:
                carries.append((left[0] & left[1])[None])
                left = (left[0] ^ left[1])[None]
        out.append(left[0])
        if carries:
            stacks.setdefault(w + 1, []).extend(carries)
        w += 1
    return out


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.numbers = np.frombuffer(row["numbers"], np.int64)
        self.cells = np.frombuffer(row["cells"], row["kind"]).reshape(len(self.ids), -1)
        bits, dim = row["bits"], self.cells.shape[1]
        planes = np.frombuffer(row["slices"], np.uint64).reshape(bits, dim, -1)
        self.rest = max(0, bits - TOP_SLICES)
        top = planes[self.rest :].transpose(1, 0, 2)
        self.signed = np.stack([top, ~top])
        live = np.zeros(planes.shape[2] * 64, np.uint8)
        live[: len(self.ids)] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def search(self, own: int, number: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's best k rows, but for the query's own."""
        live = self.live
        lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        mine = lo + np.flatnonzero(self.numbers[lo:hi] == number)
        if len(mine):
            mask = np.ones(len(live) * 64, np.uint8)
            mask[mine] = 0
            live = live & np.packbits(mask, bitorder="little").view(np.uint64)
        rows = self._boundary(live, query, k)
        scores = self.cells[rows].astype(np.int64) @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    def _boundary(self, live: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the best k: all whose coarse sum is within the bound of the k-th."""
        size = np.abs(query)
        picked = self.signed[(query < 0).astype(int), np.arange(len(query))]
        stacks: dict[int, list[np.ndarray]] = {}
        for b in range(int(size.max()).bit_length() if len(size) else 0):
            dims = np.flatnonzero((size >> b) & 1)
            if len(dims):
                for j in range(picked.shape[1]):
                    stacks.setdefault(b + j, []).append(picked[dims, j])
        sums = add_slices(stacks)
        slack = int(size.sum()) * ((1 << self.rest) - 1) >> self.rest
        above, equal, least = np.zeros_like(live), live, 0
        for w in range(len(sums) - 1, -1, -1):  # the k-th largest coarse sum, bit by bit
            ones = equal & sums[w] if sums[w] is not None else np.zeros_like(live)
            if int(np.bitwise_count(above).sum() + np.bitwise_count(ones).sum()) >= k:
                equal, least = ones, least | 1 << w
            else:
                above, equal = above | ones, equal & ~ones
        floor = max(0, least - slack)
        above, equal = np.zeros_like(live), live
        for w in range(len(sums) - 1, -1, -1):
            ones = sums[w] if sums[w] is not None else np.zeros_like(live)
            if floor >> w & 1:
                equal = equal & ones
            else:
                above, equal = above | (equal & ones), equal & ~ones
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))


def _searcher(k: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                queries, numbers = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_numbers"], np.int64)
                wanted = np.frombuffer(row["q_cells"], np.int64).reshape(len(queries), -1)
                found = [block.search(int(i), int(n), q, k) for i, n, q in zip(queries, numbers, wanted, strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pa.record_batch({
                    "query_id": np.repeat(queries, sizes), "number": np.repeat(numbers, sizes),
                    "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    return search


def _query_block(group: pa.Table) -> pa.Table:
    return pa.table({
        "part": pa.array([group["part"][0].as_py()], pa.int32()), "q_ids": [np.asarray(group["vec_id"].combine_chunks()).tobytes()],
        "q_numbers": [np.asarray(group["number"].combine_chunks()).tobytes()],
        "q_cells": [_matrix(group["q"], group.num_rows).astype(np.int64).tobytes()]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of all vectors for each vector that ``is_query``.

    Blocks of rows meet blocks of queries on a grid, so neither side is ever whole in a task.
    """
    rows = durable(vectors.withColumn("number", F.monotonically_increasing_id()))
    queries = rows.where(is_query)
    blocks = math.ceil(rows.count() / BLOCK_ROWS) or 1
    q_parts = math.ceil(queries.count() / QUERY_ROWS) or 1
    index = build_index(rows, blocks)
    parted = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.lit(q_parts)).cast("int"))
    asked = parted.groupBy("part").applyInArrow(_query_block, "part int, q_ids binary, q_numbers binary, q_cells binary")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grid = left.join(right, ["block", "part"])
    found = grid.drop("part", "block").mapInArrow(_searcher(k), "query_id long, number long, vec_id long, score long")
    best = W.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
