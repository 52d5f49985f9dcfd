"""Index of the keys that a stream has stored, so that a micro-batch looks into few files.

Keys lie in *runs* below ``<table>/_keys``: one for each new micro-batch, and merged ones over
several.  A run is cut by key hash into buckets of about ``BUCKET_KEYS`` keys; each bucket has a
Bloom filter, and the run has its least and largest key.  When ``fan`` runs of one size have come
together they are merged into the next size, so n stored micro-batches leave at most
(fan - 1) * log_fan(n) + 1 runs and every key is rewritten log_fan(n) times.

A lookup keeps, for each key, the runs whose span and filter can hold it, and reads only the buckets
that are left.  Stored keys carry the number of their micro-batch, so a replayed micro-batch never
finds itself, not even in a merged run.  A run counts once its span is written; one that was cut off
by a failure is written again by the replay.  Nulls in keys equal each other.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
BUCKET_KEYS = 1 << 20
#: Bits of a filter for each key and probes of each lookup (about 1 % false hits).
KEY_BITS = 10
PROBES = 7
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _probes(hashes: np.ndarray, bits: int):
    """Bit places of 64-bit hashes in a filter."""
    step = (hashes * _MUL) | np.uint64(1)
    for i in range(PROBES):
        yield ((hashes + np.uint64(i) * step) >> np.uint64(1)) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    size = max(8, -(-len(hashes) * KEY_BITS // 8))
    bits = np.zeros(size * 8, bool)
    for at in _probes(hashes, size * 8):
        bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(filter_, np.uint8)
    out = np.ones(len(hashes), bool)
    for at in _probes(hashes, len(raw) * 8):
        out &= (raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _hashes(table: pa.Table) -> np.ndarray:
    return table["hash"].to_numpy().view(np.uint64)


class KeyIndex:
    """Stored keys of the table at ``path`` (folders ``batch=<id>``)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], fan: int = FAN, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.keys, self.fan, self.bucket_keys = spark, path, list(keys), fan, bucket_keys
        self.root = f"{path}/_keys"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._list(self.root) and self._list(path, "batch="):
            self.rebuild()

    # --- runs

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str, prefix: str = "") -> list[str]:
        target = self._hadoop(path)
        if not self.system.exists(target):
            return []
        return [n for s in self.system.listStatus(target) if (n := s.getPath().getName()).startswith(prefix)]

    def runs(self) -> list[tuple[int, int, int, int]]:
        """(first batch, last batch, batches, buckets) of the complete runs; their number grows with the logarithm of the batches."""
        names = [n for n in self._list(self.root, "run=") if self.system.exists(self._hadoop(f"{self.root}/{n}/span/_SUCCESS"))]
        return sorted(tuple(map(int, n.removeprefix("run=").split("_"))) for n in names)

    def _folder(self, run: tuple[int, int, int, int]) -> str:
        return f"{self.root}/run={'_'.join(map(str, run))}"

    def _delete(self, run: tuple[int, int, int, int]) -> None:
        self.system.delete(self._hadoop(f"{self._folder(run)}/span"), True)
        self.system.delete(self._hadoop(self._folder(run)), True)

    def _write(self, keyed: DataFrame, first: int, last: int, batches: int, count: int) -> None:
        """Write a run: keys by bucket, filters, and last its span, which makes it count."""
        buckets = 1 << max(0, math.ceil(math.log2(max(1, count / self.bucket_keys))))
        folder = self._folder((first, last, batches, buckets))
        hashed = keyed.withColumn("hash", F.xxhash64(*self.keys)).withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
        (hashed.repartition(min(buckets, 1 << 12), "bucket").sortWithinPartitions("bucket", "hash")
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{folder}/keys"))
        if not count:
            self.spark.createDataFrame([], "hash long, bucket int").write.mode("overwrite").parquet(f"{folder}/filters")
        else:
            def build(key: tuple, table: pa.Table) -> pa.Table:
                return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bloom": pa.array([bloom(_hashes(table))], pa.binary())})

            there = self.spark.read.parquet(f"{folder}/keys").select("bucket", "hash")
            there.groupBy("bucket").applyInArrow(build, "bucket int, bloom binary").write.mode("overwrite").parquet(f"{folder}/filters")
        span = F.struct(*self.keys)
        (keyed.agg(F.min(span).alias("least"), F.max(span).alias("largest"), F.count(F.lit(1)).alias("n"))
            .coalesce(1).write.mode("overwrite").parquet(f"{folder}/span"))

    # --- changes

    def add(self, batch: int, rows: DataFrame) -> None:
        """The keys that micro-batch ``batch`` has stored, as a run of their own; then merge what is due."""
        keyed = rows.select(*self.keys).distinct().withColumn("batch", F.lit(batch).cast("long"))
        for run in self.runs():
            if run[0] == run[1] == batch:
                self._delete(run)
        self._write(keyed, batch, batch, 1, keyed.count())
        self.merge()

    def merge(self) -> None:
        """Merge runs of one size while there are ``fan`` of them."""
        while True:
            sizes: dict[int, list] = {}
            for run in self.runs():
                sizes.setdefault(int(math.log(run[2], self.fan) + 1e-9), []).append(run)
            due = next((runs[: self.fan] for _, runs in sorted(sizes.items()) if len(runs) >= self.fan), None)
            if due is None:
                return
            keyed = self.spark.read.parquet(*[f"{self._folder(r)}/keys/bucket={b}" for r in due for b in self._buckets(r)]) if any(map(self._buckets, due)) else None
            if keyed is not None:
                keyed = keyed.select(*self.keys, "batch").distinct()
                self._write(keyed, due[0][0], max(r[1] for r in due), sum(r[2] for r in due), keyed.count())
                for run in due:
                    self._delete(run)
            else:  # only empty runs: keep one
                for run in due[:-1]:
                    self._delete(run)
                if len(due) < 2:
                    return

    def _buckets(self, run: tuple[int, int, int, int]) -> list[int]:
        return [int(n.removeprefix("bucket=")) for n in self._list(f"{self._folder(run)}/keys", "bucket=")]

    def rebuild(self) -> None:
        """One run from the stored micro-batches, for a table that has no index yet."""
        batches = [int(n.removeprefix("batch=")) for n in self._list(self.path, "batch=")]
        keyed = self.spark.read.option("basePath", self.path).parquet(self.path).select(*self.keys, F.col("batch").cast("long").alias("batch")).distinct()
        self._write(keyed, min(batches), max(batches), len(batches), keyed.count())

    # --- lookups

    def candidates(self, rows: DataFrame) -> list[str]:
        """Folders of the buckets that can hold a key of the rows."""
        runs = self.runs()
        if not runs:
            return []
        spans = {r: self.spark.read.parquet(f"{self._folder(r)}/span").first() for r in runs}
        runs = [r for r in runs if spans[r]["n"]]
        if not runs:
            return []
        key, digest = F.struct(*self.keys), F.col("hash")
        kinds = rows.select(key.alias("k")).schema["k"].dataType
        literal = {r: [F.from_json(F.lit(self._json(spans[r][side])), kinds) for side in ("least", "largest")] for r in runs} if self._orderable(kinds) else {}
        inside = [F.when((key >= literal[r][0]) & (key <= literal[r][1]) if literal else F.lit(True),
                         F.struct(F.lit(i).alias("run"), F.pmod(digest, F.lit(r[3])).cast("int").alias("bucket"))) for i, r in enumerate(runs)]
        asked = rows.withColumn("hash", F.xxhash64(*self.keys)).select("hash", F.explode(F.array_compact(F.array(*inside))).alias("at")).select("hash", "at.*").distinct()
        filters = None
        for i, r in enumerate(runs):
            one = self.spark.read.parquet(f"{self._folder(r)}/filters").select(F.lit(i).alias("run"), "bucket", "bloom")
            filters = one if filters is None else filters.unionByName(one)

        def test(key: tuple, keys: pa.Table, found: pa.Table) -> pa.Table:
            hits = keys.num_rows and found.num_rows and may_hold(found["bloom"][0].as_py(), _hashes(keys)).any()
            return pa.table({"run": pa.array([key[0].as_py()] if hits else [], pa.int32()), "bucket": pa.array([key[1].as_py()] if hits else [], pa.int32())})

        hits = asked.groupBy("run", "bucket").cogroup(filters.groupBy("run", "bucket")).applyInArrow(test, "run int, bucket int").collect()
        return sorted(f"{self._folder(runs[h['run']])}/keys/bucket={h['bucket']}" for h in hits)

    @staticmethod
    def _orderable(kind) -> bool:
        """Keys whose span can be written as JSON without loss."""
        return all(f.dataType.typeName() in ("string", "integer", "long", "short", "byte", "date", "boolean") for f in kind.fields)

    def _json(self, row) -> str:
        return json.dumps({k: (v if v is None or isinstance(v, (int, str)) else str(v)) for k, v in row.asDict().items()})

    def stored(self, rows: DataFrame, batch: int) -> DataFrame:
        """(keys, batch): which keys of the rows other micro-batches have stored, and which one did."""
        folders = self.candidates(rows)
        asked = rows.select(*self.keys).distinct()
        if not folders:
            return asked.withColumn("batch", F.lit(None).cast("long")).where("false")
        there = self.spark.read.parquet(*folders).select(*[F.col(k).alias(f"_s_{k}") for k in self.keys], F.col("batch").cast("long").alias("batch")).where(F.col("batch") != batch)
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        return asked.join(there, same).select(*self.keys, "batch").distinct()


def without(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not among the known ones (nulls equal each other)."""
    other = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(other, same, "left_anti")
