"""Sharding by fixed virtual slots.

Records are hashed into some thousands of slots that never change.  Only the slot-to-shard map is
data: it is planned from the bytes in each slot, stored under a version and edited on a rebalance,
so that a change of the shard count moves whole slots and nothing else.

Null keys hash like any value, null texts weigh only the overhead, rows of one key go to one slot;
where ids may be null or repeat, the text is made part of the key, so that only equal rows stay
together.  An empty table gives an empty result and a map of empty slots.  A result column takes the
place of an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch.llm.common import new_folder, packed, with_results

#: Slots of a corpus; fixed for its life.
SLOTS = 8192
#: Bytes that a record weighs besides its text.
OVERHEAD = 16
#: Further division of a slot, for numbering its records.
LANES = 16


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def slot_of(keys: Sequence[str], slots: int = SLOTS) -> Column:
    return F.pmod(_hash(keys), F.lit(slots)).cast("int")


def record_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def slot_bytes(records: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes) for every slot, empty ones included."""
    held = records.groupBy(slot_of(keys, slots).alias("virtual_slot")).agg(F.sum(record_bytes(text)).alias("bytes"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(held, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _deal(free: Column, loads: Column) -> Column:
    """Slots, heaviest first, each to the shard with the least so far: array of (virtual_slot, shard)."""
    heavy_first = F.array_sort(F.transform(free, lambda s: F.struct((-s["bytes"]).alias("w"), s["virtual_slot"].alias("v"))))

    def place(state: Column, slot: Column) -> Column:
        shard = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda v, i: F.when(i == shard, v - slot["w"] + 1).otherwise(v))
        return F.struct(
            loads.alias("loads"),
            F.concat(state["placed"], F.array(F.struct(slot["v"].alias("virtual_slot"), shard.alias("shard")))).alias("placed"),
        )

    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)").alias("placed"))
    return F.aggregate(heavy_first, start, place)["placed"]


def plan_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A first map (virtual_slot, shard, version) from the bytes of each slot.

    The slots, of a fixed number, are the only rows that meet in one place.
    """
    one = sizes.agg(F.collect_list(F.struct("virtual_slot", "bytes")).alias("free"))
    placed = _deal(F.col("free"), F.array_repeat(F.lit(0).cast("long"), shards))
    return one.select(F.inline(placed)).withColumn("version", F.lit(version))


def rebalance(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map's next version for ``shards`` shards.

    A shard keeps its slots as long as they fit the mean load, smallest first so that few large
    slots move; the slots beyond it, and those of shards that are gone, are dealt anew.
    """
    mean = F.sum("bytes").over(W.partitionBy(F.lit(0))) / F.lit(shards)
    both = old.join(F.broadcast(sizes), "virtual_slot").withColumn("mean", mean)
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", "virtual_slot"))
    judged = both.withColumn("stays", (running <= F.col("mean")) & (F.col("shard") < shards))
    slot = F.struct("virtual_slot", "bytes")
    one = judged.agg(
        F.collect_list(F.when(~F.col("stays"), slot)).alias("free"),
        F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard"))).alias("kept"),
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("loads"),
        (F.max("version") + 1).alias("version"),
    )
    loads = F.aggregate(
        "loads", F.array_repeat(F.lit(0).cast("long"), shards),
        lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["shard"], v + x["bytes"] + 1).otherwise(v)),
    )
    return one.select("version", F.inline(F.concat("kept", _deal(F.col("free"), loads)))).select("virtual_slot", "shard", "version")


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored maps; a stored version is never written again."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored map, the newest unless a version is given."""
    maps = spark.read.parquet(folder)
    wanted = version if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == wanted).select("virtual_slot", "shard", "version")


def next_map(sizes: DataFrame, shards: int, folder: str) -> DataFrame:
    """The stored map that a run uses: a first plan, or the newest version edited for these bytes and shards."""
    spark = sizes.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    save_map(rebalance(load_map(spark, folder), sizes, shards) if stored else plan_map(sizes, shards), folder)
    return load_map(spark, folder)


def assign(records: DataFrame, slot_map: DataFrame, keys: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """Every record with ``virtual_slot``, ``shard`` and ``map_version``.

    The map has ``slots`` rows whatever the corpus holds, so it is broadcast; no record is shuffled.
    """
    rows = packed(records, virtual_slot=slot_of(keys, slots))
    named = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"))
    return with_results(rows.join(F.broadcast(named), "virtual_slot"), records.columns, ["virtual_slot", "shard", "map_version"])


def number(assigned: DataFrame, order: Sequence[str], keys: Sequence[str] = ("doc_id",), lanes: int = LANES) -> DataFrame:
    """Gapless positions from 0 in each shard, as ``slot``.

    Records are numbered inside (slot, lane) bins; one row a bin carries the count of the bins
    before it in the shard, so no task holds a shard.
    """
    lane = F.pmod(F.shiftright(_hash(keys), 32), F.lit(lanes)).cast("int")
    rows = packed(assigned, virtual_slot=F.col("virtual_slot"), shard=F.col("shard"), lane=lane, order=F.struct(*order))
    inside = W.partitionBy("virtual_slot", "lane").orderBy("order")
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    before = W.partitionBy("shard").orderBy("virtual_slot", "lane").rowsBetween(W.unboundedPreceding, -1)
    bins = rows.groupBy("shard", "virtual_slot", "lane").agg(F.count(F.lit(1)).alias("n"))
    bases = bins.select("virtual_slot", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = ranked.join(bases, ["virtual_slot", "lane"])
    return with_results(out.withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long")), assigned.columns, ["slot"])


def shard_documents(docs: DataFrame, shards: int, keys: Sequence[str] = ("doc_id", "text"), text: str = "text", maps: str | None = None) -> DataFrame:
    """Documents with the shard of the next map in the folder ``maps``; of a first map in a new folder if none is given."""
    folder = maps or f"{new_folder(docs.sparkSession)}/maps"
    return assign(docs, next_map(slot_bytes(docs, keys, text), shards, folder), keys)
