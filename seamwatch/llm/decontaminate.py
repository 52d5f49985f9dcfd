"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's MinHash slots each hold the one of its word shingles with the least value under the
slot's hash function.  A slot agrees with a document if the document holds that shingle, which
happens with probability containment(item in document), however long the document is; a signature
of the document itself would drown a short item.  Items are partitioned by the power of two of
their shingle count, and the partition sets the number of slots: all shingles of small items, so
that nothing is left to chance there, ``SLOTS`` of larger ones.  Documents too small to contain
enough of an item are not paired with it.  Candidates are verified exactly: the share of the
item's distinct shingles that the whole document holds.

Words are runs of other than white space, lower-cased.  An item of fewer than ``WIDTH`` words is
one shingle of all of them, looked for at that width.  Items and documents that are null or
without words match nothing; items of equal words are searched for once and found under each of
their ids (equal rows are one); ties do not arise.  An empty benchmark keeps all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch.functions.core import let
from seamwatch.llm.common import SPACE, durable, packed

WIDTH = 5
CONTAINMENT = 0.8
#: Slots of items of more shingles than that: misses a containment of 0.8 once in 0.2^-24 items.
SLOTS = 24
#: Rows of a side that may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased words of a text, empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of ``width`` words; none for a text of fewer words."""
    def runs(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        return F.slice(hashed, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))
    return let(words(text), runs)


def memberships(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id): each distinct item id by the id that stands for all items of equal words."""
    own = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    least = own.groupBy("w").agg(F.min("item_id").alias("item"))
    return own.join(least, "w").select("item", "item_id").distinct()


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, width, n, h): the distinct shingles of each distinct item, by its least id."""
    short = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    sized = short.groupBy("w").agg(F.min("item").alias("item")).select("*", F.least(F.size("w"), F.lit(width)).alias("width"))
    hashes = F.coalesce(*[F.when(F.col("width") == k, shingles(F.array_join("w", " "), k)) for k in range(1, width + 1)])
    one = sized.select("item", "width", F.array_distinct(hashes).alias("hs"))
    return one.select("item", "width", F.size("hs").alias("n"), F.explode("hs").alias("h"))


def item_slots(parts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(item, width, n, size_class, h): the shingles that the items' MinHash slots hold."""
    classed = parts.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    mins = [F.min_by("h", F.xxhash64(F.lit(s), F.col("h"))).alias(f"s{s}") for s in range(slots)]
    large = classed.where(F.col("n") > slots).groupBy("item", "width", "n", "size_class").agg(*mins)
    chosen = large.select("item", "width", "n", "size_class", F.explode(F.array_distinct(F.array(*[f"s{s}" for s in range(slots)]))).alias("h"))
    return chosen.unionByName(classed.where(F.col("n") <= slots).select(chosen.columns))


def _fits(side: DataFrame) -> DataFrame:
    """The side with a broadcast hint if it has few enough rows."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def _text_shingles(texts: DataFrame, text: str, widths: list[int]) -> DataFrame:
    """(tag, size, h, width) of all shingles of all texts."""
    rows = None
    for k in widths:
        found = texts.select(F.xxhash64(text).alias("tag"), shingles(F.col(text), k).alias("hs"))
        found = found.select("tag", F.size("hs").alias("size"), F.explode("hs").alias("h"), F.lit(k).alias("width"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def leaking_texts(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  containment: float = CONTAINMENT) -> DataFrame:
    """(tag, item, n_shared, n_item, containment): whole texts, by hash, that hold enough of an item.

    Copies of a text are one candidate.
    """
    parts = durable(item_shingles(items, item_id, item_text))
    widths = [r["width"] for r in parts.select("width").distinct().collect()] or [WIDTH]
    enough = F.ceil(F.col("n") * containment)
    hits = _text_shingles(docs, text, widths).join(_fits(item_slots(parts)), ["width", "h"]).where(F.col("size") >= enough)
    candidates = durable(hits.select("tag", "item").distinct())
    tagged = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("tag"))
    held = tagged.join(_fits(candidates.select("tag").distinct()), "tag", "left_semi").dropDuplicates(["tag"])
    shared = _text_shingles(held, "text", widths).select("tag", "width", "h").distinct().join(_fits(parts), ["width", "h"])
    counted = shared.groupBy("tag", "item", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    verified = counted.where(F.col("n_shared") >= enough).join(candidates, ["tag", "item"], "left_semi")
    return verified.select("tag", "item", "n_shared", F.col("n").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc, item, n_shared, n_item, containment): documents that hold enough of an item, those without an id included.

    Items of equal words are searched for once and each of their ids has its row.
    """
    found = durable(leaking_texts(docs, items, text, **options))
    ids = memberships(items, options.get("item_id", "item_id"), options.get("item_text", "text"))
    found = found.join(_fits(ids), found["item"].eqNullSafe(ids["item"])).select("tag", F.col("item_id").alias("item"), "n_shared", "n_item", "containment")
    found = durable(found)
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("tag"))
    return rows.join(_fits(found), "tag").drop("tag")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = durable(leaking_texts(docs, items, text, **options).select(F.col("tag").alias("_tag")).distinct())
    rows = packed(docs, _text_tag=F.xxhash64(docs[text]))
    return rows.join(_fits(found), rows["_text_tag"] == F.col("_tag"), "left_anti").select("_row.*")
