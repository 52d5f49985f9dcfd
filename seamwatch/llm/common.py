"""Shared by the operators: table reads, row packing, durable cuts, word tokens in bulk."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a class body for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
#: Rows of a table of names and a few numbers that may be broadcast.
BROADCAST_ROWS = 20_000
#: Text bytes that one parcel of documents should hold.
PARCEL_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``_row`` beside the given ones, so that no names clash."""
    return df.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in columns.items()])


def with_results(df: DataFrame, original: list[str], results: list[str]) -> DataFrame:
    """The columns of ``_row`` and the results; a result takes the place of a column of the same name."""
    lowered = {r.lower() for r in results}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in original if c.lower() not in lowered]
    return df.select(*kept, *results)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared one."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder, which outlives executors.

    Unlike a checkpoint it is compressed, is read by column, and carries no inferred constraints
    into the next step, which an iteration would pile up.
    """
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole(value: Column | int) -> Column:
    """A 38-digit decimal without places, so that products pass 64 bits."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(38,0)")


def exact_quotient(above: Column, below: Column) -> Column:
    """floor(above / below) of positive decimals without places, as a long."""
    return F.call_function("div", above, below)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that is broadcast if its rows are within the bound, else joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def parts(spark: SparkSession, size: int, each: int = PARCEL_BYTES) -> int:
    """How many partitions of about ``each`` bytes; no fewer than the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


#: A random 64-bit value for each byte; upper-case letters have those of lower-case ones.
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODES[65:91] = BYTE_CODES[97:123]
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (multiply and fold, twice)."""
    values = (values ^ (values >> np.uint64(32))) * _MUL2
    values = (values ^ (values >> np.uint64(29))) * _MUL
    return values ^ (values >> np.uint64(32))


def byte_views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and n + 1 offsets; a null text has none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z as a-z) and the number of words in each text.

    A word's hash is that of its run of bytes: a sum of byte codes times powers of an odd number,
    moved to the word's start by the inverse powers.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    edge = offsets[:-1]
    first[edge[edge < n]] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    edge = offsets[1:] - 1
    last[edge[edge >= 0]] = True
    last &= inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODES[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number modulo 2^64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = 0xA0761D6478BD642F
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(b, have, 1 << 64))
                have *= 2
            pair.append(out)
        _POWERS[:] = pair
    return _POWERS[0], _POWERS[1]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their number in each text.

    A text of fewer words has one: the whole run.  A text without words has none.
    """
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(counts)), sizes)
    step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = firsts[owner] + step
    left = counts[owner] - step
    out = np.zeros(total, np.uint64)
    for i in range(width):
        live = left > i
        out[live] = mix(out[live] * _MUL + words[at[live] + i] + np.uint64(i + 1))
    return out, sizes


def slices(texts: pa.Array, limit: int = 1 << 18):
    """(first row, texts) of consecutive rows of about ``limit`` bytes, so that work arrays stay small."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = byte_views(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star rounds; each is a few joins of narrow rows, written out.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = durable(oriented)
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = state.agg(mark.alias("m")).first()["m"]
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = durable(small.unionByName(nearest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = state.agg(mark.alias("m")).first()["m"]
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def parceled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(parcel, doc_id, text) dealt into parcels of about ``PARCEL_BYTES``, and their number.

    Passes that all start from this one frame share its shuffle, so texts move once.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    count = parts(docs.sparkSession, text_bytes(own))
    return own.withColumn("parcel", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")).repartition(count, "parcel"), count
