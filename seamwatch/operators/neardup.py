"""Near duplicates that leak across splits: 64-bit hashes at most four bits apart.

Exact, and without comparing all pairs:

1. rows are merged to distinct (split, hash, content) classes, so copies never multiply work;
2. a hash is cut in m bands; two hashes ``limit`` bits apart agree on m - limit
   bands at least, so classes meet on every choice of that many bands.  m follows
   the number of hashes: more bands are more keys for each hash but longer ones
   (5 keys of 13 bits, 15 of 21, 35 of 27, 70 of 32, 126 of 35 for four bits
   apart), and the fewest are taken whose buckets stay small.  A pair is kept at
   the first choice of bands it agrees on alone;
3. buckets that grow beyond a bound are not compared pairwise: their hashes meet
   on *balls* instead - every hash emits all values two flips away or less from
   its remaining bits, and two hashes four apart share one of those.  A ball key
   has at most 2,081 members whatever the data looks like.

The result lists pairs of classes with their sizes; it stands for
``left_rows * right_rows`` row pairs, which ``members`` spells out by hash.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions.hashing import hamming

#: Bucket size from which pairs are found through balls.
BUCKET_LIMIT = 1024
#: Hashes that a bucket should hold if hashes are spread evenly.
BUCKET_ROWS = 64
MOST_BANDS = 9


def band_widths(bands: int) -> list[int]:
    """Bits of each band of a 64-bit hash."""
    return [64 // bands + (i < 64 % bands) for i in range(bands)]


def bands_for(hashes: int, limit: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The fewest bands whose keys keep buckets of ``hashes`` evenly spread hashes at ``bucket_rows``."""
    for bands in range(limit + 1, MOST_BANDS):
        shortest = sum(sorted(band_widths(bands))[: bands - limit])
        if hashes <= bucket_rows << shortest:
            return bands
    return MOST_BANDS


def _bits(hi: Column, lo: Column, start: int, width: int) -> Column:
    """Bits from ``start`` (0 is the highest) of a hash in two 32-bit halves."""
    stop = start + width
    if stop <= 32:
        return F.shiftrightunsigned(hi, 32 - stop).bitwiseAND(F.lit((1 << width) - 1))
    if start >= 32:
        return F.shiftrightunsigned(lo, 64 - stop).bitwiseAND(F.lit((1 << width) - 1))
    head, tail = 32 - start, stop - 32
    return F.shiftleft(hi.bitwiseAND(F.lit((1 << head) - 1)), tail).bitwiseOR(F.shiftrightunsigned(lo, 32 - tail))


def _band(hi: Column, lo: Column, index: int, bands: int) -> Column:
    widths = band_widths(bands)
    return _bits(hi, lo, sum(widths[:index]), widths[index])


def _choice(bands: tuple[int, ...]) -> str:
    return "".join(chr(97 + i) for i in bands)


def _keys(bands: int, limit: int) -> Column:
    """(combo, value) for every choice of bands - limit bands."""
    widths, hi, lo = band_widths(bands), F.col("hi"), F.col("lo")
    out = []
    for chosen in combinations(range(bands), bands - limit):
        value = F.lit(0).cast("bigint")
        for i in chosen:
            value = F.shiftleft(value, widths[i]).bitwiseOR(_band(hi, lo, i, bands))
        out.append(F.struct(F.lit(_choice(chosen)).alias("combo"), value.alias("value")))
    return F.array(*out)


def hash_classes(rows: DataFrame, content: str | None = None) -> DataFrame:
    """Distinct (split, hi, lo[, content]) with row count and first member."""
    keys = ["split", "hi", "lo", *([content] if content else [])]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))


def members(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the classes named by the pairs (their hash occurs on either side)."""
    named = pairs.select("left_split", "left_hi", "left_lo").toDF("split", "hi", "lo").union(
        pairs.select("right_split", "right_hi", "right_lo").toDF("split", "hi", "lo")
    ).distinct()
    return rows.join(named, ["split", "hi", "lo"], "left_semi")


def cross_split_pairs(rows: DataFrame, limit: int = K.NEAR_DUPLICATE_BITS, bucket_limit: int = BUCKET_LIMIT, bands: int | None = None) -> DataFrame:
    """Pairs of hash classes of different splits at most ``limit`` (up to four) bits apart.

    ``rows``: id, split, hi, lo.  Left and right are ordered by split name.  ``bands`` is chosen by
    the number of hashes (counted to within a few per cent) if it is not given.
    """
    if not 0 <= limit <= 4:
        raise ValueError("balls cover distances up to four bits")
    classes = hash_classes(rows)
    if bands is None:
        bands = bands_for(rows.agg(F.approx_count_distinct(F.struct("hi", "lo"))).first()[0], limit)
    keys = _keys(bands, limit)
    hashes = classes.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("splits"))
    keyed = classes.select("*", F.explode(keys).alias("k")).select(*classes.columns, "k.combo", "k.value")
    sizes = hashes.select(F.explode(keys).alias("k")).groupBy("k.combo", "k.value").agg(F.count(F.lit(1)).alias("members"))
    crowded = sizes.where(F.col("members") > bucket_limit).select("combo", "value")
    useful = sizes.where(F.col("members") <= bucket_limit).select("combo", "value")
    met = _meet(keyed.join(useful, ["combo", "value"], "left_semi"), ["combo", "value"], limit)
    hi, lo = F.col("left_hi").bitwiseXOR(F.col("right_hi")), F.col("left_lo").bitwiseXOR(F.col("right_lo"))
    agreed = F.concat(*[F.when(_band(hi, lo, i, bands) == 0, _choice((i,))).otherwise("") for i in range(bands)])
    near = met.where(F.substring(agreed, 1, bands - limit) == F.col("combo")).drop("combo", "value")
    in_crowd = keyed.join(crowded, ["combo", "value"], "left_semi").select(*classes.columns).distinct()
    far = _meet(in_crowd.select("*", F.explode(_ball()).alias("ball")).select(*classes.columns, "ball.*"), ["bhi", "blo"], limit).drop("bhi", "blo")
    return near.unionByName(far).distinct()


def _meet(keyed: DataFrame, keys: list[str], limit: int) -> DataFrame:
    left = keyed.select(*keys, *[F.col(c).alias(f"left_{c}") for c in ("split", "hi", "lo", "rows", "first_id")])
    right = keyed.select(*keys, *[F.col(c).alias(f"right_{c}") for c in ("split", "hi", "lo", "rows", "first_id")])
    distance = hamming(F.col("left_hi"), F.col("left_lo"), F.col("right_hi"), F.col("right_lo"))
    joined = left.join(right, keys).where(F.col("left_split") < F.col("right_split"))
    return joined.withColumn("distance", distance).where(F.col("distance") <= limit)


def _ball() -> Column:
    """All (hi, lo) values at most two flips away."""
    flips = [(0, 0)] + [_flip(i) for i in range(64)]
    flips += [(a[0] ^ b[0], a[1] ^ b[1]) for a, b in combinations([_flip(i) for i in range(64)], 2)]
    masks = F.from_json(
        F.lit("[" + ",".join(f'{{"h":{h},"l":{l}}}' for h, l in flips) + "]"), "array<struct<h:bigint,l:bigint>>"
    )
    return F.transform(masks, lambda m: F.struct(
        F.col("hi").bitwiseXOR(m["h"]).alias("bhi"), F.col("lo").bitwiseXOR(m["l"]).alias("blo")))


def _flip(bit: int) -> tuple[int, int]:
    return (1 << (31 - bit), 0) if bit < 32 else (0, 1 << (63 - bit))


def content_duplicates(rows: DataFrame) -> DataFrame:
    """Equal content (sha256) in different splits: distance zero whatever the perceptual hash says."""
    per_split = rows.groupBy("sha256", "split").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))
    left = per_split.select("sha256", *[F.col(c).alias(f"left_{c}") for c in ("split", "rows", "first_id")])
    right = per_split.select("sha256", *[F.col(c).alias(f"right_{c}") for c in ("split", "rows", "first_id")])
    return left.join(right, "sha256").where(F.col("left_split") < F.col("right_split"))
