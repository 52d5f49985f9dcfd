"""Template matching of binary masks with a bounded template library.

Masks are packed in 32-bit words (array<bigint>).  Templates come in blocks of
at most ``BLOCK`` masks; a query meets a block in one row and scores all its
templates there, so query x template pairs never become rows.  A library that
fits one block (the usual case: some hundred templates) is one small row that
Spark broadcasts; a larger one simply has more blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions.meters import clamp01

BLOCK = 512
#: Bytes of masks up to which a library is broadcast, and lanes that a larger one is repeated in.
LIBRARY_BYTES = 16 << 20
LANES = 64


def pack_bits(flags: Column, size: int) -> Column:
    """Array of booleans/0-1 values -> array of 32-bit words, first value in the top bit."""
    words = (size + 31) // 32
    return F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda w: F.aggregate(
            F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"),
            lambda bits, i: bits * 2 + F.coalesce(F.get(flags, w * 32 + i).cast("bigint"), F.lit(0)),
        ),
    )


def ones(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, word: n + F.bit_count(word))


def overlap(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("bigint"), lambda n, c: n + c
    )


def shifted(bits: Column, shift: tuple[int, int], height: int, width: int) -> Column:
    """Mask moved by (dy, dx); vacated cells are empty.  Width must be a multiple of 32."""
    if width % 32:
        raise ValueError("mask width must be a multiple of 32")
    dy, dx = shift
    per_row = width // 32
    empty = F.lit(0).cast("bigint")
    full = (1 << 32) - 1

    def word(index: Column) -> Column:
        row = F.floor(index / per_row).cast("int") - dy
        col = index % per_row
        def at(c: Column) -> Column:
            inside = (row >= 0) & (row < height) & (c >= 0) & (c < per_row)
            return F.when(inside, F.get(bits, row * per_row + c)).otherwise(empty)
        if dx == 0:
            return at(col)
        k = abs(dx)
        if dx > 0:  # move right: low bits of the left neighbour enter on top
            return F.shiftrightunsigned(at(col), k).bitwiseOR(
                F.shiftleft(at(col - 1), 32 - k).bitwiseAND(F.lit(full)))
        return F.shiftleft(at(col), k).bitwiseAND(F.lit(full)).bitwiseOR(F.shiftrightunsigned(at(col + 1), 32 - k))

    return F.transform(F.sequence(F.lit(0), F.lit(height * per_row - 1)), word)


def shift_variants(bits: Column, shifts: Sequence[tuple[int, int]], height: int, width: int, recount: bool) -> Column:
    """Array of struct<bits, ones>; ``recount`` counts the shifted mask, otherwise the unshifted one."""
    own = ones(bits)
    out = []
    for shift in shifts:
        moved = bits if shift == (0, 0) else shifted(bits, shift, height, width)
        out.append(F.struct(moved.alias("bits"), (ones(moved) if recount else own).alias("ones")))
    return F.array(*out)


def dice_distance(variants: Column, template_bits: Column, template_ones: Column) -> Column:
    """Smallest Dice distance over the shifted variants; two empty masks are at distance one."""
    def distance(v: Column) -> Column:
        total = v["ones"] + template_ones
        share = F.when(total > 0, 2.0 * overlap(v["bits"], template_bits) / total).otherwise(F.lit(0.0))
        return 1.0 - share
    return F.least(F.lit(1.0), F.array_min(F.transform(variants, distance)))


def template_blocks(templates: DataFrame, block: int = BLOCK) -> DataFrame:
    """Templates (template_id, label, source, bits) packed in blocks of bounded size.

    Block numbers are dense: ids are ranked inside hash buckets and shifted by
    the bucket offsets, so no single task sees the whole library.
    """
    counted = templates.withColumn("ones", ones(F.col("bits"))).withColumn(
        "_bucket", F.pmod(F.xxhash64("template_id"), F.lit(1024)).cast("int")
    )
    sizes = counted.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    ranked = counted.withColumn("_r", F.row_number().over(W.partitionBy("_bucket").orderBy("template_id")) - 1)
    placed = ranked.join(offsets, "_bucket").withColumn("block", F.floor((F.col("_r") + F.col("_base")) / block).cast("int"))
    return placed.groupBy("block").agg(
        F.max(F.ceil(F.col("_total") / block).cast("int")).alias("blocks"),
        F.sort_array(F.collect_list(F.struct("template_id", "label", "source", "bits", "ones"))).alias("templates"),
    )


def score_templates(
    queries: DataFrame, templates: DataFrame, keys: Sequence[str], shifts: Sequence[tuple[int, int]],
    shape: tuple[int, int], recount: bool, source: str | None = None, nearest: int = 1, block: int = BLOCK,
) -> DataFrame:
    """Per query and label: mean of the ``nearest`` smallest distances and the first best template.

    ``source`` names a query column; templates of the same source are left out
    (leave-one-out).
    """
    keys = list(keys)
    height, width = shape
    variants = queries.withColumn("_variants", shift_variants(F.col("bits"), shifts, height, width, recount))
    met = _meet(variants, template_blocks(templates, block))
    usable = F.col("templates")
    if source:
        usable = F.filter(usable, lambda t: t["source"] != F.col(source))
    scored = F.transform(usable, lambda t: F.struct(
        t["label"].alias("label"),
        dice_distance(F.col("_variants"), t["bits"], t["ones"]).alias("distance"),
        t["template_id"].alias("template_id"),
    ))
    labelled = met.withColumn("_scored", scored).withColumn(
        "_labels", F.array_distinct(F.transform("_scored", lambda s: s["label"]))
    )
    best = F.transform("_labels", lambda lab: F.struct(
        lab.alias("label"),
        F.slice(F.array_sort(F.transform(
            F.filter("_scored", lambda s: s["label"] == lab), lambda s: F.struct(s["distance"], s["template_id"]))), 1, nearest).alias("near"),
    ))
    rows = labelled.select(*keys, F.explode(best).alias("_b")).select(*keys, F.col("_b.label").alias("label"), F.explode("_b.near").alias("_n"))
    kept = _k_best(rows, [*keys, "label"], [F.col("_n")], nearest)
    return kept.groupBy(*keys, "label").agg(F.sum("_n.distance").alias("_sum"), F.count(F.lit(1)).alias("_k"), F.min("_n").alias("_first")).select(
        *keys, "label", (F.col("_sum") / F.col("_k")).alias("distance"), F.col("_first.template_id").alias("template_id"))


def _k_best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key: every map task sends k at most, and what they send is merged."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def _meet(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query with every block of templates.

    A library within ``LIBRARY_BYTES`` is broadcast and queries stay where they are.  A larger one
    stands once in each of ``LANES`` lanes; a query goes to its lane of each block, so no block is one
    reducer's.
    """
    held = F.aggregate("templates", F.lit(0).cast("bigint"), lambda n, t: n + F.size(t["bits"]) * 8 + 64)
    count, size = blocks.agg(F.coalesce(F.max("blocks"), F.lit(0)), F.coalesce(F.sum(held), F.lit(0))).first()
    if not count:
        return queries.where("false").join(blocks.drop("blocks"), F.lit(True))
    numbers = F.sequence(F.lit(0), F.lit(count - 1))
    if size <= LIBRARY_BYTES:
        return queries.withColumn("block", F.explode(numbers)).join(F.broadcast(blocks.drop("blocks")), "block")
    lane = F.pmod(F.xxhash64(*[F.col(c) for c in queries.columns if c != "_variants"]), F.lit(LANES)).cast("int")
    library = blocks.drop("blocks").withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    return queries.withColumn("_lane", lane).withColumn("block", F.explode(numbers)).join(library, ["block", "_lane"]).drop("_lane")


def best_labels(scores: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Best label, runner-up of another label and the confidence (kind ``digit`` or ``station``).

    Ties: digits go to the template listed first, stations to the smaller label (their means are
    compared to twelve places).  Two rows of a query are merged at most.
    """
    order = [F.col("distance"), F.col("template_id"), F.col("label")] if kind == "digit" else [F.round("distance", 12), F.col("label")]
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "label", "distance")
    two = _k_best(scores.select(*keys, entry.alias("_e")), keys, [F.col("_e")], 2)
    ranked = two.groupBy(*keys).agg(F.min("_e").alias("_one"), F.max("_e").alias("_two"), F.count(F.lit(1)).alias("_n"))
    d1 = F.col("_one.distance")
    d2 = F.when(F.col("_n") > 1, F.col("_two.distance")).otherwise(F.lit(1.0))
    margin = F.greatest(F.lit(0.0), d2 - d1)
    if kind == "digit":
        confidence = clamp01(0.65 * (1.0 - d1) + 0.35 * margin)
    else:
        confidence = clamp01(0.70 * (1.0 - d1) + 0.30 * F.least(F.lit(1.0), 2.0 * margin))
    return ranked.select(
        *keys, F.col("_one.label").alias("label"),
        d1.alias("best_distance"), d2.alias("second_distance"), confidence.alias("confidence"),
    )


def match_digits(queries: DataFrame, templates: DataFrame, keys: Sequence[str], source: str | None = None,
                 shape: tuple[int, int] = K.DIGIT_SHAPE, shifts: Sequence[tuple[int, int]] = K.DIGIT_SHIFTS) -> DataFrame:
    scores = score_templates(queries, templates, keys, shifts, shape, recount=True, source=source)
    return best_labels(scores, keys, "digit")


def match_stations(queries: DataFrame, templates: DataFrame, keys: Sequence[str], source: str | None = None,
                   shape: tuple[int, int] = K.STATION_SHAPE, shifts: Sequence[tuple[int, int]] = K.STATION_SHIFTS) -> DataFrame:
    scores = score_templates(queries, templates, keys, shifts, shape, recount=False, source=source, nearest=K.STATION_NEAREST)
    return best_labels(scores, keys, "station")


def judge(matches: DataFrame, minimum: float, confirmed: str, below: str) -> DataFrame:
    """confirmed / unreadable by the confidence threshold, with the reason."""
    ok = F.col("confidence") >= minimum
    return matches.withColumn("status", F.when(ok, "confirmed").otherwise("unreadable")).withColumn(
        "reason", F.when(ok, confirmed).otherwise(below)
    )
