"""Votes over the frames of a capture and the angular medoid.

``order`` columns give the frame order; ties go to the reading seen first.
Groups are reduced to one row per (group, reading) before anything else, so a
group with very many frames is summed up on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions import meters as M
from seamwatch.functions.text import blank_to_null


def majority_vote(
    readings: DataFrame, keys: Sequence[str], order: Sequence[str], text: str,
    min_agreement: int | None = 2,
) -> DataFrame:
    """Most frequent non-blank reading; confidence is its share of the non-blank readings.

    ``min_agreement=None`` asks for two votes once a group has two rows.
    """
    rank = F.struct(*order)
    votes = readings.withColumn("_text", blank_to_null(F.col(text))).groupBy(*keys, "_text").agg(
        F.count(F.lit(1)).alias("_votes"), F.min(rank).alias("_first")
    )
    valid = F.col("_text").isNotNull()
    groups = votes.groupBy(*keys).agg(
        F.sum("_votes").alias("_frames"),
        F.sum(F.when(valid, F.col("_votes")).otherwise(0)).alias("_total"),
        F.min_by(F.struct("_text", "_votes"), F.when(valid, F.struct(-F.col("_votes"), F.col("_first")))).alias("_best"),
    )
    won = F.coalesce(F.col("_best._votes"), F.lit(0))
    need = F.lit(min_agreement) if min_agreement is not None else F.when(F.col("_frames") >= 2, 2).otherwise(1)
    good = (F.col("_total") > 0) & (won >= need)
    return groups.select(
        *keys, F.when(good, "confirmed").otherwise("unreadable").alias("status"),
        F.when(good, F.col("_best._text")).alias("raw_text"),
        F.when(good, F.col("_best._text").try_cast("double")).alias("value"),
        F.when(F.col("_total") > 0, won / F.col("_total")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("_total") > 0, won).otherwise(0).cast("bigint").alias("votes"),
    )


def confirmed_vote(
    frames: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, status: str, confidence: str,
    allowed: Sequence | None = None,
) -> DataFrame:
    """Vote of confirmed frames only; confidence is the smallest among the winning frames.

    Two votes are needed once the group has two frames.  ``allowed`` restricts
    the readings that may vote.
    """
    counts = F.col(status) == "confirmed"
    if allowed is not None:
        counts = counts & F.col(text).isin(*allowed)
    votes = frames.withColumn("_ok", counts & F.col(text).isNotNull()).groupBy(*keys, F.col(text).alias("_text")).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_ok").alias("_votes"),
        F.min(F.when(F.col("_ok"), F.struct(*order))).alias("_first"),
        F.min(F.when(F.col("_ok"), F.col(confidence))).alias("_conf"),
    )
    groups = votes.groupBy(*keys).agg(
        F.sum("_all").alias("frames"),
        F.min_by(
            F.struct("_text", "_votes", "_conf"),
            F.when(F.col("_votes") > 0, F.struct(-F.col("_votes"), F.col("_first"))),
        ).alias("_best"),
    )
    none = F.col("_best").isNull()
    enough = F.col("_best._votes") >= F.when(F.col("frames") >= 2, 2).otherwise(1)
    good = ~none & enough
    return groups.select(
        *keys, F.when(good, "confirmed").otherwise("unreadable").alias("status"),
        F.when(good, F.col("_best._text")).alias("reading"),
        F.when(none, F.lit(0.0)).otherwise(F.col("_best._conf")).alias("confidence"),
        F.coalesce(F.col("_best._votes"), F.lit(0)).cast("bigint").alias("votes"),
        F.when(none, "no_confirmed").when(good, "majority").otherwise("disagree").alias("verdict"),
        "frames",
    )


METER_REASONS = {
    "no_confirmed": "no_confirmed_frame_readings",
    "disagree": "multi_frame_readings_do_not_agree",
    "majority": "multi_frame_majority_confirmed",
}
STATION_REASONS = {
    "no_confirmed": "no_confirmed_station_number_readings",
    "disagree": "multi_frame_station_numbers_do_not_agree",
    "majority": "multi_frame_majority_confirmed",
}


def _reason(table: dict[str, str], verdict: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(verdict == key, F.lit(value)).otherwise(out)
    return out


def meter_vote(frames: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "raw_text") -> DataFrame:
    """Meter module verdict from per-frame readings."""
    voted = confirmed_vote(frames, keys, order, text, "status", "confidence")
    return voted.select(
        *keys, "status", F.col("reading").alias("raw_text"), F.col("reading").try_cast("double").alias("value"),
        "confidence", "votes", _reason(METER_REASONS, F.col("verdict")).alias("reason"),
    )


def station_vote(
    frames: DataFrame, keys: Sequence[str], order: Sequence[str], number: str = "number",
    allowed: Sequence[int] = K.ALLOWED_STATIONS, station_id: str | None = None,
) -> DataFrame:
    """Station module verdict; ``station_id`` (a key column) adds the comparison with the metadata."""
    voted = confirmed_vote(frames, keys, order, number, "status", "confidence", allowed)
    out = voted.select(
        *keys, "status", F.col("reading").alias("number"), "confidence", "votes",
        _reason(STATION_REASONS, F.col("verdict")).alias("reason"),
    )
    if station_id:
        meta = F.trim(F.col(station_id).cast("string")).try_cast("int")
        ok = F.col("status") == "confirmed"
        out = out.withColumn("metadata_number", F.when(ok, meta)).withColumn(
            "metadata_matches", F.when(ok, meta.eqNullSafe(F.col("number")))
        )
    return out


def station_verdicts(
    captures: DataFrame, frames: DataFrame, markers: DataFrame, keys: Sequence[str], order: Sequence[str],
    trained: Column | bool = True, use_roi: bool = True, full_frame: bool = True, station_id: str | None = None, number: str = "number",
    allowed: Sequence[int] = K.ALLOWED_STATIONS,
) -> DataFrame:
    """Station module verdict of every capture, whether or not a frame could be read.

    Without a trained classifier the module is unavailable.  With ``use_roi`` the digits are read
    inside the best marker of ``markers`` (keys, bbox); a capture without one is unreadable, or is
    read over the full frame if ``full_frame`` allows it.  The rest is the vote of its frames.
    """
    keys = list(keys)
    ready = trained if isinstance(trained, Column) else F.lit(trained)
    vote = station_vote(frames, keys, order, number, allowed, station_id)
    extra = ["metadata_number", "metadata_matches"] if station_id else []
    rows = captures.select(*keys, ready.alias("_ready")).join(vote, keys, "left")
    if use_roi:
        rows = rows.join(markers.select(*keys, F.col("bbox").alias("_bbox")), keys, "left")
    else:
        rows = rows.withColumn("_bbox", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    blind = F.lit(use_roi and not full_frame) & F.col("_bbox").isNull()
    read = F.col("_ready") & ~blind
    status = F.when(~F.col("_ready"), "unavailable").when(blind, "unreadable").otherwise(F.coalesce("status", F.lit("unreadable")))
    reason = F.when(~F.col("_ready"), "station_image_classifier_not_trained").when(blind, "station_marker_not_detected").otherwise(
        F.coalesce("reason", F.lit(STATION_REASONS["no_confirmed"])))
    return rows.select(
        *keys, status.alias("status"), F.when(read, F.col("number")).alias("number"),
        F.when(F.col("_ready"), F.when(blind, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
        F.when(F.col("_ready"), F.when(blind, 0).otherwise(F.coalesce("votes", F.lit(0)))).cast("bigint").alias("votes"), reason.alias("reason"),
        F.when(F.col("_ready"), F.when(blind | F.col("_bbox").isNotNull(), "yolo_station_marker").otherwise("full_frame")).alias("roi_source"),
        F.when(F.col("_ready"), F.col("_bbox")).alias("station_marker_bbox"), F.when(read & (status == "confirmed"), "image_classifier").alias("source"),
        *[F.when(read, F.col(c)).alias(c) for c in extra])


_MICRO = 1_000_000
_TURN = 360 * _MICRO
#: Buckets of a turn; an even number that divides it, so that the opposite of a bucket is a bucket.
BUCKETS = 3600


def angle_medoid(
    angles: DataFrame, keys: Sequence[str], order: Sequence[str], angle: str = "angle", confidence: str = "confidence", buckets: int = BUCKETS,
) -> DataFrame:
    """Measured angle with the smallest summed circular distance to the others of its group.

    No pairs are formed and no group is gathered.  Equal angles are merged first (angles are compared
    in micro-degrees) and counted by bucket.  For an angle x of a bucket, all other buckets but the
    opposite one lie wholly ahead or behind, so their part of the sum is linear in x and comes from
    circular prefix sums over the group's buckets, a bounded number.  The own and the opposite bucket
    bound the rest; only buckets whose lower bound reaches the least upper bound of the group are
    looked at by angle, each apart, with signed prefix sums over its own and its opposite's angles.
    """
    if buckets % 2 or _TURN % buckets:
        raise ValueError("buckets must be even and divide the turn")
    keys = list(keys)
    width, half, count = _TURN // buckets, _TURN // 2, buckets // 2
    turn = F.pmod(F.round(F.col(angle) * _MICRO).cast("bigint"), F.lit(_TURN))
    merged = angles.where(F.col(angle).isNotNull()).withColumn("_a", turn).groupBy(*keys, "_a").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(*order)).alias("_first"),
        F.min_by(F.struct(F.col(angle).alias("angle"), F.col(confidence).alias("confidence")), F.struct(*order)).alias("_v"),
    ).withColumn("_b", F.floor(F.col("_a") / width).cast("bigint"))
    held = merged.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_a")).alias("_s"), F.min("_a").alias("_least"))
    laid = held.select("*", F.explode(F.array(*[F.lit(t) for t in (-1, 0, 1)])).alias("_t")).withColumns({
        "_x": F.col("_b") + F.col("_t") * buckets, "_s": F.col("_s") + F.col("_n") * F.col("_t") * _TURN})

    def upto(offset: int) -> tuple[Column, Column]:
        window = W.partitionBy(*keys).orderBy("_x").rangeBetween(W.unboundedPreceding, offset)
        return F.coalesce(F.sum("_n").over(window), F.lit(0)), F.coalesce(F.sum("_s").over(window), F.lit(0))

    (n0, s0), (n_before, s_before), (n_far, s_far), (n_last, s_last) = upto(0), upto(-1), upto(-count), upto(count - 1)
    n_opposite, _ = upto(count)
    summed = laid.select(*keys, "_b", "_t", "_n", "_least", (n_last - n0).alias("_na"), (s_last - s0).alias("_sa"),
                         (n_before - n_far).alias("_nb"), (s_before - s_far).alias("_sb"), (n_opposite - n_last).alias("_no")).where("_t = 0")

    def linear(x: Column) -> Column:
        return F.col("_sa") - x * F.col("_na") + x * F.col("_nb") - F.col("_sb")

    start = F.col("_b") * width
    low = F.least(linear(start), linear(start + width - 1)) + F.col("_no") * (half - width + 1)
    high = linear(F.col("_least")) + F.col("_n") * (width - 1) + F.col("_no") * half
    group = W.partitionBy(*keys)
    near = summed.withColumns({"_low": low, "_best": F.min(high).over(group), "measurements": F.sum("_n").over(group)}).where("_low <= _best")
    sides = near.select(*keys, F.col("_b").alias("_home"), "_na", "_sa", "_nb", "_sb", "_no", "measurements", F.explode(F.array(
        F.struct(F.col("_b").alias("_b"), F.lit(1).alias("_sign")), F.struct(F.pmod(F.col("_b") + count, F.lit(buckets)).alias("_b"), F.lit(-1).alias("_sign")))).alias("_side"))
    sides = sides.select(*keys, "_home", "_na", "_sa", "_nb", "_sb", "_no", "measurements", "_side.*")
    met = merged.join(sides, [*keys, "_b"]).withColumns({
        "_p": F.when(F.col("_sign") > 0, F.col("_a")).otherwise(F.pmod(F.col("_a") - half, F.lit(_TURN))), "_w": F.col("_n") * F.col("_sign")})
    home = W.partitionBy(*keys, "_home")
    here = home.orderBy("_p").rangeBetween(W.unboundedPreceding, 0)
    p = F.col("_p")
    inside = p * (2 * F.sum("_w").over(here) - F.sum("_w").over(home)) - (2 * F.sum(F.col("_w") * p).over(here) - F.sum(F.col("_w") * p).over(home))
    scored = met.withColumn("_total", inside + linear(p) + F.col("_no") * half).where("_sign > 0")
    best = scored.groupBy(*keys).agg(
        F.min_by(F.struct("_v", "_total"), F.struct("_total", "_first")).alias("_b"), F.first("measurements").alias("measurements"))
    return best.select(
        *keys, F.col("_b._v.angle").alias("angle"), F.col("_b._v.confidence").alias("confidence"),
        (F.col("_b._total") / _MICRO).alias("total_distance"), "measurements",
    )


def pointer_verdicts(medoids: DataFrame, reference: Column, tolerance: Column, min_confidence: Column | float = K.POINTER_MIN_CONFIDENCE) -> DataFrame:
    """Status, delta and reason for measured angles."""
    verdict = M.pointer_status(F.col("angle"), reference, tolerance, F.col("confidence"), min_confidence)
    out = medoids.withColumn("_p", verdict)
    return out.select(
        *[c for c in medoids.columns if c not in ("angle", "confidence")],
        F.col("_p.status").alias("status"), F.col("_p.confidence").alias("confidence"),
        F.col("_p.angle_deg").alias("angle_deg"), F.col("_p.reference_angle_deg").alias("reference_angle_deg"),
        F.col("_p.delta_deg").alias("delta_deg"), F.col("_p.reason").alias("reason"),
    )
