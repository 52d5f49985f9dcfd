"""Gas and thermal streams: decoding, alignment, roll-ups and running display bounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions import registers as R
from seamwatch.functions import thermal as T
from seamwatch.functions.core import compute_once, let
from seamwatch.skew import first_per_key, number_rows, previous_value, spread_join


def parse_frames(frames: DataFrame, frame: str = "frame", slave_id: str = "slave_id", registers: int = 6) -> DataFrame:
    """Validate raw response frames and decode them; ``error`` holds the first broken rule."""
    values = frames.withColumn("_u", R.unpack_frames(F.col(frame)))
    checked = compute_once(values, _error=R.frame_error(F.col("_u.bytes"), F.col("_u.crc"), F.col(slave_id), registers))
    split = compute_once(checked, _registers=F.when(
        F.col("_error").isNull(), R.frame_registers(F.col("_u.bytes"), registers)))
    out = R.decode_registers(split, "_registers")
    fields = ("value", "decimals", "value_text", "unit", "status")
    return out.select(*frames.columns, *fields, F.coalesce("_error", "error").alias("error"))


def decode_register_rows(rows: DataFrame, registers: str = "registers") -> DataFrame:
    """Decode already extracted register arrays."""
    return R.decode_registers(rows, registers)


def first_valid_attempt(
    attempts: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column,
    reading: str, error: str, retries: int = 2,
) -> DataFrame:
    """First good reading among the first ``retries + 1`` attempts, else a read_error row.

    The rank filter is a top-k per key, which Spark already cuts on the map side.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    tried = attempts.withColumn("attempt", F.row_number().over(window)).where(
        F.col("attempt") <= retries + 1
    ).withColumn("_ok", ok)
    out = tried.groupBy(*keys).agg(
        F.min_by(F.when(F.col("_ok"), F.col(reading)), F.when(F.col("_ok"), F.col("attempt"))).alias("value"),
        F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("used_attempt"),
        F.max_by(F.col(error), F.when(~F.col("_ok"), F.col("attempt"))).alias("_last_error"),
        F.count(F.lit(1)).alias("attempts"),
    )
    good = F.col("used_attempt").isNotNull()
    return out.select(
        *keys, F.when(good, F.col("value")).alias("value"), "used_attempt", "attempts",
        F.when(good, "ok").otherwise("read_error").alias("status"),
        F.when(~good, F.col("_last_error")).alias("error"),
    )


def keep_first_sample(samples: DataFrame, keys: Sequence[str], order: Sequence[str], message: Column) -> tuple[DataFrame, DataFrame]:
    """(first row of every key, diagnostics for the later ones)."""
    rank = F.struct(*[F.col(o) for o in order])
    owners = samples.groupBy(*keys).agg(F.min(rank).alias("_owner"), F.count(F.lit(1)).alias("_rows"))
    kept = first_per_key(samples, keys, order)
    repeated = spread_join(samples, owners.where(F.col("_rows") > 1), keys, "_rows", how="inner")
    later = repeated.where(rank != F.col("_owner")).drop("_owner", "_rows")
    return kept.select(*samples.columns), later.withColumn("message", message)


def align_sensors(
    gas: DataFrame, thermal: DataFrame, keys: Sequence[str] = ("batch_id", "sample_key"),
) -> DataFrame:
    """Full outer alignment on the exact key; both sides hold one row per key.

    Gas values win for shared columns; an absent side is named in ``warning``.
    """
    keys = list(keys)
    shared = [c for c in thermal.columns if c in gas.columns and c not in keys]
    left = gas.withColumn("_gas", F.lit(True))
    right = thermal.select(*keys, *[
        F.col(c).alias(f"_t_{c}") if c in shared else F.col(c) for c in thermal.columns if c not in keys
    ], F.lit(True).alias("_thermal"))
    joined = left.join(right, keys, "full_outer")
    warning = F.concat_ws(
        "; ",
        F.when(F.col("_gas").isNull(), "missing_gas_row"),
        F.when(F.col("_thermal").isNull(), "missing_thermal_frame"),
    )
    merged = [F.coalesce(F.col(c), F.col(f"_t_{c}")).alias(c) if c in shared else F.col(c)
              for c in gas.columns if c not in keys]
    extra = [F.col(c) for c in thermal.columns if c not in keys and c not in shared]
    return joined.select(*keys, *merged, *extra, F.nullif(warning, F.lit("")).alias("warning"))


def alignment_diagnostics(aligned: DataFrame, batch: str = "batch_id", key: str = "sample_key") -> DataFrame:
    """One warning per sample that lacks a side, in the diagnostics layout."""
    return aligned.where(F.col("warning").isNotNull()).select(
        F.col(batch).alias("batch_id"), F.lit("sensors").alias("scope"), F.lit("warning").alias("level"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("row"),
        F.col(key).cast("string").alias("sample_key"), F.translate("warning", ";", ",").alias("message"),
    )


def status_text(readings: dict[str, tuple[Column, Column, Column]], errors: Column | None = None) -> Column:
    """Status message of a wide row.

    ``readings`` maps a channel to (present, status, error).  Messages follow
    the channel order, then the extra errors, without repeats.
    """
    parts = []
    for channel in K.CHANNELS:
        present, status, error = readings[channel]
        name = K.DISPLAY_NAMES[channel]
        parts.append(
            F.when(~present, F.lit(f"{name}缺少读数"))
            .when(error.isNotNull() & (error != ""), F.concat(F.lit(f"{name}："), error))
            .when(~status.isin("normal", ""), F.concat(F.lit(f"{name}状态："), status))
        )
    messages = F.array_compact(F.array(*parts))
    if errors is not None:
        extra = F.filter(errors, lambda e: e.isNotNull() & (e != ""))
        messages = F.concat(messages, F.coalesce(extra, F.array().cast("array<string>")))
    joined = F.array_join(F.array_distinct(messages), K.STATUS_SEPARATOR)
    return F.when(F.size(messages) == 0, K.STATUS_OK_ZH).otherwise(joined)


def gas_wide(
    readings: DataFrame, keys: Sequence[str], order: Sequence[str], errors: str | None = None,
) -> DataFrame:
    """Long readings -> one row per sample with four values and the status message.

    ``readings`` has channel, value, status, error; the first reading of a
    channel in ``order`` is used.  ``errors`` names an array column of extra
    errors that is constant inside a sample.
    """
    rank = F.struct(*[F.col(o) for o in order])
    picked = F.struct("value", "status", "error")
    aggs = [
        F.min_by(F.when(F.col("channel") == c, picked), F.when(F.col("channel") == c, rank)).alias(c)
        for c in K.CHANNELS
    ]
    if errors:
        aggs.append(F.first(errors, ignorenulls=True).alias("_errors"))
    wide = readings.groupBy(*keys).agg(*aggs)
    parts = {c: (F.col(c).isNotNull(), F.col(f"{c}.status"), F.col(f"{c}.error")) for c in K.CHANNELS}
    return wide.select(
        *keys,
        *[F.col(f"{c}.value").alias(f"{c}_value") for c in K.CHANNELS],
        status_text(parts, F.col("_errors") if errors else None).alias("status"),
    )


def sample_errors(reading_errors: Column, service_errors: Column) -> Column:
    """Errors of a sample: reading errors in channel order, then service errors."""
    present = F.filter(reading_errors, lambda e: e.isNotNull() & (e != ""))
    return F.concat(present, F.coalesce(service_errors, F.array().cast("array<string>")))


def frame_statistics(frames: DataFrame, values: str = "temperatures", pixels: int = K.THERMAL_WIDTH * K.THERMAL_HEIGHT) -> DataFrame:
    """Minimum, maximum, mean and display percentiles of every frame, or its error."""
    t = F.col(values)
    checked = frames.withColumn("frame_error", T.frame_error(t, pixels)).withColumn(
        "_sorted", F.when(F.col("frame_error").isNull(), F.sort_array(t))
    )
    ok = F.col("frame_error").isNull()
    return checked.select(
        *frames.columns, "frame_error",
        F.when(ok, F.array_min(t)).alias("t_min"), F.when(ok, F.array_max(t)).alias("t_max"),
        F.when(ok, T.array_mean(t)).alias("t_mean"),
        T.sorted_percentile(F.col("_sorted"), K.DISPLAY_LOW).alias("t_low"),
        T.sorted_percentile(F.col("_sorted"), K.DISPLAY_HIGH).alias("t_high"),
    )


#: Frames of a reading up to which they meet as arrays.
_READING_FRAMES = 64


def pixel_median(frames: DataFrame, keys: Sequence[str], values: str = "temperatures") -> DataFrame:
    """Per-pixel median over the frames of one reading, one row per pixel.

    A reading has a few frames as a rule: those travel as one row each and meet as arrays.  Readings
    with more than ``_READING_FRAMES`` work on (reading, pixel) keys instead, which spreads even very
    many frames over as many groups as they have pixels.
    """
    rows = _medians(frames, keys, values)
    return rows[0].select(*keys, F.posexplode(values).alias("pixel", "t")).unionByName(rows[1])


def _medians(frames: DataFrame, keys: Sequence[str], values: str) -> tuple[DataFrame, DataFrame]:
    """(readings of few frames as arrays, pixels of the others)."""
    keys = list(keys)
    usual = frames.where(F.col(values).isNotNull()).select(*keys, F.col(values).cast("array<double>").alias(values))
    many = usual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _READING_FRAMES).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    few = usual.join(many, same, "left_anti").groupBy(*keys).agg(F.collect_list(values).alias("_f"))
    places = F.sequence(F.lit(0), F.array_max(F.transform("_f", F.size)) - 1)

    def middle(i: Column) -> Column:
        here = F.filter(F.transform("_f", lambda f: F.get(f, i)), lambda t: t.isNotNull())
        return let(F.sort_array(here), lambda ordered: T.sorted_percentile(ordered, 0.5))

    arrays = few.where(F.array_max(F.transform("_f", F.size)) > 0).select(*keys, F.transform(places, middle).alias(values))
    pixels = usual.join(many, same, "left_semi").select(*keys, F.posexplode(values).alias("pixel", "t"))
    return arrays, pixels.groupBy(*keys, "pixel").agg(F.median("t").alias("t"))


def median_frames(frames: DataFrame, keys: Sequence[str], values: str = "temperatures") -> DataFrame:
    """Per-pixel median frames as arrays; where pixels were split, one frame's pixels meet again."""
    arrays, pixels = _medians(frames, keys, values)
    ordered = F.array_sort(F.collect_list(F.struct("pixel", "t")))
    return arrays.unionByName(pixels.groupBy(*keys).agg(F.transform(ordered, lambda p: p["t"]).alias(values)))


def smooth_frames(frames: DataFrame, width: int, height: int, values: str = "temperatures", out: str = "smoothed") -> DataFrame:
    """3x3 median filter of every frame: all frames of an Arrow batch are filtered at once.

    ``functions.thermal.median3x3`` is the same filter as a pure expression; it
    sorts one pixel window at a time and is some fifty times slower.
    """
    @F.pandas_udf("array<double>")
    def smooth(batch: pd.Series) -> pd.Series:
        stack = np.stack(batch.to_numpy()).reshape(len(batch), height, width)
        return pd.Series(list(median_windows(stack).reshape(len(batch), -1)))

    ok = F.size(values) == width * height
    return frames.withColumn(out, F.when(ok, smooth(F.when(ok, F.col(values)).otherwise(
        F.array_repeat(F.lit(0.0), width * height)))))


def median_windows(stack: np.ndarray) -> np.ndarray:
    """Median over the 3x3 neighbourhood of every pixel of (frames, height, width); edges use what is there."""
    height, width = stack.shape[1:]
    padded = np.pad(stack, ((0, 0), (1, 1), (1, 1)), constant_values=np.inf)
    windows = np.sort(np.stack([padded[:, y:y + height, x:x + width] for y in range(3) for x in range(3)]), axis=0)
    rows = 3 - (np.arange(height) == 0).astype(int) - (np.arange(height) == height - 1)
    cols = 3 - (np.arange(width) == 0).astype(int) - (np.arange(width) == width - 1)
    size = np.broadcast_to(rows[:, None] * cols[None, :], stack.shape)[None]
    low, high = np.take_along_axis(windows, (size - 1) // 2, 0)[0], np.take_along_axis(windows, size // 2, 0)[0]
    return (low + high) / 2


def missed_slots(
    samples: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str], interval: float,
    slice_seconds: int = 86_400,
) -> DataFrame:
    """Sampling slots skipped before every sample: ceil(late / interval)."""
    seconds = samples.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6))
    lagged = previous_value(
        seconds, keys, [ts, *tiebreak], "_s", "_prev",
        slice_by=F.floor(F.col("_s") / slice_seconds),
    )
    late = F.col("_s") - F.col("_prev") - F.lit(float(interval))
    missed = F.when(late > 0, F.ceil(late / float(interval))).otherwise(F.lit(0)).cast("bigint")
    return lagged.withColumn("missed_slots", missed).drop("_s", "_prev")


# --- asymmetric exponential display bounds -------------------------------------------------
#
# One step of the lower bound is  l' = min(x, (1-a) l + a x): it drops at once and
# recovers slowly.  Steps of the form  l -> min(c, p l + q)  are closed under
# composition, so a long run folds block by block: every block is reduced to one
# (c, p, q), blocks of blocks likewise, and the carried-in value is handed back
# down.  The upper bound is the same recurrence on negated values.

_BLOCK = 256
#: Range of the order column for each row from which rows are ranked before they are cut into blocks.
_SPARSE = 16


def _block_levels(span: int, block: int) -> int:
    """Levels of blocks so that even the last one holds at most ``block`` entries."""
    levels = 0
    while span // block**levels + 2 > block:
        levels += 1
    return levels


def display_bounds(
    frames: DataFrame, device: str, order: str, low: str, high: str,
    alpha: float = K.DISPLAY_ALPHA, block: int = _BLOCK, levels: int | None = None,
) -> DataFrame:
    """Running display bounds per device over an integer ``order`` column that is unique per device.

    A block holds at most ``block`` rows, blocks of blocks likewise, and there are as many levels as
    the longest device needs, so no device is ever gathered in one place.  If the order is sparse (a
    time in microseconds, say), rows are first ranked by sampled slices; the rank is then the order.
    """
    if levels is None:
        of_device = frames.groupBy(device).agg(F.count(F.lit(1)).alias("n"), (F.max(order) - F.min(order)).cast("bigint").alias("span"))
        longest, span = of_device.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("span"), F.lit(0))).first()
        if span > _SPARSE * longest + block:
            ranked = number_rows(frames, [device], [F.col(order)], "_place", slice_by="sampled")
            out = display_bounds(ranked, device, "_place", low, high, alpha, block, _block_levels(longest, block))
            return out.drop("_place")
        levels = _block_levels(span, block)
    steps = frames.select(
        "*",
        F.struct(
            F.col(low).alias("c"), F.lit(1.0 - alpha).alias("p"), (F.col(low) * alpha).alias("q"),
            (-F.col(high)).alias("nc"), (-F.col(high) * alpha).alias("nq"),
        ).alias("_step"),
    )
    slim = steps.select(device, F.col(order).cast("bigint").alias("_i"), "_step")
    carried = _carry_in(slim, device, block, levels)
    out = steps.join(
        carried, (steps[device] == carried["_device"]) & (steps[order].cast("bigint") == carried["_i"])
    )
    lower, upper = F.col("_in.l"), -F.col("_in.n")
    x, y = F.col(low), F.col(high)
    return out.select(
        *[steps[c] for c in frames.columns],
        F.when(x < lower, x).otherwise(F.when(lower == float("inf"), x).otherwise(lower * (1 - alpha) + x * alpha)).alias("display_low"),
        F.when(y > upper, y).otherwise(F.when(upper == float("-inf"), y).otherwise(upper * (1 - alpha) + y * alpha)).alias("display_high"),
    )


def _compose(first: Column, then: Column) -> Column:
    return F.struct(
        F.least(then["c"], then["p"] * first["c"] + then["q"]).alias("c"),
        (first["p"] * then["p"]).alias("p"),
        (then["p"] * first["q"] + then["q"]).alias("q"),
        F.least(then["nc"], then["p"] * first["nc"] + then["nq"]).alias("nc"),
        (then["p"] * first["nq"] + then["nq"]).alias("nq"),
    )


_INF = float("inf")


def _carry_in(steps: DataFrame, device: str, block: int, levels: int) -> DataFrame:
    """(device, _i, _step) -> (_device, _i, _in): the bound values before each step."""
    entry = F.struct(F.col("_i").alias("i"), F.col("_step").alias("s"))
    key = F.floor(F.col("_i") / block).cast("bigint") if levels > 0 else F.lit(0).cast("bigint")
    blocks = steps.groupBy(F.col(device).alias("_device"), key.alias("_b")).agg(
        F.array_sort(F.collect_list(entry)).alias("_items")
    )
    start = F.struct(F.lit(_INF).alias("l"), F.lit(_INF).alias("n"))
    if levels > 0:
        whole = F.aggregate(
            F.slice(F.col("_items"), 2, F.size("_items")), F.get(F.col("_items"), F.lit(0))["s"],
            lambda acc, item: _compose(acc, item["s"]),
        )
        above = blocks.select(F.col("_device").alias(device), F.col("_b").alias("_i"), whole.alias("_step"))
        carried = _carry_in(above, device, block, levels - 1).withColumnRenamed("_i", "_b")
        blocks = blocks.join(carried, ["_device", "_b"])
        start = F.col("_in")
    first = F.struct(start.alias("v"), F.array().cast("array<struct<i:bigint,v:struct<l:double,n:double>>>").alias("out"))
    folded = F.aggregate(
        F.col("_items"), first,
        lambda acc, item: F.struct(
            F.struct(
                F.least(item["s"]["c"], item["s"]["p"] * acc["v"]["l"] + item["s"]["q"]).alias("l"),
                F.least(item["s"]["nc"], item["s"]["p"] * acc["v"]["n"] + item["s"]["nq"]).alias("n"),
            ).alias("v"),
            F.concat(acc["out"], F.array(F.struct(item["i"].alias("i"), acc["v"].alias("v")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return blocks.select("_device", F.explode(folded).alias("_o")).select(
        "_device", F.col("_o.i").alias("_i"), F.col("_o.v").alias("_in")
    )
