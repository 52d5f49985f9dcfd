"""Building blocks that stay even when one key holds a large share of the rows.

The rules behind them:

* "first row per key" is an aggregate (partial on the map side), never a window;
* joining a per-key table back to the rows never shuffles the rows of a hot key
  to one reducer: the few hot keys are joined apart and their rows are spread;
* ordinals, lags and running folds of a hot key are computed per slice of its
  order column and stitched with one small row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows from which a key counts as hot.
HOT_ROWS = 200_000
#: Slices that a sampled order is cut into, and sampled rows for each.
SLICES = 256
SAMPLED = 64
#: Reducer share a hot key is spread over.
SPREAD = 512


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """The first row of every key in ``order`` (optionally with the key's row count)."""
    keep = [c for c in (values if values is not None else df.columns) if c not in keys]
    rank = F.struct(*[_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    aggs = [F.min_by(F.struct(*keep), rank).alias("_first")] if keep else []
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    picked = [F.col(f"_first.{c}").alias(c) for c in keep]
    return out.select(*keys, *picked, *([count] if count else []))


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The side with a broadcast hint if it has no more rows than that, else as it is.

    Meant for configuration tables that are joined on few distinct values: the check reads one row
    more than the bound at most, and beyond it Spark joins by shuffle.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def spread_join(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], count: str,
    how: str = "left", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a one-row-per-key table to rows without piling a hot key on one reducer.

    ``per_key`` carries the number of rows of its key in ``count``.  Keys with
    ``hot_rows`` rows or more number at most total / hot_rows, so their side is
    tiny; Spark picks a broadcast for it from its real size.  Their rows then
    take part in the second join under a spread key that matches nothing.
    """
    keys = list(keys)
    payload = [c for c in per_key.columns if c not in keys]
    hot = per_key.where(F.col(count) >= hot_rows).select(
        *keys, F.struct(*payload).alias("_hot")
    )
    cold = per_key.where(F.col(count) < hot_rows).select(
        *keys, F.lit(-1).alias("_spread"), F.struct(*payload).alias("_cold")
    )
    lane = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(rows)]), F.lit(SPREAD)).cast("int")
    apart = F.col("_hot").isNotNull()
    for key in keys:  # null keys match nothing either: spread them too
        apart = apart | F.col(key).isNull()
    tagged = rows.join(hot, keys, "left").withColumn(
        "_spread", F.when(apart, lane).otherwise(F.lit(-1))
    )
    joined = tagged.join(cold, [*keys, "_spread"], "left")
    match = F.coalesce("_hot", "_cold")
    out = joined.withColumn("_match", match)
    if how == "inner":
        out = out.where(F.col("_match").isNotNull())
    return out.select(*rows.columns, *[F.col(f"_match.{c}").alias(c) for c in payload])


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]


def sampled_slices(df: DataFrame, order: Sequence[Column | str], slices: int = SLICES) -> Column:
    """Number of the slice of a row in ``order``: slices hold about equal numbers of rows.

    Their bounds are taken from a sample of ``SAMPLED`` rows for each slice on average and stand in
    the plan as literals, so every use of the expression cuts alike.  Ties in the first columns are
    told apart by the later ones.
    """
    order = [_col(o) for o in order]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = df.select(key.alias("_o"))
    kinds = keyed.schema["_o"].dataType.fields
    rows = keyed.count()
    wanted = slices * SAMPLED
    sample = keyed if rows <= wanted else keyed.sample(False, wanted / rows, 7)
    found = [r["_o"] for r in sample.sort("_o").collect()]
    count = min(slices, len(found) // SAMPLED + 1)
    bounds = []
    for i in range(1, count):
        bound = found[i * len(found) // count]
        if not bounds or bound != bounds[-1]:
            bounds.append(bound)

    def cut(low: int, high: int) -> Column:
        """How many of the bounds are not above the row, among those from ``low`` to ``high``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        literal = F.struct(*[F.lit(v).cast(k.dataType).alias(k.name) for v, k in zip(bounds[middle], kinds, strict=True)])
        return F.when(key < literal, cut(low, middle)).otherwise(cut(middle + 1, high))

    return cut(0, len(bounds))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str,
    slice_by: Column | str | None = None, start: int = 0,
) -> DataFrame:
    """Ordinal of a row inside its key; without keys, its rank among all rows.

    With ``slice_by`` (an expression that never decreases along ``order``) each
    slice is numbered apart and shifted by the row count of the slices before.
    ``"sampled"`` cuts the slices by a sample of the rows, whatever the columns of the order.
    """
    order = [_col(o) for o in order]
    if isinstance(slice_by, str):
        slice_by = sampled_slices(df, order)
    if slice_by is None:
        window = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window) - 1 + start)
    sliced = df.withColumn("_slice", slice_by)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_rank", F.row_number().over(inside) - 1 + start)
    out = numbered.join(offsets.drop("_n"), [*keys, "_slice"])
    return out.withColumn(name, F.col("_rank") + F.col("_base")).drop("_slice", "_rank", "_base")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, slice_by: Column,
) -> DataFrame:
    """``lag(value)`` per key, computed per slice; a slice's first row looks into the last one before."""
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    lagged = sliced.withColumn("_lag", F.lag(value).over(inside)).withColumn(
        "_head", F.row_number().over(inside) == 1
    )
    rank = F.struct(*[F.col(o) for o in order])
    tails = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, rank).alias("_tail"))
    carried = tails.withColumn(
        "_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_slice"))
    ).drop("_tail")
    out = lagged.join(carried, [*keys, "_slice"], "left")
    return out.withColumn(name, F.when(F.col("_head"), F.col("_carry")).otherwise(F.col("_lag"))).drop(
        "_slice", "_lag", "_head", "_carry"
    )


def global_rank(df: DataFrame, digest: str, name: str, total: str, digits: int = 4) -> DataFrame:
    """1-based rank of every row by a hex digest, and the row total, without a global sort.

    The leading hex digits split the rows in 16^digits equal buckets; one row
    per bucket carries the count of the buckets before it (65,536 rows at most
    with four digits, whatever the input size).
    """
    bucket = F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = W.partitionBy("_bucket").orderBy(digest)
    ranked = tagged.withColumn("_rank", F.row_number().over(inside))
    out = ranked.join(offsets, "_bucket")
    return out.withColumn(name, F.col("_rank") + F.col("_base")).drop("_bucket", "_rank", "_base")
