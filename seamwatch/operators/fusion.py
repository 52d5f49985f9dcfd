"""Fusion of the detections of several frames into objects.

The association is greedy and order-dependent: a detection joins the cluster of
its type and class whose most confident box overlaps best, otherwise it opens a
cluster.  Every (capture, type, class) is folded in frame order, holding one box per
open cluster; a grid names the clusters a box may touch where many are open.  Boxes that
cannot touch, directly or through others, never influence each other, so hot groups
are first cut into stripes and those into islands, each folded by itself.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamwatch import constants as K
from seamwatch.operators.voting import angle_medoid, majority_vote, pointer_verdicts
from seamwatch.skew import HOT_ROWS

_GROUP = ("type", "class_id")
#: Buckets that groups are counted in before the groups of heavy buckets are counted apart.
_BUCKETS = 1 << 16
#: Open clusters that a box is compared with one by one; a grid serves more. Cells that a box stands in at most.
_FEW, _CELLS = 32, 64


def _islands(df: DataFrame, keys: list[str], low: str, high: str, name: str) -> DataFrame:
    """Number maximal runs of overlapping intervals inside a key."""
    ordered = W.partitionBy(*keys).orderBy(F.col(f"bbox.{low}"))
    reach = F.max(F.col(f"bbox.{high}")).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    starts = df.withColumn("_gap", F.when(reach.isNull() | (F.col(f"bbox.{low}") >= reach), 1).otherwise(0))
    return starts.withColumn(name, F.sum("_gap").over(ordered.rowsBetween(W.unboundedPreceding, 0))).drop("_gap")


def assign_clusters(
    detections: DataFrame, key: str = "capture_id", order: Sequence[str] = ("frame_index", "pos"),
    threshold: float = K.FUSION_IOU, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Detections with ``cluster``: the position (inside the capture's order) of the cluster's first member.

    Input columns: key, order columns (unique per key), type, class_id, bbox,
    confidence and anything else.  One shuffle on the group and one sort serve
    the fold; only hot (key, type, class) groups are cut in stripes and islands.
    """
    group = [key, *_GROUP]
    hot = F.broadcast(_hot_groups(detections, group, hot_rows))
    cold = detections.join(hot, _same(group, "_hot_"), "left_anti").repartition(*group)
    cold = cold.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).withColumn("cluster", F.struct(*order))
    cold = cold.sortWithinPartitions(*group, *order)
    keys = [*group, "_stripe"]
    crowded = detections.join(hot, _same(group, "_hot_"), "left_semi")
    cut = _islands(_stripes(crowded, group).repartition(*keys), keys, "x1", "x2", "_ix")
    cut = _islands(cut, [*keys, "_ix"], "y1", "y2", "_iy")
    island = W.partitionBy(*keys, "_ix", "_iy")
    cut = cut.withColumn("_rank", F.row_number().over(island.orderBy(*order))).withColumn("cluster", F.struct(*order))
    cut = cut.sortWithinPartitions(*keys, "_ix", "_iy", *order).drop("_stripe", "_ix", "_iy")
    return cold.mapInArrow(_fold(threshold), _closed(cold.schema)).unionByName(
        cut.mapInArrow(_fold(threshold), _closed(cut.schema))).drop("_rank")


def _same(group: list[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in group]


def _hot_groups(df: DataFrame, group: list[str], hot_rows: int) -> DataFrame:
    """Groups of ``hot_rows`` rows or more, rows / hot_rows of them at most; only rows of as heavy buckets are shuffled."""
    bucketed = df.select(*group, F.pmod(F.xxhash64(*group), F.lit(_BUCKETS)).alias("_bucket"))
    heavy = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).select("_bucket")
    sizes = bucketed.join(F.broadcast(heavy), "_bucket", "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") >= hot_rows).select(*[F.col(c).alias(f"_hot_{c}") for c in group])


def _stripes(df: DataFrame, group: list[str], cell: float = 64.0) -> DataFrame:
    """Number independent vertical stripes of (hot) groups.

    A box covers cells of ``cell`` pixels and ties each to the next; cells of a
    group that are not tied start a new stripe.  The cells are aggregated on
    the map side, so a hot group contributes a few rows per image width.
    """
    first, last = (F.floor(F.col(f"bbox.{s}") / cell) for s in ("x1", "x2"))
    covered = df.select(*group, F.explode(F.sequence(first, last)).alias("_cell"), last.alias("_last"))
    tied = covered.groupBy(*group, "_cell").agg(F.max(F.col("_cell") < F.col("_last")).alias("_tie"))
    row = W.partitionBy(*group).orderBy("_cell")
    new = F.when(F.coalesce(F.lag("_tie").over(row), F.lit(False)), 0).otherwise(1)
    numbered = tied.withColumn("_new", new).withColumn(
        "_number", F.sum("_new").over(row.rowsBetween(W.unboundedPreceding, 0))
    ).select(*[F.col(c).alias(f"_in_{c}") for c in group], F.col("_cell").alias("_in_cell"), "_number")
    tagged = df.withColumn("_cell", first).join(numbered, [*_same(group, "_in_"), F.col("_cell") == F.col("_in_cell")], "left")
    return tagged.select(*df.columns, F.coalesce("_number", F.lit(0)).alias("_stripe"))


def _closed(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _fold(threshold: float):
    """Fold the sorted groups or islands of a partition; each begins at rank 1 and may run over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, grid, carried = [], None, None  # clusters: [x1, y1, x2, y2, confidence, row of the first member]
        for batch in batches:
            firsts = batch.column("cluster")
            rows = batch.num_rows
            if carried is not None:
                firsts = pa.concat_arrays([firsts, carried])
                for place, cluster in enumerate(clusters):
                    cluster[5] = rows + place
            member = np.arange(rows)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            shared = np.flatnonzero((rank > 1) | np.append(rank[1:] > 1, True))  # all but rows that are alone
            sides = [pc.struct_field(batch.column("bbox"), s).to_numpy(zero_copy_only=False) for s in ("x1", "y1", "x2", "y2")]
            scores = batch.column("confidence").to_numpy(zero_copy_only=False)
            values = zip(shared.tolist(), rank[shared].tolist(), *(v[shared].tolist() for v in (*sides, scores)))
            for row, place, *box, confidence in values:
                if place == 1:
                    clusters, grid = [], None
                if grid is None and len(clusters) > _FEW:
                    grid = _Grid(clusters)
                member[row] = _join_cluster(clusters, box, confidence, row, threshold, grid)
            position = batch.schema.get_field_index("cluster")
            yield batch.set_column(position, batch.schema.field(position), firsts.take(pa.array(member)))
            carried = firsts.take(pa.array([c[5] for c in clusters], pa.int64())) if clusters else None

    return run


class _Grid:
    """Cells of the image with the numbers of the clusters whose boxes stand in them."""

    def __init__(self, clusters: list[list]):
        sides = [max(c[2] - c[0], c[3] - c[1]) for c in clusters]
        self.size = median([s for s in sides if 0 < s < math.inf] or [1.0])
        self.clusters, self.cells, self.wide = clusters, defaultdict(set), set()
        for number, cluster in enumerate(clusters):
            self.add(number, cluster)

    def _covered(self, box: Sequence[float]) -> list[tuple[int, int]] | None:
        """Cells of a box; None if they are too many. A box without a finite area touches nothing and has none."""
        if not all(map(math.isfinite, box[:4])) or box[2] <= box[0] or box[3] <= box[1]:
            return []
        x1, y1, x2, y2 = (math.floor(v / self.size) for v in box[:4])
        if (x2 - x1 + 1) * (y2 - y1 + 1) > _CELLS:
            return None
        return [(x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)]

    def add(self, number: int, box: Sequence[float]) -> None:
        covered = self._covered(box)
        for bucket in [self.wide] if covered is None else [self.cells[c] for c in covered]:
            bucket.add(number)

    def remove(self, number: int, box: Sequence[float]) -> None:
        covered = self._covered(box)
        for bucket in [self.wide] if covered is None else [self.cells[c] for c in covered]:
            bucket.discard(number)

    def near(self, box: Sequence[float]) -> list[int]:
        """Numbers of the clusters that the box may touch, in the order they were opened."""
        covered = self._covered(box)
        if covered is None:
            return list(range(len(self.clusters)))
        return sorted(self.wide.union(*[self.cells[c] for c in covered if c in self.cells])) if covered else []


def _join_cluster(clusters: list[list], box: list[float], confidence: float, row: int, threshold: float, grid: _Grid | None = None) -> int:
    """Row of the first member of the cluster the box joins or opens."""
    x1, y1, x2, y2 = box
    best, best_iou = None, 0.0
    for number in range(len(clusters)) if grid is None else grid.near(box):
        cluster = clusters[number]
        width = min(cluster[2], x2) - max(cluster[0], x1)
        height = min(cluster[3], y2) - max(cluster[1], y1)
        if width <= 0 or height <= 0:
            continue
        shared = width * height
        own = (cluster[2] - cluster[0]) * (cluster[3] - cluster[1])
        overlap = shared / (own + (x2 - x1) * (y2 - y1) - shared)
        if overlap >= threshold and overlap > best_iou:
            best, best_iou = number, overlap
    if best is None:
        clusters.append([x1, y1, x2, y2, confidence, row])
        if grid is not None:
            grid.add(len(clusters) - 1, box)
        return row
    if confidence > clusters[best][4]:
        if grid is not None:
            grid.remove(best, clusters[best])
            grid.add(best, box)
        clusters[best][:5] = [x1, y1, x2, y2, confidence]
    return clusters[best][5]


def fused_objects(
    clustered: DataFrame, key: str = "capture_id", order: Sequence[str] = ("frame_index", "pos"), frame: str = "frame_index",
) -> DataFrame:
    """One row per cluster: its first most confident detection and the number of frames it was seen in."""
    keys = [key, *_GROUP, "cluster"]
    keep = [c for c in clustered.columns if c not in (*keys, *order)]
    ranked = F.struct(-F.col("confidence"), *[F.col(o) for o in order])
    # members of a cluster leave one task of the fold, so one shuffle on the cluster serves both aggregates
    per_frame = clustered.repartition(*keys).groupBy(*keys, frame).agg(F.min_by(F.struct(*keep), ranked).alias("_r"), F.min(ranked).alias("_k"))
    fused = per_frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.min_by("_r", "_k").alias("_b"))
    return fused.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep], "observations")


def strip_private(attributes: Column) -> Column:
    """Attributes without the keys that start with an underscore."""
    return F.map_filter(attributes, lambda k, v: ~k.startswith("_"))


def ordered_objects(fused: DataFrame, key: str = "capture_id") -> DataFrame:
    """Objects of a capture by falling confidence; equal ones in cluster order."""
    return fused.orderBy(key, *object_order())


def object_order() -> list[Column]:
    return [F.desc("confidence"), F.asc("cluster"), *[F.asc(g) for g in _GROUP]]


def cluster_meter_votes(clustered: DataFrame, key: str = "capture_id", order: Sequence[str] = ("frame_index", "pos"), text: str = "digital_text") -> DataFrame:
    """Voted reading of every digital-meter cluster (two votes needed from two members on)."""
    meters = clustered.where(F.col("type") == "digital_meter")
    return majority_vote(meters, [key, *_GROUP, "cluster"], order, text, min_agreement=None)


def cluster_pointer_status(
    clustered: DataFrame, references: DataFrame, key: str = "capture_id", order: Sequence[str] = ("frame_index", "pos"),
) -> DataFrame:
    """Pointer verdict of every analog-meter cluster.

    ``clustered`` has pointer_angle and pointer_confidence; ``references`` has
    the cluster keys with normal_angle_deg, tolerance_deg, min_confidence
    (nulls or a missing row mean that no reference is configured).
    """
    keys = [key, *_GROUP, "cluster"]
    meters = clustered.where(F.col("type") == "analog_meter")
    owners = meters.select(*keys).distinct()
    medoids = angle_medoid(
        meters.withColumn("pointer_confidence", F.coalesce("pointer_confidence", F.lit(0.0))),
        keys, order, "pointer_angle", "pointer_confidence",
    )
    joined = owners.join(references, keys, "left").join(medoids, keys, "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )
    judged = pointer_verdicts(
        joined, F.col("normal_angle_deg"), F.col("tolerance_deg"),
        F.coalesce(F.col("min_confidence"), F.lit(K.POINTER_MIN_CONFIDENCE)),
    )
    known = F.col("normal_angle_deg").isNotNull()
    return judged.select(
        *keys,
        F.when(known, F.col("status")).otherwise("uncertain").alias("status"),
        F.when(known, F.col("confidence")).otherwise(F.lit(0.0)).alias("meter_confidence"),
        *[F.when(known, F.col(c)).alias(c) for c in ("angle_deg", "reference_angle_deg", "delta_deg")],
        F.when(known, F.col("reason")).otherwise("analog_reference_missing").alias("reason"),
    )
