"""Dataset curation: duplicate flags, leak-free splits, labels, crops and their reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch.functions import geometry as G
from seamwatch.functions.core import compute_once, let
from seamwatch.functions.hashing import sha256
from seamwatch.functions.text import split_group_key, unique_sample_name
from seamwatch.skew import global_rank, small_side, spread_join


# --- duplicates -----------------------------------------------------------------------------------

def duplicate_flags(records: DataFrame, path: str = "relative_path", exact: str = "sha256", near: str = "perceptual_hash") -> DataFrame:
    """Adds exact_duplicate and near_duplicate (never both).

    In the order of the lower-cased path, a row whose content was seen before
    is an exact duplicate; otherwise a row whose perceptual hash was seen
    before is a near duplicate.  The owner of a hash is an aggregate; only
    hashes that occur more than once are joined back, hot ones spread.
    """
    place = F.struct(F.lower(F.col(path)).alias("l"), F.col(path).alias("p"))

    def owners(column: str, name: str) -> DataFrame:
        sizes = records.where(F.col(column).isNotNull()).groupBy(column).agg(
            F.min(place).alias(f"_{name}_owner"), F.count(F.lit(1)).alias(f"_{name}_rows")
        )
        return sizes.where(F.col(f"_{name}_rows") > 1)

    flagged = spread_join(records, owners(exact, "x"), [exact], "_x_rows")
    flagged = flagged.withColumn("exact_duplicate", F.coalesce(place != F.col("_x_owner"), F.lit(False)))
    flagged = flagged.drop("_x_owner", "_x_rows")
    flagged = spread_join(flagged, owners(near, "n"), [near], "_n_rows")
    later = F.coalesce(place != F.col("_n_owner"), F.lit(False))
    return flagged.withColumn("near_duplicate", later & ~F.col("exact_duplicate")).drop("_n_owner", "_n_rows")


# --- splits -------------------------------------------------------------------------------------------

def allocate_counts(total: Column, ratios: Mapping[str, float] | None = None) -> Column:
    """Largest-remainder allocation of ``total`` groups as struct<train,val,test>.

    Every split with a positive ratio gets at least one group when there are
    enough groups; the largest split with more than one gives it away.
    """
    ratios = dict(ratios or K.SPLIT_RATIOS)
    if set(ratios) != set(K.SPLITS):
        raise ValueError("ratios must contain train, val and test")
    if min(ratios.values()) < 0 or sum(ratios.values()) <= 0:
        raise ValueError("split ratios cannot be negative and need a positive sum")
    whole = float(sum(ratios.values()))
    share = {name: float(ratios[name]) / whole for name in K.SPLITS}
    raw = {n: F.lit(share[n]) * total for n in K.SPLITS}
    base = {n: F.floor(raw[n]).cast("bigint") for n in K.SPLITS}
    left = total - sum((base[n] for n in K.SPLITS), F.lit(0))
    rest = {n: raw[n] - base[n] for n in K.SPLITS}

    def ahead(a: str, b: str) -> Column:
        """Whether split ``a`` is served before ``b`` (remainder, then ratio, then name order)."""
        tie = share[a] > share[b] or (share[a] == share[b] and K.SPLITS.index(a) < K.SPLITS.index(b))
        return (rest[a] > rest[b]) | ((rest[a] == rest[b]) & F.lit(tie))

    rank = {n: sum((ahead(o, n).cast("int") for o in K.SPLITS if o != n), F.lit(0)) for n in K.SPLITS}
    counts = F.array(*[base[n] + (rank[n] < left).cast("int") for n in K.SPLITS])
    positive = [i for i, n in enumerate(K.SPLITS) if share[n] > 0]

    def repaired(state: Column, missing: int) -> Column:
        richest = F.array_max(F.array(*[F.get(state, F.lit(i)) for i in positive]))
        needed = (F.get(state, F.lit(missing)) == 0) & (total >= len(positive)) & (richest > 1)

        def move(donor: Column) -> Column:
            return F.transform(state, lambda c, i: c - (i == donor).cast("int") + (i == missing).cast("int"))

        return F.when(needed, let(F.array_position(state, richest) - 1, move)).otherwise(state)

    def repair_step(missing: int):
        return lambda state: repaired(state, missing)

    for index in positive:
        counts = let(counts, repair_step(index))
    return let(counts, lambda c: F.struct(*[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(K.SPLITS)]))


def assign_splits(
    records: DataFrame, ratios: Mapping[str, float] | None = None, seed: str = K.SPLIT_SEED,
    batch: str = "batch_id", capture: str = "capture_id",
) -> DataFrame:
    """Adds split: whole groups go to train, val or test in the order of sha256(seed|group).

    Ranking the groups is distributed (hash buckets plus bucket offsets); the
    assignment travels back to the records with hot groups spread.
    """
    keyed = records.withColumn("_group", split_group_key(F.col(batch).cast("string"), F.col(capture).cast("string")))
    groups = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    hashed = groups.withColumn("_digest", sha256(F.concat(F.lit(f"{seed}|"), F.col("_group"))))
    ranked = global_rank(hashed, "_digest", "_position", "_total")
    ranked = compute_once(ranked, _share=allocate_counts(F.col("_total"), ratios))
    share = F.col("_share")
    split = F.when(F.col("_position") <= share["train"], "train").when(
        F.col("_position") <= share["train"] + share["val"], "val"
    ).otherwise("test")
    table = ranked.select("_group", "_rows", split.alias("split"))
    base = keyed.drop("split") if "split" in keyed.columns else keyed
    return spread_join(base, table, ["_group"], "_rows").drop("_group", "_rows")


# --- summaries --------------------------------------------------------------------------------------------

def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count(F.lit(1)).alias("images"))


def _all_splits(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(s,) for s in K.SPLITS], "split string")


def empty_splits(records: DataFrame) -> DataFrame:
    """Expected splits without any record."""
    present = split_counts(records).select("split")
    return _all_splits(records).exceptAll(present)


def flag_counts(records: DataFrame, flags: str = "qc_flags") -> DataFrame:
    return records.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("images"))


def odd_captures(records: DataFrame, frames: int = 3, key: str = "capture_id") -> DataFrame:
    """Captures that do not have exactly ``frames`` images."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("frames")).where(F.col("frames") != frames)


def dataset_totals(records: DataFrame, key: str = "capture_id") -> DataFrame:
    """Images and captures in total (captures are merged before they are counted)."""
    per_capture = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_capture.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("images_total"), F.count(F.lit(1)).alias("captures_total")
    )


def quality_issues(records: DataFrame) -> DataFrame:
    """Rows with at least one flag, flags joined by a pipe."""
    return records.where(F.size("qc_flags") > 0).select(
        "relative_path", "capture_id", "batch_id", "split", F.array_join("qc_flags", "|").alias("qc_flags")
    )


def label_matrix(manifest: DataFrame, label: str = "station_number", values: Sequence | None = None) -> DataFrame:
    """Split x label counts with positives, negatives (no label) and manual annotations."""
    totals = manifest.groupBy("split").agg(
        F.count_if(F.col(label).isNotNull()).alias("positives"),
        F.count_if(F.col(label).isNull()).alias("negatives"),
        F.count_if(F.col("annotation_source") == "manual").alias("manual"),
        *[F.count_if(F.col(label) == v).alias(f"label_{v}") for v in (values or K.ALLOWED_STATIONS)],
    )
    return totals


def split_overlap(val: DataFrame, test: DataFrame) -> DataFrame:
    """Keys configured for both val and test; must be empty."""
    return val.intersect(test)


def unknown_split_keys(configured: DataFrame, known: DataFrame) -> DataFrame:
    """Configured keys that no sample has; must be empty."""
    return configured.subtract(known)


def configured_split(samples: DataFrame, val: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Split from the configured key lists; everything else is train."""
    v = val.select(F.col(key), F.lit("val").alias("_v")).dropDuplicates([key])
    t = test.select(F.col(key), F.lit("test").alias("_t")).dropDuplicates([key])
    out = samples.join(v, key, "left").join(t, key, "left")
    return out.withColumn("split", F.coalesce("_v", "_t", F.lit("train"))).drop("_v", "_t")


# --- labels -------------------------------------------------------------------------------------------------

def annotation_rows(
    boxes: DataFrame, classes: DataFrame, width: str = "width", height: str = "height", label: str = "class",
) -> DataFrame:
    """Boxes with outcome kept / ignored / unknown / invalid and the label line of kept ones.

    ``classes``: class, class_index (null when the class is known but not trained).
    """
    table = classes.select(F.col("class").alias(label), "class_index", F.lit(True).alias("_known"))
    joined = compute_once(
        boxes.join(small_side(table), label, "left"),
        _line=G.label_line(F.col("class_index"), F.col("bbox"), F.col(width), F.col(height)),
    )
    outcome = (
        F.when(F.col("_known").isNull(), "unknown").when(F.col("class_index").isNull(), "ignored")
        .when(~G.is_valid_box(F.col("bbox")) | F.col("_line").isNull(), "invalid").otherwise("kept")
    )
    return compute_once(joined, outcome=outcome).withColumn(
        "line", F.when(F.col("outcome") == "kept", F.col("_line"))
    ).drop("_known", "_line")


def class_counts(rows: DataFrame, classes: DataFrame, label: str = "class") -> DataFrame:
    """Kept and ignored boxes per configured class, zero-filled."""
    counts = rows.groupBy(label).agg(
        F.count_if(F.col("outcome") == "kept").alias("kept"), F.count_if(F.col("outcome") == "ignored").alias("ignored")
    )
    return classes.select(F.col("class").alias(label)).join(counts, label, "left").fillna(0, ["kept", "ignored"])


def label_texts(rows: DataFrame, images: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Label text per image: kept lines in box order, each with its newline; empty without kept boxes.

    The text is one value, so an image's lines meet in one row, however many they are.
    """
    kept = rows.where(F.col("outcome") == "kept")
    lines = F.array_sort(F.collect_list(F.struct(*order, "line")))
    texts = kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda s: F.concat(s["line"], F.lit("\n"))), "").alias("text"))
    return images.join(texts, key, "left").select(*images.columns, F.coalesce("text", F.lit("")).alias("text"))


SPLITS = ("train", "val", "test")


def dataset_images(records: DataFrame, there: Column, labelled: Column, split: str = "split", width: str = "width", height: str = "height") -> DataFrame:
    """Records with their part in a training set, as ``outcome``.

    ``missing`` (the image is not there), ``invalid_split`` (none of train, val, test) and, for a
    labelled image, ``missing_size`` are violations; ``skipped`` images have no labels; the others are
    ``converted``.  The first that holds counts, in this order.
    """
    def no(flag: Column) -> Column:
        return ~F.coalesce(flag, F.lit(False))

    outcome = (
        F.when(no(there), "missing").when(no(F.col(split).isin(*SPLITS)), "invalid_split").when(no(labelled), "skipped")
        .when(no((F.col(width) > 0) & (F.col(height) > 0)), "missing_size").otherwise("converted")
    )
    return records.withColumn("outcome", outcome)


def dataset_summary(images: DataFrame, split: str = "split") -> DataFrame:
    """(part, name, images): images converted and skipped, converted ones by split, violations by kind; splits without images count 0."""
    def row(part: str, name: str, flag: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.count_if(flag).alias("images"))

    outcome = F.col("outcome")
    rows = [row("images", "converted", outcome == "converted"), row("images", "skipped_unlabelled", outcome == "skipped")]
    rows += [row("split", s, (outcome == "converted") & (F.col(split) == s)) for s in SPLITS]
    rows += [row("violation", v, outcome == v) for v in ("missing", "invalid_split", "missing_size")]
    return images.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def sample_names(records: DataFrame) -> Column:
    return unique_sample_name(F.col("capture_id"), F.col("path"), F.col("sha256"))


# --- marker dataset and crops ---------------------------------------------------------------------------------

def largest_boxes(boxes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Box with the largest area per image, the first one on ties."""
    rank = F.struct(-G.area(F.col("bbox")), *[F.col(o) for o in order])
    return boxes.groupBy(*keys).agg(F.min_by("bbox", rank).alias("bbox"), F.count(F.lit(1)).alias("boxes"))


def match_annotations(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Samples with the annotation of the same content hash.

    ``annotations`` is unique per sha256 (checked by a uniqueness query).  A
    missing match and a differing label are reported in columns.
    """
    notes = annotations.select(F.lower("sha256").alias("sha256"), *[c for c in annotations.columns if c != "sha256"], F.lit(True).alias("_hit"))
    sizes = samples.groupBy("sha256").agg(F.count(F.lit(1)).alias("_samples"))
    counted = notes.join(sizes, "sha256")
    out = spread_join(samples, counted, ["sha256"], "_samples")
    old = F.col("annotation_label")
    return out.withColumn(
        "error", F.when(F.col("_hit").isNull(), F.lit("no reviewed detector annotation matches"))
    ).withColumn(
        "label_corrected", F.coalesce(old.isNotNull() & (old != F.col("label")), F.lit(False))
    ).drop("_hit", "_samples")


def crop_boxes(matched: DataFrame, fraction: float = K.CROP_PADDING) -> tuple[DataFrame, DataFrame]:
    """(crop rows, skipped rows): expanded box of every matched sample inside its image."""
    inside = G.inside_image(F.col("bbox"), F.col("width"), F.col("height"))
    checked = matched.withColumn(
        "error", F.coalesce("error", F.when(F.col("bbox").isNull(), F.lit("reviewed detector annotation has no box")),
                            F.when(~inside, F.lit("reviewed bbox is outside the image")))
    ).withColumn("crop", G.expand_box(F.col("bbox"), F.col("width"), F.col("height"), fraction))
    good = checked.where(F.col("error").isNull()).drop("error").withColumn(
        "crop_width", F.col("crop.x2") - F.col("crop.x1")
    ).withColumn("crop_height", F.col("crop.y2") - F.col("crop.y1"))
    return good, checked.where(F.col("error").isNotNull())


def marker_manifest(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positive and confirmed-negative samples with aligned columns and area fractions.

    ``bboxes``: array of boxes; negatives carry none.
    """
    both = positives.withColumn("label", F.lit("positive")).unionByName(
        negatives.withColumn("label", F.lit("negative")), allowMissingColumns=True
    )
    boxes = F.coalesce(F.col("bboxes"), F.array().cast(both.schema["bboxes"].dataType))
    fractions = F.transform(boxes, lambda b: G.area_fraction(b, F.col("width"), F.col("height")))
    return both.withColumn("bboxes", boxes).withColumn("bbox_area_fractions", fractions)
