"""File scans: gas tables, thermal frames, photos, packages, manifests and sidecars.

Each scan has a path-based reader and a row-based core, so the same logic runs
on files, on file streams and on tables that already hold the contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamwatch import constants as K
from seamwatch import schemas as S
from seamwatch.functions import geometry as G
from seamwatch.functions import text as X
from seamwatch.functions.core import compute_once
from seamwatch.functions.quality import image_payload_error
from seamwatch.operators.sensors import keep_first_sample
from seamwatch.operators.validate import diagnostics, parse_metadata, path_error
from seamwatch.skew import spread_join

# --- listings --------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Whole files as (path, content); one file is one sensor day or one document."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Binary files as (path, size, content); a listing alone never opens the files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    columns = ["path", F.col("length").alias("size")] + (["content"] if content else [])
    return reader.load(root).select(*columns)


def below(path: Column, root: str) -> Column:
    """Path relative to a root folder (scheme prefixes are dropped)."""
    clean = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    return clean.substr(F.lit(len(root.rstrip("/")) + 2), F.length(clean))


def with_batch(files: DataFrame, inbox: str) -> DataFrame:
    """Split the path below an inbox in batch_id, area (gas/thermal/visible) and relative_path."""
    rel = files.withColumn("_rel", below(F.col("path"), inbox))
    parts = F.split("_rel", "/", 3)
    return rel.withColumn("batch_id", F.get(parts, F.lit(0))).withColumn("area", F.get(parts, F.lit(1))).withColumn(
        "relative_path", F.get(parts, F.lit(2))
    ).drop("_rel").where(F.col("batch_id").rlike(K.BATCH_ID_PATTERN))


def inbox_listing(files: DataFrame) -> DataFrame:
    """Counts per batch: visible items, thermal frames (from :func:`with_batch` rows)."""
    photo = (F.col("area") == "visible") & visible_item(F.col("relative_path")).isNotNull()
    items = files.where(photo).select("batch_id", visible_item(F.col("relative_path")).alias("item")).distinct()
    per_item = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("capture_total"))
    frames = files.groupBy("batch_id").agg(
        F.count_if((F.col("area") == "thermal") & F.lower("relative_path").endswith(".png")).alias("thermal_frame_count")
    )
    return frames.join(per_item, "batch_id", "left").fillna(0, ["capture_total"])


# --- gas tables ----------------------------------------------------------------------------------------

def csv_records(files: DataFrame) -> DataFrame:
    """Records of CSV texts: path columns, header, record, row (2 = first data record).

    Line ends inside quotes belong to the record; a leading BOM is dropped and
    blank records are skipped without taking a number.
    """
    body = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n")
    kept = F.when(~F.contains(body, F.lit('"')), body).otherwise(F.array_join(
        F.transform(F.split(body, '"'), lambda s, i: F.when(i % 2 == 1, F.translate(s, "\n", "\u0001")).otherwise(s)), '"'
    ))
    lines = F.filter(F.split(kept, "\n"), lambda line: line != "")
    others = [c for c in files.columns if c != "content"]
    exploded = files.withColumn("_lines", lines).withColumn("header", F.coalesce(F.get("_lines", F.lit(0)), F.lit("")))
    data = F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))
    return exploded.select(*others, "header", F.posexplode_outer(data).alias("_pos", "_line")).select(
        *others, "header", F.translate("_line", "\u0001", "\n").alias("record"), (F.col("_pos") + 2).cast("bigint").alias("row")
    )


def count_gas_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """Data records per key, headers excluded."""
    return records.groupBy(*keys).agg(F.count("record").alias("gas_rows"))


def _header_is(names: tuple[str, ...]) -> Column:
    return F.translate("header", "\"", "") == ",".join(names)


def normalize_gas(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, diagnostics) from CSV records of either dialect.

    Needs batch_id, path, header, record, row.  A wrong header rejects its
    file once; a bad record is reported and the others are kept.
    """
    en, zh = _header_is(K.GAS_HEADER_EN), _header_is(K.GAS_HEADER_ZH)
    wrong = records.where(~(en | zh)).select("batch_id", "path").distinct()
    bad_files = diagnostics(
        wrong, "gas", "error", F.concat(F.lit("invalid gas CSV header: "), X.portable_name(F.col("path"))), path="path")
    rows = records.where((en | zh) & F.col("record").isNotNull())
    parsed = compute_once(
        rows,
        _en=F.when(en, F.from_csv("record", ", ".join(f"{n} string" for n in K.GAS_HEADER_EN))),
        _zh=F.when(zh, F.from_csv("record", ", ".join(f"`{n}` string" for n in K.GAS_HEADER_ZH))),
    )
    zh_text = F.trim(F.coalesce(F.col("_zh")["状态"], F.lit("")))
    fields = {
        "timestamp": F.coalesce(F.col("_en.timestamp"), F.col("_zh")["时间"]),
        "sample_id": F.coalesce(F.col("_en.sample_id"), F.col("_zh")["编号"]),
        "gas_error": F.when(en, F.col("_en.error")).when(~zh_text.isin("", K.STATUS_OK_ZH), zh_text),
    }
    for channel, name in zip(K.CHANNELS, K.GAS_HEADER_ZH[2:6]):
        fields[f"{channel}_value"] = F.coalesce(F.col(f"_en.{channel}_value"), F.col("_zh")[name])
        fields[f"{channel}_unit"] = F.when(en, F.col(f"_en.{channel}_unit")).otherwise(F.lit(K.GAS_UNITS_ZH[channel]))
        fields[f"{channel}_status"] = F.col(f"_en.{channel}_status")
    flat = compute_once(parsed, **fields).select("batch_id", "path", "row", "_en", "_zh", *fields)
    checked = normalize_gas_fields(flat)
    good = checked.where(F.col("error").isNull()).drop("error")
    failed = diagnostics(checked.where(F.col("error").isNotNull()), "gas", "error", F.col("error"), path="path", row="row")
    kept, later = keep_first_sample(
        good, ["batch_id", "sample_key"], ["path", "row"],
        F.concat(F.lit("duplicate sensor sample: "), F.col("sample_key")))
    repeated = diagnostics(later, "gas", "error", F.col("message"), path="path", row="row", key="sample_key")
    return kept.drop("path", "row"), bad_files.unionByName(failed).unionByName(repeated)


def normalize_gas_fields(flat: DataFrame) -> DataFrame:
    """Typed sample columns and ``error`` from text fields (``_en`` / ``_zh`` are the raw records).

    Shared parts get columns of their own so that every text is parsed once.
    """
    parsed = compute_once(
        flat,
        captured_at=F.trim(F.coalesce("timestamp", F.lit(""))),
        _sample=F.trim(F.coalesce("sample_id", F.lit(""))),
        _wall=X.iso_wall_clock(F.coalesce("timestamp", F.lit(""))),
        **{f"_raw_{c}": X.blank_to_null(F.col(f"{c}_value")) for c in K.CHANNELS},
        **{f"_num_{c}": F.trim(F.col(f"{c}_value")).try_cast("double") for c in K.CHANNELS},
    )
    error = F.when(F.col("_wall").isNull(), F.lit("gas timestamp must be ISO-8601")).when(
        ~F.col("_sample").rlike(r"^\p{Nd}{1,12}$"), F.lit("gas sample_id must be numeric"))
    values = []
    for c in K.CHANNELS:
        raw, number = F.col(f"_raw_{c}"), F.col(f"_num_{c}")
        infinite = F.isnan(number) | (F.abs(number) == float("inf"))
        error = error.when(raw.isNotNull() & number.isNull(), F.lit(f"{c}_value must be numeric or blank"))
        error = error.when(infinite, F.lit(f"{c}_value must be finite"))
        values += [
            F.when(~infinite, number).alias(f"{c}_value"), X.blank_to_null(F.col(f"{c}_unit")).alias(f"{c}_unit"),
            X.blank_to_null(F.col(f"{c}_status")).alias(f"{c}_status"),
        ]
    others = [c for c in flat.columns if c in ("batch_id", "path", "row")]
    return compute_once(parsed, error=error).select(
        *others, X.sample_key(F.col("_wall"), F.col("_sample")).alias("sample_key"), "captured_at",
        X.zero_pad(F.col("_sample")).alias("sample_id"), *values,
        X.blank_to_null(F.col("gas_error")).alias("gas_error"),
        F.coalesce(F.to_json("_en"), F.to_json("_zh")).alias("raw_row_json"), "error",
    )


# --- thermal frames -----------------------------------------------------------------------------------------

def normalize_thermal(files: DataFrame, max_bytes: int = K.MAX_IMAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(samples, diagnostics) from thermal files: batch_id, path, content and optionally decodable."""
    name = X.portable_name(F.col("path"))
    part = [F.regexp_extract(name, K.THERMAL_NAME_PATTERN, i) for i in (1, 2, 3)]
    named = name.rlike(K.THERMAL_NAME_PATTERN)
    key = F.concat_ws("_", *part)
    when = F.concat(
        F.substring(part[0], 1, 4), F.lit("-"), F.substring(part[0], 5, 2), F.lit("-"), F.substring(part[0], 7, 2), F.lit("T"),
        F.substring(part[1], 1, 2), F.lit(":"), F.substring(part[1], 3, 2), F.lit(":"), F.substring(part[1], 5, 2))
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    decodable = F.col("decodable") if "decodable" in files.columns else F.lit(True)
    error = (
        F.when(~named, F.lit("invalid thermal file name")).when(image_payload_error(F.col("content"), max_bytes).isNotNull(), image_payload_error(F.col("content"), max_bytes))
        .when(~png, F.lit("thermal file must be PNG")).when(~decodable, F.lit("thermal file cannot be decoded"))
        .when(X.iso_wall_clock(when).isNull(), F.lit("thermal file name holds no valid time"))
    )
    checked = compute_once(files, error=error)
    good = checked.where(F.col("error").isNull()).select(
        "batch_id", "path", key.alias("sample_key"), part[2].alias("sample_id"), when.alias("captured_at"),
        F.col("path").alias("thermal_stored_path"), F.sha2("content", 256).alias("thermal_sha256"))
    kept, later = keep_first_sample(
        good, ["batch_id", "sample_key"], ["path"], F.concat(F.lit("duplicate thermal sample: "), F.col("sample_key")))
    failed = diagnostics(checked.where(F.col("error").isNotNull()), "thermal", "error", F.col("error"), path="path")
    repeated = diagnostics(later, "thermal", "error", F.col("message"), path="path", key="sample_key")
    return kept.drop("path"), failed.unionByName(repeated)



def mark_decodable(files: DataFrame, images: DataFrame) -> DataFrame:
    """Attach Spark's own decoding verdict (image source: width -1 marks a broken file)."""
    verdict = images.select(F.col("image.origin").alias("path"), (F.col("image.width") > 0).alias("decodable"))
    return files.join(verdict, "path", "left").withColumn("decodable", F.coalesce("decodable", F.lit(False)))


# --- photos and packages --------------------------------------------------------------------------------------

def visible_item(relative_path: Column) -> Column:
    """Item of a file below visible/: its folder for metadata.json, itself for a flat photo, else null."""
    name = X.portable_name(relative_path)
    folder = F.regexp_replace(relative_path, r"/?[^/]*$", "")
    shown = ~X.has_hidden_part(relative_path)
    return F.when(shown & (name == "metadata.json"), folder).when(
        shown & name.rlike(K.PHOTO_NAME_PATTERN), relative_path)


def visible_items(files: DataFrame) -> DataFrame:
    """Distinct items of every batch in path order."""
    found = files.withColumn("item", visible_item(F.col("relative_path"))).where(F.col("item").isNotNull())
    return found.select("batch_id", "item").distinct().orderBy("batch_id", "item")


def load_photos(photos: DataFrame) -> DataFrame:
    """Flat photos -> capture columns plus ``error``: id from the name, time at +08:00, empty station."""
    name = X.portable_name(F.col("relative_path"))
    part = [F.regexp_extract(name, K.PHOTO_NAME_PATTERN, i) for i in (1, 2, 3)]
    time = F.concat(
        F.substring(part[0], 1, 4), F.lit("-"), F.substring(part[0], 5, 2), F.lit("-"), F.substring(part[0], 7, 2), F.lit("T"),
        F.substring(part[1], 1, 2), F.lit(":"), F.substring(part[1], 3, 2), F.lit(":"), F.substring(part[1], 5, 2),
        F.when(part[2] == "000000", "").otherwise(F.concat(F.lit("."), part[2])), F.lit(K.PHOTO_OFFSET))
    error = F.when(~name.rlike(K.PHOTO_NAME_PATTERN), F.lit("invalid flat visible image name"))
    if "content" in photos.columns:
        error = F.coalesce(error, image_payload_error(F.col("content")))
    return photos.select(
        "batch_id", "relative_path", X.stem(F.col("relative_path")).alias("capture_id"), time.alias("capture_time"),
        F.lit("").alias("station_id"), F.lit(K.PHOTO_CAMERA).alias("camera_id"), F.array(name).alias("images"),
        F.coalesce(error, F.when(X.iso_wall_clock(time).isNull(), F.lit("photo name holds no valid time"))).alias("error"))


def load_packages(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Packages (batch_id, relative_path, metadata_json) checked against their image files.

    ``files``: batch_id, relative_path, image_error (null for a usable image).
    Exactly three images must be declared, present and valid.
    """
    parsed = parse_metadata(packages.withColumnRenamed("batch_id", "_batch")).withColumnRenamed("batch_id", "declared_batch")
    parsed = parsed.withColumnRenamed("_batch", "batch_id")
    named = parsed.select("batch_id", "relative_path", F.posexplode("images").alias("_pos", "_name")).withColumn(
        "_file", F.concat_ws("/", "relative_path", F.translate("_name", "\\", "/")))
    listing = files.select("batch_id", F.col("relative_path").alias("_file"), F.lit(True).alias("_there"), "image_error")
    joined = named.join(listing, ["batch_id", "_file"], "left")
    problem = F.coalesce(
        path_error(F.col("_name"), "image path"),
        F.when(F.col("_there").isNull(), F.concat(F.lit("queued image not found: "), F.col("_name"))), F.col("image_error"))
    bad = joined.withColumn("_problem", problem).groupBy("batch_id", "relative_path").agg(
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("_pos"))).alias("_problem"))
    out = parsed.join(bad, ["batch_id", "relative_path"], "left")
    error = F.coalesce(
        path_error(F.col("relative_path")), F.col("error"),
        F.when(F.size("images") != 3, F.lit("offline visible package must declare exactly 3 images")), F.col("_problem"))
    return out.withColumn("error", error).drop("_problem")


# --- image discovery and sidecars ----------------------------------------------------------------------------------

def discover_images(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Image files outside the ignored folders, in lower-cased path order."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    parts = F.split(path, "/")
    ignored = F.arrays_overlap(parts, F.array(*[F.lit(f) for f in K.IGNORED_FOLDERS]))
    return files.where(suffix.isin(*K.IMAGE_SUFFIXES) & ~ignored).orderBy(F.lower(path))


def _swap_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def _folder_file(path: Column, name: str) -> Column:
    return F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.lit(name))


def _of_folder(images: DataFrame, side: DataFrame, folder: str) -> DataFrame:
    """Images with what stands once for their folder; the images of a folder with very many are spread."""
    sizes = images.groupBy(folder).agg(F.count(F.lit(1)).alias("_images"))
    return spread_join(images, side.join(sizes, folder), [folder], "_images").drop("_images")


def attach_metadata(images: DataFrame, sidecars: DataFrame, stored: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Metadata JSON of every image: file sidecar, stem sidecar, folder sidecar, stored capture.

    ``sidecars``: path, content; only texts that parse to an object count.
    ``stored``: capture_id, metadata_json, matched by the folder name.
    """
    usable = sidecars.where(F.try_parse_json("content").isNotNull() & F.trim("content").startswith("{")).select(
        F.col("path").alias("_p"), F.col("content").alias("_c"))
    p = F.col(path)
    out = images.withColumn("_1", F.concat(p, F.lit(".metadata.json"))).withColumn("_2", _swap_suffix(p, ".json")).withColumn(
        "_3", _folder_file(p, "metadata.json"))
    for i in (1, 2):
        side = usable.select(F.col("_p").alias(f"_{i}"), F.col("_c").alias(f"_c{i}"))
        out = out.join(side, f"_{i}", "left")
    out = _of_folder(out, usable.select(F.col("_p").alias("_3"), F.col("_c").alias("_c3")), "_3")
    found = F.coalesce("_c1", "_c2", "_c3")
    where = F.coalesce(*[F.when(F.col(f"_c{i}").isNotNull(), F.col(f"_{i}")) for i in (1, 2, 3)])
    out = out.withColumn("metadata_json", found).withColumn("metadata_path", where)
    if stored is not None:
        kept = stored.select(F.col("capture_id").cast("string").alias("_folder"), F.col("metadata_json").alias("_stored"))
        out = _of_folder(out.withColumn("_folder", X.parent_name(p)), kept, "_folder")
        out = out.withColumn("metadata_path", F.coalesce("metadata_path", F.when(F.col("_stored").isNotNull(), F.lit("captures"))))
        out = out.withColumn("metadata_json", F.coalesce("metadata_json", "_stored")).drop("_folder", "_stored")
    return out.drop("_1", "_2", "_3", "_c1", "_c2", "_c3")


def image_records(images: DataFrame, path: str = "path") -> DataFrame:
    """Dataset record columns from images with metadata_json (null = no metadata)."""
    m = F.from_json("metadata_json", S.RAW_METADATA)
    rows = images.withColumn("_m", m)
    capture = X.capture_id_of(F.col("_m.capture_id"), F.col(path))
    pose = F.col("_m.robot_pose")
    return rows.withColumn("capture_id", capture).withColumn(
        "batch_id", X.batch_id_of(F.col("_m.batch_id"), F.col("_m.capture_batch"), F.col(path), F.col("capture_id"))
    ).withColumn("station_id", X.blank_to_null(F.col("_m.station_id"))).withColumn(
        "camera_id", X.blank_to_null(F.col("_m.camera_id"))).withColumn(
        "capture_time", X.blank_to_null(F.col("_m.capture_time"))).withColumn(
        "pose_missing", F.coalesce(pose["x_m"], pose["y_m"], pose["yaw_deg"]).isNull()
    ).withColumn("metadata_missing", F.col("metadata_json").isNull()).drop("_m")


# --- manifests ---------------------------------------------------------------------------------------------------------

def read_manifest(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of a JSON-lines manifest; blank lines are skipped."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return parse_manifest(lines, schema)


def parse_manifest(lines: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    kept = lines.where(F.trim("line") != "")
    is_object = F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    good = kept.where(is_object).withColumn("_row", F.from_json("line", schema))
    others = [c for c in lines.columns if c != "line"]
    return good.select(*others, "_row.*"), kept.where(~is_object).withColumn("message", F.lit("malformed manifest line"))


def keyed_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with lower-cased sha256, violations: missing or repeated hashes)."""
    lowered = rows.withColumn("sha256", F.lower(X.blank_to_null(F.col("sha256"))))
    repeated = lowered.groupBy("sha256").agg(F.count(F.lit(1)).alias("rows"))
    bad = repeated.where(F.col("sha256").isNull() | (F.col("rows") > 1))
    return lowered.where(F.col("sha256").isNotNull()), bad


def detection_rows(sidecars: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Replayed detections of JSON array sidecars, one row per entry with its position."""
    entries = F.from_json(F.col(content), f"array<{S.RAW_DETECTION.simpleString()}>")
    rows = sidecars.select(*keys, F.posexplode(entries).alias("pos", "d"))
    number = F.col("d.confidence").try_cast("double")
    return rows.select(
        *keys, "pos", F.col("d.type").alias("type"), F.col("d.class").alias("class_id"),
        F.coalesce("d.class_cn", "d.class").alias("class_cn"), G.box_from_array(F.col("d.bbox_xyxy")).alias("bbox"),
        number.alias("confidence"), F.col("d.attributes").alias("attributes"))


def attach_annotations(images: DataFrame, sidecars: DataFrame, path: str = "path") -> DataFrame:
    """Annotation text of every image: ``<file>.labels.json`` before ``<stem>.labels.json``."""
    side = sidecars.select(F.col("path").alias("_p"), F.col("content").alias("_c"))
    p = F.col(path)
    out = images.withColumn("_1", F.concat(p, F.lit(".labels.json"))).withColumn("_2", _swap_suffix(p, ".labels.json"))
    for i in (1, 2):
        out = out.join(side.select(F.col("_p").alias(f"_{i}"), F.col("_c").alias(f"_c{i}")), f"_{i}", "left")
    return out.withColumn("annotation_json", F.coalesce("_c1", "_c2")).drop("_1", "_2", "_c1", "_c2")


def annotation_boxes(images: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(boxes of annotated images, images whose annotation is no array of objects).

    Images without annotation are neither: they are skipped, not negatives.
    """
    entries = F.from_json("annotation_json", f"array<{S.RAW_ANNOTATION.simpleString()}>")
    known = images.where(F.col("annotation_json").isNotNull()).withColumn("_a", entries)
    bad = F.col("_a").isNull() | ~F.trim("annotation_json").startswith("[") | F.exists("_a", lambda a: a.isNull())
    boxes = known.where(~bad).select(*keys, F.posexplode("_a").alias("pos", "a")).select(
        *keys, "pos", F.trim("a.class").alias("class"), G.box_from_array(F.col("a.bbox_xyxy")).alias("bbox"))
    return boxes, known.where(bad).drop("_a")


# --- labelled samples --------------------------------------------------------------------------------------------------

def labelled_samples(files: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples in natural order, violations) of files stored as ``<label>/<name>``.

    Violations: an exclusion that names no file, a file whose leading number
    differs from its folder, a repeated path.
    """
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    parts = F.split("relative_path", "/")
    label = F.element_at(parts, 1).try_cast("int")
    rows = files.where(suffix.isin(*K.IMAGE_SUFFIXES) & (F.size(parts) == 2)).withColumn("label", label).where(F.col("label").isNotNull())
    kept = rows.join(exclusions.select("relative_path"), "relative_path", "left_anti")
    lead = F.regexp_extract(X.portable_name(F.col("relative_path")), r"^(\d+)", 1).try_cast("int")
    wrong = kept.where(~lead.eqNullSafe(F.col("label"))).select("relative_path", F.lit("file number differs from its folder").alias("violation"))
    unknown = exclusions.join(files, "relative_path", "left_anti").select("relative_path", F.lit("excluded sample does not exist").alias("violation"))
    twice = kept.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "relative_path", F.lit("sample paths must be unique").alias("violation"))
    return kept.orderBy("label", X.natural_key(F.col("relative_path"))), wrong.unionByName(unknown).unionByName(twice)


def labelled_meters(samples: DataFrame, digit_count: int = 4) -> tuple[DataFrame, DataFrame]:
    """(samples, violations): configured text must equal the file stem and have ``digit_count`` digits."""
    digits = F.regexp_replace("text", r"^-+|\.", "")
    error = F.when(X.stem(F.col("path")) != F.col("text"), F.lit("configured text differs from the file name")).when(
        ~digits.rlike(f"^[0-9]{{{digit_count}}}$"), F.lit(f"reading must have {digit_count} digits"))
    checked = samples.withColumn("violation", error)
    return checked.where(F.col("violation").isNull()).drop("violation"), checked.where(F.col("violation").isNotNull())


# --- dimensions ------------------------------------------------------------------------------------------------------------

def keyed_config(texts: DataFrame, entry, key: str) -> DataFrame:
    """Keyed JSON object (column ``content``) -> one row per entry with its position."""
    table = F.from_json("content", f"map<string,{entry.simpleString()}>")
    order = F.map_keys(table)
    rows = texts.select(order.alias("_order"), F.explode(table).alias(key, "_e"))
    names = [f.name for f in entry.fields]
    return rows.select(key, (F.array_position("_order", F.col(key)) - 1).cast("int").alias("ord"), *[F.col(f"_e.{n}").alias(n) for n in names])


def classes(texts: DataFrame) -> DataFrame:
    """Class table with the dense training index in configuration order (null = not trained)."""
    rows = keyed_config(texts, S.CLASS_ENTRY, "class").withColumn("train", F.coalesce("train", F.lit(True)))
    trained = rows.agg(F.array_sort(F.collect_list(F.when(F.col("train"), F.col("ord")))).alias("_t")).withColumn("_k", F.lit(1))
    out = rows.withColumn("_k", F.lit(1)).join(trained, "_k").drop("_k")
    return out.withColumn("class_index", F.when(F.col("train"), (F.array_position("_t", F.col("ord")) - 1).cast("int"))).drop("_t")
