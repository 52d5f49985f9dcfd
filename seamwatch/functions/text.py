"""Text, time and file-name expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# groups: year, month, day, hour, minute, second, fraction, offset of an ISO-8601 text
_ISO = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[^0-9](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
)


def blank_to_null(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def finite_double(text: Column) -> Column:
    """Number in the text; null when blank, malformed, infinite or NaN."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def iso_wall_clock(text: Column) -> Column:
    """Local date and time of an ISO-8601 text with the offset dropped (timestamp_ntz).

    A text that does not match stays as it is behind a marker and fails the cast.
    """
    clean = F.trim(text)
    spelled = F.regexp_replace(clean, _ISO, "=$1-$2-$3 $4:$5:$6.$7")
    tidy = F.regexp_replace(F.regexp_replace(spelled, r"[ :.]+$", ""), r" (\d{2})$", " $1:00")
    return F.when(tidy.startswith("="), F.substring(tidy, 2, 40)).try_cast("timestamp_ntz")


def iso_instant(text: Column) -> Column:
    """Instant of an ISO-8601 text; texts without an offset are read in the session zone."""
    offset = F.regexp_extract(F.trim(text), _ISO, 8)
    zone = F.when(offset == "Z", "+00:00").otherwise(
        F.regexp_replace(F.regexp_replace(offset, r"^([+-]\d{2}):?(\d{2}).*$", "$1:$2"), r"^([+-]\d{2})$", "$1:00")
    )
    wall = F.date_format(iso_wall_clock(text), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(wall, zone).try_cast("timestamp")


def zero_pad(text: Column, width: int = 6) -> Column:
    """Left zero padding that never shortens a longer text."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def sample_key(wall_clock: Column, sample_id: Column) -> Column:
    """``yyyyMMdd_HHmmss_<id>`` from the wall clock, whatever the offset was."""
    return F.concat_ws("_", F.date_format(wall_clock, "yyyyMMdd_HHmmss"), zero_pad(sample_id))


def truncate_error(text: Column, limit: int = 2000) -> Column:
    return F.substring(text, 1, limit)


def portable_name(path: Column) -> Column:
    """Base name of a Windows or POSIX path."""
    return F.trim(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))


def safe_name(path: Column, fallback: Column) -> Column:
    """Base name with unsafe runs replaced, outer dots/underscores cut, 120 characters at most."""
    clean = F.regexp_replace(portable_name(path), r"[^A-Za-z0-9_.-]+", "_")
    clean = F.substring(F.regexp_replace(clean, r"^[._]+|[._]+$", ""), 1, 120)
    return F.coalesce(F.nullif(clean, F.lit("")), fallback)


def stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(portable_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    """Name of the directory holding the file, or empty."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def unique_sample_name(capture_id: Column, path: Column, sha256: Column) -> Column:
    """``<capture>_<stem>_<first 10 of hash>`` with unsafe characters replaced."""
    owner = F.coalesce(F.nullif(capture_id, F.lit("")), parent_name(path))
    owner = F.regexp_replace(owner, r"[^\p{L}\p{N}._-]", "_")
    owner = F.regexp_replace(owner, r"^[._]+|[._]+$", "")
    name = F.concat(
        owner, F.lit("_"), stem(path), F.lit("_"), F.substring(F.coalesce(sha256, F.lit("")), 1, 10)
    )
    return F.regexp_replace(name, r"^_+|_+$", "")


def is_relative_path(path: Column) -> Column:
    """Neither rooted nor with a drive letter (or any colon) in its first part."""
    clean = F.translate(path, "\\", "/")
    first = F.element_at(F.split(clean, "/"), 1)
    return ~clean.startswith("/") & ~first.contains(":")


def stays_inside(path: Column) -> Column:
    """True when walking the parts never climbs above the starting directory."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    lowest = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda state, part: F.struct(
            (state["depth"] + _step(part)).alias("depth"),
            F.least(state["low"], state["depth"] + _step(part)).alias("low"),
        ),
        lambda state: state["low"],
    )
    return lowest >= 0


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def has_hidden_part(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.startswith("."))


def natural_key(text: Column) -> Column:
    """Sort key with digit runs compared as numbers and the rest lower-cased.

    Every run gets a class byte (numbers sort before text) and digit runs get
    their length in front of the zero-stripped digits, so text order equals
    natural order for numbers of any length.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    keyed = F.transform(
        runs,
        lambda run: F.when(
            run.rlike(r"^\d"),
            F.concat(
                F.lit("0"),
                F.lpad(F.length(_bare(run)).cast("string"), 6, "0"),
                _bare(run),
            ),
        ).otherwise(F.concat(F.lit("1"), run)),
    )
    return F.array_join(keyed, "\u0001")


def _bare(run: Column) -> Column:
    return F.regexp_replace(run, r"^0+(?=\d)", "")


def capture_id_of(metadata_id: Column, path: Column) -> Column:
    """Capture id: metadata value, else the directory name, else the file stem."""
    return F.coalesce(blank_to_null(metadata_id), blank_to_null(parent_name(path)), stem(path))


def batch_id_of(batch: Column, capture_batch: Column, path: Column, capture_id: Column) -> Column:
    """Batch id: metadata batch, capture batch, directory name, then the capture id."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(batch, empty), F.nullif(capture_batch, empty),
        F.nullif(parent_name(path), empty), capture_id,
    )


def split_group_key(batch_id: Column, capture_id: Column) -> Column:
    """A named batch stays together; otherwise the frames of one capture do."""
    has_batch = batch_id.isNotNull() & (batch_id != "") & (batch_id != capture_id)
    return F.when(has_batch, F.concat(F.lit("batch:"), batch_id)).otherwise(
        F.concat(F.lit("capture:"), capture_id)
    )


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null for unknown keys."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, key)
