"""Explicit schemas of every reader; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from seamwatch import constants as K

_text = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_POSE = _struct(frame=_text, x_m=_text, y_m=_text, yaw_deg=_text)
RAW_METADATA = _struct(
    capture_id=_text, capture_time=_text, station_id=_text, robot_pose=RAW_POSE,
    camera_id=_text, images=T.ArrayType(_text), batch_id=_text, capture_batch=_text,
)
RAW_OBJECT = T.StructType([
    T.StructField("type", _text), T.StructField("class", _text), T.StructField("class_cn", _text),
    T.StructField("bbox_xyxy", T.ArrayType(_text)), T.StructField("confidence", _text),
])
RAW_CORRECTION = _struct(operator=_text, reason=_text, objects=T.ArrayType(RAW_OBJECT))
RAW_DETECTION = T.StructType([
    T.StructField("type", _text), T.StructField("class", _text), T.StructField("class_cn", _text),
    T.StructField("bbox_xyxy", T.ArrayType(_text)), T.StructField("confidence", _text),
    T.StructField("attributes", T.MapType(_text, _text)),
])
RAW_ANNOTATION = T.StructType([
    T.StructField("class", _text), T.StructField("bbox_xyxy", T.ArrayType(_text)),
])
CLASS_ENTRY = _struct(
    id=_text, type=_text, name_cn=_text, train=T.BooleanType(), min_confidence=T.DoubleType(),
    attributes=T.MapType(_text, _text),
)
STATION_ENTRY = _struct(location_name=_text)
REFERENCE_ENTRY = T.StructType([
    T.StructField("station_id", _text), T.StructField("class", _text),
    T.StructField("normal_reference_image", _text), T.StructField("normal_angle_deg", T.DoubleType()),
    T.StructField("tolerance_deg", T.DoubleType()), T.StructField("min_confidence", T.DoubleType()),
])
GAS_EN = _struct(**{name: _text for name in K.GAS_HEADER_EN})
GAS_ZH = T.StructType([T.StructField(name, _text) for name in K.GAS_HEADER_ZH])
IMAGE_RECORD = T.StructType([
    *[T.StructField(n, _text) for n in (
        "path", "relative_path", "capture_id", "batch_id", "station_id", "camera_id", "capture_time")],
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("sha256", _text), T.StructField("perceptual_hash", _text),
    *[T.StructField(n, T.DoubleType()) for n in (
        "brightness_mean", "dark_fraction", "bright_fraction", "edge_variance")],
    T.StructField("qc_flags", T.ArrayType(_text)), T.StructField("metadata_path", _text),
    T.StructField("split", _text),
])
MARKER_ROW = T.StructType([
    T.StructField("source", _text), T.StructField("source_key", _text),
    T.StructField("station_number", T.IntegerType()), T.StructField("split", _text),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("bboxes_xyxy", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("sha256", _text), T.StructField("dhash", _text),
    T.StructField("annotation_source", _text),
])
DIAGNOSTIC = T.StructType([
    T.StructField("batch_id", _text), T.StructField("scope", _text), T.StructField("level", _text),
    T.StructField("path", _text), T.StructField("row", T.LongType()),
    T.StructField("sample_key", _text), T.StructField("message", _text),
])
