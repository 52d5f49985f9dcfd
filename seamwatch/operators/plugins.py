"""Plug-in point for detectors: any per-image function as a distributed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamwatch.sources.files import detection_rows

DETECTION_SCHEMA = (
    "pos int, type string, class_id string, class_cn string, "
    "bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double, attributes map<string,string>"
)
NOT_CONFIGURED = "detector_not_configured: capture stored successfully; add model weights later"


def run_detector(
    images: DataFrame, keys: Sequence[str], factory: Callable[[], Callable], batched: bool = False,
) -> DataFrame:
    """Detections of every image.

    ``factory`` builds the detector once per worker.  A ``batched`` detector gets a frame of images,
    as many as one Arrow batch holds, and returns a frame of detections with the fields of the schema,
    except that ``row`` (the image's place in the batch) stands in for ``pos``.  Otherwise it gets one
    image row as a dict and returns detection dicts (``pos`` is filled in).
    """
    keys = list(keys)
    names = ["type", "class_id", "class_cn", "bbox", "confidence", "attributes"]

    def each(detect: Callable[[dict], list[dict]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{**found, "row": row} for row, image in enumerate(frame.to_dict("records")) for found in detect(image)], columns=["row", *names])
        return run

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = None
        for frame in frames:
            if detect is None:
                detect = factory() if batched else each(factory())
            found = detect(frame).reindex(columns=["row", *names])
            rows = found["row"].to_numpy(int)
            out = frame[keys].iloc[rows].reset_index(drop=True)
            out["pos"] = found.groupby("row", sort=False).cumcount().to_numpy("int32")
            for name in names:
                out[name] = pd.Series(found[name].tolist(), dtype=object)
            out["attributes"] = pd.Series([a if isinstance(a, dict) else {} for a in out["attributes"]], dtype=object)
            yield out

    head = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.mapInPandas(run, f"{head}, {DETECTION_SCHEMA}")


def no_detector(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections of an unconfigured detector: none, with the right columns."""
    head = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)
    return images.sparkSession.createDataFrame([], f"{head}, {DETECTION_SCHEMA}")


def replay_detector(images: DataFrame, sidecars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections replayed from the JSON sidecar of each image; a missing sidecar means none."""
    side = sidecars.select(F.col("path").alias("_p"), "content")
    joined = images.withColumn("_p", F.concat("path", F.lit(".detections.json"))).join(side, "_p").drop("_p")
    return detection_rows(joined, list(keys))


def detector_warnings(configured: bool) -> list[str]:
    return [] if configured else [NOT_CONFIGURED]


def with_parameters(results: DataFrame, parameters: dict[str, str | float | int | bool]) -> DataFrame:
    """Snapshot of the job parameters carried with every result."""
    fields = [F.lit(v).alias(k) for k, v in sorted(parameters.items())]
    return results.withColumn("processing_parameters", F.struct(*fields) if fields else F.lit(None).cast("string"))
