"""Photos out of the rows that the importer delivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without a zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def clean_camera(camera: str | Column) -> Column:
    """Lower case, trimmed, one space for each run of white space; null or blank is ``unknown``."""
    c = F.col(camera) if isinstance(camera, str) else camera
    c = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def current_photos(metadata: DataFrame) -> DataFrame:
    """One row per filename (filename, photo_ts, camera_id): that with the latest ingested_at.

    Among equal instants of ingestion the highest row_id counts; a null instant
    is the earliest. Rows without a filename belong to no photo. One aggregation
    whose partial results are as many as filenames, so a photo delivered very
    often does no harm.
    """
    last = F.max(F.struct("ingested_at", "row_id", "photo_ts", "camera_id")).alias("last")
    return (
        metadata.filter(F.col("filename").isNotNull()).groupBy("filename").agg(last)
        .select("filename", "last.photo_ts", "last.camera_id")
    )
