"""What leaves the library: events, reports, log lines and frame pictures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats

MAX_LOG_BYTES = 512 * 1024


def append_events(events: DataFrame, path: str) -> None:
    """events: type and any payload columns; one line of JSON each, added to the folder."""
    rest = {c: F.col(c) for c in events.columns if c != "type"}
    events.select(formats.event_json(F.col("type"), **rest).alias("value")).write.mode("append").text(path)


def diagnostics(stats: DataFrame, settings: DataFrame, folders: DataFrame, status: DataFrame, at_ms: int) -> DataFrame:
    """``report``: one JSON text of what may be told about a library: counts, settings, folder states, indexer; no paths.

    Each part has one row."""
    parts = {"library": stats, "settings": settings, "folders": folders, "indexer": status}
    out = None
    for name, part in parts.items():
        one = part.select(F.struct(*part.columns).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(at_ms).alias("generated_at_ms"), *parts)).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    """A gzip'ed file with the report."""
    report.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)


def append_log(lines: DataFrame, path: str, max_bytes: int = MAX_LOG_BYTES) -> None:
    """Add lines (value) to a log folder; one that has grown above ``max_bytes`` first becomes the only older one (``.1``)."""
    spark = lines.sparkSession
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(P(path)) and fs.getContentSummary(P(path)).getLength() > max_bytes:
        fs.delete(P(f"{path}.1"), True)
        fs.rename(P(path), P(f"{path}.1"))
    lines.select("value").write.mode("append").text(path)


def frame_pictures(frames: DataFrame, generations: DataFrame, encode: Callable[[bytes, int, int], bytes]) -> DataFrame:
    """name (<video>/<ms>.jpg) and content of frames (video_id, generation, time_ms, rgb, width, height) still wanted.

    ``generations`` (video_id, generation) has the current writer of each video; frames of an older one are dropped, and so
    are those whose bytes are not width * height * 3. ``encode`` runs on the executors.
    """

    @F.pandas_udf("binary")
    def encoded(rgb, width, height):
        import pandas as pd

        return pd.Series([encode(bytes(d), int(w), int(h)) for d, w, h in zip(rgb, width, height)])

    whole: Column = F.octet_length("rgb") == F.col("width") * F.col("height") * 3
    current = frames.where(whole).join(generations, ["video_id", "generation"], "left_semi")
    return current.select(F.format_string("%d/%d.jpg", F.col("video_id"), F.col("time_ms")).alias("name"), encoded("rgb", "width", "height").alias("content"))
