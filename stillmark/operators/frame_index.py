"""A kept index of fingerprinted frames: written once, changed by video, searched from its newest snapshot.

A frame's 256 bytes (hashes, colours, layout, number and time) are columns of a Parquet row, so a search reads the cheap hash
first and stays in generated code. Frames are in buckets by video; changing a video writes its bucket again and no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mutations, recall, snapshots
from .snapshots import Snapshot

KEY = "video_id"


def build(frames: DataFrame, root: str, buckets: int = 64) -> Snapshot:
    """A new index of ``frames`` (video_id, frame_index, time_ms and the fingerprint columns)."""
    return snapshots.create(frames, root, KEY, buckets)


def add(frames: DataFrame, index: Snapshot) -> Snapshot:
    """Frames of videos that the index doesn't have; nothing is written again."""
    return snapshots.append(frames, index)


def replace(fresh: DataFrame, video_ids: DataFrame, index: Snapshot) -> Snapshot:
    """The old frames of those videos go, the fresh ones come; a video without fresh frames is simply gone."""
    ids = video_ids.select(KEY).distinct()
    return snapshots.rewrite(ids, index, lambda rows: mutations.replace_in_index(rows, ids, fresh))


def remove(video_ids: DataFrame, index: Snapshot) -> Snapshot:
    ids = video_ids.select(KEY).distinct()
    return snapshots.rewrite(ids, index, lambda rows: mutations.remove_from_index(rows, ids))


def frames(spark: SparkSession, index: Snapshot) -> DataFrame:
    return snapshots.read(spark, index).drop("bucket")


def frames_of_video(spark: SparkSession, index: Snapshot, video_id: int) -> DataFrame:
    """All frames of one video, from the files of its bucket."""
    return snapshots.rows_of(spark, index, video_id)


def search(queries: DataFrame, root: str, struct: list[str], **options) -> DataFrame:
    """``recall.recall`` over the newest snapshot of the index; no frame is fingerprinted again."""
    spark = queries.sparkSession
    index = snapshots.current(spark, root)
    if index is None:
        raise FileNotFoundError(f"no index in {root}")
    return recall.recall(frames(spark, index), queries, struct, **options)
