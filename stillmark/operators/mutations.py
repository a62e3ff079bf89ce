"""Changes to the catalogue as whole-table transformations: keyed merges, cascades and idempotent batch writes.

Each function gives the new table; ``snapshots`` commits one, so that readers see it before or after a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .shared import saved

COMPARED = ["size", "mtime_ms", "duration", "width", "height", "video_codec"]
# Key, type, default, lowest, highest.
SETTINGS = [
    ("uniformIntervalSeconds", "long", 5, 1, 3600),
    ("concurrency", "long", 2, 1, 8),
    ("minHashScore", "double", 0.6, 0.0, 1.0),
    ("maxResults", "long", 40, 1, 200),
    ("awaitWriteMs", "long", 1500, 0, 60000),
    ("pruneOnDelete", "boolean", True, None, None),
    ("samplingMode", "string", "uniform", None, None),
    ("updateCheck", "boolean", True, None, None),
    ("keepFrameImages", "boolean", False, None, None),
]


def upsert_videos(videos: DataFrame, incoming: DataFrame, now_ms: Column, folder: str = "folder_id") -> DataFrame:
    """The merged catalogue with ``created`` and ``changed``.

    Keyed by path_key; of several incoming rows with one key the last by mtime, size, then path and the other columns, counts. A changed file is one
    whose size, time, duration, picture or codec differ, or whose digest became known. An unknown folder keeps the old
    one; the digest is always the incoming one. New ids follow the largest, in order of path_key.
    """
    key = paths.path_key(F.col("path"))
    last = Window.partitionBy("in_key").orderBy(*[F.desc(c) for c in ("mtime_ms", "size", "path", "file_hash", "duration", "width", "height", "video_codec", folder)])
    fresh = incoming.withColumn("in_key", key).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    fresh = fresh.select(*[F.col(c).alias(f"in_{c}") for c in ("path", *COMPARED, folder, "file_hash")], "in_key")
    both = videos.join(fresh, F.col("path_key") == F.col("in_key"), "full_outer")
    touched, created = F.col("in_key").isNotNull(), F.col("id").isNull()
    differs = F.lit(False)
    for c in COMPARED:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"in_{c}"))
    changed = touched & (created | differs | (F.col("file_hash").isNull() & F.col("in_file_hash").isNotNull()))
    highest = videos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))
    new_ids = fresh.join(videos.select("path_key"), F.col("in_key") == F.col("path_key"), "left_anti").select("in_key")
    new_ids = numbered(new_ids, ["in_key"], "new_number").withColumnRenamed("in_key", "new_key")
    joined = both.join(new_ids, F.col("in_key") == F.col("new_key"), "left").crossJoin(F.broadcast(highest))
    path = paths.normalize_path(F.col("in_path"))
    made = {
        "id": F.coalesce("id", F.col("highest") + F.col("new_number")),
        "path": F.coalesce("path", path),
        "path_key": F.coalesce("path_key", "in_key"),
        "name": F.coalesce("name", paths.file_name(path)),
        "dir": F.coalesce("dir", paths.dir_name(path)),
        "ext": F.coalesce("ext", paths.extension(path)),
        "status": F.coalesce("status", F.lit("pending")),
        "added_at": F.coalesce("added_at", now_ms),
        "frame_count": F.coalesce("frame_count", F.lit(0)),
        "processed_ms": F.coalesce("processed_ms", F.lit(0)),
        "processed_timestamps": F.coalesce("processed_timestamps", F.array().cast("array<long>")),
        "folder_id": F.when(touched, F.coalesce(f"in_{folder}", "folder_id")).otherwise(F.col("folder_id")),
        "file_hash": F.when(touched, F.col("in_file_hash")).otherwise(F.col("file_hash")),
        **{c: F.when(touched, F.col(f"in_{c}")).otherwise(F.col(c)) for c in COMPARED},
    }
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in videos.columns], (touched & created).alias("created"), changed.alias("changed"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, 3, ... in order without one task for all rows: numbers within range partitions plus the counts before them.

    The range partitions are written, so their numbers are the same for both uses.
    """
    ranged = saved(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.join(F.broadcast(before), F.col("part") == F.col("of")).withColumn(name, F.col("before") + within).drop("part", "of", "before")


def import_outcomes(candidates: DataFrame, upserted: DataFrame) -> DataFrame:
    """path, outcome of each scanned path: skipped (missing or no candidate), added, duplicate (ready) or requeued.

    candidates: path, path_key, present, is_candidate; upserted: path_key, created, changed, status."""
    joined = candidates.join(upserted.select(F.col("path_key").alias("known_key"), "created", "changed", "status"), F.col("path_key") == F.col("known_key"), "left")
    outcome = F.when(~F.col("present") | ~F.col("is_candidate") | F.col("known_key").isNull(), "skipped").when(F.col("created") | F.col("changed"), "added").when(F.col("status") == "ready", "duplicate").otherwise("requeued")
    return joined.select("path", outcome.alias("outcome"))


def import_totals(results: DataFrame) -> DataFrame:
    """Sums of the counters, the first error by order, and the number of failures."""
    errors = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("position")))
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "skipped", "failed", "duplicates")], errors.alias("error"), F.coalesce(F.sum(F.when(F.col("failures").isNotNull(), F.size("failures"))), F.lit(0)).alias("n_failures"))


def import_failures(results: DataFrame) -> DataFrame:
    """position, place, failure: a row for each failure; ordered by position and place they are the whole list."""
    return results.select("position", F.posexplode("failures").alias("place", "failure"))


def insert_folder(folders: DataFrame, path: str, pinned: bool, recursive: bool, now_ms: int) -> DataFrame:
    """Idempotent by path_key: an unpinned folder is promoted to pinned and enabled, a pinned one keeps a user's pause."""
    spark = folders.sparkSession
    new = spark.createDataFrame([(path,)], "path string").select(paths.normalize_path(F.col("path")).alias("path"))
    new = new.select("path", paths.path_key(F.col("path")).alias("path_key"), paths.file_name(F.col("path")).alias("name"))
    key = F.lit(new.first().path_key)
    promote = (F.col("path_key") == key) & F.lit(pinned) & ~F.col("pinned")
    kept = folders.withColumns({"enabled": F.when(promote, True).otherwise(F.col("enabled")), "pinned": F.when(promote, True).otherwise(F.col("pinned"))})
    highest = folders.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = new.join(folders.select("path_key"), "path_key", "left_anti").crossJoin(highest)
    values = {"pinned": F.lit(pinned), "enabled": F.lit(True), "recursive": F.lit(recursive), "watch_state": F.lit("idle"), "added_at": F.lit(now_ms).cast("long")}
    return kept.unionByName(row.select(*[values.get(f.name, F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in folders.schema.fields]))


def delete_videos(ids: DataFrame, videos: DataFrame, *dependants: DataFrame) -> list[DataFrame]:
    """Videos without those ids, and each dependent table (video_id) without their rows."""
    gone = ids.select(F.col("id").alias("gone_id"))
    return [videos.join(gone, F.col("id") == F.col("gone_id"), "left_anti"), *[d.join(gone, F.col("video_id") == F.col("gone_id"), "left_anti") for d in dependants]]


def ids_under(videos: DataFrame, directory: str) -> DataFrame:
    """Ids of all videos inside a directory, at any depth; a video whose own path it is isn't inside."""
    return videos.where(paths.is_under(F.col("path_key"), paths.path_key(F.lit(directory)))).select("id")


def removed(ids: DataFrame, videos: DataFrame, *dependants: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``video-removed`` events (type, video_id, path) of those videos, and all tables without them."""
    gone = videos.join(ids.select("id").distinct(), "id", "left_semi")
    events = gone.select(F.lit("video-removed").alias("type"), F.col("id").alias("video_id"), "path")
    return events, delete_videos(gone, videos, *dependants)


def remove_by_path(path: str, videos: DataFrame, *dependants: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """A file that is gone: its video, if there is one, and what hangs on it."""
    return removed(videos.where(F.col("path_key") == paths.path_key(F.lit(path))).select("id"), videos, *dependants)


def remove_under(directory: str, videos: DataFrame, *dependants: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """A directory that is gone: every video in it, and what hangs on them."""
    return removed(ids_under(videos, directory), videos, *dependants)


def cleared(*tables: DataFrame) -> list[DataFrame]:
    """Empty tables of the same columns: a library reset, which leaves settings alone."""
    return [t.where(F.lit(False)) for t in tables]


def update_rows(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the columns that ``changes`` (key and some columns) has, where it has their key.

    No row is multiplied: of several changes of one key the one with the largest columns, taken from left to right, counts.
    """
    given = [c for c in changes.columns if c != key]
    changes = changes.groupBy(key).agg(F.max(F.struct(*given)).alias("last")).select(key, "last.*")
    joined = rows.join(changes.select(F.col(key).alias("changed_key"), *[F.col(c).alias(f"changed_{c}") for c in given]), F.col(key) == F.col("changed_key"), "left")
    return joined.select(*[F.when(F.col("changed_key").isNotNull(), F.col(f"changed_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in rows.columns])


def insert_imported_folder(folders: DataFrame, path: str, recursive: bool, now_ms: int) -> DataFrame:
    """A one-time import keeps its directory, unwatched; a folder that is there already stays as it is."""
    before = folders.select(F.col("id").alias("known_id"))
    out = insert_folder(folders, path, False, recursive, now_ms).join(before, F.col("id") == F.col("known_id"), "left")
    out = out.withColumn("enabled", F.when(F.col("known_id").isNotNull(), F.col("enabled")).otherwise(F.lit(False)))
    return folders.unionByName(out.where("known_id is null").drop("known_id"))


def set_status(videos: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, status, error."""
    return update_rows(videos, changes.select("id", "status", "error"))


def put_scene_times(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh: video_id, cache_key, times; one row for each video, the fresh one where there is one."""
    rows = fresh.select("video_id", "cache_key", F.to_json("times").alias("scene_times"))
    return cache.join(rows.select("video_id"), "video_id", "left_anti").unionByName(rows)


def can_reuse_hash(stored_size: Column, stored_mtime: Column, size: Column, mtime: Column) -> Column:
    """A stored digest holds only for a file of the same known size and time."""
    return F.coalesce((size > 0) & (mtime > 0) & (stored_size == size) & (stored_mtime == mtime), F.lit(False))


def remove_folder(folders: DataFrame, videos: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    return folders.where(F.col("id") != folder_id), videos.withColumn("folder_id", F.when(F.col("folder_id") != folder_id, F.col("folder_id")))


def commit_frames(frames: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("video_id", "frame_index"), order: str | None = None) -> DataFrame:
    """Frames with the batch's in place of those with the same key; within the batch the last one by ``order`` counts, of equal
    ones that with the largest columns, taken from left to right."""
    latest = batch
    if order:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.struct(*frames.columns))))
        latest = batch.withColumn("n", n).where("n = 1").drop("n")
    return frames.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(*frames.columns))


def record_progress(videos: DataFrame, progress: DataFrame) -> DataFrame:
    """progress: video_id, saved (array of ms), elapsed. Sets the saved list, adds the time, marks as indexing."""
    p = progress.select(F.col("video_id").alias("of"), "saved", "elapsed")
    joined = videos.join(p, F.col("id") == F.col("of"), "left")
    hit = F.col("of").isNotNull()
    made = {"processed_timestamps": F.when(hit, F.col("saved")).otherwise(F.col("processed_timestamps")), "processed_ms": F.when(hit, F.col("processed_ms") + F.col("elapsed")).otherwise(F.col("processed_ms")), "status": F.when(hit, "indexing").otherwise(F.col("status"))}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in videos.columns])


def mark_ready(videos: DataFrame, frames: DataFrame, done: DataFrame, now_ms: Column) -> DataFrame:
    """done: id. Status ready with the counted frames; other videos stay as they are."""
    counts = frames.groupBy(F.col("video_id").alias("counted_id")).agg(F.count("*").alias("counted"))
    d = done.select(F.col("id").alias("done_id")).join(counts, F.col("done_id") == F.col("counted_id"), "left")
    joined = videos.join(d, F.col("id") == F.col("done_id"), "left")
    hit = F.col("done_id").isNotNull()
    made = {"status": F.when(hit, "ready").otherwise(F.col("status")), "indexed_at": F.when(hit, now_ms).otherwise(F.col("indexed_at")), "frame_count": F.when(hit, F.coalesce("counted", F.lit(0))).otherwise(F.col("frame_count")), "error": F.when(~hit, F.col("error"))}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in videos.columns])


def reset_progress(videos: DataFrame, frames: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("gone_id")).distinct()
    joined = videos.join(gone, F.col("id") == F.col("gone_id"), "left")
    hit = F.col("gone_id").isNotNull()
    made = {"processed_timestamps": F.when(hit, F.array().cast("array<long>")).otherwise(F.col("processed_timestamps")), "frame_count": F.when(hit, 0).otherwise(F.col("frame_count"))}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in videos.columns]), frames.join(gone, F.col("video_id") == F.col("gone_id"), "left_anti")


def set_pending(videos: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk status change that clears errors."""
    hit = ids.select(F.col("id").alias("hit_id"), F.lit(True).alias("hit")).distinct()
    joined = videos.join(hit, F.col("id") == F.col("hit_id"), "left")
    made = {"status": F.when(F.col("hit"), "pending").otherwise(F.col("status")), "error": F.when(F.col("hit").isNull(), F.col("error"))}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in videos.columns])


def migrate_sampling(videos: DataFrame, old: str, new: str) -> DataFrame:
    """After a change of the general mode only videos pinned to the old one follow."""
    return videos.withColumn("sampling_override", F.when(F.col("sampling_override") == old, new).otherwise(F.col("sampling_override")))


def merge_settings(settings: DataFrame, patch: DataFrame) -> DataFrame:
    """Keyed replacement of JSON values; keys that the patch doesn't have stay."""
    return settings.join(patch.select("key"), "key", "left_anti").unionByName(patch.select("key", "value"))


JSON_LONG = r"^\s*-?(0|[1-9][0-9]*)\s*$"
JSON_DOUBLE = r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?\s*$"


def typed_settings(settings: DataFrame, by: list[str] = [], order: str | None = None) -> DataFrame:
    """One row of typed settings, for each ``by`` if there is any: values that aren't JSON of the type, or are missing, take
    the default, numbers are clamped. Of a key's several values the last by ``order`` counts, then the largest text."""
    at = F.struct(F.col(order), F.col("value")) if order else F.struct("value")
    values = settings.groupBy(*by).agg(*[F.max_by("value", F.when(F.col("key") == k, at)).alias(k) for k, *_ in SETTINGS])
    out = []
    for key, kind, default, low, high in SETTINGS:
        raw = F.col(key)
        if kind == "string":
            value = F.when(F.regexp_extract(raw, r'^\s*"(.*)"\s*$', 1) == "scene", "scene").otherwise("uniform")
        elif kind == "boolean":
            value = F.coalesce(F.when(F.trim(raw).isin("true", "false"), F.trim(raw) == "true"), F.lit(default))
        else:
            number = F.when(raw.rlike(JSON_LONG if kind == "long" else JSON_DOUBLE), F.trim(raw).try_cast(kind))
            number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number) if kind == "double" else number
            value = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(number, F.lit(default)))).cast(kind)
        out.append(value.alias(key))
    return values.select(*by, *out)


def remove_from_index(frames: DataFrame, video_ids: DataFrame) -> DataFrame:
    return frames.join(video_ids.select("video_id").distinct(), "video_id", "left_anti")


def replace_in_index(frames: DataFrame, video_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Frames of those videos go, the fresh ones come; a video without fresh frames is simply gone."""
    return remove_from_index(frames, video_ids).unionByName(fresh.join(video_ids.select("video_id").distinct(), "video_id", "left_semi").select(*frames.columns))
