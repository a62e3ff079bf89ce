"""Search, duplicate search and ingest from end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sampling
from ..operators import catalog, duplicates, frame_index, mutations, recall, snapshots
from ..operators.shared import saved
from ..operators.snapshots import Snapshot
from ..schemas import STRUCT_WORDS
from ..sources import media


def search(frames: DataFrame, videos: DataFrame, queries: DataFrame, min_score: float = recall.MIN_SCORE, max_results: int = recall.MAX_RESULTS, pixels: DataFrame | None = None, decode: Callable | None = None) -> DataFrame:
    """Coarse recall, rerank of the first hits where pictures can be decoded, and the rounded response."""
    hits = recall.recall(frames, queries, STRUCT_WORDS, k=max(max_results, recall.RERANK_DEPTH), min_score=min_score)
    if decode is not None and pixels is not None:
        hits = recall.rerank(hits, pixels, decode, videos)
    return recall.respond(hits, videos, max_results)


def find_duplicates(frames: DataFrame, videos: DataFrame, files: DataFrame | None = None, threshold: float = duplicates.DEFAULT_THRESHOLD) -> DataFrame:
    """Identical and near pairs, identical first; digests are computed only for files of equal size and length."""
    candidates = duplicates.identical_candidates(videos)
    hashed = videos
    if files is not None:
        ids = candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        hashed = duplicates.with_hash(videos, files, ids)
    same = duplicates.identical_pairs(hashed, candidates)
    return duplicates.all_pairs(same, duplicates.coverage_pairs(frames, STRUCT_WORDS, threshold)).orderBy(F.desc("score"), "id_a", "id_b")


def sampling_plan(videos: DataFrame, scenes: DataFrame | None, interval: int, default_mode: str = "uniform") -> DataFrame:
    """video_id, path, seconds, full_scan for each video: scene plans where asked for and cuts are known."""
    mode = sampling.effective_mode(F.col("sampling_override"), F.lit(default_mode))
    v = videos.withColumn("mode", mode)
    if scenes is not None:
        v = v.join(scenes.select(F.col("video_id").alias("of"), "cuts"), F.col("id") == F.col("of"), "left")
    else:
        v = v.withColumn("cuts", F.lit(None).cast("array<double>"))
    by_scene = (F.col("mode") == "scene") & (F.coalesce(F.size("cuts"), F.lit(0)) > 0)
    i = F.lit(interval)
    v = v.withColumns({"by_scene": by_scene, "seconds": F.when(by_scene, sampling.scene_plan(F.coalesce("cuts", F.array().cast("array<double>")), F.col("duration"), i)).otherwise(sampling.uniform_plan(F.col("duration"), i))})
    n = F.size("seconds")
    forced = sampling.is_forced_seek(F.col("by_scene"), F.col("duration"), n)
    return v.select(F.col("id").alias("video_id"), "path", "seconds", sampling.is_full_scan(n, F.col("width"), F.col("height"), forced).alias("full_scan"))


def index_videos(videos: DataFrame, decode: Callable, interval: int = 5, scenes: DataFrame | None = None) -> DataFrame:
    """Fingerprinted frames of all given videos."""
    plan = sampling_plan(videos, scenes, interval)
    return media.decode_frames(plan.repartition("video_id"), decode)


def pending_plan(videos: DataFrame, frames: DataFrame, plan: DataFrame) -> DataFrame:
    """What is left to decode after a restart: video_id, path, seconds (the rest), resume_at, full_scan.

    Videos that are pending or were being indexed take part. A saved prefix counts if it is the plan's own and all its
    frames are there; else the video starts again.
    """
    waiting = videos.where(F.col("status").isin("pending", "indexing")).select(F.col("id").alias("video_id"), "processed_timestamps")
    saved = waiting.join(plan, "video_id").withColumn("n", sampling.resume_index(F.col("processed_timestamps"), F.col("seconds"), F.col("full_scan")).cast("long"))
    complete = catalog.prefix_complete(frames, saved.select("video_id", "n")).select("video_id", "complete")
    at = F.when(F.col("complete"), F.col("n")).otherwise(0)
    out = saved.join(complete, "video_id").withColumn("resume_at", at.cast("int"))
    return out.select("video_id", "path", F.slice("seconds", F.col("resume_at") + 1, F.size("seconds")).alias("seconds"), "resume_at", "full_scan")


def index_in_batches(videos: Snapshot, index: Snapshot, plan: DataFrame, decode: Callable, now_ms, batch: int = sampling.SEEK_BATCH) -> tuple[Snapshot, Snapshot]:
    """Decode what is pending in rounds: in each, every unfinished video's next ``batch`` seeks, committed before the next.

    Frames are committed first, then how far each video is; a run that stops anywhere goes on behind the last committed batch.
    Frames beyond a video's committed progress are of such a run and go first. A video whose batch fails keeps its earlier
    ones, has status ``error`` and takes no part in later rounds. A video that is scanned whole is one batch.
    """
    spark = plan.sparkSession
    table = snapshots.read(spark, videos).drop("bucket")
    every = plan.select(F.col("video_id").alias("of"), F.col("seconds").alias("every"))
    unfinished = table.where(F.col("status").isin("pending", "indexing")).select(F.col("id").alias("video_id"), F.size("processed_timestamps").alias("known"))
    index = _without_beyond(index, unfinished)
    todo = saved(pending_plan(table, frame_index.frames(spark, index), plan).join(every, F.col("video_id") == F.col("of")).drop("of"), "to-decode")
    index = _without_beyond(index, todo.select("video_id", F.col("resume_at").alias("known")))
    left = F.size("seconds")
    rounds = todo.agg(F.max(F.when(F.col("full_scan"), 1).otherwise(F.ceil(left / batch)))).first()[0] or 0
    failed = spark.createDataFrame([], "id long, error string")
    for k in range(rounds):
        mine = F.when(F.col("full_scan"), F.col("seconds")).otherwise(F.slice("seconds", k * batch + 1, batch))
        part = todo.where((left > k * batch) & (~F.col("full_scan") | F.lit(k == 0))).join(failed.select(F.col("id").alias("video_id")), "video_id", "left_anti")
        part = part.withColumn("first", (F.col("resume_at") + k * batch).cast("long")).withColumn("seconds", mine)
        out = saved(media.decode_batches(part.repartition("video_id"), decode), "decoded")
        index = frame_index.add(out.where("error is null"), index)
        broken = out.where("error is not null").select(F.col("video_id").alias("id"), "error")
        failed = saved(failed.unionByName(broken), "failed")
        went = part.join(broken.select(F.col("id").alias("video_id")), "video_id", "left_anti")
        ms = sampling.planned_ms(F.slice("every", F.lit(1), F.when(F.col("full_scan"), F.size("every")).otherwise(F.least(F.size("every"), F.col("first") + batch)).cast("int")))
        progress = went.select("video_id", ms.alias("saved"), F.lit(0).cast("long").alias("elapsed"))
        videos = snapshots.rewrite(progress.select("video_id"), videos, lambda rows, p=progress: mutations.record_progress(rows, p))
    done = saved(todo.select(F.col("video_id").alias("id")).join(failed, "id", "left_anti"), "done")
    counted = frame_index.frames(spark, index)
    videos = snapshots.rewrite(done, videos, lambda rows: mutations.mark_ready(rows, counted, done, now_ms))
    errors = failed.select("id", F.lit("error").alias("status"), "error")
    return snapshots.rewrite(errors, videos, lambda rows: mutations.set_status(rows, errors)), index


def _without_beyond(index: Snapshot, known: DataFrame) -> Snapshot:
    """known: video_id, known. Frames of these videos from number ``known`` on go."""
    spark = known.sparkSession
    beyond = frame_index.frames(spark, index).join(known, "video_id").where("frame_index >= known")
    stray = saved(beyond.select("video_id", "frame_index").distinct(), "stray")
    if stray.isEmpty():
        return index
    return snapshots.rewrite(stray.select("video_id"), index, lambda rows: rows.join(stray, ["video_id", "frame_index"], "left_anti"))


def commit_unchanged(videos: DataFrame, frames: DataFrame, fresh: DataFrame, seen: DataFrame, now_ms) -> tuple[DataFrame, DataFrame]:
    """(videos, frames) after a batch. ``seen`` (video_id, size, mtime_ms) is what the files were after decoding.

    A video whose file is still the catalogue's has its frames committed and is ready; one that was replaced meanwhile loses
    all frames and is pending again; one of which nothing was seen stays as it is.
    """
    s = seen.select("video_id", F.col("size").alias("seen_size"), F.col("mtime_ms").alias("seen_ms"))
    judged = videos.join(s, F.col("id") == F.col("video_id")).select("id", ((F.col("size") == F.col("seen_size")) & (F.col("mtime_ms") == F.col("seen_ms"))).alias("same"))
    done, changed = judged.where("same").select("id"), judged.where("not same").select("id")
    kept = fresh.join(done.select(F.col("id").alias("video_id")), "video_id", "left_semi")
    after = mutations.commit_frames(frames, kept)
    v, f = mutations.reset_progress(mutations.mark_ready(videos, after, done, now_ms), after, changed)
    return mutations.set_pending(v, changed), f
