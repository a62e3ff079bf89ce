"""Frame pictures in a shared store, ``<video>/<generation>/<ms>.jpg``: written by tasks, valid by a table of generations.

Beginning to write a video's pictures gives it the next generation, which revokes all earlier writers. A late writer's files
are in a folder of their own, so they never mix with valid ones; its commit is refused and leaves nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snapshots
from ..operators.shared import saved
from ..operators.snapshots import Snapshot

GENERATIONS = "video_id long, generation long"
WRITTEN = "video_id long, generation long, time_ms long, size long"


def _opened(path: str):
    """(file system, path in it) of a folder that driver and executors share."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def new_store(spark, root: str) -> Snapshot:
    """The generations of an empty store: ``video_id, generation`` of each video's current writer."""
    return snapshots.create(spark.createDataFrame([], GENERATIONS), f"{root}/generations", "video_id")


def begin(video_ids: DataFrame, generations: Snapshot) -> tuple[DataFrame, Snapshot]:
    """(tokens, generations): the next generation of each video. Tokens of earlier ones are worth nothing from now on."""
    ids = video_ids.select(F.col("video_id").cast("long")).distinct()
    latest = snapshots.read(ids.sparkSession, generations).drop("bucket").withColumnRenamed("video_id", "of")
    tokens = saved(ids.join(latest, F.col("video_id") == F.col("of"), "left").select("video_id", (F.coalesce("generation", F.lit(0)) + 1).alias("generation")), "tokens")
    return tokens, snapshots.rewrite(ids, generations, lambda rows: rows.join(ids, "video_id", "left_anti").unionByName(tokens))


def write(frames: DataFrame, tokens: DataFrame, root: str, encode: Callable[[bytes, int, int], bytes]) -> DataFrame:
    """The files of frames (video_id, time_ms, rgb, width, height) by the writer that has ``tokens``; a row for each.

    Frames of other videos, and those whose bytes aren't width * height * 3, are passed over. A task that runs again writes the
    same files again. ``encode`` runs on the executors.
    """

    def store(batches):
        fs, inside = _opened(root)
        for batch in batches:
            sizes = []
            for r in batch.to_pylist():
                folder = f"{inside}/{r['video_id']}/{r['generation']}"
                fs.create_dir(folder, recursive=True)
                data = encode(r["rgb"], r["width"], r["height"])
                with fs.open_output_stream(f"{folder}/{r['time_ms']}.jpg") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([*batch.select(["video_id", "generation", "time_ms"]).columns, pa.array(sizes, pa.int64())], ["video_id", "generation", "time_ms", "size"])

    whole = F.octet_length("rgb") == F.col("width") * F.col("height") * 3
    mine = frames.where(whole).join(tokens, "video_id").select("video_id", "generation", F.col("time_ms").cast("long").alias("time_ms"), F.col("rgb").cast("binary").alias("rgb"), "width", "height")
    return saved(mine.mapInArrow(store, WRITTEN), "pictures")


def commit(written: DataFrame, root: str) -> DataFrame:
    """The rows of ``written`` whose writer is still the video's current one. Folders of others go: those of a late writer,
    and, where a current one commits, those of the generations before it."""
    spark = written.sparkSession
    now = snapshots.read(spark, snapshots.current(spark, f"{root}/generations")).drop("bucket")
    current = now.select(F.col("video_id").alias("of"), F.col("generation").alias("valid"))
    judged = written.join(current, F.col("video_id") == F.col("of"), "left")

    def clear(batches):
        import pyarrow.fs as pafs

        fs, inside = _opened(root)
        for batch in batches:
            for video, valid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for folder in fs.get_file_info(pafs.FileSelector(f"{inside}/{video}", allow_not_found=True)):
                    if valid is None or int(folder.base_name) < valid:
                        fs.delete_dir(folder.path)
                if not fs.get_file_info(pafs.FileSelector(f"{inside}/{video}", allow_not_found=True)) and valid is None:
                    fs.delete_dir_contents(f"{inside}/{video}", missing_dir_ok=True)
            yield batch

    touched = judged.select("video_id", "valid").distinct()
    cleared = saved(touched.mapInArrow(clear, "video_id long, valid long"), "cleared")
    kept = judged.where(F.col("generation") == F.col("valid")).select(*written.columns)
    return kept.join(cleared.select("video_id"), "video_id", "left_semi")


def remove(video_ids: DataFrame, generations: Snapshot, root: str) -> Snapshot:
    """Videos that are gone: their writers are revoked for good, as the next generation has no writer, and their files go."""
    tokens, now = begin(video_ids, generations)
    commit(tokens.select("video_id", F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("time_ms"), F.lit(0).cast("long").alias("size")), root)
    return now
