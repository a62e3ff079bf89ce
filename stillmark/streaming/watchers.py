"""Which folders are watched, and how often their state is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Milliseconds between broadcasts, and the word for a paused folder.
STATUS_MS, STATS_MS, IMPORT_MS = 200, 500, 200
PAUSED = "已暂停监听"


def watcher_changes(folders: DataFrame, running: DataFrame) -> DataFrame:
    """folder_id, action (start or stop): the difference of enabled folders and running watchers (folder_id)."""
    wanted = folders.where("enabled").select(F.col("id").alias("folder_id"))
    start = wanted.join(running.select("folder_id"), "folder_id", "left_anti").withColumn("action", F.lit("start"))
    stop = running.select("folder_id").distinct().join(wanted, "folder_id", "left_anti").withColumn("action", F.lit("stop"))
    return start.unionByName(stop)


def watched_states(folders: DataFrame, present: DataFrame) -> DataFrame:
    """folders after the watchers are in step: enabled ones are watching, or missing where their path isn't ``present``
    (path_key); pinned paused ones idle; others stay."""
    there = present.select(F.col("path_key").alias("there_key")).distinct()
    joined = folders.join(there, F.col("path_key") == F.col("there_key"), "left")
    paused = ~F.col("enabled") & F.col("pinned")
    state = F.when(F.col("enabled"), F.when(F.col("there_key").isNotNull(), "watching").otherwise("missing")).when(paused, "idle").otherwise(F.col("watch_state"))
    message = F.when(F.col("enabled"), F.lit(None).cast("string")).when(paused, PAUSED).otherwise(F.col("message"))
    return joined.withColumns({"watch_state": state, "message": message}).drop("there_key")


def import_reports(progress: DataFrame, interval_ms: int = IMPORT_MS) -> DataFrame:
    """The steps of a batch (id, at_ms, processed, total) that are told: the first of each interval, and always the last."""
    order = Window.partitionBy("id", F.floor(F.col("at_ms") / interval_ms)).orderBy("at_ms", "processed")
    final = (F.col("total") > 0) & (F.col("processed") >= F.col("total"))
    return progress.withColumn("place", F.row_number().over(order)).where((F.col("place") == 1) | final).drop("place")


def folder_list(folders: DataFrame, events: DataFrame) -> DataFrame:
    """The list after folder events (revision, type ``updated`` or ``deleted``, and the columns of ``folders``)."""
    from .changes import apply_changes

    return apply_changes(folders, events)
