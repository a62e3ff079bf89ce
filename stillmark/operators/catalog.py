"""The catalogue of videos, folders and settings: lists, statistics, ownership by path, trees and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

SORTS = {"name": "name", "size": "size", "duration": "duration"}


def by_key(rows: DataFrame, column: str, value) -> DataFrame:
    """The rows with this id, path or folder: a filter that reaches the scan."""
    return rows.where(F.col(column) == F.lit(value))


def by_path(rows: DataFrame, path: str) -> DataFrame:
    """The video or folder at a path, however it is written; at most one, as path_key is unique."""
    return rows.where(F.col("path_key") == paths.path_key(F.lit(path)))


def folder_videos(videos: DataFrame, folder_id: int) -> DataFrame:
    return by_key(videos, "folder_id", folder_id).select("id", "path")


def compared_frames(frames: DataFrame) -> DataFrame:
    """How many frames a search looks at: all of them, whatever is pruned on the way."""
    return frames.agg(F.count("*").alias("compared"))


def indexer_status(jobs: DataFrame) -> DataFrame:
    """One row of counts over jobs (state): queued, active, done, failed, their total, and whether anything runs."""
    n = {s: F.count_if(F.col("state") == s) for s in ("active", "queued", "done", "failed")}
    return jobs.agg(*[c.alias(s) for s, c in n.items()]).withColumns({"total": F.col("active") + F.col("queued") + F.col("done") + F.col("failed"), "running": (F.col("active") > 0) | (F.col("queued") > 0)})


def in_arrival_order(rows: DataFrame, fresh: DataFrame, ascending: bool = False) -> DataFrame:
    """Loaded rows and fresh ones in one list by (added_at, id)."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("added_at", "id")]
    return rows.unionByName(fresh).orderBy(*order)


def filtered(videos: DataFrame, keyword: str | None = None, folder_id: int | None = None, status: str | None = None, text_columns: tuple[str, ...] = ("name", "dir")) -> DataFrame:
    """Rows whose name or directory matches the keyword (case-insensitive; % and _ in it are wildcards), and folder, and status."""
    out = videos
    if keyword and keyword.strip():
        pattern = f"%{keyword.strip()}%"
        match = F.lit(False)
        for c in text_columns:
            match = match | F.col(c).ilike(pattern)
        out = out.where(match)
    if folder_id is not None:
        out = out.where(F.col("folder_id") == folder_id)
    if status and status != "all":
        out = out.where(F.col("status") == status)
    return out


def sort_columns(sort: str = "added", order: str = "desc", id_column: str = "id") -> list[Column]:
    """Unknown values last either way; ties by id in the same direction."""
    column = F.col(SORTS.get(sort, "added_at"))
    if order == "asc":
        return [column.asc_nulls_last(), F.col(id_column).asc()]
    return [column.desc_nulls_last(), F.col(id_column).desc()]


def page(rows: DataFrame, sort: str = "added", order: str = "desc", limit: int = 200, offset: int = 0, id_column: str = "id") -> DataFrame:
    """One page: limit clamped to 1..2000, offset not below 0. The total is a count of ``rows``."""
    return rows.orderBy(*sort_columns(sort, order, id_column)).offset(max(0, offset)).limit(min(2000, max(1, limit)))


def next_sort(sort: str, order: str, clicked: str) -> tuple[str, str]:
    """A click on the current column flips its order; a new one starts upwards for names, downwards for the rest."""
    if clicked == sort:
        return sort, "asc" if order == "desc" else "desc"
    return clicked, "asc" if clicked == "name" else "desc"


def pending(videos: DataFrame) -> DataFrame:
    return videos.where(F.col("status").isin("pending", "indexing")).orderBy("added_at", "id")


def library_stats(videos: DataFrame, frames: DataFrame, folders: DataFrame) -> DataFrame:
    """One row: videos by status, bytes, frames, folders. Each part is one pass with partial sums."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    v = videos.agg(F.count("*").alias("total"), *map(count, ("ready", "pending", "indexing", "failed")), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    f = frames.agg(F.count("*").alias("frames"))
    d = folders.agg(F.count("*").alias("folders"), F.count_if("enabled").alias("enabled_folders"))
    return v.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(d))  # three rows of one


def folders_in_order(folders: DataFrame) -> DataFrame:
    return folders.orderBy(F.desc("pinned"), "added_at", "id")


def folder_summary(folders: DataFrame) -> DataFrame:
    """total, enabled, recursive and how many folders are in each watch state."""
    by_state = folders.groupBy("watch_state").agg(F.count("*").alias("n"), F.count_if("enabled").alias("enabled"), F.count_if("recursive").alias("recursive"))
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("watch_state", "n"))))
    return by_state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("enabled"), F.lit(0)).alias("enabled"), F.coalesce(F.sum("recursive"), F.lit(0)).alias("recursive"), states.alias("states"))


def closest_folder(items: DataFrame, folders: DataFrame, item_key: str = "id", excluded: int | None = None) -> DataFrame:
    """``items`` (item_key, path) with ``closest_id``: the folder with the longest path that encloses the item, or null.

    Each path is taken apart into its enclosing directories, which makes the prefix test an equi-join; the depth of paths,
    not the number of folders, bounds the rows.
    """
    own = folders if excluded is None else folders.where(F.col("id") != excluded)
    own = own.select(F.col("id").alias("closest_id"), F.when(F.length("path_key") > 1, F.regexp_replace("path_key", "/$", "")).otherwise(F.col("path_key")).alias("folder_key"))
    normal = items.select(F.col(item_key).alias("item"), paths.normalize_path(F.col("path")).alias("normal"))  # columns of their own: each is used many times for a path
    keyed = normal.select("item", paths.normal_key(F.col("normal")).alias("key"))
    above = keyed.select("item", F.explode(paths.ancestors(F.col("key"))).alias("folder_key"))
    best = above.join(own, "folder_key").groupBy("item").agg(F.max_by("closest_id", F.struct(F.length("folder_key"), -F.col("closest_id"))).alias("closest_id"))
    return items.join(best, items[item_key] == best["item"], "left").drop("item")


def reconcile_ownership(videos: DataFrame, folders: DataFrame) -> DataFrame:
    """Videos of a folder go to their closest one; videos without a folder, or outside all of them, stay as they are."""
    found = closest_folder(videos, folders)
    moved = F.when(F.col("folder_id").isNotNull(), F.coalesce("closest_id", "folder_id"))
    return found.withColumn("folder_id", moved).drop("closest_id")


def detach_folder(videos: DataFrame, folders: DataFrame, folder_id: int) -> DataFrame:
    """id, new_folder_id for each video of the folder: the closest other one; null means that the video is to be removed."""
    return closest_folder(videos.where(F.col("folder_id") == folder_id), folders, excluded=folder_id).select("id", F.col("closest_id").alias("new_folder_id"))


def subtree_counts(items: DataFrame) -> DataFrame:
    """node, n: how many items (column path) lie anywhere below each directory."""
    return items.select(F.explode(paths.ancestors(F.col("path"))).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def tree_rows(items: DataFrame) -> DataFrame:
    """node, parent, name, level, n of every directory, in preorder by name; missing levels between are made up."""
    nodes = subtree_counts(items)
    parent = F.when(F.col("node") == "/", None).otherwise(paths.dir_name(F.col("node")))
    return nodes.select("node", parent.alias("parent"), F.when(F.col("node") == "/", "/").otherwise(paths.file_name(F.col("node"))).alias("name"), F.when(F.col("node") == "/", 0).otherwise(paths.depth(F.col("node"))).alias("level"), "n").orderBy(F.split("node", "/"))


def first_seen(rows: DataFrame, id_column: str, position: str) -> DataFrame:
    """Distinct ids in the order of their first appearance."""
    return rows.groupBy(id_column).agg(F.min(position).alias("first_position")).orderBy("first_position")


def index_info(frames: DataFrame, frame_bytes: int = 256) -> DataFrame:
    """Frames, videos and bytes of the index. Videos first, so the distinct count is over partial groups."""
    by_video = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    return by_video.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.count("video_id").alias("videos"), (F.coalesce(F.sum("n"), F.lit(0)) * frame_bytes).alias("bytes"))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Queries (family, variant, expected, rank, n_hits) counted in total, by family and by variant in one pass."""
    positive = F.col("expected").isNotNull()
    sets = [[], ["family"], ["variant"]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "family", "variant").agg(
        F.count("*").alias("queries"),
        F.count_if(positive & (F.col("rank") == 1)).alias("top1"),
        F.count_if(positive & (F.col("rank") <= 5)).alias("top5"),
        F.count_if(positive & F.col("rank").isNull()).alias("missing"),
        F.count_if(~positive & (F.col("n_hits") > 0)).alias("false_positives"),
    )
    return out


def first_boundaries(cuts: DataFrame, key: str, time: str) -> DataFrame:
    """Shots between neighbouring cuts: start, end, length."""
    order = Window.partitionBy(key).orderBy(time)
    return cuts.withColumn("next", F.lead(time).over(order)).where("next is not null").select(key, F.col(time).alias("start"), F.col("next").alias("end"), (F.col("next") - F.col(time)).alias("length"))


def thumbnails(frames: DataFrame, target: str = "target", window: str = "window") -> DataFrame:
    """The frame nearest to each video's target time within its window, the first of equals."""
    off = F.abs(F.col("seconds") - F.col(target))
    return frames.where(off <= F.col(window)).groupBy("video_id").agg(F.min_by("frame_index", F.struct(off, F.col("frame_index"))).alias("frame_index"))


def prefix_complete(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """video_id, complete: are exactly frames 0..n-1 there? (expected: video_id, n; n = 0 needs none)."""
    seen = frames.groupBy("video_id").agg(F.count("*").alias("c"), F.min("frame_index").alias("low"), F.max("frame_index").alias("high"))
    joined = expected.join(seen, "video_id", "left")
    full = (F.col("c") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return joined.select("video_id", "n", F.when(F.col("n") == 0, True).otherwise(F.coalesce(full, F.lit(False))).alias("complete"))
