"""The library as a tree of directories: nested folders, videos where they are, loose ones last, in a language's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .mutations import numbered
from .shared import saved

LANGUAGE = "zh"
ROW = ["type", "path", "video_id", "name", "depth", "n"]


def _step(kind: int, name: Column, raw: Column, position: Column) -> Column:
    """A place among what stands in one directory: folders by name in the language's order, videos, then the empty mark."""
    return F.struct(F.lit(kind).alias("kind"), F.collate(name.cast("string"), LANGUAGE).alias("name"), raw.cast("string").alias("raw"), position.cast("long").alias("position"))


def roots(folders: DataFrame) -> DataFrame:
    """id, path, name, root (path) and root_name of each folder: the outermost folder that holds it, or itself."""
    f = folders.select("id", paths.normalize_path(F.col("path")).alias("path"), "name").withColumn("folder_key", paths.normal_key(F.col("path")))
    above = f.select(F.col("id").alias("of"), F.explode(paths.ancestors(F.col("path"))).alias("up")).select("of", paths.normal_key(F.col("up")).alias("up_key"))
    holder = f.select(F.col("folder_key").alias("up_key"), F.struct(F.length("path").alias("size"), F.col("path").alias("path"), F.col("name").alias("name")).alias("holder"))
    outer = above.join(holder, "up_key").groupBy("of").agg(F.min("holder").alias("holder"))
    joined = f.join(outer, F.col("id") == F.col("of"), "left")
    return joined.select("id", "path", "name", F.coalesce("holder.path", "path").alias("root"), F.coalesce("holder.name", "name").alias("root_name"))


def explorer_rows(folders: DataFrame, videos: DataFrame, expanded: DataFrame, closed: DataFrame | None = None, reveal_all: bool = False) -> DataFrame:
    """type (folder, video, empty), path, video_id, name, depth, n, position: the rows of the tree that are on show, in preorder.

    folders: id, path, name; videos: id, dir, folder_id, position (their order within a directory); expanded and closed:
    path_key. Folders nest by path; levels between are made up. A video stands in its directory if its folder is known and
    holds it, else loose at the end. ``n`` counts the videos in and below a directory. What a directory holds is shown if it
    is expanded or ``reveal_all`` is set, and it isn't closed; one without any videos then has an ``empty`` row.
    """
    known = saved(roots(folders), "folders")
    dirs = videos.select(F.col("id").alias("video_id"), paths.normalize_path(F.col("dir")).alias("dir"), "folder_id", "position")
    owner = known.select(F.col("id").alias("owner_id"), F.col("path").alias("owner_path"), "root", "root_name")
    joined = dirs.join(owner, F.col("folder_id") == F.col("owner_id"), "left")
    held = F.coalesce(paths.contains(paths.normal_key(F.col("owner_path")), paths.normal_key(F.col("dir"))), F.lit(False))
    judged = saved(joined.withColumn("held", held), "placed")
    placed, loose = judged.where("held"), judged.where("not held")

    counted = placed.groupBy("root", "root_name", "dir").agg(F.count("*").alias("n"))
    every = counted.unionByName(known.select("root", "root_name", F.col("path").alias("dir"), F.lit(0).cast("long").alias("n")))
    below = F.filter(F.split(F.expr("substring(dir, length(root) + 1)"), paths.SEPARATORS), lambda p: p != "")
    level = saved(every.withColumn("parts", below), "levels")
    level = level.withColumn("level", F.explode(F.sequence(F.lit(0), F.size("parts"))))
    sep = paths.separator(F.col("root"))
    made = F.concat(F.regexp_replace("root", r"[\\/]$", ""), sep, F.array_join(F.slice("parts", F.lit(1), F.col("level")), "\u0000"))
    node = F.when(F.col("level") == 0, F.col("root")).otherwise(F.replace(made, F.lit("\u0000"), sep))
    nodes = level.select("root", "root_name", "level", F.slice("parts", F.lit(1), F.col("level")).alias("parts"), node.alias("path"), "n").withColumn("node_key", paths.normal_key(F.col("path")))
    first = F.min(F.struct("path", "parts", "root", "root_name", "level")).alias("first")
    nodes = nodes.groupBy("node_key").agg(first, F.sum("n").alias("n")).select("node_key", "first.*", "n")
    steps = F.concat(F.array(_step(0, F.col("root_name"), F.col("root"), F.lit(0))), F.transform("parts", lambda p: _step(0, p, p, F.lit(0))))
    shown = expanded.select(F.col("path_key").alias("node_key")).distinct().withColumn("is_open", F.lit(True))
    shut = (closed if closed is not None else expanded.where(F.lit(False))).select(F.col("path_key").alias("node_key")).distinct().withColumn("is_shut", F.lit(True))
    opened = F.coalesce("is_open", F.lit(reveal_all)) & F.col("is_shut").isNull()
    nodes = nodes.join(shown, "node_key", "left").join(shut, "node_key", "left").withColumns({"opened": opened, "steps": steps})
    nodes = saved(nodes.select("node_key", "path", paths.normal_key(F.col("root")).alias("root_key"), F.when(F.col("level") == 0, F.col("root_name")).otherwise(F.element_at("parts", -1)).alias("name"), F.col("level").alias("depth"), "n", "opened", "steps"), "nodes")

    inside = F.filter(paths.ancestors(F.col("node_key")), lambda up: paths.contains(F.col("root_key"), up))
    up = nodes.select(F.col("node_key").alias("of"), F.explode(inside).alias("up_key"))
    hidden = up.join(nodes.where("not opened").select(F.col("node_key").alias("up_key")), "up_key", "left_semi").select(F.col("of").alias("node_key"))
    visible = nodes.join(hidden, "node_key", "left_anti")
    folder_rows = visible.select(F.lit("folder").alias("type"), "path", F.lit(None).cast("long").alias("video_id"), "name", "depth", "n", "steps")
    open_nodes = visible.where("opened")
    none = F.lit(None)
    empty = open_nodes.where("n = 0").select(F.lit("empty").alias("type"), "path", none.cast("long").alias("video_id"), none.cast("string").alias("name"), (F.col("depth") + 1).alias("depth"), none.cast("long").alias("n"), F.concat("steps", F.array(_step(2, none, none, F.lit(0)))).alias("steps"))

    def video(depth: Column, before: Column | None) -> list[Column]:
        own = F.array(_step(1, none, none, F.col("position")))
        return [F.lit("video").alias("type"), none.cast("string").alias("path"), F.col("video_id").cast("long").alias("video_id"), none.cast("string").alias("name"), depth.cast("int").alias("depth"), none.cast("long").alias("n"), (own if before is None else F.concat(before, own)).alias("steps")]

    at = placed.select("video_id", "position", paths.normal_key(F.col("dir")).alias("node_key")).join(open_nodes.select("node_key", "depth", "steps"), "node_key")
    rows = folder_rows.unionByName(empty).unionByName(at.select(*video(F.col("depth") + 1, F.col("steps")))).unionByName(loose.select(*video(F.lit(0), None)))
    return numbered(rows.withColumn("video_last", F.coalesce("video_id", F.lit(0))), ["steps", "video_last"], "position").select(*ROW, "position")
