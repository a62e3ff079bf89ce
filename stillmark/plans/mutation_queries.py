"""Lookups, mutations and formats over whole tables. Orders stand for videos, suppliers for folders, lineitems for frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint, formats, paths, sampling
from ..operators import catalog, mutations
from ..schemas import STRUCT_WORDS
from ..sources import media, web
from . import lifecycle
from .registry import query, table

VIDEOS = "videos AS (SELECT o_orderkey AS id, '/lib/' || o_custkey % 50 || '/' || o_orderkey || '.mp4' AS path, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'old' END AS error, o_custkey % 50 AS folder_id FROM orders)"


def videos_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('/lib/', o_custkey % 50, '/', o_orderkey, '.mp4') AS path", "o_orderstatus AS status", "IF(o_orderkey % 2 = 0, 'old', NULL) AS error", "o_custkey % 50 AS folder_id", "CAST(NULL AS STRING) AS file_hash", "3L AS frame_count", "array(1L) AS processed_timestamps"
    )
    return v.withColumn("path_key", paths.path_key(F.col("path")))


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("frame_index"))


@query("SELECT l_orderkey AS video_id, l_linenumber AS frame_index FROM lineitem WHERE l_orderkey = 3 ORDER BY 2")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of one video: the filter reaches the scan."""
    return catalog.by_key(frames_of(spark, sf_dir), "video_id", 3).orderBy("frame_index")


@query(f"WITH {VIDEOS} SELECT id, path FROM videos WHERE folder_id = 7")
def folder_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.folder_videos(videos_of(spark, sf_dir), 7)


@query(f"WITH {VIDEOS} SELECT id, status FROM videos WHERE path = (SELECT max(path) FROM videos WHERE id = 1)")
def video_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video by its path, written with a slash too many."""
    videos = videos_of(spark, sf_dir)
    (one,) = catalog.by_key(videos, "id", 1).select("path").collect()
    return catalog.by_path(videos, one.path + "/").select("id", "status")


@query("SELECT count(*) AS compared FROM lineitem")
def compared_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.compared_frames(frames_of(spark, sf_dir))


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS active, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'F') AS done, 0::BIGINT AS failed, count(*) AS total, count(*) FILTER (o_orderstatus IN ('P', 'O')) > 0 AS running FROM orders")
def indexer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.indexer_status(table(spark, sf_dir, "orders").selectExpr("CASE o_orderstatus WHEN 'P' THEN 'active' WHEN 'O' THEN 'queued' ELSE 'done' END AS state"))


@query("SELECT id, added_at FROM (SELECT o_orderkey AS id, o_custkey AS added_at FROM orders) ORDER BY 2, 1")
def arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders loaded, odd ones fresh, in one list."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS added_at")
    return catalog.in_arrival_order(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ascending=True)


@query(f"WITH {VIDEOS} SELECT 'video-removed' AS type, id AS video_id, path FROM videos WHERE path LIKE '/lib/7/%'")
def remove_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a removed directory; its name begins that of others, which stay."""
    events, _ = mutations.remove_under("/lib/7/", videos_of(spark, sf_dir), frames_of(spark, sf_dir))
    return events


@query(f"WITH {VIDEOS} SELECT count(*) AS frames, count(DISTINCT l_orderkey) AS videos FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM videos WHERE path LIKE '/lib/7/%')")
def frames_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (_, frames) = mutations.remove_under("/lib/7", videos_of(spark, sf_dir), frames_of(spark, sf_dir))
    return frames.agg(F.count("*").alias("frames"), F.count_distinct("video_id").alias("videos"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS under FROM part")
def paths_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly inside: neither the directory itself nor one whose name it begins."""
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/a/"), k.cast("string"))).when(k % 3 == 1, "/a").otherwise(F.concat(F.lit("/ab/"), k.cast("string")))
    videos = table(spark, sf_dir, "part").select("p_partkey", k.alias("id"), path.alias("path_key"))
    found = mutations.ids_under(videos, "/a/").select(F.col("id").alias("found_id"))
    return videos.join(found, F.col("id") == F.col("found_id"), "left").select("p_partkey", F.col("found_id").isNotNull().alias("under"))


@query(f"WITH {VIDEOS} SELECT id, CASE WHEN id % 5 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'e' || id ELSE error END AS error FROM videos")
def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = videos_of(spark, sf_dir)
    return mutations.set_status(videos, videos.where("id % 5 = 0").selectExpr("id", "'failed' AS status", "concat('e', id) AS error")).select("id", "status", "error")


@query(f"WITH {VIDEOS} SELECT id, CASE WHEN id % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN NULL ELSE error END AS error FROM videos")
def set_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = videos_of(spark, sf_dir)
    return mutations.set_pending(videos, videos.where("id % 3 = 0").select("id")).select("id", "status", "error")


@query(f"WITH {VIDEOS} SELECT id, CASE WHEN id % 4 = 0 THEN sha256(id::VARCHAR) END AS file_hash FROM videos")
def set_file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = videos_of(spark, sf_dir)
    fresh = videos.where("id % 4 = 0").select("id", F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    return mutations.update_rows(videos, fresh).select("id", "file_hash")


@query(f"WITH {VIDEOS} SELECT id, CASE WHEN folder_id = 7 THEN NULL ELSE folder_id END AS folder_id FROM videos")
def remove_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = videos_of(spark, sf_dir)
    return mutations.remove_folder(videos.select(F.col("folder_id").alias("id")).distinct(), videos, 7)[1].select("id", "folder_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 3 END::BIGINT AS frame_count, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS saved, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE coalesce(n, 0) END AS frames FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def reset_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = videos_of(spark, sf_dir)
    v, f = mutations.reset_progress(videos, frames_of(spark, sf_dir), videos.where("id % 6 = 0").select("id"))
    left = f.groupBy(F.col("video_id").alias("of")).agg(F.count("*").alias("n"))
    return v.join(left, F.col("id") == F.col("of"), "left").select("id", "frame_count", F.size("processed_timestamps").alias("saved"), F.coalesce("n", F.lit(0)).alias("frames"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'indexing' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS saved FROM orders")
def record_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = videos_of(spark, sf_dir).withColumn("processed_ms", F.lit(0).cast("long"))
    steps = videos.where("id % 2 = 0").selectExpr("id AS video_id", "array(1L, 2L, 3L) AS saved", "10L AS elapsed")
    return mutations.record_progress(videos, steps).select("id", "status", F.size("processed_timestamps").alias("saved"))


@query("SELECT p_partkey AS video_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS cache_key, CASE WHEN p_partkey % 3 = 0 THEN '[0.5,' || p_partkey || '.0]' ELSE '[]' END AS scene_times FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def put_scene_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part")
    cache = ids.where("p_partkey % 2 = 0").selectExpr("p_partkey AS video_id", "'old' AS cache_key", "'[]' AS scene_times")
    return mutations.put_scene_times(cache, ids.where("p_partkey % 3 = 0").selectExpr("p_partkey AS video_id", "'new' AS cache_key", "array(0.5D, CAST(p_partkey AS DOUBLE)) AS times"))


@query("SELECT l_orderkey, l_linenumber, l_quantity > 10 AND l_linenumber % 3 > 0 AND l_partkey % 2 = 0 AS reused FROM lineitem")
def hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    size = F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0)
    return li.select("l_orderkey", "l_linenumber", mutations.can_reuse_hash(size, F.col("l_linenumber") % 3, size, F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber") % 3).otherwise(9)).alias("reused"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'error' ELSE 'idle' END AS watch_state, CASE WHEN s_suppkey % 2 = 0 THEN 'gone' END AS message FROM supplier")
def update_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "'idle' AS watch_state", "CAST(NULL AS STRING) AS message")
    return mutations.update_rows(folders, folders.where("id % 2 = 0").selectExpr("id", "'error' AS watch_state", "'gone' AS message"))


@query("SELECT s_suppkey::BIGINT AS id, '/f/' || s_suppkey AS path_key, s_suppkey % 2 = 0 AS pinned, true AS enabled FROM supplier UNION ALL SELECT max(s_suppkey) + 1, '/f/new', false, false FROM supplier")
def imported_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-time import of a new directory, and of one that is watched already."""
    folders = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS BIGINT) AS id", "concat('/f/', s_suppkey) AS path", "concat('/f/', s_suppkey) AS path_key", "'x' AS name", "s_suppkey % 2 = 0 AS pinned", "true AS enabled", "true AS recursive", "'idle' AS watch_state", "CAST(NULL AS STRING) AS message", "0L AS added_at", "CAST(NULL AS BIGINT) AS last_scan_at"
    )
    out = mutations.insert_imported_folder(mutations.insert_imported_folder(folders, "/f/new/", True, 5), "/f/1", True, 6)
    return out.select("id", "path_key", "pinned", "enabled")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'FFmpeg 无法读取该文件或其片段' ELSE '探测媒体失败：x' || event_id END AS reason FROM events")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_id") % 2 == 0, F.lit("ffprobe 失败: 1")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", formats.failure_message(F.lit("探测媒体"), error).alias("reason"))


@query("""SELECT event_id, '{"type":"video-removed","video_id":' || user_id || CASE WHEN event_id % 2 = 0 THEN ',"path":"/a/' || event_id || '"' ELSE '' END || '}' AS line FROM events""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/a/"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", formats.event_json(F.lit("video-removed"), video_id=F.col("user_id"), path=path).alias("line"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS id FROM events")
def guarded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only objects of the agreed shape come through: no broken JSON, no missing field, no number that isn't finite."""
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    json = F.when(k == 0, F.concat(F.lit('{"id":'), n, F.lit(',"share":0.5}'))).when(k == 1, F.concat(F.lit('{"id":'), n)).when(k == 2, F.lit('{"share":1}')).otherwise(F.concat(F.lit('{"id":'), n, F.lit(',"share":1e999}')))
    return table(spark, sf_dir, "events").select("event_id", formats.guarded(json, "id long not null, share double")["id"].alias("id"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{"version":1,"threshold":4599075939470750515,"video":{"path":"/v/' || p_partkey || '","size":' || p_size || ',"ns":7},"tool":{"path":"/bin/t","size":9,"ns":8}}' END AS cache_key FROM part""")
def scene_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists, every other part, have no key."""
    name = F.concat(F.lit("/v/"), F.col("p_partkey").cast("string"))
    video = F.struct(name.alias("path"), F.col("p_size").alias("size"), F.lit(7).alias("ns"))
    tool = F.struct(F.lit("/bin/t").alias("path"), F.lit(9).alias("size"), F.lit(8).alias("ns"))
    path = F.concat(name, F.when(F.col("p_partkey") % 2 == 0, ".MKV").otherwise(".m3u8"))
    return table(spark, sf_dir, "part").select("p_partkey", sampling.scene_cache_key(path, 0.3, video, tool).alias("cache_key"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/a/x.ts' WHEN p_partkey % 4 = 1 THEN '/a/b/' || p_partkey || '.ts' WHEN p_partkey % 4 = 2 THEN '/top.ts' ELSE '/a/b/c/d/e/f/g/s/1.ts' END AS part FROM part")
def playlist_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts named with any number of dots against their playlist's directory."""
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, "../../../../../../x.ts").when(k == 1, F.concat(F.lit("./../../.././../../"), F.col("p_partkey").cast("string"), F.lit(".ts"))).when(k == 2, "../../../../../../../../../../top.ts").otherwise("./s//1.ts")
    lists = table(spark, sf_dir, "part").select("p_partkey", F.lit("/a/b/c/d/e/f/g/l.m3u8").alias("path"), F.concat(F.lit("#EXTM3U\n"), line).alias("text"))
    joined = paths.fold_dots(F.concat(paths.dir_name(F.col("path")), F.lit("/"), F.split("text", "\n")[1]))
    known = media.playlist_parts(lists)  # each part once
    return lists.select("p_partkey", joined.alias("part")).join(known, "part", "left_semi")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://e.org/d/p?q=1' WHEN 1 THEN 'https://e.org/d/p?x=2' WHEN 2 THEN 'https://e.org/d/p?x=2#s' WHEN 3 THEN 'https://e.org/z/' ELSE 'https://e.org/d/k/i.png?../a' END AS link FROM pages")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    link = F.when(k == 0, "?q=1").when(k == 1, "./p?x=2").when(k == 2, "#s").when(k == 3, "../../../../../../../../../../z/y/..").otherwise("k/./i.png?../a")
    return table(spark, sf_dir, "pages").select("page_id", web.absolute(F.lit("https://e.org/d/p?x=2#old"), link).alias("link"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 END::BIGINT AS closest_id FROM part")
def windows_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest folder of Windows paths, in any case and with either separator."""
    n = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("C:\\Media\\"), n, F.lit(".mp4"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("c:/media/Sub/x/"), n, F.lit(".mp4"))).otherwise(F.concat(F.lit("C:\\Media2\\"), n))
    folders = spark.createDataFrame([(1, "c:\\media"), (2, "c:\\media\\sub")], "id long, path_key string")
    return catalog.closest_folder(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path")), folders).select("id", "closest_id")


WORDS = ", ".join(f"(vec_id * {7919 + 2 * i} + {i})::BIGINT AS s{i}" for i in range(16))


@query(f"SELECT vec_id, vec_id * 104729 AS dhash, (SELECT sum(x) FROM (VALUES {', '.join(f'(s{i})' for i in range(16))}) AS t(x))::BIGINT AS words, 255 AS color, 7 AS spatial, vec_id AS frame_index, vec_id * 1000 AS time_ms, 256 AS size FROM (SELECT vec_id, {WORDS} FROM embeddings)")
def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames packed to records of 256 bytes and read back."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id * 104729 AS dhash", *[f"vec_id * {7919 + 2 * i} + {i} AS s{i}" for i in range(16)], "array_repeat(255, 64) AS color", "array_repeat(7, 48) AS spatial")
    record = fingerprint.pack_frame(F.col("dhash"), [F.col(w) for w in STRUCT_WORDS], F.col("color"), F.col("spatial"), F.col("vec_id"), F.col("vec_id") * 1000)
    back = e.select("vec_id", record.alias("r")).select("vec_id", F.octet_length("r").alias("size"), *[c.alias(k) for k, c in fingerprint.unpack_frame(F.col("r")).items()])
    words = sum((F.col(w) for w in STRUCT_WORDS[1:]), F.col("s0"))
    return back.select("vec_id", "dhash", words.alias("words"), F.array_max("color").alias("color"), F.array_min("spatial").alias("spatial"), "frame_index", "time_ms", "size")


@query(
    """WITH v AS (SELECT o_orderkey, greatest(1, ceil(o_totalprice / 10000 / 5))::INT AS size, CASE WHEN o_custkey % 4 = 0 THEN least(2, greatest(1, ceil(o_totalprice / 10000 / 5)))::INT ELSE 0 END AS k FROM orders WHERE o_orderstatus <> 'F'),
f AS (SELECT l_orderkey, count(*) AS c, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
r AS (SELECT o_orderkey, size, CASE WHEN k > 0 AND c = k AND low = 1 AND high = k THEN k ELSE 0 END AS resume_at FROM v LEFT JOIN f ON o_orderkey = l_orderkey)
SELECT o_orderkey AS video_id, resume_at, size - resume_at AS left_over FROM r"""
)
def pending_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a restart: every fourth customer's videos have two saved frames; those that are really there count."""
    v = table(spark, sf_dir, "orders")
    plan = sampling.uniform_plan(F.col("o_totalprice") / 10000, F.lit(5))
    saved = F.when(F.col("o_custkey") % 4 == 0, F.slice(sampling.planned_ms(plan), F.lit(1), F.lit(2))).otherwise(F.array().cast("array<long>"))
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "indexing").otherwise("pending")
    videos = v.select(F.col("o_orderkey").alias("id"), status.alias("status"), saved.alias("processed_timestamps"))
    plans = v.select(F.col("o_orderkey").alias("video_id"), F.lit("x").alias("path"), plan.alias("seconds"), F.lit(False).alias("full_scan"))
    frames = frames_of(spark, sf_dir).where("frame_index <= 2").withColumn("frame_index", F.col("frame_index") - 1)  # a batch of two was cut off
    return lifecycle.pending_plan(videos, frames, plans).select("video_id", "resume_at", F.size("seconds").alias("left_over"))
