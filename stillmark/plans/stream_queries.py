"""Change-stream queries: their batch forms over the events and orders tables, and one that runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir
from ..streaming import changes, debounce, notices, watchers
from .registry import query, table


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query(
    """SELECT user_id, min(t) AS first_ms, max(t) + 3600000 AS due_ms, count(*) AS n FROM (
  SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS burst FROM (
    SELECT user_id, (epoch_us(ts) // 1000) AS t, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, burst"""
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce.debounced(timed(spark, sf_dir).select("user_id", "at_ms"), "user_id", "at_ms", 3_600_000)


DUE_SQL = """SELECT 'p' || user_id AS path_key, t + 7200000 AS due_ms FROM (
  SELECT user_id, event_type, (epoch_us(ts) // 1000) AS t, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
WHERE event_type NOT IN ('error') AND (following IS NULL OR following - t >= 7200000)"""


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "create").otherwise("modify")
    key = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    return timed(spark, sf_dir).select(key.alias("path_key"), key.alias("path"), F.lit(1).cast("long").alias("folder_id"), kind.alias("kind"), "at_ms")


@query(DUE_SQL)
def due_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced imports that no removal cancelled."""
    return debounce.due_imports(file_events(spark, sf_dir), 7_200_000).select("path_key", "due_ms")


@query("SELECT 'p' || user_id AS path_key FROM events GROUP BY user_id HAVING arg_max(event_type, ts) = 'error'")
def pruned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce.removals(file_events(spark, sf_dir))


@query(
    """SELECT event_type AS level, user_id AS message, min(t) AS first_ms, max(t) AS last_ms, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY event_type, user_id ORDER BY t) AS notice FROM (
    SELECT event_type, user_id, (epoch_us(ts) // 1000) AS t, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type, user_id ORDER BY ts) < 20000000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY event_type, user_id, notice"""
)
def notice_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).select(F.col("event_type").alias("level"), F.col("user_id").alias("message"), "at_ms")
    return notices.notices(rows, ["level", "message"], "at_ms", 20_000_000)


@query(
    """WITH RECURSIVE t AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
fold(user_id, i, anchor, held, out_at, out_held) AS (
  SELECT user_id, i, t, 0::BIGINT, t, 0::BIGINT FROM t WHERE i = 1
  UNION ALL
  SELECT f.user_id, t.i, CASE WHEN t.t - anchor < 30000000 THEN anchor ELSE t.t END, CASE WHEN t.t - anchor < 30000000 THEN held + 1 ELSE 0 END,
         CASE WHEN t.t - anchor < 30000000 THEN NULL ELSE t.t END, CASE WHEN t.t - anchor < 30000000 THEN NULL ELSE held END
  FROM fold f JOIN t ON f.user_id = t.user_id AND t.i = f.i + 1)
SELECT user_id, out_at AS at_ms, out_held AS suppressed FROM fold WHERE out_at IS NOT NULL"""
)
def repeat_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.emitted(timed(spark, sf_dir).select("user_id", "at_ms"), "user_id", "at_ms", 30_000_000)


@query(
    """WITH RECURSIVE life(level, ttl) AS (VALUES ('info', 5000), ('warn', 8000), ('error', 12000)),
t AS (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY ms, level, message) AS i FROM (
  SELECT user_id % 3 AS viewer, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'warn' END AS level, event_type || user_id % 2 AS message, (epoch_us(ts) // 1000) // 100000 AS ms FROM events)),
fold(viewer, i, stack, ended) AS (
  SELECT viewer, i, [{'level': level, 'message': message, 'f': ms, 'l': ms, 'n': 1}], [{'level': '', 'message': '', 'f': 0::BIGINT, 'l': 0::BIGINT, 'n': 1, 'e': 0::BIGINT}][1:0] FROM t WHERE i = 1
  UNION ALL
  SELECT viewer, i, CASE WHEN same IS NULL THEN list_concat([{'level': level, 'message': message, 'f': ms, 'l': ms, 'n': 1}], alive[1:3])
                         ELSE list_concat([{'level': level, 'message': message, 'f': same.f, 'l': ms, 'n': same.n + 1}], list_filter(alive, lambda x: x != same)) END,
         list_concat(list_transform(over, lambda x: {'level': x.level, 'message': x.message, 'f': x.f, 'l': x.l, 'n': x.n, 'e': x.l + CASE x.level WHEN 'info' THEN 5000 WHEN 'warn' THEN 8000 ELSE 12000 END}),
                     CASE WHEN same IS NULL THEN list_transform(alive[4:], lambda x: {'level': x.level, 'message': x.message, 'f': x.f, 'l': x.l, 'n': x.n, 'e': ms}) ELSE [] END)
  FROM (SELECT *, list_filter(alive, lambda x: x.level = lv AND x.message = mg AND ms - x.l < 2000)[1] AS same FROM (
    SELECT t.*, t.level AS lv, t.message AS mg,
      list_filter(f.stack, lambda x: x.l + CASE x.level WHEN 'info' THEN 5000 WHEN 'warn' THEN 8000 ELSE 12000 END > t.ms) AS alive,
      list_filter(f.stack, lambda x: x.l + CASE x.level WHEN 'info' THEN 5000 WHEN 'warn' THEN 8000 ELSE 12000 END <= t.ms) AS over
    FROM fold f JOIN t ON f.viewer = t.viewer AND t.i = f.i + 1))),
told AS (
  SELECT viewer, unnest(ended) AS x FROM fold
  UNION ALL SELECT viewer, {'level': x.level, 'message': x.message, 'f': x.f, 'l': x.l, 'n': x.n, 'e': x.l + ttl}
  FROM (SELECT viewer, unnest(stack) AS x FROM fold QUALIFY i = max(i) OVER (PARTITION BY viewer)) JOIN life ON x.level = life.level)
SELECT viewer, x.level AS level, x.message AS message, x.f AS first_ms, x.l AS last_ms, x.n AS n, x.e AS ended_ms FROM told"""
)
def notice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice that was on show to each of three viewers, events taken as one in a hundred seconds."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").otherwise("warn")
    message = F.concat("event_type", (F.col("user_id") % 2).cast("string"))
    rows = timed(spark, sf_dir).select((F.col("user_id") % 3).alias("viewer"), level.alias("level"), message.alias("message"), F.floor(F.col("at_ms") / 100000).alias("at_ms"))
    return notices.notice_log(rows, "viewer")


VIEW_SQL = """rows AS (SELECT o_orderkey AS id, o_orderstatus AS status, floor(o_totalprice)::BIGINT AS size FROM orders),
changed AS (SELECT event_id AS revision, user_id * 4 AS id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'updated' END AS type, CASE WHEN event_type = 'view' THEN 'P' ELSE 'F' END AS status, floor(value * 100)::BIGINT AS size FROM events),
last AS (SELECT id, arg_max(type, revision) AS type, arg_max(status, revision) AS status, arg_max(size, revision) AS size FROM changed {} GROUP BY id)"""


def view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "floor(o_totalprice) AS size")
    events = table(spark, sf_dir, "events").selectExpr("event_id AS revision", "user_id * 4 AS id", "IF(event_type = 'error', 'deleted', 'updated') AS type", "IF(event_type = 'view', 'P', 'F') AS status", "floor(value * 100) AS size")
    return rows, events


@query(f"WITH {VIEW_SQL.format('')} SELECT id, status, size FROM rows WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, status, size FROM last WHERE type = 'updated'")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unfiltered list after all events: last event of each row wins, new rows come in."""
    return changes.apply_changes(*view(spark, sf_dir))


@query(f"WITH {VIEW_SQL.format('')} SELECT id, status, size FROM rows WHERE status = 'F' AND id NOT IN (SELECT id FROM last) UNION ALL SELECT id, status, size FROM last WHERE type = 'updated' AND status = 'F' AND id IN (SELECT id FROM rows WHERE status = 'F')")
def apply_changes_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, events = view(spark, sf_dir)
    return changes.apply_changes(rows.where("status = 'F'"), events, status="F", insert=changes.takes_new_rows(None, "F", None, "added"))


@query(f"WITH {VIEW_SQL.format('WHERE revision > 300')} SELECT id, status, size FROM rows WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, status, size FROM last WHERE type = 'updated'")
def snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, events = view(spark, sf_dir)
    return changes.replay(rows, events, since=300)


@query(f"WITH {VIEW_SQL.format('')} SELECT id, status, size FROM last WHERE type = 'updated' AND id NOT IN (SELECT id FROM rows WHERE status = 'F')")
def unseen_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that a view of finished orders doesn't have."""
    rows, events = view(spark, sf_dir)
    return changes.unseen_changes(events, rows.where("status = 'F'")).select("id", "status", "size")


@query("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM events) WHERE h IS NULL OR value > h")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.running_highest(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("SELECT id, seq, processed FROM (SELECT user_id AS id, event_id AS seq, event_id % 100 AS processed, false AS finished FROM events) ORDER BY id DESC, seq DESC LIMIT 1")
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id AS seq", "event_id % 100 AS processed", "false AS finished")
    return changes.import_progress(rows).select("id", "seq", "processed")


@query(
    """SELECT 'u' || user_id AS repeat_key, count(*) AS n FROM events GROUP BY user_id"""
)
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file read as a stream, folded by key in micro-batches until all of it is there.

    Every micro-batch writes its counts to a folder of its own number, so a batch run again after a failure replaces what
    it wrote; the counts of all batches are then added up. Nothing is kept on the driver.
    """
    import uuid

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(f"{sf_dir}/")
    folder = f"{shared_dir(spark)}/streamed-counts-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repeat_key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    debounce.apply_each(stream, write, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("repeat_key string, n long, batch long").parquet(f"{folder}/out").groupBy("repeat_key").agg(F.sum("n").alias("n"))


@query(
    """SELECT id, at_ms, processed FROM (SELECT *, row_number() OVER (PARTITION BY id, t // 20000000 ORDER BY t, processed) AS place FROM (
  SELECT user_id AS id, (epoch_us(ts) // 1000) AS t, (epoch_us(ts) // 1000) AS at_ms, event_id % 100 AS processed, 99 AS total FROM events)) WHERE place = 1 OR processed >= total"""
)
def import_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of every batch, told once in an interval and at its end."""
    rows = timed(spark, sf_dir).selectExpr("user_id AS id", "at_ms", "event_id % 100 AS processed", "99 AS total")
    return watchers.import_reports(rows, 20_000_000).select("id", "at_ms", "processed")


@query("SELECT s_suppkey AS folder_id, 'start' AS action FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 'stop' FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal <= 0")
def watcher_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders to watch and watchers to stop; every third supplier's folder is watched already."""
    folders = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_acctbal > 0 AS enabled")
    return watchers.watcher_changes(folders, folders.where("id % 3 = 0").select(F.col("id").alias("folder_id")))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'missing' ELSE 'watching' END WHEN s_suppkey % 2 = 0 THEN 'idle' ELSE 'error' END AS watch_state, CASE WHEN s_acctbal > 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN '已暂停监听' ELSE 'x' END AS message FROM supplier")
def watched_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('/f/', s_suppkey) AS path_key", "s_acctbal > 0 AS enabled", "s_suppkey % 2 = 0 AS pinned", "'error' AS watch_state", "'x' AS message")
    return watchers.watched_states(folders, folders.where("id % 4 <> 0")).select("id", "watch_state", "message")


@query(f"WITH {VIEW_SQL.format('')}, f AS (SELECT s_suppkey AS id, 'F' AS status, s_nationkey::BIGINT AS size FROM supplier) SELECT id, status, size FROM f WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, status, size FROM last WHERE type = 'updated'")
def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder list after folder events."""
    folders = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "'F' AS status", "CAST(s_nationkey AS BIGINT) AS size")
    return watchers.folder_list(folders, view(spark, sf_dir)[1])


@query("SELECT 'p' || user_id AS path_key FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 97 = 1) = 0")
def vanished_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a scan of all events that one of few of them lacks."""
    events = file_events(spark, sf_dir).select("path_key").distinct()
    few = table(spark, sf_dir, "events").where("event_id % 97 = 1").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path_key"))
    return debounce.vanished(events, few)
