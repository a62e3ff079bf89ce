"""Search and duplicate queries. Vectors stand for frames: label is the video, vec_id the frame, 64 cells the picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import similarity as S
from ..operators import catalog, duplicates, evaluation, frame_index, mutations, recall, snapshots
from ..operators.shared import fresh_path
from .registry import query, table

STRUCT, DHASH = ["s0", "s1"], ["d0", "d1"]
LIMITS = {"dhash": DHASH, "max_dhash": 40, "max_struct": 40, "bits": 64}
FLOOR, PAIR_FLOOR, CLOSE_FLOOR = 0.4, 0.55, duplicates.DEFAULT_THRESHOLD


def frames_of(embeddings: DataFrame) -> DataFrame:
    v = embeddings.selectExpr("label AS video_id", "vec_id AS frame_index", "vec_id * 1000 AS time_ms", "transform(embedding, x -> double(x)) AS v")
    v = v.selectExpr("*", "aggregate(v, 0D, (a, x) -> a + x) / 64 AS mean", "aggregate(v, 0D, (a, x) -> a + abs(x)) AS total", "array_max(transform(v, x -> abs(x))) AS most")
    bits = lambda first: f"aggregate(transform(slice(v, {first}, 32), (x, i) -> IF(x >= mean, shiftleft(1L, i), 0L)), 0L, (a, x) -> a + x)"
    steps = lambda first, last: f"aggregate(transform(sequence({first}, {last}), i -> IF(element_at(v, i) < element_at(v, i + 1), shiftleft(1L, i - {first}), 0L)), 0L, (a, x) -> a + x)"
    frames = v.selectExpr(
        "video_id", "frame_index", "time_ms", f"{bits(1)} AS s0", f"{bits(33)} AS s1", f"{steps(1, 32)} AS d0", f"{steps(33, 63)} AS d1",
        "transform(v, x -> int(floor(abs(x) / total * 255 + 0.5D))) AS color", "transform(slice(v, 1, 48), x -> int(floor(abs(x) / most * 255 + 0.5D))) AS spatial",
    )
    return frames.withColumn("color_total", S.color_total(F.col("color")))


FRAMES = r"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT *, list_reduce(v, lambda a, b: a + b) / 64 AS mean, list_reduce(list_transform(v, lambda x: abs(x)), lambda a, b: a + b) AS total,
             list_max(list_transform(v, lambda x: abs(x))) AS most FROM e),
packed AS (
  SELECT label AS video_id, vec_id AS frame_index, vec_id * 1000 AS time_ms,
    list_sum(list_transform(v[1:32], lambda x, i: CASE WHEN x >= mean THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT AS s0,
    list_sum(list_transform(v[33:64], lambda x, i: CASE WHEN x >= mean THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT AS s1,
    list_sum(list_transform(range(1, 33), lambda i: CASE WHEN v[i] < v[i + 1] THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT AS d0,
    list_sum(list_transform(range(33, 64), lambda i: CASE WHEN v[i] < v[i + 1] THEN 1::BIGINT << (i - 33)::BIGINT ELSE 0::BIGINT END))::BIGINT AS d1,
    list_transform(v, lambda x: floor(abs(x) / total * 255 + 0.5::DOUBLE)::BIGINT) AS color,
    list_transform(v[1:48], lambda x: floor(abs(x) / most * 255 + 0.5::DOUBLE)::BIGINT) AS spatial
  FROM m),
frames AS (SELECT *, list_sum(color)::BIGINT AS color_total FROM packed)"""


def scored(name: str, queries: str, floor: float, prune: bool = True) -> str:
    near = "WHERE dd <= 40 AND sd <= 40 AND 1 - sd / 64 >= {}".format(floor) if prune else ""
    return f"""
{name} AS (
  SELECT query_id, video_id, frame_index, time_ms, sd AS hash_distance, 1 - sd / 64 AS hash_score, color_score,
         (1 - sd / 64) * (1 - weight) + color_score * weight AS frame_score
  FROM (SELECT q.query_id, f.video_id, f.frame_index, f.time_ms,
          bit_count(xor(f.s0, q.s0))::BIGINT + bit_count(xor(f.s1, q.s1))::BIGINT AS sd, bit_count(xor(f.d0, q.d0))::BIGINT + bit_count(xor(f.d1, q.d1))::BIGINT AS dd,
          0.3::DOUBLE + (0.7::DOUBLE - 0.3::DOUBLE) * (list_max(q.color) / 255::DOUBLE) AS weight,
          list_sum(list_transform(list_zip(q.color, f.color), lambda x: least(x[1] * f.color_total, x[2] * q.color_total)))::BIGINT / (q.color_total * f.color_total)::DOUBLE * 0.65::DOUBLE
          + greatest(0::DOUBLE, 1 - list_sum(list_transform(list_zip(q.spatial, f.spatial), lambda x: abs(x[1] - x[2])))::BIGINT / (48 * 255)::DOUBLE) * 0.35::DOUBLE AS color_score
        FROM frames f, {queries} q) {near})"""


def top_two(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, video_id, 0.75::DOUBLE * max(CASE WHEN n = 1 THEN frame_score END) + 0.25::DOUBLE * coalesce(max(CASE WHEN n = 2 THEN frame_score END), max(CASE WHEN n = 1 THEN frame_score END)) AS score,
    max(CASE WHEN n = 1 THEN frame_index END) AS frame_index, max(CASE WHEN n = 1 THEN time_ms END) AS time_ms, max(CASE WHEN n = 1 THEN hash_distance END) AS hash_distance,
    max(CASE WHEN n = 1 THEN hash_score END) AS hash_score, max(CASE WHEN n = 1 THEN color_score END) AS color_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY frame_score DESC, frame_index) AS n FROM {source}) GROUP BY query_id, video_id)"""


RECALL_END = "SELECT query_id, video_id, round(score, 6) AS score, frame_index, time_ms, hash_distance, round(hash_score, 6) AS hash_score, round(color_score, 6) AS color_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM hits) WHERE rank <= 40"


def shown(hits: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("score", "hash_score", "color_score")]
    return hits.select("query_id", "video_id", "frame_index", F.col("time_ms").cast("long").alias("time_ms"), F.col("hash_distance").cast("long").alias("hash_distance"), F.col("rank").cast("long").alias("rank"), *rounded)


@query(f"WITH {FRAMES}, queries AS (SELECT frame_index AS query_id, * FROM frames WHERE frame_index = 0), {scored('scores', 'queries', FLOOR)}, {top_two('hits', 'scores')} {RECALL_END}")
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query picture against all frames: pruned scan, top two of each video, best videos first."""
    frames = frames_of(table(spark, sf_dir, "embeddings"))
    asked = frames.where("frame_index = 0").withColumn("query_id", F.col("frame_index"))
    return shown(recall.recall(frames, asked, STRUCT, min_score=FLOOR, **LIMITS))


@query(f"WITH {FRAMES}, queries AS (SELECT frame_index AS query_id, * FROM frames WHERE frame_index % 20 = 0), {scored('scores', 'queries', FLOOR)}, {top_two('hits', 'scores')} {RECALL_END}")
def recall_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth frame as a query against all frames."""
    frames = frames_of(table(spark, sf_dir, "embeddings"))
    asked = frames.where("frame_index % 20 = 0").withColumn("query_id", F.col("frame_index"))
    return shown(recall.recall(frames, asked, STRUCT, min_score=FLOOR, **LIMITS))


KEPT_INDEX = f"""{FRAMES.replace('frames AS (', 'every AS (')},
frames AS (SELECT * FROM every WHERE video_id % 4 <> 2 AND NOT (video_id % 4 = 1 AND frame_index % 2 = 1))"""


def kept_index(spark: SparkSession, sf_dir: str) -> str:
    """An index of even videos, to which odd ones are added; then some lose every other frame and some go."""
    frames = frames_of(table(spark, sf_dir, "embeddings"))
    index = frame_index.build(frames.where("video_id % 2 = 0"), fresh_path(spark, "frame-index"), buckets=16)
    index = frame_index.add(frames.where("video_id % 2 = 1"), index)
    ids = frames.select("video_id")
    index = frame_index.replace(frames.where("frame_index % 2 = 0"), ids.where("video_id % 4 = 1"), index)
    return frame_index.remove(ids.where("video_id % 4 = 2"), index).root


@query(f"WITH {KEPT_INDEX}, queries AS (SELECT frame_index AS query_id, * FROM every WHERE frame_index % 20 = 0), {scored('scores', 'queries', FLOOR)}, {top_two('hits', 'scores')} {RECALL_END}")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth frame against an index that was built, added to, replaced in and reduced."""
    asked = frames_of(table(spark, sf_dir, "embeddings")).where("frame_index % 20 = 0").withColumn("query_id", F.col("frame_index"))
    return shown(frame_index.search(asked, kept_index(spark, sf_dir), STRUCT, min_score=FLOOR, **LIMITS))


@query(f"WITH {KEPT_INDEX} SELECT video_id, count(*) AS n, sum(s0)::BIGINT AS words, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM frames GROUP BY video_id")
def index_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the kept index has of each video."""
    kept = frame_index.frames(spark, snapshots.current(spark, kept_index(spark, sf_dir)))
    return kept.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("s0").alias("words"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


@query(f"WITH {FRAMES} SELECT video_id, frame_index, s0, s1, d0, d1, color_total, list_sum(spatial)::BIGINT AS spatial_total, round(list_max(color) / 255::DOUBLE, 6) AS dominant_share FROM frames")
def frame_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(table(spark, sf_dir, "embeddings"))
    return frames.select("video_id", "frame_index", *STRUCT, *DHASH, "color_total", S.color_total(F.col("spatial")).alias("spatial_total"), F.round(S.dominant_share(F.col("color")), 6).alias("dominant_share"))


@query(f"WITH {FRAMES}, queries AS (SELECT frame_index AS query_id, * FROM frames WHERE frame_index = 1), {scored('scores', 'queries', 0, prune=False)} SELECT frame_index, hash_distance, round(hash_score, 6) AS hash_score, round(color_score, 6) AS color_score, round(frame_score, 6) AS frame_score FROM scores")
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partial scores of one query against every frame, nothing pruned."""
    frames = frames_of(table(spark, sf_dir, "embeddings"))
    asked = frames.where("frame_index = 1").withColumn("query_id", F.col("frame_index"))
    out = recall.score_frames(frames, asked, STRUCT, **(LIMITS | {"max_dhash": 64, "max_struct": 64}), min_score=0.0)
    return out.select("frame_index", F.col("hash_distance").cast("long").alias("hash_distance"), *[F.round(c, 6).alias(c) for c in ("hash_score", "color_score", "frame_score")])


@query("SELECT frame_index, label, color FROM (SELECT vec_id AS frame_index, CASE WHEN s >= 0.92 THEN '很相似' WHEN s >= 0.84 THEN '较相似' WHEN s >= 0.76 THEN '有些相似' ELSE '相似度较低' END AS label, CASE WHEN s >= 0.84 THEN 'text-ok' WHEN s >= 0.76 THEN 'text-warn' ELSE 'text-muted' END AS color FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) AS s FROM embeddings))")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.abs(F.element_at("embedding", 1).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_index"), formats.score_label(s).alias("label"), formats.score_color(s).alias("color"))


REPRESENTATIVES = """
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS n FROM frames),
middle AS (SELECT video_id AS query_id, * EXCLUDE (place, n) FROM placed WHERE place = n // 2),
samples AS (SELECT * EXCLUDE (place, n) FROM placed WHERE CASE WHEN n = 1 THEN place = 0 ELSE list_contains(list_transform(range(0, least(8, n)), lambda k: floor(k * (n - 1) / (least(8, n) - 1) + 0.5)::BIGINT), place) END)"""


@query("WITH frames AS (SELECT label AS video_id, vec_id AS frame_index FROM embeddings)," + REPRESENTATIVES + " SELECT video_id, frame_index FROM samples")
def representative_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_index"))
    return duplicates.representatives(frames, duplicates.SAMPLES)


def coverage_sql(floor: float) -> str:
    return f"""WITH {FRAMES}, {REPRESENTATIVES}, {scored('first_scores', 'middle', floor)}, {top_two('first_hits', 'first_scores')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM first_hits),
partner AS (SELECT query_id AS id_a, video_id AS id_b, hash_score, color_score, time_ms / 1000 AS time_seconds
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM ranked WHERE rank <= 8 AND video_id <> query_id) WHERE n = 1),
asked AS (SELECT s.*, {{'of': s.video_id, 'at': s.frame_index}} AS query_id FROM samples s WHERE s.video_id IN (SELECT id_a FROM partner)),
{scored('sample_scores', 'asked', floor)}, {top_two('sample_hits', 'sample_scores')},
found AS (SELECT query_id.of AS id_a, video_id AS id_b, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM sample_hits) WHERE rank <= 50),
sampled AS (SELECT video_id AS id_a, count(*) AS n_samples FROM asked GROUP BY video_id),
judged AS (SELECT p.*, count(*) AS matched, avg(f.score) AS average FROM found f JOIN partner p USING (id_a, id_b) GROUP BY ALL),
kept AS (SELECT *, average * (0.5::DOUBLE + 0.5::DOUBLE * matched / n_samples) AS score FROM judged JOIN sampled USING (id_a))
SELECT id_a, id_b, round(score, 6) AS score, round(hash_score, 6) AS hash_score, round(color_score, 6) AS color_score, time_seconds
FROM (SELECT *, row_number() OVER (PARTITION BY least(id_a, id_b), greatest(id_a, id_b) ORDER BY id_a) AS n FROM kept WHERE score >= {floor}) WHERE n = 1"""


def coverage(frames: DataFrame, floor: float, **options) -> DataFrame:
    pairs = duplicates.coverage_pairs(frames, STRUCT, floor, **LIMITS, **options)
    return pairs.select("id_a", "id_b", *[F.round(c, 6).alias(c) for c in ("score", "hash_score", "color_score")], "time_seconds")


@query(coverage_sql(PAIR_FLOOR))
def duplicate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate videos by how many of their sample frames find the partner."""
    return coverage(frames_of(table(spark, sf_dir, "embeddings")), PAIR_FLOOR)


CLIPS = """clips AS (
  SELECT vec_id // 4 AS label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings
  UNION ALL SELECT vec_id // 4 + 1000000, vec_id + 4000000, list_transform(embedding, lambda x: floor(x::DOUBLE * 64) / 64) FROM embeddings WHERE vec_id % 3 > 0)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short videos of four frames, and coarser copies of them that lack some frames."""
    e = table(spark, sf_dir, "embeddings").selectExpr("floor(vec_id / 4) AS label", "vec_id", "transform(embedding, x -> double(x)) AS embedding")
    coarse = e.where("vec_id % 3 > 0").selectExpr("label + 1000000 AS label", "vec_id + 4000000 AS vec_id", "transform(embedding, x -> floor(x * 64) / 64D) AS embedding")
    return e.unionByName(coarse)


@query(coverage_sql(CLOSE_FLOOR).replace("WITH ", f"WITH {CLIPS}, ", 1).replace("x::DOUBLE) AS v FROM embeddings", "x::DOUBLE) AS v FROM clips"))
def close_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short videos and their coarser copies by the default threshold; pairs meet in cells around pivots."""
    return coverage(frames_of(clips(spark, sf_dir)), CLOSE_FLOOR, most_met=1.0)


PAIRS_SQL = """pairs AS (SELECT o_custkey AS id_a, CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey % 997 + 100000 ELSE o_orderkey + 1000000 END AS id_b, (o_orderkey % 100) / 100.0::DOUBLE AS score, o_orderkey % 7 = 0 AS identical_file FROM orders),
sizes AS (SELECT c_custkey AS id, floor(c_acctbal)::BIGINT AS size FROM customer)"""


def order_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = table(spark, sf_dir, "orders").selectExpr("o_custkey AS id_a", "CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey % 997 + 100000 ELSE o_orderkey + 1000000 END AS id_b", "(o_orderkey % 100) / 100D AS score", "o_orderkey % 7 = 0 AS identical_file")
    return pairs, table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CAST(floor(c_acctbal) AS BIGINT) AS size")


GROUPS_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
edges AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
labels AS (SELECT node, min(other) AS label FROM reach GROUP BY node),
members AS (SELECT label, list(node ORDER BY coalesce(size, 0) DESC, node) AS members FROM labels LEFT JOIN sizes ON node = id GROUP BY label)
SELECT label AS group_id, len(members)::BIGINT AS n_members, members[1] AS suggested_keep_id, max(score) AS best_score, bool_or(identical_file) AS identical_file
FROM members JOIN labels USING (label) JOIN pairs ON id_a = node GROUP BY label, members"""


@query(GROUPS_SQL)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to groups: connected components, the largest file suggested to be kept."""
    pairs, videos = order_pairs(spark, sf_dir)
    found, _ = duplicates.groups(pairs, videos)
    return found.select("group_id", "n_members", "suggested_keep_id", "best_score", "identical_file")


@query(
    """WITH g AS (SELECT l_orderkey AS group_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS members, arg_max(l_partkey, {'price': l_extendedprice, 'part': -l_partkey}) AS suggested_keep_id FROM lineitem GROUP BY l_orderkey)
SELECT group_id, coalesce(list_filter(members, lambda m: m % 100 = 7)[1], suggested_keep_id, members[1]) AS keep_id FROM g"""
)
def kept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    members = li.selectExpr("l_orderkey AS group_id", "l_partkey AS id", "l_linenumber AS place")
    suggested = li.groupBy(F.col("l_orderkey").alias("group_id")).agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("suggested_keep_id"))
    chosen = table(spark, sf_dir, "part").where("p_partkey % 100 = 7").select(F.col("p_partkey").alias("id"))
    return duplicates.kept_members(members, suggested, chosen)


@query(
    """SELECT l_partkey, round(0.75::DOUBLE * max(CASE WHEN n = 1 THEN s END) + 0.25::DOUBLE * coalesce(max(CASE WHEN n = 2 THEN s END), max(CASE WHEN n = 1 THEN s END)), 6) AS score, max(CASE WHEN n = 1 THEN frame_index END) AS frame_index
FROM (SELECT l_partkey, l_discount AS s, frame_index, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, frame_index) AS n FROM (SELECT *, l_orderkey * 10 + l_linenumber AS frame_index FROM lineitem)) GROUP BY l_partkey"""
)
def top2_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_discount AS frame_score", "l_orderkey * 10 + l_linenumber AS frame_index")
    return recall.top_two(rows, ["l_partkey"]).select("l_partkey", F.round("score", 6).alias("score"), "frame_index")


@query("SELECT count(*) AS frames, count(DISTINCT label) AS videos, count(*) * 256 AS bytes FROM embeddings")
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_info(table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id")))


@query("SELECT label, min(vec_id) AS first_position FROM embeddings GROUP BY label ORDER BY 2")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_seen(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query("SELECT label AS video_id, vec_id AS frame_index, 0 AS generation FROM embeddings WHERE label NOT IN (1, 2) UNION ALL SELECT label, vec_id + 1000000, 1 FROM embeddings WHERE label = 1 AND vec_id % 2 = 0")
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video 1 gets new frames, video 2 none: both lose the old ones."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_index"), F.lit(0).alias("generation"))
    fresh = e.where("video_id = 1 and frame_index % 2 = 0").select("video_id", (F.col("frame_index") + 1000000).alias("frame_index"), F.lit(1).alias("generation"))
    return mutations.replace_in_index(e, spark.createDataFrame([(1,), (2,)], "video_id int"), fresh)


@query("SELECT video_id, frame_index FROM (SELECT label AS video_id, vec_id AS frame_index, row_number() OVER (PARTITION BY label ORDER BY abs(vec_id / 10::DOUBLE - 0.12::DOUBLE * m / 10), vec_id) AS n FROM embeddings JOIN (SELECT label, max(vec_id) AS m FROM embeddings GROUP BY label) USING (label) WHERE abs(vec_id / 10::DOUBLE - 0.12::DOUBLE * m / 10) <= 2) WHERE n = 1")
def thumbnail_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").selectExpr("label AS video_id", "vec_id AS frame_index", "vec_id / 10D AS seconds")
    last = e.groupBy("video_id").agg(F.max("frame_index").alias("m"))
    rows = e.join(last, "video_id").selectExpr("*", "0.12D * m / 10 AS target", "2D AS window")
    return catalog.thumbnails(rows)


@query(
    """WITH r AS (SELECT doc_id, lang AS family, source AS variant, CASE WHEN n_chars % 5 > 0 THEN doc_id END AS expected, CASE WHEN n_chars % 3 > 0 THEN n_chars % 9 + 1 END AS rank, CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END AS n_hits FROM documents)
SELECT family, variant, count(*) AS queries, count(*) FILTER (expected IS NOT NULL AND rank = 1) AS top1, count(*) FILTER (expected IS NOT NULL AND rank <= 5) AS top5, count(*) FILTER (expected IS NOT NULL AND rank IS NULL) AS missing, count(*) FILTER (expected IS NULL AND n_hits > 0) AS false_positives
FROM r GROUP BY GROUPING SETS ((), (family), (variant))"""
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("lang AS family", "source AS variant", "CASE WHEN n_chars % 5 > 0 THEN doc_id END AS expected", "CASE WHEN n_chars % 3 > 0 THEN n_chars % 9 + 1 END AS rank", "CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END AS n_hits")
    return catalog.evaluation_summary(rows)


SEEN = """
seen AS (
  SELECT vec_id * 3 + n AS vec_id, label,
    CASE n WHEN 0 THEN embedding::DOUBLE[] WHEN 1 THEN list_transform(embedding, lambda x: floor(x::DOUBLE * 16 + 0.5::DOUBLE) / 16) ELSE list_transform(embedding, lambda x, i: CASE WHEN i <= 8 THEN 0::DOUBLE ELSE x::DOUBLE END) END AS embedding
  FROM embeddings, range(3) AS t(n))"""
EVALUATED = f"""WITH {SEEN}, {FRAMES.replace('FROM embeddings', 'FROM seen').replace('frames AS (', 'every AS (')},
frames AS (SELECT * FROM every WHERE frame_index % 3 = 0 AND video_id % 5 <> 4),
queries AS (SELECT frame_index AS query_id, * FROM every WHERE frame_index // 3 % 20 = 0), {scored('scores', 'queries', FLOOR)}, {top_two('hits', 'scores')},
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM hits) WHERE rank <= 40),
stated AS (SELECT query_id, 'group ' || (video_id % 3) AS family, CASE WHEN video_id % 5 = 4 THEN 'held-out' ELSE ['exact', 'coarse', 'covered'][query_id % 3 + 1] END AS variant, CASE WHEN video_id % 5 <> 4 THEN video_id END AS expected FROM queries),
evaluated AS (
  SELECT s.query_id, family, variant, expected, max(CASE WHEN video_id = expected THEN rank END) AS rank, count(video_id) AS n_hits,
    coalesce(string_agg(CASE WHEN rank <= 5 THEN video_id::VARCHAR END, ',' ORDER BY rank), '') AS top
  FROM stated s LEFT JOIN found f ON s.query_id = f.query_id GROUP BY s.query_id, family, variant, expected)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth frame as it is, in coarser steps and with its first cells covered, against all frames of most videos;
    the others' frames should find nothing."""
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "transform(embedding, x -> double(x)) AS v", "explode(array(0, 1, 2)) AS n")
    changed = "CASE n WHEN 0 THEN v WHEN 1 THEN transform(v, x -> floor(x * 16 + 0.5D) / 16D) ELSE transform(v, (x, i) -> IF(i < 8, 0D, x)) END AS embedding"
    every = frames_of(v.selectExpr("vec_id * 3 + n AS vec_id", "label", changed))
    held = F.col("video_id") % 5 == 4
    family = F.concat(F.lit("group "), F.col("video_id") % 3)
    variant = F.when(held, "held-out").otherwise(F.element_at(F.array(*map(F.lit, ("exact", "coarse", "covered"))), (F.col("frame_index") % 3 + 1).cast("int")))
    asked = every.where("frame_index div 3 % 20 = 0").withColumns({"query_id": F.col("frame_index"), "family": family, "variant": variant, "expected": F.when(~held, F.col("video_id"))})
    return evaluation.evaluate(every.where((F.col("frame_index") % 3 == 0) & ~held), asked, STRUCT, min_score=FLOOR, **LIMITS)


@query(f"{EVALUATED} SELECT * FROM evaluated")
def evaluation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the video that each query should find, and its first five hits."""
    return evaluated(spark, sf_dir).withColumns({"rank": F.col("rank").cast("long"), "top": F.array_join("top.video_id", ",")})


@query(f"{EVALUATED} SELECT * FROM evaluated WHERE CASE WHEN expected IS NULL THEN n_hits > 0 ELSE rank IS DISTINCT FROM 1 END")
def evaluation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that another video answers first, and those answered though nothing should be found."""
    return evaluation.failures(evaluated(spark, sf_dir)).withColumns({"rank": F.col("rank").cast("long"), "top": F.array_join("top.video_id", ",")})


@query(
    f"""{EVALUATED} SELECT family, variant, count(*) AS queries, count(*) FILTER (expected IS NOT NULL AND rank = 1) AS top1, count(*) FILTER (expected IS NOT NULL AND rank <= 5) AS top5,
count(*) FILTER (expected IS NOT NULL AND rank IS NULL) AS missing, count(*) FILTER (expected IS NULL AND n_hits > 0) AS false_positives FROM evaluated GROUP BY GROUPING SETS ((), (family), (variant))"""
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured ranks counted in total, by family and by variant."""
    return catalog.evaluation_summary(evaluated(spark, sf_dir))
