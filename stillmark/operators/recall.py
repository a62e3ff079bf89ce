"""Which item, and at what time, does a picture come from: pruned similarity scan, top two per item, top k, rerank, refine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint, sampling
from ..functions import similarity as S
from .frame_blocks import FRAMES_A_TASK, best_two
from .pivots import Pivots, with_cell, with_visits
from .shared import appended, saved

MAX_DHASH, MAX_STRUCT, MIN_SCORE, MAX_RESULTS = 24, 448, 0.6, 40
RERANK_DEPTH, RERANK_WEIGHT = 8, 0.3
QUERY_BLOCK = 32768


def score_frames(
    frames: DataFrame, queries: DataFrame, struct: list[str], dhash: list[str] = ["dhash"], max_dhash: int = MAX_DHASH, max_struct: int = MAX_STRUCT, min_score: float = MIN_SCORE, bits: int | None = None, pivots: Pivots | None = None
) -> DataFrame:
    """query_id and frame for every pair that passes the prunes: cheap hash first, then structure, then colours.

    ``queries`` (query_id and the fingerprint columns) is a stated set: each block of it is broadcast, never the frames.
    With ``pivots``, whose radius covers ``max_struct`` and ``min_score``, both sides are joined by cells instead: the same
    pairs come out, and neither side is broadcast for that.
    """
    bits = bits or 64 * len(struct)
    renamed = [c for c in dict.fromkeys([*dhash, *struct, "color", "color_total", "spatial"])]
    cell = ["pivot", "ring"] if pivots else []
    if pivots:
        frames, queries = with_cell(frames, pivots), with_visits(queries, pivots)
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in renamed], S.color_weight(S.dominant_share(F.col("color"))).alias("weight"), *[F.col(c).alias(f"q_{c}") for c in cell])
    near = S.hamming([F.col(c) for c in dhash], [F.col(f"q_{c}") for c in dhash]) <= max_dhash
    distance = S.hamming([F.col(c) for c in struct], [F.col(f"q_{c}") for c in struct])
    for c in cell:
        near = (F.col(c) == F.col(f"q_{c}")) & near
    pairs = frames.join(q if pivots else F.broadcast(q), near & (distance <= max_struct)).withColumn("hash_distance", distance)
    pairs = pairs.withColumn("hash_score", S.struct_similarity(F.col("hash_distance"), bits)).where(F.col("hash_score") >= min_score)
    color = S.color_score(S.histogram_similarity(F.col("q_color"), F.col("q_color_total"), F.col("color"), F.col("color_total")), S.spatial_similarity(F.col("q_spatial"), F.col("spatial")))
    pairs = pairs.withColumn("color_score", color)
    return pairs.select("query_id", "video_id", "frame_index", "time_ms", "hash_distance", "hash_score", "color_score", S.frame_score(F.col("hash_score"), F.col("color_score"), F.col("weight")).alias("frame_score"))


def score_pixels(pictures: DataFrame, queries: DataFrame, id_columns: list[str]) -> DataFrame:
    """id columns, query_id, frame_score of raw pictures (``image``) against queries, nothing pruned.

    ``queries`` is a stated set of few rows, as in ``score_frames``."""
    from ..schemas import STRUCT_WORDS

    frames = fingerprint.with_signature(pictures, id_columns).withColumns({"video_id": F.lit(0), "frame_index": F.struct(*id_columns), "time_ms": F.lit(0)})
    out = score_frames(frames, queries, STRUCT_WORDS, max_dhash=64, max_struct=64 * len(STRUCT_WORDS), min_score=0.0)
    return out.select("frame_index.*", "query_id", "frame_score")


def top_two(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Best frame of each group blended with its runner-up; everything but ``score`` is the best frame's.

    Ties go to the smaller frame_index; a group of one frame counts it twice.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("frame_score"), "frame_index")
    ranked = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    best = lambda c: F.max(F.when(F.col("place") == 1, F.col(c))).alias(c)
    first = F.max(F.when(F.col("place") == 1, F.col("frame_score")))
    second = F.max(F.when(F.col("place") == 2, F.col("frame_score")))
    score = S.BEST_WEIGHT * first + S.SECOND_WEIGHT * F.coalesce(second, first)
    kept = [c for c in ("frame_index", "time_ms", "hash_distance", "hash_score", "color_score") if c in scored.columns]
    return ranked.groupBy(*keys).agg(score.alias("score"), *map(best, kept))


def recall(
    frames: DataFrame, queries: DataFrame, struct: list[str], k: int = MAX_RESULTS, dhash: list[str] = ["dhash"], max_dhash: int = MAX_DHASH, max_struct: int = MAX_STRUCT, min_score: float = MIN_SCORE, bits: int | None = None, pivots: Pivots | None = None
) -> DataFrame:
    """rank, query_id, video_id, score and the best frame of the k best videos of each query (ties to the smaller video_id).

    The pairs are those of ``score_frames``. Queries are taken in blocks of at most about 32,768 (some 20 MB), whose number is
    checked by a count; each goes to all tasks, which compare it with their frames in numpy (``frame_blocks``), so that pairs
    are no rows. Beyond one block both sides are written first and each block's hits as they come, so no plan or task grows
    with the number of queries. With ``pivots`` a query meets only the cells that it visits.
    """
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frames.count() // FRAMES_A_TASK))

    def hits(part: DataFrame) -> DataFrame:
        return top_two(best_two(frames, part, struct, dhash, max_dhash, max_struct, min_score, bits or 64 * len(struct), k, parts, pivots), ["query_id", "video_id"])

    if blocks == 1:
        found = hits(queries)
    else:
        frames, queries = saved(frames, "frames"), saved(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
        found = appended((hits(queries.where(F.col("block") == b)) for b in range(blocks)), "hits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, query_pixels: DataFrame, decode: Callable[[str, list[float]], list], videos: DataFrame, depth: int = RERANK_DEPTH, weight: float = RERANK_WEIGHT) -> DataFrame:
    """The first ``depth`` hits of each query blended with the similarity of their decoded frame; the rest keep their score.

    ``decode(path, seconds)`` gives RGB arrays (or None) and runs on the executors; a failure leaves the score.
    ``query_pixels``: query_id, width, height, data (RGB).
    """
    head = hits.where(F.col("rank") <= depth).join(videos.select(F.col("id").alias("video_id"), "path"), "video_id").join(query_pixels, "query_id")
    several = Window.partitionBy("query_id")
    schema = "query_id long, video_id long, ssim double"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                frame = next(iter(decode(r["path"], [r["time_ms"] / 1000])), None)
                if frame is not None:
                    asked = fingerprint.rgb(r["data"], r["width"], r["height"], 3)
                    rows.append((r["query_id"], r["video_id"], fingerprint.ssim(fingerprint.gray(asked, 48, 48), fingerprint.gray(frame, 48, 48))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "video_id", "ssim"])

    judged = head.select("query_id", "video_id", "path", "time_ms", "width", "height", "data").mapInArrow(run, schema)
    joined = hits.withColumn("n_hits", F.count("*").over(several)).join(judged, ["query_id", "video_id"], "left")
    blended = F.when((F.col("n_hits") > 1) & F.col("ssim").isNotNull(), F.col("score") * (1 - weight) + F.col("ssim") * weight).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return joined.withColumn("score", blended).drop("n_hits").withColumn("rank", F.row_number().over(order))


def refine(hits: DataFrame, videos: DataFrame, score_at: Callable[[str, list[float], dict], list[float]], query: dict) -> DataFrame:
    """The best second near each query's first hit: candidates around it are scored, ties to the first; moves of at most
    0.01 s are ignored. ``score_at(path, seconds, query)`` runs on the executors."""
    v = videos.select(F.col("id").alias("video_id"), "path", "duration", "frame_count")
    head = hits.where("rank = 1").join(v, "video_id").withColumn("seconds", F.col("time_ms") / 1000)
    asked = head.withColumn("candidates", sampling.refine_times(F.col("duration"), F.col("frame_count"), F.col("seconds")))

    @F.pandas_udf("array<double>")
    def scores(path, candidates):
        return candidates.index.to_series().map(lambda i: score_at(path[i], list(candidates[i]), query))

    pairs = F.arrays_zip(F.col("candidates").alias("t"), F.col("scores").alias("s"))
    best = F.aggregate(pairs, F.struct(F.lit(None).cast("double").alias("t"), F.lit(-1.0).alias("s")), lambda acc, x: F.when(x["s"] > acc["s"], F.struct(x["t"].alias("t"), x["s"].alias("s"))).otherwise(acc))
    judged = asked.withColumn("scores", scores("path", "candidates")).withColumn("best", best["t"])
    moved = F.when((F.size("candidates") > 1) & (F.abs(F.col("best") - F.col("seconds")) > 0.01), F.round("best", 2)).otherwise(F.col("seconds"))
    return judged.select("query_id", "video_id", "score", "time_ms", moved.alias("refined_seconds"))


def respond(hits: DataFrame, videos: DataFrame, max_results: int = MAX_RESULTS) -> DataFrame:
    """Hits joined to their videos (unknown ones go), numbered anew, cut and rounded for display."""
    v = videos.select(F.col("id").alias("video_id"), "path", "name", "duration")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    out = hits.drop("rank").join(v, "video_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results)
    return out.select("query_id", "rank", "video_id", "path", "name", "duration", F.round("score", 4).alias("score"), F.round("hash_score", 4).alias("hash_score"), F.round("color_score", 4).alias("color_score"), F.round(F.col("time_ms") / 1000, 2).alias("time_seconds"))
