"""Recall in blocks against all pairs scored by columns: the same rows to the last bit."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stillmark.operators import pivots, recall
from stillmark.schemas import FRAMES, STRUCT_WORDS

LIMITS = {"max_dhash": 40, "max_struct": 600, "min_score": 0.4}


def frames_of(spark, videos, seed=3):
    """``videos``: video_id: number of frames. Some frames are equal, some have no colours."""
    rng, rows = random.Random(seed), []
    for video, n in videos.items():
        for i in range(n):
            words = [rng.getrandbits(64) - (1 << 63) for _ in range(16)]
            color = [0] * 64 if rng.random() < 0.1 else [rng.choice([0, 1, 4, 30]) for _ in range(64)]
            row = (i, i * 1000, words[0] ^ 3, *words, color, sum(color), [rng.randrange(256) for _ in range(48)])
            rows.append((video, *row[:2], *(rows[-1][3:] if rows and rng.random() < 0.1 else row[2:])))
    return spark.createDataFrame(rows, FRAMES).repartition(3)


def by_pairs(frames, queries, k, **limits):
    found = recall.top_two(recall.score_frames(frames, queries, STRUCT_WORDS, **limits), ["query_id", "video_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shown(found):
    return sorted(map(str, found.select(*sorted(found.columns)).collect()))


@pytest.mark.parametrize("videos, k", [({1: 300, 2: 250, 3: 2, 9: 1}, 3), ({v: 3 for v in range(150)}, 4), ({1: 90, **{v: 2 for v in range(10, 60)}, 99: 90}, 2)])
@pytest.mark.parametrize("max_dhash, min_score", [(40, 0.4), (24, 0.4), (64, 0.52), (64, 0.0)])
def test_hits_are_those_of_all_pairs(spark, videos, k, max_dhash, min_score):
    frames = frames_of(spark, videos).cache()
    asked = frames.where("frame_index % 7 = 1").withColumn("query_id", F.struct("video_id", "frame_index"))
    limits = {"max_dhash": max_dhash, "max_struct": 1024, "min_score": min_score}
    assert shown(recall.recall(frames, asked, STRUCT_WORDS, k, **limits)) == shown(by_pairs(frames, asked, k, **limits)) != []
    if min_score > 0.5:
        cells = pivots.choose(frames, STRUCT_WORDS, pivots.radius_of(min_score, 1024, 1024), 20)
        assert shown(recall.recall(frames, asked, STRUCT_WORDS, k, pivots=cells, **limits)) == shown(by_pairs(frames, asked, k, **limits))


def test_unknown_hashes_and_cells(spark):
    frames = frames_of(spark, {1: 40, 2: 40})
    odd = F.col("frame_index") % 5
    frames = frames.withColumns({
        "s3": F.when(odd != 1, F.col("s3")), "spatial": F.when(odd == 2, F.transform("spatial", lambda x: F.when(x > 9, x))).otherwise(F.col("spatial")),
        "color": F.when(odd == 3, F.transform("color", lambda x: F.when(x > 0, x))).otherwise(F.col("color")), "color_total": F.when(odd != 3, F.col("color_total")),
    })
    asked = frames.withColumn("query_id", F.col("video_id") * 100 + F.col("frame_index"))
    got = recall.recall(frames, asked, STRUCT_WORDS, 5, **LIMITS)
    assert shown(got) == shown(by_pairs(frames, asked, 5, **LIMITS)) and got.select("query_id").distinct().count() == 64


def test_pairs_are_no_rows(spark):
    """Neither a nested loop over frames and queries, nor a row for each cell that a query visits."""
    frames = frames_of(spark, {1: 60, 2: 60})
    asked = frames.withColumn("query_id", F.col("frame_index"))
    cells = pivots.choose(frames, STRUCT_WORDS, 122)
    for limits in ({}, {"pivots": cells, "min_score": 0.88}):
        plan = recall.recall(frames, asked, STRUCT_WORDS, **limits)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan
