"""Similarity joins by pivots against the nested loop over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillmark.operators import duplicates, pivots, recall
from stillmark.plans import search_queries as q
from stillmark.schemas import FRAMES, STRUCT_WORDS
from tests.test_queries import DATA

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def pictures(spark, shots=30, each=8, seed=1):
    """Frames of shots: copies with some of 1,024 bits turned over; every shot is in several videos."""
    rng = random.Random(seed)
    rows = []
    for s in range(shots):
        base = rng.getrandbits(1024)
        for i in range(each):
            word = base
            for bit in rng.sample(range(1024), rng.choice([0, 3, 60, 121, 122, 123, 124, 200])):
                word ^= 1 << bit
            words = [signed(word >> (64 * k) & MASK) for k in range(16)]
            rows.append((s % 7 + 10 * i, s, s * 1000, words[0] & 0xFF, *words, [s % 5 + 1] * 64, 64 * (s % 5 + 1), [i] * 48))
    return spark.createDataFrame(rows, FRAMES)


def scored(found):
    return sorted(map(str, found.collect()))


@pytest.mark.parametrize("min_score, max_struct", [(0.88, 448), (0.6, 448), (0.0, 130), (0.999, 448), (0.0, 1024)])
@pytest.mark.parametrize("most", [1, 3, 60])
def test_pairs_are_those_of_the_nested_loop(spark, min_score, max_struct, most):
    frames = pictures(spark).repartition(3)
    asked = frames.where("frame_index % 3 = 0").withColumn("query_id", F.struct("video_id", "frame_index"))
    limits = {"min_score": min_score, "max_struct": max_struct, "max_dhash": 64}
    chosen = pivots.choose(frames, STRUCT_WORDS, pivots.radius_of(min_score, max_struct, 1024), most)
    assert len(chosen.words) <= most
    assert scored(recall.score_frames(frames, asked, STRUCT_WORDS, pivots=chosen, **limits)) == scored(recall.score_frames(frames, asked, STRUCT_WORDS, **limits))


def test_the_bound_itself_counts(spark):
    assert pivots.radius_of(0.88, 448, 1024) == 122 and pivots.radius_of(0.75, 448, 64) == 16 and pivots.radius_of(0.0, 40, 64) == 40
    for bits in (64, 1024):
        for score in np.arange(0, 1.001, 0.01).tolist():
            r = pivots.radius_of(score, 2000, bits)
            assert all(d <= r for d in range(bits + 1) if 1 - d / bits >= score)


def test_coverage_is_the_same_either_way(spark):
    frames = pictures(spark, 40, 6, 4)
    for threshold in (0.88, 0.7):
        by_cells = duplicates.coverage_pairs(frames, STRUCT_WORDS, threshold, most_met=1.0, max_dhash=64)
        by_loop = duplicates.coverage_pairs(frames, STRUCT_WORDS, threshold, most_met=-1.0, max_dhash=64)
        assert scored(by_cells) == scored(by_loop)
    assert not by_loop.isEmpty()
    vectors = q.frames_of(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    assert scored(q.coverage(vectors, 0.7, most_met=1.0)) == scored(q.coverage(vectors, 0.7, most_met=-1.0))


def test_shots_meet_few_others_and_plans_have_no_nested_loop(spark):
    frames = pictures(spark, 200, 8, 2)
    chosen = pivots.choose(frames, STRUCT_WORDS, 122)
    met, every = pivots.pairs_compared(frames, frames, chosen)
    assert every == 1600 * 1600 and met < every and 0 < chosen.share <= 1
    asked = frames.withColumn("query_id", F.col("frame_index"))
    plan = recall.score_frames(frames, asked, STRUCT_WORDS, pivots=chosen, min_score=0.88)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_frames(spark):
    none = pictures(spark).where("false")
    chosen = pivots.choose(none, STRUCT_WORDS, 10)
    assert chosen.share == 1.0 and pivots.pairs_compared(none, none, chosen) == (0, 0)
    assert duplicates.coverage_pairs(none, STRUCT_WORDS).isEmpty()
