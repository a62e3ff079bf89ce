"""Retrieval measured: each stated query against a gallery, the rank of the video it should find, and where that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recall import MAX_RESULTS, recall

SHOWN = 5


def evaluate(frames: DataFrame, queries: DataFrame, struct: list[str], k: int = MAX_RESULTS, **limits) -> DataFrame:
    """query_id, family, variant, expected, rank, n_hits, top for every query.

    ``queries`` has query_id (unique), family, variant, expected (the video_id to be found; null: none is) and the fingerprint
    columns. ``rank`` is the expected video's place among the k hits, null if it isn't one of them or none is expected;
    ``top`` holds the first five hits (rank, video_id, score). A query without hits stays, with n_hits 0 and an empty
    ``top``. Hits are k rows for a query at most, and only those meet the expectations.
    """
    stated = queries.select(F.col("query_id").alias("of"), "family", "variant", "expected")
    hits = recall(frames, queries.drop("family", "variant", "expected"), struct, k=k, **limits).select("query_id", "video_id", "score", "rank")
    both = stated.join(hits, F.col("of") == F.col("query_id"), "left")
    first = F.when(F.col("rank") <= SHOWN, F.struct("rank", "video_id", "score"))
    out = both.groupBy("of", "family", "variant", "expected").agg(
        F.max(F.when(F.col("video_id") == F.col("expected"), F.col("rank"))).alias("rank"),
        F.count("video_id").alias("n_hits"),
        F.sort_array(F.collect_list(first)).alias("top"),
    )
    return out.withColumnRenamed("of", "query_id")


def failures(evaluated: DataFrame) -> DataFrame:
    """The queries whose expected video isn't first, and those that should find nothing but have hits."""
    missed = F.col("expected").isNotNull() & ~F.col("rank").eqNullSafe(1)
    return evaluated.where(missed | (F.col("expected").isNull() & (F.col("n_hits") > 0)))


def exact_are_first(evaluated: DataFrame, variant: str = "exact") -> bool:
    """The one thing asked of every gallery: a picture of its own, unchanged, comes first."""
    return failures(evaluated.where((F.col("variant") == variant) & F.col("expected").isNotNull())).isEmpty()
