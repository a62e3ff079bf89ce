"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .encoder import encoder, text_slices


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, n_docs: documents by encoded length. Every task sends one row for each length it saw, not for each text.

    Defined results: null and empty texts have length 0; very long texts are encoded whole, in pieces; repeated rows each
    count; an empty table gives no rows; columns other than text, whatever their names, are ignored.
    """

    def count(batches):
        seen, enc = Counter(), encoder(tokenizer)
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                seen.update(len(ids) // enc.dtype.itemsize for ids in enc.encode(texts))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 64) -> DataFrame:
    """For every length that occurs, taken as a context limit: what is at least as long, totals, and totals when cut there.

    docs_at_least and tokens_at_least count documents of that length or more; truncated_total is the sum of
    min(length, n_tokens); quantile is the share of documents no longer than n_tokens.
    Sums run in two levels: within blocks of ``block`` neighbouring lengths, then over block totals, so no task holds the
    whole histogram. A block has ``block`` rows at most, as the histogram has one for each length; a task's share of them is
    bounded by that, however many documents stand behind a row.
    """
    rows = histogram.withColumns({"block": F.floor(F.col("n_tokens") / block), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("block_id"),
        *[F.coalesce(F.sum(f"block_{c}").over(after), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")],
        *[F.sum(f"block_{c}").over(whole).alias(f"total_{c}") for c in ("docs", "tokens")],
    )
    here = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    joined = rows.join(blocks, rows.block == blocks.block_id)
    sums = joined.select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(here) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(here) + F.col("later_tokens")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def exact_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``suffix_sums`` of ``length_histogram``; the histogram is written once, as its rows are used twice."""
    return suffix_sums(saved(length_histogram(docs, tokenizer), "length-histogram"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, truncated_total for any limits (a short list), also ones that no document's length equals."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the first length above the limit carries all sums above it
    above = sums.select("n_tokens", "docs_at_least", "tokens_at_least").join(F.broadcast(asked), F.col("n_tokens") > F.col("context_limit"))
    first = above.groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("over"))
    total = sums.agg(F.max("tokens_at_least").alias("total_tokens"))
    return asked.join(first, "context_limit", "left").crossJoin(F.broadcast(total)).select(
        "context_limit",
        F.coalesce("over.docs_at_least", F.lit(0)).alias("docs_over"),
        (F.coalesce("total_tokens", F.lit(0)) - F.coalesce("over.tokens_at_least", F.lit(0)) + F.col("context_limit") * F.coalesce("over.docs_at_least", F.lit(0))).alias("truncated_total"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
