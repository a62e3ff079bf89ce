"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, word budgets by prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, with_rows

WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def source_key(col: Column) -> Column:
    """A non-null stand-in for a source that sorts by code point with null last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col))


def label_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """Sampling weights from quality labels (1 or 0); other documents count 1."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).alias("weight"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source_key, source_size, n_docs, target: ``share`` of all sizes dealt by weight, no source above ``cap`` times its size.

    The water level is found in closed form: with sources in order of cap / weight, the first one from which the rest
    can take its weighted part without overflowing sets the level. Rows here are sources, not documents.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    whole = Window.partitionBy()
    named = per.withColumn("place", F.row_number().over(Window.orderBy("source_key")))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    named = named.withColumns({"share_weight": w, "most": F.col("source_size") * F.lit(float(cap))})
    order = Window.orderBy(F.col("most") / F.col("share_weight"), "place")
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("share_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = named.withColumns({"level": level, "rank": F.row_number().over(order)})
    fits = F.when(F.col("level") <= F.col("most") / F.col("share_weight"), F.col("rank"))
    found = ranked.withColumn("at", F.min_by("level", fits).over(whole))
    return found.select("source_key", "source_size", "n_docs", F.least("most", F.coalesce(F.col("at") * F.col("share_weight"), F.col("most"))).alias("target"))


def _planned(rows: DataFrame, quality: DataFrame | None, weights: tuple[float, ...], share: float, cap: float, seed: str, rows_per_part: int) -> DataFrame:
    """``rows`` (row, doc_id, source, size; written) with source_size, target, taken, epochs."""
    if quality is not None:
        scores = quality.select(F.col("doc_id").cast("long").alias("scored_id"), F.col("weight").cast("double").alias("weight")).groupBy("scored_id").agg(F.max("weight").alias("weight"))
        rows = rows.join(scores, F.col("doc_id") == F.col("scored_id"), "left").drop("scored_id")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = rows.withColumns({"weight": F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0), "source_key": source_key(F.col("source"))})
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("mix_key", -F.log((bits + 0.5) / F.lit(float(1 << 48))) / F.col("weight")).drop("weight")
    targets = saved(source_targets(rows, weights, share, cap), "mix-targets")  # a known size: broadcast only if that is small
    n = max(partitions(rows.sparkSession), -(-(targets.agg(F.sum("n_docs")).first()[0] or 0) // rows_per_part))
    order = ["source_key", "mix_key", "doc_id", "size", "row"]
    ranged = saved(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-order")
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("source_key", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("source_key", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("part_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = ranged.join(parts, ["source_key", "part"]).withColumn("ahead", ahead).join(targets, "source_key")
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), words - epochs * F.col("source_size") - F.col("ahead")))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), epochs.cast("int").alias("epochs"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    rows_per_part: int = 250_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs: how many words of every document the mix takes.

    Each source first gives whole epochs of all its documents, then the rest of its budget in the order of exponential
    keys ``-ln(u) / weight``, where u comes from the md5 of seed and doc_id (reruns agree) and weight from ``quality``
    (doc_id, weight; 1 where it has none). The document at the budget's edge gives only the words still wanted, so a
    source's words meet its target to the word.

    No window holds a source: rows are range-partitioned by source and key (a row number parts equal ones), so parts are
    of about one size whatever the weights; totals of parts are summed along each source, and documents within a part.

    Defined results: null or empty text has size 0 and takes nothing; a very long text is counted like any other; null
    source is a source of its own, the last; repeated rows count each for itself, and equal keys go by doc_id and size;
    weights that are null or not above 0 count as 1; an empty table gives no rows; other columns, whatever their names,
    are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    return _planned(saved(rows, "mix-sizes"), quality, weights, share, cap, seed, rows_per_part).drop("row")


def mixed_corpus(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    rows_per_part: int = 250_000,
) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each whole copy, and one cut at the word where a budget ends.

    Decided as by ``mix_sources``, row by row, so rows that share a doc_id, or have none, are told apart. The plan has a row for each document, so it is never broadcast: at every size the join is a sort-merge join.

    Defined results: as ``mix_sources``; rows that give no word go; an empty table stays empty; extra columns may have any
    name.
    """
    rows = with_rows(docs)
    sized = rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), n_words(F.col("doc.text")).alias("size"))
    plan = _planned(saved(sized, "mix-sizes"), quality, weights, share, cap, seed, rows_per_part)
    plan = plan.where("taken > 0").select(F.col("row").alias("of_row"), "size", "taken")
    joined = rows.join(plan.hint("merge"), F.col("row") == F.col("of_row"))
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = joined.withColumn("n", F.explode(F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.array_repeat(rest, F.when(rest > 0, 1).otherwise(0)))))
    words = F.split("doc.text", WORD_END)  # each with the white space before it
    cut = F.when(F.col("n") < F.col("size"), F.array_join(F.slice(words, 1, F.col("n")), "")).otherwise(F.col("doc.text"))
    return copies.select(F.col("doc").withField("text", cut).alias("doc")).select("doc.*")
