"""One query for each corpus operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, divergence, language, lengths, licenses, mixing, neighbours, quality, repeats, simhash, token_shards
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw token ids in shards with a perfect hash index, read back by key."""
    manifest, folder = token_shards.write_token_shards(table(spark, sf_dir, "documents"), WORD_BPE)
    return token_shards.read_token_shards(manifest, folder)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sampling of all documents to word targets for each source."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source,
         CASE WHEN d.source IS NULL THEN '1' ELSE '0' || d.source END AS source_key,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(l.weight, 1.0) AS weight
  FROM documents d LEFT JOIN (
    SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id) l
  ON d.doc_id = l.doc_id),
per AS (
  SELECT source_key, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2 AS most,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source_key),
levels AS (
  SELECT *, most / w AS ratio,
         ((SELECT sum(source_size)::DOUBLE * 1.5 FROM per)
           - coalesce(sum(most) OVER (ORDER BY most / w, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY most / w, source_key) AS rank
  FROM per),
targets AS (
  SELECT source_key, source_size,
         least(most, coalesce((SELECT arg_min(level, rank) FROM levels WHERE level <= ratio) * w, most)) AS target
  FROM levels),
keyed AS (
  SELECT s.*, t.source_size, t.target, round(t.target)::BIGINT AS words,
         -ln((('0x' || substr(md5('mix|' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / s.weight AS mix_key
  FROM sized s JOIN targets t USING (source_key)),
placed AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY mix_key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM keyed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, words - epochs * source_size - ahead)))::BIGINT AS taken
FROM placed
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of benchmark items in every document."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered once for each participant; mask spans as text."""
    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask_spans", lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")
    return out.withColumn("mask_spans", spans)


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier document has in a string of 50 bytes."""
    found = repeats.find_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents for every context limit."""
    return lengths.exact_lengths(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one, found through the tree."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and the licence it equals, if any."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    found = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language by the lowest score of their cuts."""
    return collocations.find_collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from each other one of its language, and the terms it uses more than the language does."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_token_shards": op1_token_shards,
        "op2_language_id": op2_language_id,
        "op3_mix_sources": op3_mix_sources,
        "op4_decontaminate": op4_decontaminate,
        "op5_chat_perspectives": op5_chat_perspectives,
        "op6_repeated_substrings": op6_repeated_substrings,
        "op7_length_histogram": op7_length_histogram,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_license_scan": op9_license_scan,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_quality_classifier": op11_quality_classifier,
        "op12_collocations": op12_collocations,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": OP3_SQL,
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op5_chat_perspectives": chat.ORACLE_SQL,
        "op9_license_scan": licenses.oracle_sql(),
        "op12_collocations": collocations.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
