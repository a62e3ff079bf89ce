"""From raw documents to token shards in five stages, each written as Parquet and read again as the next one's input.

Each stage works on all that its predecessor kept: language ID drops documents in no language, SimHash near-dedup keeps one
document of each component, decontamination drops documents that hold windows of benchmark items, mixing repeats and
cuts documents to the sources' word targets, and the last writes token shards and gives what was read back from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stillmark.llm import decontaminate, language, mixing, simhash, token_shards
from stillmark.llm.common import saved, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Language decisions come from EM in Python, components from an iteration and ids from a tokenizer library.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    manifest, folder = token_shards.write_token_shards(docs, TOKENIZER)
    return token_shards.read_token_shards(manifest, folder)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, start, n_tokens, ids_crc32 for every document of the mix, in shard order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
