"""Results that are cut from their history in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints/stillmark"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or LOCAL_FALLBACK).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its history, is computed once, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema (at least one), written one after another to one place and read back as one."""
    path, spark, schema = "", None, None
    for df in parts:
        if not path:
            spark, schema = df.sparkSession, df.schema
            path = fresh_path(spark, name)
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
