"""Helpers shared by the corpus operators: shared storage, stable row ids and small binary codecs."""

from __future__ import annotations

import json
import re
import struct
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/checkpoints/stillmark"
#: Names of stores as Hadoop has them and as Arrow has them.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one where that is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_parts(spark: SparkSession, total: int | None, each: int) -> int:
    """Parts of about ``each`` bytes for ``total`` bytes, and the session's number of shuffle partitions at least."""
    return max(partitions(spark), -(-(total or 0) // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(path: str):
    """(file system, path in it) for a URI or plain path that executors and driver share."""
    import pyarrow.fs as pafs

    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """A header (JSON: name, dtype, length) and the raw little-endian arrays one after another."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    return struct.pack("<I", len(head)) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpack_arrays(blob: bytes) -> dict[str, np.ndarray]:
    n = struct.unpack_from("<I", blob)[0]
    at, out = 4 + n, {}
    for name, dtype, length in json.loads(bytes(blob[4 : 4 + n])):
        out[name] = np.frombuffer(blob, dtype, length, at)
        at += length * np.dtype(dtype).itemsize
    return out


def with_rows(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of ``docs`` as a struct) and ``row``, which names each row for good.

    In a table read straight from files a row is its file and place there, so nothing is copied; other frames are written
    first and numbered.
    """
    doc = F.struct("*").alias("doc")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            out = docs.select(doc, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("row"))
            out.schema  # noqa: B018  resolves the names
            return out
        except AnalysisException:  # a format without row numbers
            pass
    return saved(docs.select(doc, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place")).alias("row")), "rows")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it where ``df`` has such a column already (names compare in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
