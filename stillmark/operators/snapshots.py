"""Tables of Parquet parts in buckets, with a snapshot file that names the valid ones.

A commit writes new parts in a folder of their own, then the next snapshot file, put in place by one rename that fails if the
name is taken. Readers take the newest snapshot: they see the table before or after a commit, whatever stops in between, and
of two writers that began from one snapshot the second is refused. Only the buckets that a change touches are written again.
The rename must be atomic, as it is in HDFS and local file systems.

    <root>/parts/part=<id>/bucket=<n>/*.parquet     <root>/snapshots/<version>.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StaleWriter(RuntimeError):
    """Another writer has committed since this one read its snapshot; nothing of this one's is in the table."""


@dataclass(frozen=True)
class Snapshot:
    """``parts``: for each bucket the folders that hold it. Its size grows with buckets and appends, never with rows."""

    root: str
    version: int
    key: str
    buckets: int
    schema: T.StructType
    parts: dict[int, list[str]]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str) -> list[str]:
    p = _path(spark, path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The newest snapshot, or that version; None if there is no table."""
    known = [int(f[:-5]) for f in _files(spark, f"{root}/snapshots") if f.endswith(".json") and not f.startswith(".")]
    if not known:
        return None
    version = max(known) if version is None else version
    x = json.loads("\n".join(r.value for r in spark.read.text(f"{root}/snapshots/{version:020d}.json", wholetext=True).collect()))
    return Snapshot(root, version, x["key"], x["buckets"], T.StructType.fromJson(x["schema"]), {int(b): p for b, p in x["parts"].items()})


def _commit(spark: SparkSession, s: Snapshot) -> Snapshot:
    jvm = spark.sparkContext._jvm
    to, draft = _path(spark, f"{s.root}/snapshots/{s.version:020d}.json"), _path(spark, f"{s.root}/snapshots/.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = to.getFileSystem(conf).create(draft)
    out.write(json.dumps({"key": s.key, "buckets": s.buckets, "schema": s.schema.jsonValue(), "parts": s.parts}).encode())
    out.close()
    try:
        place(spark, draft, to)
    except Exception as error:
        to.getFileSystem(conf).delete(draft, False)
        if jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).util().exists(to):
            raise StaleWriter(f"snapshot {s.version} of {s.root} is another writer's") from error
        raise
    return s


def place(spark: SparkSession, draft, to) -> None:
    """Rename, unless there is such a file."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, to, none)


def _write(df: DataFrame, root: str, key: str, buckets: int) -> dict[int, str]:
    """bucket: the folder written for it. Rows of a bucket go to one file, a rebalance splits what is too large for one task."""
    name = f"part={uuid.uuid4().hex}"
    marked = df.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", F.col("bucket"))
    marked.write.partitionBy("bucket").parquet(f"{root}/parts/{name}")
    return {int(f.split("=")[1]): name for f in _files(df.sparkSession, f"{root}/parts/{name}") if f.startswith("bucket=")}


def create(df: DataFrame, root: str, key: str, buckets: int = 64) -> Snapshot:
    """A new table; it has no columns named ``bucket`` or ``part``. An empty frame gives an empty table."""
    parts = _write(df, root, key, buckets)
    return _commit(df.sparkSession, Snapshot(root, 1, key, buckets, df.schema, {b: [p] for b, p in parts.items()}))


def read(spark: SparkSession, snapshot: Snapshot, only: list[int] | None = None) -> DataFrame:
    """The table's rows with their ``bucket``, or those of some buckets; other parts' files are not listed."""
    named = T.StructType([*snapshot.schema.fields, T.StructField("bucket", T.IntegerType())])
    wanted = snapshot.parts if only is None else {b: snapshot.parts.get(b, []) for b in only}
    folders = [f"{snapshot.root}/parts/{p}/bucket={b}" for b, parts in sorted(wanted.items()) for p in parts]
    if not folders:
        return spark.createDataFrame([], named)
    return spark.read.schema(named).option("basePath", f"{snapshot.root}/parts").parquet(*folders).select(*named.names)


def rows_of(spark: SparkSession, snapshot: Snapshot, key) -> DataFrame:
    """The rows of one key: its bucket's files alone are read, by partition pruning."""
    value = F.lit(key).cast(snapshot.schema[snapshot.key].dataType)
    return read(spark, snapshot).where((F.col("bucket") == bucket_of(value, snapshot.buckets)) & (F.col(snapshot.key) == value)).drop("bucket")


def append(df: DataFrame, snapshot: Snapshot) -> Snapshot:
    """More rows: nothing that is there is read or written."""
    parts = _write(df.select(*snapshot.schema.names), snapshot.root, snapshot.key, snapshot.buckets)
    every = {b: [*snapshot.parts.get(b, []), *([parts[b]] if b in parts else [])] for b in {**snapshot.parts, **parts}}
    return _commit(df.sparkSession, Snapshot(snapshot.root, snapshot.version + 1, snapshot.key, snapshot.buckets, snapshot.schema, every))


def rewrite(keys: DataFrame, snapshot: Snapshot, change: Callable[[DataFrame], DataFrame]) -> Snapshot:
    """The buckets of ``keys`` (its first column) after ``change(their rows)``; the others stay as they are.

    The driver gets the numbers of the touched buckets and no keys.
    """
    spark = keys.sparkSession
    touched = sorted(r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]).cast(snapshot.schema[snapshot.key].dataType), snapshot.buckets).alias("b")).distinct().collect())
    rows = change(read(spark, snapshot, touched).drop("bucket")).select(*snapshot.schema.names)
    parts = _write(rows, snapshot.root, snapshot.key, snapshot.buckets) if touched else {}
    if not parts.keys() <= set(touched):
        raise ValueError("the change moved rows to other buckets")
    every = {b: p for b, p in snapshot.parts.items() if b not in touched} | {b: [p] for b, p in parts.items()}
    return _commit(spark, Snapshot(snapshot.root, snapshot.version + 1, snapshot.key, snapshot.buckets, snapshot.schema, every))


def clean(spark: SparkSession, root: str) -> int:
    """Delete the folders that the newest snapshot doesn't name, and older snapshots; gives the number of folders.

    For a time without writers and without readers of older snapshots, as an unfinished commit's folders look the same.
    """
    now, gone = current(spark, root), 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = _path(spark, root).getFileSystem(conf)
    valid = {(p, f"bucket={b}") for b, parts in now.parts.items() for p in parts} if now else set()
    for part in _files(spark, f"{root}/parts"):
        inside = [f for f in _files(spark, f"{root}/parts/{part}") if f.startswith("bucket=")]
        stale = [f for f in inside if (part, f) not in valid]
        for f in [""] if len(stale) == len(inside) else stale:
            fs.delete(_path(spark, f"{root}/parts/{part}/{f}".rstrip("/")), True)
            gone += 1
    for f in _files(spark, f"{root}/snapshots"):
        if now and f != f"{now.version:020d}.json":
            fs.delete(_path(spark, f"{root}/snapshots/{f}"), False)
    return gone
