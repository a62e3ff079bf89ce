"""Token-ID / binary output: raw id payloads in shards, with a minimal perfect hash index from document key to offset.

Files of one shard, both written by one task straight to the shared folder:

* ``shard-<n>-<attempt>.bin``: the ids of its documents one after another, little-endian, two bytes each where the
  vocabulary allows it, else four;
* ``shard-<n>-<attempt>.idx``: named arrays (see ``pack_arrays``): ``keys`` (doc_id in payload order), ``nulls`` (rows
  without a doc_id, which come first), ``offsets`` (in ids, one more than documents), ``first`` (by slot: the key's first
  ordinal) and the perfect hash with its fingerprints.

A manifest row is committed by Spark only for the attempt that succeeded, so a lost executor leaves at most an unnamed
file behind. Defined results: a null text is empty and has only the end id; repeated doc_ids are stored one after
another and found together; a row without doc_id is stored and read back but can't be looked up; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, open_fs, pack_arrays, partitions, range_parts, saved, unpack_arrays
from .encoder import encoder, text_slices
from .mph import PerfectHash

MANIFEST = "shard int, file string, min_key long, max_key long, n_docs long, n_tokens long, id_bytes int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOC_BYTES = 64  # that a document counts for besides its text, so that very many empty ones fill a shard as well


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        enc, fs, where, sink = encoder(tokenizer), None, "", None
        end = np.array([end_id], enc.dtype).tobytes()
        keys, lens = [], []
        try:
            for batch in batches:
                if sink is None and batch.num_rows:
                    fs, where = open_fs(folder)
                    fs.create_dir(where)
                    sink = fs.open_output_stream(f"{where}/{name}.bin")
                keys.append(batch.column(0))
                for texts in text_slices(batch.column(1)):
                    for ids in enc.encode(texts):
                        sink.write(ids + end)
                        lens.append(len(ids) // enc.dtype.itemsize + 1)
        finally:
            if sink is not None:
                sink.close()
        if not lens:
            return
        column = pa.chunked_array(keys)
        nulls = column.null_count
        stored = column.fill_null(0).to_numpy()[nulls:].astype("<i8")
        distinct, first = np.unique(stored, return_index=True)
        mph = PerfectHash.build(distinct)
        by_slot = np.zeros(len(distinct), "<u4")
        by_slot[mph.lookup(distinct)] = first + nulls
        index = {"keys": stored, "nulls": np.array([nulls], "<i8"), "offsets": np.r_[0, np.cumsum(lens)].astype("<i8"), "first": by_slot, "mph": np.frombuffer(mph.to_bytes(), "u1")}
        with fs.open_output_stream(f"{where}/{name}.idx") as out:
            out.write(pack_arrays(index))
        low, high = (int(stored.min()), int(stored.max())) if len(stored) else (None, None)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "file": name, "min_key": low, "max_key": high, "n_docs": len(lens), "n_tokens": int(sum(lens)), "id_bytes": enc.dtype.itemsize}],
            schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32())]),
        )

    return write


def write_token_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, shards: int | None = None, shard_bytes: int = 128 << 20) -> tuple[DataFrame, str]:
    """Encode every whole text and write the shards in ascending doc_id order; gives (manifest, folder).

    One range shuffle on doc_id orders the documents; equal doc_ids may be split over neighbouring shards, so no key is
    ever too large for a task. Without a given number of ``shards`` there is one for about ``shard_bytes`` of text, so a
    task's sort and its keys (16 bytes for each document, never the payload) stay as they are when the table grows.

    Defined results: as at the top of this module; an empty table gives an empty manifest; other columns, whatever their
    names, are ignored.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if shards is None:
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + DOC_BYTES
        shards = range_parts(spark, rows.agg(F.sum(size)).first()[0], shard_bytes)
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = saved(ranged.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "token-manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), folder


class ShardReader:
    """Keyed access to one shard: constant time for each key, reading only the index and the ids asked for."""

    def __init__(self, folder: str, file: str, id_bytes: int):
        self.fs, where = open_fs(folder)
        self.path, self.dtype = f"{where}/{file}", np.dtype(f"<u{id_bytes}")
        with self.fs.open_input_file(f"{self.path}.idx") as f:
            a = unpack_arrays(f.read())
        self.keys, self.nulls, self.offsets, self.first = a["keys"], int(a["nulls"][0]), a["offsets"], a["first"]
        self.mph = PerfectHash.from_bytes(a["mph"].tobytes())
        self.payload = self.fs.open_input_file(f"{self.path}.bin")

    def ordinals(self, keys: np.ndarray) -> np.ndarray:
        """The first ordinal of each key, -1 for keys that are not in the shard."""
        slots = self.mph.lookup(keys)
        found = np.where(slots >= 0, self.first[np.maximum(slots, 0)].astype(np.int64) if len(self.first) else -1, -1)
        real = found >= 0
        real[real] = self.keys[found[real] - self.nulls] == np.asarray(keys)[real]
        return np.where(real, found, -1)

    def _read(self, low: int, high: int) -> np.ndarray:
        return np.frombuffer(self.payload.read_at((high - low) * self.dtype.itemsize, low * self.dtype.itemsize), self.dtype)

    def ids(self, ordinal: int) -> np.ndarray:
        return self._read(*map(int, self.offsets[ordinal : ordinal + 2]))

    def each(self, ordinals: np.ndarray, most: int = 4 << 20):
        """The ids of many documents; neighbours in the payload are read together, about ``most`` bytes at once."""
        at = 0
        while at < len(ordinals):
            low, to = int(self.offsets[ordinals[at]]), at + 1
            while to < len(ordinals) and ordinals[to] == ordinals[to - 1] + 1 and (self.offsets[ordinals[to] + 1] - low) * self.dtype.itemsize <= most:
                to += 1
            ids = self._read(low, int(self.offsets[ordinals[to - 1] + 1]))
            for k in ordinals[at:to]:
                yield ids[self.offsets[k] - low : self.offsets[k + 1] - low]
            at = to

    def get(self, key: int) -> list[np.ndarray]:
        at = int(self.ordinals(np.array([key]))[0])
        out = []
        while 0 <= at < len(self.offsets) - 1 and self.keys[at - self.nulls] == key:
            out.append(self.ids(at))
            at += 1
        return out


def lookup(manifest: DataFrame, folder: str, key: int) -> list[np.ndarray]:
    """The ids of every document with this key. The manifest narrows it to the shards whose key range holds the key."""
    shards = manifest.where(F.lit(key).between(F.col("min_key"), F.col("max_key"))).orderBy("shard").collect()
    return [ids for s in shards for ids in ShardReader(folder, s.file, s.id_bytes).get(key)]


def _reader(folder: str):
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(folder, row["file"], row["id_bytes"])
                n, nulls = len(shard.offsets) - 1, shard.nulls
                at = np.arange(n)
                if len(shard.keys):
                    fresh = np.r_[True, shard.keys[1:] != shard.keys[:-1]]
                    run = np.arange(len(shard.keys)) - np.maximum.accumulate(np.where(fresh, np.arange(len(shard.keys)), 0))
                    at[nulls:] = shard.ordinals(shard.keys) + run  # a repeated key's later copies follow its first
                lens = np.diff(shard.offsets)
                for low in range(0, n, 2000):
                    part = at[low : low + 2000]
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.each(part)]
                    keys = pa.array([None if k < nulls else int(shard.keys[k - nulls]) for k in part], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(shard.offsets[part] + row["start"]), pa.array(lens[part]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document read back from the files through the index: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = manifest.sparkSession
    return manifest.repartition(partitions(spark), "shard").mapInArrow(_reader(folder), ROWS)
