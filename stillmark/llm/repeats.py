"""Suffix-array dedup: bytes inside strings of a given length that also start in an earlier document.

The suffixes of the corpus are never gathered in one place. A window of ``length`` bytes belongs to the smallest hash of
its 16-byte pieces, so equal windows always meet under one key wherever they stand, and windows of one key come in runs.

1. Documents are packed in blocks. Every block sends its distinct keys, dealt by key, and gets back which of them other
   documents have as well. What has no such key holds no repeat.
2. Blocks send the runs under those keys, equal ones once, dealt by key to as many buckets as the text asks for. A bucket
   puts the suffixes of its runs in suffix order with their longest common prefixes; the nearest suffixes before and after
   whose document is smaller (previous and next smaller value) give each suffix's longest previous factor. A factor of L
   bytes marks every window within it.
3. Blocks get back which windows have an earlier copy and remove the bytes they cover.

A key that very many documents have (a passage that is everywhere) sends its windows one by one, dealt by their content,
in two rounds of the same suffix order: first among a group of blocks, then what had no factor there among all groups. So
no task gets more of one passage than about the square root of the number of blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, mix64, pack_arrays, partitions, unpack_arrays
from .encoder import text_slices

PIECE = 16
RUN = 48  # windows in a run at most, so a run's answer fits in 64 bits
FILTER_BITS = 48  # of a key in the first exchange; a chance match only widens what is compared
BUCKET_BYTES = 16_000_000  # of text for each bucket
SORTED_TOGETHER = 200_000  # suffixes, about
U = np.uint64
BLOCKS = "block long, size long, doc_ids array<long>, lens array<long>, payload binary"
ENTRIES = "bucket int, block long, part int, entries binary"
ANSWERS = "block long, to_bucket int, content binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept_sha256", pa.string())])


def _squeeze(arrays: dict[str, np.ndarray]) -> bytes:
    return zstandard.compress(pack_arrays(arrays), 1)


def _expand(blob: bytes) -> dict[str, np.ndarray]:
    return unpack_arrays(zstandard.decompress(blob))


def _gaps(sorted_keys: np.ndarray) -> np.ndarray:
    gaps = np.diff(sorted_keys, prepend=U(0))
    return gaps.astype("<u4") if len(gaps) and gaps.max() < U(1 << 32) else gaps.astype("<u8")


def _ungaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(U))


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Whole documents in blocks of about ``block_bytes``; a longer text is a block of its own."""
    arrow = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, number, ids, lens, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            row = {"block": (part << 32) + number, "size": size, "doc_ids": ids, "lens": lens, "payload": zstandard.compress(b"".join(held), 3)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in text_slices(batch.column(1)):
                for text in texts:
                    data = (text or "").encode("utf-8", "surrogatepass")
                    ids.append(keys[at])
                    lens.append(len(data))
                    held.append(data)
                    size, at = size + len(data), at + 1
                    if size >= block_bytes:
                        yield flush()
                        number, ids, lens, held, size = number + 1, [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


class Block:
    """The bytes of one block and its documents; rows without doc_id take no part."""

    def __init__(self, row: dict, length: int, part_bytes: int):
        self.number, self.length, self.part_bytes, self.doc_ids = row["block"], length, part_bytes, row["doc_ids"]
        self.lens = np.array(row["lens"], np.int64)
        self.starts = np.cumsum(np.r_[0, self.lens])
        self.ids = np.array([-1 if d is None else d for d in self.doc_ids], np.int64)
        takes_part = np.array([d is not None for d in self.doc_ids], bool)
        self.data = np.frombuffer(zstandard.decompress(row["payload"]) if self.starts[-1] else b"", np.uint8)
        self.low = self.starts[:-1][takes_part]
        self.high = self.low + np.maximum(0, self.lens[takes_part] - length + 1)

    def parts(self):
        for base in range(0, len(self.data), self.part_bytes):
            yield Runs(self, base, min(base + self.part_bytes, len(self.data)))


class Runs:
    """The runs of windows that start in one part of a block: ``key``, place in the part, number of windows ``n``, ``doc``."""

    def __init__(self, block: Block, base: int, end: int):
        self.length, self.base = block.length, base
        self.data = block.data[base : end + block.length + PIECE]
        inside = np.zeros(end - base + 1, np.int32)
        np.add.at(inside, np.clip(block.low, base, end) - base, 1)
        np.add.at(inside, np.clip(block.high, base, end) - base, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        key = self._window_keys(end - base)[at]
        doc = np.searchsorted(block.starts, at + base, "right") - 1
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (np.diff(at) != 1) | (np.diff(doc) != 0)
        first = np.flatnonzero(fresh)
        within = _counting(np.diff(np.r_[first, len(at)])) if len(at) else at
        first = np.flatnonzero(fresh | (within % RUN == 0))
        self.key, self.start, self.doc = key[first], at[first], block.ids[doc[first]]
        self.n = np.diff(np.r_[first, len(at)])

    def _window_keys(self, size: int) -> np.ndarray:
        padded = np.concatenate([self.data, np.zeros(self.length + 2 * PIECE, np.uint8)])
        span = size + self.length
        a = np.ndarray((span,), "<u8", padded.data, 0, (1,))
        b = np.ndarray((span,), "<u8", padded.data, 8, (1,))
        m = mix64(a * U(0x9E3779B97F4A7C15) + mix64(b + U(0x632BE59BD9B4E019)))
        reach, done = self.length - PIECE + 1, 1
        while done < reach:
            s = min(done, reach - done)
            m[:-s] = np.minimum(m[:-s], m[s:])
            done += s
        return m[:size]

    def filter_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shortened keys, sorted, and in how many documents of the part each occurs (255 at most)."""
        short = self.key >> U(64 - FILTER_BITS)
        order = np.lexsort((self.doc, short))
        k, d = short[order], self.doc[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[1:] != k[:-1]
        docs = fresh.copy()
        docs[1:] |= d[1:] != d[:-1]
        return _summed(k, docs.astype(np.int64), fresh)


def _summed(keys: np.ndarray, counts: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(fresh)
    return keys[first], np.minimum(np.add.reduceat(counts, first) if len(first) else counts, 255).astype(np.uint8)


def block_keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """``filter_keys`` of all parts together."""
    keys, counts = zip(*[p.filter_keys() for p in block.parts()]) if len(block.data) else ((np.zeros(0, U),), (np.zeros(0, np.uint8),))
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return _summed(keys, counts[order], fresh)


class Entries:
    """What a part of a block sends under repeated keys: distinct strings, each with the smallest doc_id that has it there.

    Equal runs become one; a run that a smaller document of the same part has too is a copy throughout, which needs no factor. Under a
    hot key the windows of each distinct run are sent one by one, equal ones once. Built the same way from the same block
    and keys each time, so answers can be given by an entry's number.
    """

    def __init__(self, runs: Runs, keys: np.ndarray, hot: np.ndarray):
        short = runs.key >> U(64 - FILTER_BITS)
        at = np.minimum(np.searchsorted(keys, short), max(0, len(keys) - 1))
        known = np.flatnonzero(keys[at] == short) if len(keys) else np.zeros(0, np.int64)
        self.run_start, self.run_n, self.run_doc = runs.start[known], runs.n[known], runs.doc[known]
        key = runs.key[known]
        strings = padded_strings(runs.data, self.run_start, self.run_n + runs.length - 1, RUN + runs.length - 1)
        first, self.run_number = _distinct((self.run_doc, strings, key))
        is_hot = hot[at[known[first]]] if len(first) else np.zeros(0, bool)
        cold, alone = first[~is_hot], first[is_hot]
        n = self.run_n[alone]
        start = np.repeat(self.run_start[alone], n) + _counting(n)
        doc = np.repeat(self.run_doc[alone], n)
        content = window_hash(runs.data, start, runs.length)
        single, number = _distinct((doc, content))
        stray = np.flatnonzero(differing(runs.data, start, start[single][number], runs.length))
        number[stray] = len(single) + np.arange(len(stray))  # equal hashes of different strings: each for itself
        single = np.concatenate([single, stray])
        self.key = np.concatenate([key[cold], content[single]])
        self.doc = np.concatenate([self.run_doc[cold], doc[single]])
        self.n = np.concatenate([self.run_n[cold], np.ones(len(single), np.int64)])
        self.start = np.concatenate([self.run_start[cold], start[single]])
        self.hot = np.r_[np.zeros(len(cold), bool), np.ones(len(single), bool)]
        self.data, self.length = runs.data, runs.length
        self.is_hot = is_hot
        self.cold_entry = np.cumsum(~is_hot) - 1
        self.single_at = np.zeros(len(first), np.int64)
        self.single_at[is_hot] = np.cumsum(n) - n
        self.single_entry = len(cold) + number

    def blob(self, some: np.ndarray) -> bytes:
        size = self.n[some] + self.length - 1
        raw = self.data[np.repeat(self.start[some], size) + _counting(size)]
        return _squeeze({"key": self.key[some], "doc": self.doc[some], "n": self.n[some].astype("u1"), "hot": self.hot[some].astype("u1"), "raw": raw})

    def copied(self, mask: np.ndarray) -> np.ndarray:
        """For each run a bit for every window that an earlier document has, from the answers to the entries."""
        out = np.zeros(len(self.run_start), U)
        is_hot = self.is_hot[self.run_number]
        some = np.flatnonzero(~is_hot)
        e = self.cold_entry[self.run_number[some]]
        out[some] = np.where(self.run_doc[some] > self.doc[e], (U(1) << self.run_n[some].astype(U)) - U(1), mask[e])
        for i in range(RUN):
            some = np.flatnonzero(is_hot & (self.run_n > i))
            e = self.single_entry[self.single_at[self.run_number[some]] + i]
            found = (self.run_doc[some] > self.doc[e]) | (mask[e] != 0)
            out[some[found]] |= U(1 << i)
        return out


def _distinct(columns: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): rows that differ in all but the first column, each by its smallest in that, and every row's number."""
    order = np.lexsort(columns)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns[1:]:
        sorted_ = c[order]
        fresh[1:] |= sorted_[1:] != sorted_[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


SLICE = 1 << 14  # strings looked at together, so that indices into them stay small


def window_hash(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each place."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    h = np.zeros(len(start), U)
    for at in range(0, len(start), SLICE):
        part, some = start[at : at + SLICE], h[at : at + SLICE]
        for offset in [*range(0, length - 7, 8), length - 8]:
            some[:] = mix64(some * U(0x9E3779B97F4A7C15) + eight[part + offset] + U(1))
    return h


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Where the ``length`` bytes at ``a`` are not those at ``b``."""
    out, reach = np.zeros(len(a), bool), np.arange(length)
    for at in range(0, len(a), SLICE):
        out[at : at + SLICE] = (data[a[at : at + SLICE, None] + reach] != data[b[at : at + SLICE, None] + reach]).any(axis=1)
    return out


def _counting(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def padded_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width strings with the length as last byte, so that they compare exactly even where text holds zero bytes."""
    out = np.zeros((len(start), width + 1), np.uint8)
    out[:, width] = size
    for at in range(0, len(start), SLICE):
        low, long = start[at : at + SLICE], size[at : at + SLICE]
        row, col = np.repeat(np.arange(at, at + len(low)), long), _counting(long)
        out[row, col] = data[np.repeat(low, long) + col]
    return out.view(f"S{width + 1}").ravel()


def _common_prefixes(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), SLICE):
        to = min(at + SLICE, len(rows))
        unlike = rows[at:to] != rows[at - 1 : to - 1]
        n = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
        out[at:to] = np.minimum(n, np.minimum(size[at:to], size[at - 1 : to - 1]))
    return out


def _factor_before(doc: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """For each place of suffix order the prefix it shares with the nearest earlier place of a smaller document.

    The previous smaller value by pointer jumping; the least common prefix on the way is carried along, and a way ends
    where it falls under ``length``.
    """
    at, low = np.arange(len(doc)) - 1, lcp.copy()
    open_ = np.flatnonzero((at >= 0) & (low >= length))
    while len(open_):
        open_ = open_[doc[at[open_]] >= doc[open_]]
        low[open_] = np.minimum(low[open_], low[at[open_]])
        at[open_] = at[at[open_]]
        open_ = open_[(at[open_] >= 0) & (low[open_] >= length)]
    return np.where((at >= 0) & (low >= length), low, 0)


def longest_previous_factors(suffixes: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each suffix: its longest prefix that also starts in a smaller document, 0 if shorter
    than ``length``.

    ``suffixes`` has a row of bytes for each, zero behind its ``size``, and the size as last byte. In suffix order the
    longest such prefix is shared with the previous or the next place whose document is smaller.
    """
    order = np.argsort(suffixes.view(f"S{suffixes.shape[1]}").ravel(), kind="stable")
    d, n = doc[order], size[order]
    lcp = _common_prefixes(suffixes[order, :-1], n)
    before = _factor_before(d, lcp, length)
    after = _factor_before(d[::-1], np.r_[0, lcp[:0:-1]], length)[::-1]
    out = np.zeros(len(doc), np.int64)
    out[order] = np.maximum(before, after)
    return out


def answers(key: np.ndarray, doc: np.ndarray, n: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """For each entry of a bucket a bit for every window that lies in a longest previous factor.

    Whole keys are sorted together, about ``SORTED_TOGETHER`` suffixes at once. Of equal runs the first of the smallest
    document has all its suffixes in the order, the others only themselves as a whole: those of larger documents are copies
    throughout, and those of the same document (another part of it, another row with its doc_id) take the first one's answer.
    """
    width, size = RUN + length - 1, n + length - 1
    strings = padded_strings(raw, np.cumsum(size) - size, size, width)
    order = np.lexsort((doc, strings, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (strings[order[1:]] != strings[order[:-1]])
    count = np.where(fresh, n[order], 1)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    done = np.cumsum(count)
    ends = np.r_[np.flatnonzero(np.diff(key[order])) + 1, len(order)] if len(order) else np.zeros(0, np.int64)
    table, mask, at, e = strings.view(np.uint8).reshape(len(strings), -1), np.zeros(len(key), U), 0, 0
    while at < len(order):
        e = max(e, int(np.searchsorted(done[ends - 1], (done[at - 1] if at else 0) + SORTED_TOGETHER, "right")) - 1)
        to = int(ends[e])
        row, off = np.repeat(order[at:to], count[at:to]), _counting(count[at:to])
        left = size[row] - off
        padded = np.zeros((to - at, width + RUN), np.uint8)
        padded[:, :width] = table[order[at:to], :width]
        suffixes = np.empty((len(row), width + 1), np.uint8)
        suffixes[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[np.repeat(np.arange(to - at), count[at:to]), off]
        suffixes[:, width] = left
        factor = longest_previous_factors(suffixes, left, doc[row], length)
        found = np.flatnonzero(factor)
        np.bitwise_or.at(mask, row[found], ((U(1) << (factor[found] - length + 1).astype(U)) - U(1)) << off[found].astype(U))
        at, e = to, e + 1
    mask[order] = np.where(doc[order] == doc[order[lead]], mask[order[lead]], mask[order])
    return mask


def spans_of(places: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, doc) of the stretches that windows at these sorted places cover, document by document."""
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(places) > length) | (np.diff(doc) != 0)
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(places)][: len(first)] - 1
    return places[first], places[last] + length, doc[first]


def find_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 4_000_000, part_bytes: int = 1 << 19, hot_documents: int = 10_000) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal), kept_sha256 for every document.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id; strings
    are judged on the texts as given. A block is looked at in parts of ``part_bytes``, which bounds a worker's memory whatever a
    text's length. ``hot_documents`` only chooses how a key is dealt, not what is found.

    Defined results: null text is empty; texts shorter than ``length`` lose nothing; a very long text is a block of its
    own, looked at in parts; rows that share a doc_id do not remove one another; rows without doc_id neither remove nor
    lose anything; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "repeat-blocks")
    pack_blocks(docs, block_bytes).write.option("compression", "uncompressed").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    text_bytes = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions(spark), -(-text_bytes // BUCKET_BYTES))
    groups = max(1, math.isqrt(text_bytes // block_bytes))

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]
                pa.default_memory_pool().release_unused()

    def send_keys(batches):
        arrow = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])
        for row in rows_of(batches):
            keys, count = block_keys(Block(row, length, part_bytes))
            bucket = (mix64(keys) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, low = np.unique(bucket[order], return_index=True)
            rows = [{"bucket": b, "block": row["block"], "keys": _squeeze({"gaps": _gaps(keys[some]), "count": count[some]})} for b, some in zip(used.tolist(), np.split(order, low[1:]))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def repeated_keys(group: pa.Table) -> pa.Table:
        sent = [_expand(b) for b in group["keys"].to_pylist()]
        lists = [_ungaps(x["gaps"]) for x in sent]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        fresh = np.ones(len(every), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(fresh)
        documents = np.add.reduceat(np.concatenate([x["count"] for x in sent]).astype(np.int64)[order], first)
        times = np.diff(np.r_[first, len(every)])
        state = np.empty(len(every), np.uint8)  # 1 repeated, 2 hot
        state[order] = np.repeat(np.where(documents > hot_documents, 2, (documents > 1) | (times > 1)).astype(np.uint8), times)
        out, at = [], 0
        for mine in lists:
            own = state[at : at + len(mine)]
            at += len(mine)
            out.append(_squeeze({"gaps": _gaps(mine[own > 0]), "hot": (own[own > 0] == 2).astype("u1")}))
        pa.default_memory_pool().release_unused()
        return pa.table({"key_block": group["block"], "repeated": pa.array(out, pa.binary())})

    sent = blocks.select("block", "doc_ids", "lens", "payload").mapInArrow(send_keys, "bucket int, block long, keys binary")
    repeated = sent.groupBy("bucket").applyInArrow(repeated_keys, "key_block long, repeated binary")
    keys_path = fresh_path(spark, "repeat-keys")
    repeated.groupBy("key_block").agg(F.collect_list("repeated").alias("repeated")).write.option("compression", "uncompressed").parquet(keys_path)
    keyed = blocks.join(spark.read.parquet(keys_path), F.col("block") == F.col("key_block"), "left")

    def entries(row: dict, block: Block):
        """(part number, what it sends, the bucket of each entry) for each part of the block."""
        sent = [_expand(b) for b in row["repeated"] or ()]
        keys = np.concatenate([_ungaps(x["gaps"]) for x in sent]) if sent else np.zeros(0, U)
        hot = np.concatenate([x["hot"] for x in sent]).astype(bool) if sent else np.zeros(0, bool)
        order = np.argsort(keys, kind="stable")
        keys, hot = keys[order], hot[order]
        salt = mix64(mix64(np.array([block.number], U)) % U(groups) + U(1))
        for part, runs in enumerate(block.parts()) if len(keys) else ():
            made = Entries(runs, keys, hot)
            yield part, runs, made, (np.where(made.hot, mix64(made.key ^ salt), mix64(made.key)) % U(buckets)).astype(np.int64)

    def send_entries(batches):
        arrow = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("entries", pa.binary())])
        for row in rows_of(batches):
            for part, _, e, bucket in entries(row, Block(row, length, part_bytes)):
                order = np.argsort(bucket, kind="stable")
                used, low = np.unique(bucket[order], return_index=True)
                rows = [{"bucket": b, "block": row["block"], "part": part, "entries": e.blob(some)} for b, some in zip(used.tolist(), np.split(order, low[1:]))]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    told_arrow = pa.schema([("block", pa.int64()), ("to_bucket", pa.int32()), ("content", pa.binary())])

    def judge(group: pa.Table) -> pa.Table:
        """Answers to every sender. Windows sent one by one that no document of the group has earlier go on to round two."""
        sent = [_expand(b) for b in group["entries"].to_pylist()]
        key, doc, n, raw = (np.concatenate([x[c] for x in sent]) for c in ("key", "doc", "n", "raw"))
        mask = answers(key, doc, n.astype(np.int64), raw, length)
        home, rows, again, at = [group[c].to_pylist() for c in ("block", "part", "bucket")], [], [], 0
        for block, part, bucket, x in zip(*home, sent):
            own = mask[at : at + len(x["key"])]
            at += len(own)
            rows.append({"block": block, "to_bucket": -1, "content": _squeeze({"part": np.array([part], "<i4"), "bucket": np.array([bucket], "<i4"), "mask": own})})
            left = np.flatnonzero((x["hot"] == 1) & (own == 0)) if groups > 1 else []
            if len(left):
                size = x["n"].astype(np.int64) + length - 1
                raw = x["raw"][np.repeat((np.cumsum(size) - size)[left], length) + np.tile(np.arange(length), len(left))]
                again.append({"block": np.full(len(left), block), "part": np.full(len(left), part, "<i4"), "bucket": np.full(len(left), bucket, "<i4"), "at": left, "key": x["key"][left], "doc": x["doc"][left], "raw": raw.reshape(-1, length)})
        if again:
            every = {c: np.concatenate([x[c] for x in again]) for c in again[0]}
            to = (mix64(every["key"]) % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            used, low = np.unique(to[order], return_index=True)
            rows += [{"block": None, "to_bucket": b, "content": _squeeze({c: x[some].ravel() for c, x in every.items()})} for b, some in zip(used.tolist(), np.split(order, low[1:]))]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_pylist(rows, schema=told_arrow)

    def judge_again(group: pa.Table) -> pa.Table:
        """Answers, for each block in one row, to the windows that round two found an earlier copy of."""
        sent = [_expand(b) for b in group["content"].to_pylist()]
        every = {c: np.concatenate([x[c] for x in sent]) for c in ("block", "part", "bucket", "at", "key", "doc", "raw")}
        mask = answers(every["key"], every["doc"], np.ones(len(every["key"]), np.int64), every["raw"], length)
        order = np.argsort(every["block"], kind="stable")
        order = order[mask[order] != 0]
        used, low = np.unique(every["block"][order], return_index=True)
        rows = [{"block": b, "to_bucket": -1, "content": _squeeze({"mask": mask[some], **{c: every[c][some] for c in ("part", "bucket", "at")}})} for b, some in zip(used.tolist(), np.split(order, low[1:]))]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_pylist(rows, schema=told_arrow)

    dealt = keyed.mapInArrow(send_entries, ENTRIES)
    first_path = fresh_path(spark, "repeat-answers")
    dealt.groupBy("bucket").applyInArrow(judge, ANSWERS).write.option("compression", "uncompressed").parquet(first_path)
    judged = spark.read.schema(ANSWERS).parquet(first_path)
    second = judged.where("to_bucket >= 0").groupBy("to_bucket").applyInArrow(judge_again, ANSWERS)
    told = judged.where("to_bucket < 0").unionByName(second).select(F.col("block").alias("answer_block"), "content")
    answer_path = fresh_path(spark, "repeat-told")
    told.groupBy("answer_block").agg(F.collect_list("content").alias("answers")).write.option("compression", "uncompressed").parquet(answer_path)
    answered = keyed.join(spark.read.parquet(answer_path), F.col("block") == F.col("answer_block"), "left")

    def cut(batches):
        for row in rows_of(batches):
            block, told, found = Block(row, length, part_bytes), {}, []
            for x in map(_expand, row["answers"] or ()):
                for part in np.unique(x["part"]).tolist():
                    told.setdefault(part, []).append(x)
            for part, runs, e, bucket in entries(row, block):
                order, mask = np.argsort(bucket, kind="stable"), np.zeros(len(e.key), U)
                ordered = bucket[order]
                for x in told.get(part, ()):
                    low = np.searchsorted(ordered, x["bucket"])
                    if "at" in x:
                        mine = x["part"] == part
                        mask[order[low[mine] + x["at"][mine]]] |= x["mask"][mine]
                    else:
                        mask[order[low[0] : low[0] + len(x["mask"])]] |= x["mask"]
                own = e.copied(mask)
                which, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(own).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                places = np.sort(e.run_start[which] + bit) + runs.base
                found.append(spans_of(places, np.searchsorted(block.starts, places, "right") - 1, length))
            low, high, of = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            joined = np.ones(len(low), bool)
            joined[1:] = (low[1:] > high[:-1]) | (np.diff(of) != 0)
            high = high[np.r_[np.flatnonzero(joined)[1:], len(low)].astype(int) - 1] if len(low) else high
            low, of = low[joined], of[joined]
            cuts, rows = np.searchsorted(of, np.arange(len(block.lens) + 1)), []
            for k, doc_id in enumerate(block.doc_ids):
                begin, end, kept = int(block.starts[k]), int(block.starts[k + 1]), hashlib.sha256()
                spans, at = [], begin
                for a, b in zip(low[cuts[k] : cuts[k + 1]].tolist(), high[cuts[k] : cuts[k + 1]].tolist()):
                    kept.update(block.data[at:a])
                    spans.append({"from": a - begin, "to": b - begin})
                    at = b
                kept.update(block.data[at:end])
                rows.append({"doc_id": doc_id, "n_bytes": end - begin, "spans": spans, "kept_sha256": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=RESULT_ARROW)

    return answered.mapInArrow(cut, RESULT)
