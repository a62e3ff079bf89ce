"""Benchmark decontamination: a distributed positional inverted index, phrase and proximity matches by list intersection.

The index is divided by document: each segment holds whole documents and, for every term, the sorted list of its
positions. A query visits every segment once and needs no shuffle, so a term that is in every document costs no task
more than its own segment's list. Positions run through a segment with one free place between documents, so a phrase
cannot reach into the next one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .encoder import text_slices

# bytes that part words become spaces; A-Z become a-z
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "segment long, doc_ids array<long>, n_words array<long>, terms array<binary>, positions array<binary>"
HITS = "segment long, ordinal long, doc_id long, n_words long, spans array<struct<from:long,to:long>>, item_ids array<string>"
BROADCAST_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def _packed(positions: np.ndarray) -> bytes:
    """Gaps in the smallest of three widths, which the first byte names."""
    gaps = np.diff(positions, prepend=0)
    width = "u1" if gaps.max() < 1 << 8 else "<u2" if gaps.max() < 1 << 16 else "<u4"
    return width[-1].encode() + gaps.astype(width).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{chr(blob[0])}", offset=1), dtype=np.int64)


def build_index(docs: DataFrame, terms: list[bytes] | None = None, segment_chars: int = 8_000_000) -> DataFrame:
    """One row for each segment of about ``segment_chars`` characters, written to the shared folder.

    With ``terms`` only their postings are stored, which answers every query made of these terms.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(None if terms is None else {t: i for i, t in enumerate(terms)})

    def run(batches):
        from pyspark import TaskContext

        known, part = shared.value, TaskContext.get().partitionId()
        number, ids, lens, arrays, chars = 0, [], [], [], 0
        own: dict[bytes, int] = {}

        def flush():
            nonlocal number, ids, lens, arrays, chars, own
            names = known if known is not None else own
            starts = np.cumsum([0, *[n + 1 for n in lens]])[:-1]
            term = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            at = np.concatenate([np.arange(len(a)) + s for a, s in zip(arrays, starts)]) if arrays else term
            keep = term >= 0
            term, at = term[keep], at[keep]
            order = np.argsort(term, kind="stable")
            term, at = term[order], at[order]
            used, low = np.unique(term, return_index=True)
            by_id = list(names)
            row = {"segment": (part << 32) + number, "doc_ids": ids, "n_words": lens, "terms": [by_id[i] for i in used], "positions": [_packed(p) for p in np.split(at, low[1:])] if len(used) else []}
            number, ids, lens, arrays, chars, own = number + 1, [], [], [], 0, {}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("positions", pa.list_(pa.binary()))])
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in text_slices(batch.column(1)):
                for text in texts:
                    words = words_of(text)
                    if known is not None:
                        found = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                    else:
                        found = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int32, len(words))
                    ids.append(keys[at])
                    lens.append(len(words))
                    arrays.append(found)
                    chars += len(text) if text else 0
                    at += 1
                    if chars >= segment_chars:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(run, INDEX), "positional-index")


def _within(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return sorted_[at] == wanted


def phrase_starts(lists: list[np.ndarray], window: int | None) -> list[tuple[int, np.ndarray]]:
    """(window start in the item, places in the segment where the item's first word would stand) for windows that occur.

    ``lists`` has the positions of each of the item's words. Windows that share their rarest word are taken together:
    that word's list, moved by its offset, is intersected with the lists of the words common to them, rarest first, and
    then for each window with the rest of its words.
    """
    m = len(lists)
    size = m if window is None else min(window, m)
    count = np.array([len(p) for p in lists])
    groups: dict[int, list[int]] = {}
    for s in range(m - size + 1):
        rarest = s + int(np.argmin(count[s : s + size]))
        if count[rarest]:
            groups.setdefault(rarest, []).append(s)
    out = []
    for rarest, starts in groups.items():
        places = lists[rarest] - rarest
        common = range(max(starts), min(starts) + size)
        for j in sorted(common, key=count.__getitem__):
            if j != rarest and len(places):
                places = places[_within(lists[j], places + j)]
        for s in starts if len(places) else ():
            some = places
            for j in sorted((j for j in range(s, s + size) if j not in common), key=count.__getitem__):
                if len(some):
                    some = some[_within(lists[j], some + j)]
            if len(some):
                out.append((s, some))
    return out


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")


def _blocks(items: DataFrame):
    """The query set in blocks of about ``BROADCAST_BYTES`` by a hash, one at a time on the driver."""
    items = _items(items)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BROADCAST_BYTES
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item_id, w) for r in items.where(block == k).collect() if (w := words_of(r.text))]


class ItemSet:
    """The words of a block of items one after another, and all their windows, to tell at once which a segment may hold."""

    def __init__(self, block: list[tuple[str, list[bytes]]], window: int | None):
        self.block = block
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(w for _, words in block for w in words))}
        self.flat = np.fromiter((self.terms[w] for _, words in block for w in words), np.int32)
        m = np.array([len(words) for _, words in block], np.int64)
        size = m if window is None else np.minimum(m, window)
        n = m - size + 1
        self.owner = np.repeat(np.arange(len(m)), n).astype(np.int32)
        self.begin = (np.repeat(np.cumsum(m) - m - np.cumsum(n) + n, n) + np.arange(n.sum())).astype(np.int32)
        self.end = (self.begin + np.repeat(size, n)).astype(np.int32)

    def possible(self, terms) -> list[tuple[str, list[bytes]]]:
        """The items with a window all of whose words are among ``terms``: a word that the segment lacks rules its windows out."""
        known = np.zeros(len(self.terms), bool)
        known[[i for t in terms if (i := self.terms.get(t)) is not None]] = True
        seen = np.r_[0, np.cumsum(known[self.flat])]
        full = seen[self.end] - seen[self.begin] == self.end - self.begin
        return [self.block[k] for k in np.unique(self.owner[full]).tolist()]


def find_windows(index: DataFrame, block: list[tuple[str, list[bytes]]], window: int | None = 10) -> DataFrame:
    """For each document of the index: the spans of words inside occurrences of any item's windows, and those items."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        none, items = np.zeros(0, np.int64), ItemSet(shared.value, window)
        for batch in batches:
            for row in batch.to_pylist():
                lists = {t: _unpacked(p) for t, p in zip(row["terms"], row["positions"])}
                lens = np.array(row["n_words"], np.int64)
                starts = np.cumsum(np.r_[0, lens + 1])
                cover = np.zeros(starts[-1] + 1, np.int64)
                named: dict[int, set[str]] = {}
                for item_id, words in items.possible(lists):
                    size = len(words) if window is None else min(window, len(words))
                    for s, places in phrase_starts([lists.get(w, none) for w in words], window):
                        np.add.at(cover, places + s, 1)
                        np.add.at(cover, places + s + size, -1)
                        for k in np.unique(np.searchsorted(starts, places + s, "right") - 1).tolist():
                            named.setdefault(k, set()).add(item_id)
                edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans: dict[int, list] = {}
                for k, a, b in zip((np.searchsorted(starts, low, "right") - 1).tolist(), low.tolist(), high.tolist()):
                    spans.setdefault(k, []).append({"from": a - int(starts[k]), "to": b - int(starts[k])})
                for k0 in range(0, len(lens), 5000):
                    part = range(k0, min(k0 + 5000, len(lens)))
                    yield pa.RecordBatch.from_pylist(
                        [{"segment": row["segment"], "ordinal": k, "doc_id": row["doc_ids"][k], "n_words": row["n_words"][k], "spans": spans.get(k, []), "item_ids": sorted(named.get(k, ()))} for k in part],
                        schema=pa.schema([("segment", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("item_ids", pa.list_(pa.string()))]),
                    )

    return index.mapInArrow(run, HITS)


def _merged(hits: DataFrame) -> DataFrame:
    """Spans and items of a document from several blocks of the query set in one row."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= s["from"]), longer).otherwise(F.concat(acc, F.array(s)))

    one = hits.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return one.withColumn("spans", F.aggregate("spans", empty, step))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, spans, item_ids for every document: where windows of ``window`` item words occur in it.

    An item with fewer words is one window. Items are taken in blocks of about 8 MB, in the same way however many there
    are: for each block an index that holds the postings of its words, searched with all its items. What one block found
    is written before the next is read, so driver and tasks hold one block at a time.

    Defined results: null and empty texts have no words and no hits; a very long text is a segment of its own; items
    without words or item_id are never found; a repeated item_id is one item; repeated document rows each give a row;
    empty tables give no rows, or no hits; other columns, whatever their names, are ignored.
    """
    found = []
    for block in _blocks(items):
        index = build_index(docs, sorted({w for _, words in block for w in words}))
        found.append(saved(find_windows(index, block, window), "benchmark-hits"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return (_merged(out) if len(found) > 1 else out).select("doc_id", "n_words", "spans", "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any window of an item, all columns as they are.

    The decision is by text, not by doc_id: a hit comes back to the rows by the 64-bit hash of the text that has it, so
    nothing but hashes is written. Defined results: as ``find_contamination``; an empty table stays empty; extra columns
    may have any name.
    """
    own = F.xxhash64(F.col("text").cast("string"))
    found = find_contamination(docs.select(own.alias("doc_id"), "text"), items, window)
    hit = saved(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_text")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(hit, F.xxhash64(F.col("doc.text").cast("string")) == F.col("hit_text"), "left_anti").select("doc.*")


def find_near(index: DataFrame, items: DataFrame, slack: int = 5) -> DataFrame:
    """doc_id, item_id, from, to: the shortest stretch of at most the item's length plus ``slack`` words that holds all of
    the item's different words in any order, for each document that has one (the first, if several are as short)."""
    out = None
    for block in _blocks(items):
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for row in batch.to_pylist():
                    found = []
                    lists = {t: _unpacked(p) for t, p in zip(row["terms"], row["positions"])}
                    lens = np.array(row["n_words"], np.int64)
                    starts = np.cumsum(np.r_[0, lens + 1])
                    for item_id, words in shared.value:
                        asked = [lists.get(w, np.zeros(0, np.int64)) for w in set(words)]
                        reach = len(words) + slack
                        asked.sort(key=len)
                        centre = asked[0]
                        for other in asked[1:]:
                            centre = centre[np.searchsorted(other, centre - reach + 1) < np.searchsorted(other, centre + reach)] if len(other) else centre[:0]
                        best: dict[int, tuple[int, int, int]] = {}
                        for p in centre.tolist():
                            k = int(np.searchsorted(starts, p, "right") - 1)
                            low, high = max(p - reach + 1, int(starts[k])), min(p + reach, int(starts[k] + lens[k]))
                            near = sorted((int(x), i) for i, other in enumerate(asked) for x in other[np.searchsorted(other, low) : np.searchsorted(other, high)])
                            last: dict[int, int] = {}
                            for x, i in near:
                                last[i] = x
                                if len(last) == len(asked) and (n := x - min(last.values()) + 1) <= reach:
                                    best[k] = min(best.get(k, (n, min(last.values()), x)), (n, min(last.values()), x))
                        found += [{"doc_id": row["doc_ids"][k], "item_id": item_id, "from": a - int(starts[k]), "to": b + 1 - int(starts[k])} for k, (_, a, b) in sorted(best.items())]
                    yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("from", pa.int64()), ("to", pa.int64())]))

        part = index.mapInArrow(run, "doc_id long, item_id string, from long, to long")
        out = part if out is None else out.unionByName(part)
    return out


ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row_id, n, s, list_slice(w, s, s + n - 1) AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n),
found AS (SELECT row_id, p.n, s, item_id FROM places p JOIN windows v ON p.win = v.win),
hits AS (SELECT row_id, count(DISTINCT s + k) AS n_hit FROM found, unnest(range(0, n)) AS u(k) GROUP BY row_id),
items AS (SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (row_id) LEFT JOIN items USING (row_id)
"""
