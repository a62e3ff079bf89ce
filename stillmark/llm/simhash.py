"""SimHash near-duplicates: fingerprints of word shingles, linked exactly through sharded vantage-point trees.

Two levels of trees find all pairs of 64-bit fingerprints within ``distance`` bits:

* Shards. Fingerprints that differ in at most 4 bits differ in at most 1 within one of four 16-bit bands. For each band a
  vantage-point tree divides fingerprints by the Hamming distance of the band to vantage points; a ball that is still too
  heavy when only one band value is left is divided further by the distance of all 64 bits. A fingerprint lives in the
  shard of its leaf and is also sent to the boundary shards behind it that the triangle inequality doesn't rule out, so
  every pair meets in one shard at least.
* Within a shard a vantage-point tree over its own 64-bit fingerprints is searched with all that came to it; branches go
  by triangle bounds, and what is left is compared bit by bit.

The shard trees know at most 65,536 values for each band and a bounded sample of heavy balls, so what is broadcast has a
fixed bound whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_rows
from .components import LocalUnion, connected_components
from .encoder import text_slices

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 64
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
U = np.uint64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A bit is set where over half of the shingles' XXH64 have it set; no words give zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[len(words) - n :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every whole text."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for texts in text_slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _apart(values: np.ndarray, point, mask=WHOLE) -> np.ndarray:
    return np.bitwise_count((values ^ U(point)) & mask).astype(np.int64)


def _best_split(values: np.ndarray, weights: np.ndarray, mask, radius: int) -> tuple[int, int] | None:
    """(vantage point, threshold) of good balance and little weight near the threshold; None if nothing parts the values."""
    best = None
    for point in (values[0], values[len(values) // 2], values[-1], values[np.argmax(weights)]):
        by = np.bincount(_apart(values, point, mask), weights=weights)
        inside = np.cumsum(by)[:-1]
        near = np.convolve(by, np.ones(2 * radius))[radius:][: len(inside)] if radius else np.zeros(len(inside))
        gain = np.minimum(inside, weights.sum() - inside) - 0.5 * near
        gain[(inside == 0) | (inside == weights.sum())] = -np.inf
        if len(gain) and np.isfinite(gain.max()) and (best is None or gain.max() > best[0]):
            best = (gain.max(), int(point), int(np.argmax(gain)))
    return best and best[1:]


@dataclass
class VantageTree:
    """A vantage-point tree that divides 64-bit fingerprints into leaves of bounded weight.

    It is built over the values of one band (``mask``) with their numbers of fingerprints. Where one value alone is too
    heavy, ``sample`` (fingerprints) says how it is divided by all bits. ``nodes`` holds a leaf number or (mask, vantage
    point, threshold, radius, inside child, outside child).
    """

    values: np.ndarray
    weights: np.ndarray
    mask: int
    radius: int
    distance: int
    leaf_weight: int
    sample: np.ndarray
    nodes: list = field(default_factory=list)
    leaves: int = 0

    def __post_init__(self):
        self._build(self.values.astype(U), self.weights.astype(float), U(self.mask), self.radius)
        self.values = self.weights = self.sample = None

    def _build(self, v: np.ndarray, w: np.ndarray, mask, radius: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        heavy = w.sum() > self.leaf_weight
        if heavy and len(v) == 1 and mask != WHOLE:
            inside = self.sample[(self.sample & mask) == v[0]]
            if len(inside) > 1:
                v, w, mask, radius = inside, np.full(len(inside), w[0] / len(inside)), WHOLE, self.distance
        split = _best_split(v, w, mask, radius) if heavy and len(v) > 1 else None
        if split is None:
            self.nodes[at] = self.leaves
            self.leaves += 1
            return at
        near = _apart(v, split[0], mask) <= split[1]
        self.nodes[at] = (mask, *split, radius, self._build(v[near], w[near], mask, radius), self._build(v[~near], w[~near], mask, radius))
        return at

    def home(self, fps: np.ndarray) -> np.ndarray:
        rows, leaves = self._visit(fps, False)
        out = np.empty(len(fps), np.int64)
        out[rows] = leaves
        return out

    def reached(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold a fingerprint linked to ``fps[row]`` by this band."""
        return self._visit(fps, True)

    def _visit(self, fps: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        rows, leaves, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(fps)))]
        while todo:
            node, some = todo.pop()
            if not len(some):
                continue
            what = self.nodes[node]
            if isinstance(what, int):
                rows.append(some)
                leaves.append(np.full(len(some), what))
                continue
            mask, point, mu, radius, inside, outside = what
            d, reach = _apart(fps[some], point, mask), radius if wide else 0
            todo += [(inside, some[d <= mu + reach]), (outside, some[d > mu - reach])]
        return np.concatenate(rows), np.concatenate(leaves)


def link_in_shard(own: np.ndarray, fps: np.ndarray, distance: int, leaf_rows: int = 64, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root) for the fingerprints of one shard that link to another: a tree over its own ones, searched with all.

    Pairs are looked at in blocks of ``most``, never kept: they only feed a union-find, so a group of near copies gives
    one row for each member.
    """
    order = np.argsort(fps, kind="stable")
    fps, own = fps[order], own[order]
    union = LocalUnion(len(fps))
    todo = [(np.flatnonzero(own), np.arange(len(fps)))]
    while todo:
        held, asked = todo.pop()
        if not len(held) or not len(asked):
            continue
        split = _best_split(fps[held], np.ones(len(held)), WHOLE, distance) if len(held) > leaf_rows else None
        if split is not None:
            point, mu = split
            near, d = _apart(fps[held], point) <= mu, _apart(fps[asked], point)
            # triangle inequality: what is within ``distance`` of a row lies within d +- distance of the vantage point
            todo += [(held[near], asked[d <= mu + distance]), (held[~near], asked[d > mu - distance])]
            continue
        step = max(1, most // len(held))
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            row, col = np.nonzero(np.bitwise_count(fps[q, None] ^ fps[held]) <= distance)
            union.link(q[row], held[col])
    root = union.roots()
    linked = root != np.arange(len(root))
    return fps[linked], fps[root[linked]]


def linked_classes(prints: DataFrame, distance: int = 4, bands: int = 4, leaf_weight: int = 8192, sample_rows: int = 65536) -> DataFrame:
    """class_fp, root for every distinct ``fp`` of ``prints``; equal roots are one component. Needs ``distance`` < 2 * ``bands``."""
    if distance >= 2 * bands or BITS % bands:
        raise ValueError("a link must show within one differing bit of some band")
    spark = prints.sparkSession
    width, radius = BITS // bands, min(1, distance // bands)
    firsts = saved(prints.select("fp").distinct(), "distinct-fingerprints")
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << width) - 1).alias("value")) for b in range(bands)]))
    counted = firsts.select(band.alias("x")).groupBy("x.band", "x.value").count().toPandas()  # at most bands * 2**width rows
    sample = np.zeros(0, U)
    if len(counted) and counted["count"].max() > leaf_weight:
        share = int(min(1.0, 2 * sample_rows / counted[counted["band"] == 0]["count"].sum()) * (1 << 31))
        picked = firsts.withColumn("h", F.pmod(F.xxhash64("fp"), F.lit(1 << 31))).where(F.col("h") < share).orderBy("h", "fp").limit(sample_rows)
        sample = picked.select("fp").toPandas()["fp"].to_numpy(np.int64).view(U)
    trees = []
    for b in range(bands):
        mine = counted[counted["band"] == b].sort_values("value")
        values = mine["value"].to_numpy(U) << U(b * width)
        trees.append(VantageTree(values, mine["count"].to_numpy(), ((1 << width) - 1) << (b * width), radius, distance, leaf_weight, sample))
    first_shard = np.cumsum([0, *[t.leaves for t in trees]]).tolist()
    shared = spark.sparkContext.broadcast((trees, first_shard))

    def deal(batches):
        trees, first_shard = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for tree, first in zip(trees, first_shard):
                home = tree.home(fps)
                rows, leaves = tree.reached(fps)
                behind = leaves >= home[rows]  # the other fingerprint of a pair comes to the shards before its own
                rows, leaves = rows[behind], leaves[behind]
                yield pa.RecordBatch.from_arrays([pa.array((leaves + first).astype(np.int32)), pa.array(fps[rows].view(np.int64)), pa.array(home[rows] == leaves)], ["shard", "fp", "own"])

    def search(group: pa.Table) -> pa.Table:
        a, root = link_in_shard(group["own"].to_numpy(zero_copy_only=False), group["fp"].to_numpy().view(U), distance)
        return pa.table({"a": a.view(np.int64), "b": root.view(np.int64)})

    dealt = firsts.mapInArrow(deal, "shard int, fp long, own boolean")
    labels = connected_components(saved(dealt.groupBy("shard").applyInArrow(search, "a long, b long"), "fingerprint-links"))
    return firsts.join(labels, firsts.fp == labels.node, "left").select(F.col("fp").alias("class_fp"), F.coalesce("label", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, **tree) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most ``distance`` bits.

    Equal fingerprints become one before any search, whatever their number.

    Defined results: null and empty texts have fingerprint zero and link like others; very long texts are read whole, and
    their shingles' hashes are in memory one text at a time; repeated rows each give a row; rows without doc_id are linked
    but never name a component, unless it has no other row (then null); an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    prints = saved(fingerprints(docs, shingle, seed), "fingerprints")
    classes = linked_classes(prints, distance, **tree)
    firsts = prints.groupBy(F.col("fp").alias("of_fp")).agg(F.min("doc_id").alias("first_id"))
    named = saved(classes.join(firsts, F.col("class_fp") == F.col("of_fp")).select("class_fp", "root", "first_id"), "fingerprint-classes")
    smallest = named.groupBy(F.col("root").alias("of_root")).agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, F.col("root") == F.col("of_root")).select("class_fp", "component_id")
    joined = prints.join(named, F.col("fp") == F.col("class_fp"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, **tree) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the smallest doc_id (null last).

    The decision is by row, not by doc_id, so rows that share a doc_id, or have none, are told apart; of equal rows one
    stays. Texts are read twice and never written or shuffled, unless most documents go.

    Defined results: as ``near_duplicates``; an empty table stays empty; extra columns may have any name.
    """
    rows = with_rows(docs)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for texts in text_slices(batch.column(3)) for t in texts], U)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], ["file", "place", "doc_id", "fp"])

    marked = rows.select("row.file", "row.place", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    prints = saved(marked.mapInArrow(run, "file long, place long, doc_id long, fp long"), "fingerprints").select("fp", "doc_id", F.struct("file", "place").alias("row"))
    classes = linked_classes(prints, distance, **tree)
    firsts = prints.groupBy(F.col("fp").alias("of_fp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first"))
    named = classes.join(firsts, F.col("class_fp") == F.col("of_fp"))
    kept = saved(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept_row")), "kept-rows")
    gone = saved(prints.select(F.col("row").alias("gone_row")).join(kept, F.col("gone_row") == F.col("kept_row"), "left_anti"), "near-copies")
    return rows.join(gone, F.col("row") == F.col("gone_row"), "left_anti").select("doc.*")
