"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first up to a calibrated recall."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

PARTIAL = "query_row long, query_id long, row long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id and embedding of the vectors that take part: finite and not zero. The row number tells repeated ids apart."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, by differences (equal vectors are at exactly equal distance)."""
    return np.sqrt(((queries[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))


def nearest(asked: tuple, held: tuple, k: int) -> pa.Table:
    """The k nearest of a block for each query, ties to the smaller vec_id, in slices of bounded memory.

    Both are (row, id, vectors); a query meets every row but its own.
    """
    (query_rows, query_ids, queries), (rows, vec_ids, vectors) = asked, held
    step = max(1, 4_000_000 // max(1, vectors.size))
    order = np.lexsort((rows, vec_ids))
    rows, vec_ids, vectors = rows[order], vec_ids[order], vectors[order]
    out = []
    for at in range(0, len(queries), step):
        d = distances(queries[at : at + step], vectors)
        d[query_rows[at : at + step, None] == rows[None, :]] = np.inf
        for line, q, i in zip(d, query_rows[at : at + step], query_ids[at : at + step]):
            top = np.argsort(line, kind="stable")[:k]
            top = top[np.isfinite(line[top])]
            out.append((np.full(len(top), q), np.full(len(top), i), rows[top], vec_ids[top], line[top]))
    cat = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
    names = ["query_row", "query_id", "row", "vec_id"]
    return pa.table({**{c: x.astype(np.int64) for c, x in zip(names, cat)}, "score": cat[4]})


def best_of(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query."""
    q, r, v, d = (found[c].to_numpy() for c in ("query_row", "row", "vec_id", "score"))
    order = np.lexsort((r, v, d, q))
    fresh = np.r_[True, np.diff(q[order]) != 0] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return found.take(pa.array(order[place < k]))


def shards_of(counts: np.ndarray, rows_per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each leaf: neighbouring leaves share a shard of about ``rows_per_shard`` rows,
    and a leaf with more has several to itself."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > rows_per_shard:
            shard, held = shard + 1, 0
        first[leaf] = shard
        if n > rows_per_shard:
            parts[leaf] = -(-n // rows_per_shard)
            shard, held = shard + int(parts[leaf]), 0
        else:
            held += n
    return first, parts


@dataclass
class KMeansTree:
    """Inner nodes hold their children's centroids; ``child`` is a node number or, below zero, ~leaf."""

    centroids: list[np.ndarray]
    child: list[list[int]]
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: int, branching: int = 8, rounds: int = 8, seed: int = 7) -> "KMeansTree":
        rng = np.random.default_rng(seed)
        tree = cls([], [], 0)

        def split(rows: np.ndarray) -> int:
            if len(rows) <= leaf_rows or len(np.unique(sample[rows], axis=0)) <= 1:
                tree.leaves += 1
                return ~(tree.leaves - 1)
            x = sample[rows]
            distinct = np.unique(x, axis=0)
            centres = distinct[rng.choice(len(distinct), min(branching, len(distinct)), replace=False)]
            for _ in range(rounds):
                near = _closest(x, centres)
                centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
            near = _closest(x, centres)
            used = [c for c in range(len(centres)) if (near == c).any()]
            if len(used) == 1:
                tree.leaves += 1
                return ~(tree.leaves - 1)
            node = len(tree.centroids)
            tree.centroids.append(centres[used])
            tree.child.append([])
            tree.child[node] = [split(rows[near == c]) for c in used]
            return node

        if split(np.arange(len(sample))) < 0:
            tree.centroids, tree.child = [], []
        return tree

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centroid at every level."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))] if self.centroids else []
        while todo:
            node, rows = todo.pop()
            near = _closest(vectors[rows], self.centroids[node])
            for c, child in enumerate(self.child[node]):
                some = rows[near == c]
                if len(some) and child < 0:
                    out[some] = ~child
                elif len(some):
                    todo.append((child, some))
        return out

    def best_first(self, query: np.ndarray, visits: int, least_rows: int, leaf_counts: np.ndarray) -> list[int]:
        """Leaves in the order of a priority queue over centroid distances: ``visits`` of them, and on until they hold
        ``least_rows`` rows."""
        if not self.centroids:
            return [0]
        heap, found, rows = [(0.0, 0)], [], 0
        while heap and (len(found) < visits or rows < least_rows):
            _, node = heapq.heappop(heap)
            if node < 0:
                found.append(~node)
                rows += int(leaf_counts[~node])
                continue
            d = np.sqrt(((self.centroids[node] - query) ** 2).sum(axis=1))
            for child, far in zip(self.child[node], d.tolist()):
                heapq.heappush(heap, (far, child))
        return found


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (centres**2).sum(axis=1)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = np.argmin(half - x[at : at + 8192] @ centres.T, axis=1)
    return out


def brute_force(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """``PARTIAL`` and rank: the exact k nearest of a bounded set of queries (rows of ``usable``) of one length against all
    rows of that length: every task sends its k best for each query."""
    asked = tuple(np.array([r[c] for r in queries], t) for c, t in (("row", np.int64), ("vec_id", np.int64), ("embedding", np.float64)))
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                held = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(2)))
                yield from nearest(shared.value, held, k).to_batches()

    return ranked(vectors.select("row", "vec_id", "embedding").mapInArrow(run, PARTIAL), k)


def ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    recall: float = 0.97,
    sample_rows: int = 16384,
    leaf_rows: int = 256,
    calibration_queries: int = 256,
    rows_per_shard: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id is divisible by ``every``.

    The tree is fitted on a bounded sample (``sample_rows``, chosen by a hash of the row) and indexes every row. The number
    of leaves to visit is widened until the calibration queries (at most ``calibration_queries``, searched by brute force
    over all rows) reach ``recall``. Neighbouring leaves share a shard, to which a query goes once; a leaf with many rows,
    such as copies of one vector, is dealt to several shards by a hash of the row. No task holds more than about
    ``rows_per_shard`` vectors, and each shard sends k rows for a query.

    Defined results: vectors that are null, zero or not finite take no part, nor do null vec_ids; every row is a candidate
    of its own, also where vec_ids repeat (each repeated query is answered, and meets the other rows of its id); vectors
    meet those of their own length, each length having its own tree; fewer candidates than k give them all; ties go to the
    smaller vec_id; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    clean = usable(vectors)
    lengths = [r.length for r in clean.select(F.size("embedding").alias("length")).distinct().orderBy("length").collect()]
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for length in lengths:  # one, in most tables
        same = clean.where(F.size("embedding") == length) if len(lengths) > 1 else clean
        found = _search(same, every, k, recall, sample_rows, leaf_rows, calibration_queries, rows_per_shard)
        out = found if length == lengths[0] else out.unionByName(found)
    return out


def _search(clean: DataFrame, every: int, k: int, recall: float, sample_rows: int, leaf_rows: int, calibration_queries: int, rows_per_shard: int) -> DataFrame:
    """``nearest_neighbours`` of written rows of one length."""
    spark, total = clean.sparkSession, clean.count()

    def sampled(rows: DataFrame, name: str, most: int, of: int) -> list:
        """At most ``most`` rows with the smallest hashes; the filter before the sort keeps about twice that."""
        h = F.pmod(F.xxhash64(F.lit(name), "row"), F.lit(1 << 31))
        return rows.withColumn("h", h).where(F.col("h") < int(min(1.0, 2 * most / of) * (1 << 31))).orderBy("h", "row").limit(most).collect()

    sample = sampled(clean, "tree", sample_rows, total)
    points = np.array([r.embedding for r in sample], np.float64)
    tree = KMeansTree.fit(points, max(16, round(leaf_rows * len(points) / total)))
    shared_tree = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared_tree.value.assign(matrix(batch.column(2)))), *batch.columns], ["leaf", "row", "vec_id", "embedding"])

    index = saved(clean.mapInArrow(place, "leaf long, row long, vec_id long, embedding array<double>"), "vector-index")
    counts = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # one row for each leaf of the bounded tree
        counts[r.leaf] = r["count"]
    asked = index.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    visits = 1
    if n_asked:
        probe = sampled(asked, "calibrate", calibration_queries, n_asked)
        truth = brute_force(clean, probe, k)
        where_is = truth.select("query_row", "row").join(index.select("row", "leaf"), "row").select("query_row", "leaf").collect()
        place_of = {}
        for r in probe:
            order = tree.best_first(np.array(r.embedding), tree.leaves, 0, counts)
            place_of[r.row] = {leaf: i for i, leaf in enumerate(order)}
        needed = np.array([place_of[r.query_row][r.leaf] for r in where_is])
        while len(needed) and visits < tree.leaves and (needed < visits).mean() < recall:
            visits += 1
    first_shard, parts = shards_of(counts, rows_per_shard)
    shared = spark.sparkContext.broadcast((visits, counts, first_shard, parts))

    def route(batches):
        """Each query once for each shard, with the leaves that it visits there."""
        tree, (visits, counts, first_shard, parts) = shared_tree.value, shared.value
        for batch in batches:
            x = matrix(batch.column(2))
            rows, shards, visited = [], [], []
            for i, q in enumerate(x):
                mine: dict[int, list[int]] = {}
                for leaf in tree.best_first(q, visits, k + 1, counts):
                    for part in range(parts[leaf]):
                        mine.setdefault(int(first_shard[leaf]) + part, []).append(leaf)
                rows += [i] * len(mine)
                shards += mine.keys()
                visited += mine.values()
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *[c.take(pa.array(rows, pa.int64())) for c in batch.columns], pa.array(visited, pa.list_(pa.int64()))], ["shard", "query_row", "query_id", "query", "leaves"])

    routed = asked.select("row", "vec_id", "embedding").repartition(partitions(spark)).mapInArrow(route, "shard long, query_row long, query_id long, query array<double>, leaves array<long>")
    sizes = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first_shard, parts))], "size_leaf long, first_shard long, n_parts long")
    dealt = index.join(F.broadcast(sizes), F.col("leaf") == F.col("size_leaf"))  # one row for each leaf of the bounded tree
    dealt = dealt.select((F.col("first_shard") + F.pmod(F.xxhash64("row"), F.col("n_parts"))).alias("shard"), "leaf", "row", "vec_id", "embedding")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in ("query_row", "query_id", "row", "vec_id", "score")})
        if not asked.num_rows or not held.num_rows:
            return none
        queries = (asked["query_row"].to_numpy(), asked["query_id"].to_numpy(), matrix(asked["query"]))
        vectors, leaf = (held["row"].to_numpy(), held["vec_id"].to_numpy(), matrix(held["embedding"])), held["leaf"].to_numpy()
        lists = asked["leaves"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        wanted = lists.flatten().to_numpy()
        found = []
        for at in np.unique(leaf):
            some, mine = row[wanted == at], leaf == at
            if len(some):
                found.append(nearest(tuple(x[some] for x in queries), tuple(x[mine] for x in vectors), k))
        return best_of(pa.concat_tables(found), k) if found else none

    found = routed.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(search, PARTIAL)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
