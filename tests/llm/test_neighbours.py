"""Nearest neighbours: recall against brute force and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillmark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, leaf long, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("per_shard", [50, 4096])
def test_recall(spark, per_shard):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=12)).tolist()) for i in range(2000)]
    got = {}
    for r in neighbours.nearest_neighbours(table(spark, rows), every=10, leaf_rows=50, rows_per_shard=per_shard).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows, 10, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    true = {q: dict(exact(rows, 10, 1999)[q]) for q in list(want)[:5]}
    assert all(s == pytest.approx(true[q][v], abs=1e-12) for q in true for v, s in got[q])


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(400, [4.0, 4.0, 4.0])]
    bad = [(500, None), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 2.0]), (800, [float("nan"), 1.0, 1.0]), (900, [float("inf"), 1.0, 1.0]), (1100, []), (None, [1.0, 1.0, 1.0])]
    got = neighbours.nearest_neighbours(table(spark, rows + bad), rows_per_shard=64).orderBy("query_id", "rank").collect()
    want = exact(rows, 100, 10)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(q, i + 1, v, s) for q in sorted(want) for i, (v, s) in enumerate(want[q])]


def test_fewer_candidates_than_asked(spark):
    got = neighbours.nearest_neighbours(table(spark, [(100, [1.0, 0.0]), (101, [0.0, 1.0]), (101, [0.0, 1.0])])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(100, 1, 101), (100, 2, 101)]
    assert neighbours.nearest_neighbours(table(spark, [])).collect() == []
    assert neighbours.nearest_neighbours(table(spark, [(1, [1.0])])).collect() == []


def test_recall_on_the_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = neighbours.nearest_neighbours(vectors)
    clean = neighbours.usable(vectors)
    asked = clean.where(F.col("vec_id") % 100 == 0).collect()
    want = neighbours.brute_force(clean, asked, 10)
    both = got.join(want, ["query_id", "vec_id"], "left_semi").count()
    assert both / want.count() >= 0.9


def test_every_row_is_a_candidate(spark):
    rows = [(7, [5.0, 6.0]), (7, [-9.0, -9.0]), (100, [5.0, 5.0]), (100, [5.0, 4.0]), (200, [1.0, 0.0, 0.0]), (201, [2.0, 0.0, 0.0]), (300, [4.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest_neighbours(table(spark, rows), k=2).collect())
    assert got == [(100, 1, 7, 1.0), (100, 1, 100, 1.0), (100, 2, 7, 2.0), (100, 2, 100, 1.0), (200, 1, 201, 1.0)]
