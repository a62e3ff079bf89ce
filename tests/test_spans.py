"""Runs and following entries in time against plain loops, whatever the spans; one key with most of the entries."""

import random

import pytest
from pyspark.sql import functions as F

from stillmark.streaming import debounce, notices, spans


def entries(seed, n=600, most=4000):
    """Most entries are of one key; times repeat, and some are before 1970 or missing."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *[rng.randrange(-500, most)] * 60])) for _ in range(n)]
    return rows + [("dense", t) for t in range(0, most, 7)] + [("alone", 5), ("copies", 40)] + [("copies", 40)] * 50


def plain_bursts(rows, gap):
    out = []
    for key in {k for k, _ in rows}:
        out += [(key, None, None, 1) for k, t in rows if k == key and t is None]
        run = None
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if run is None or t - run[2] >= gap:
                run = [key, t, t, 0]
                out.append(run)
            run[2], run[3] = t, run[3] + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("gap,span", [(20, 1), (20, 20), (20, 64), (8, 1000), (7, 10), (1, 13), (20, None), (100_000, 50)])
def test_bursts_equal_a_plain_loop(spark, gap, span):
    rows = entries(gap + (span or 0))
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "key string, at_ms long, span int, fresh string").repartition(5)
    got = spans.bursts(table, ["key"], "at_ms", gap, span).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_bursts(rows, gap)


def test_bursts_by_several_keys_whose_names_clash(spark):
    rows = [(i % 3, "ab"[i % 2], i * i % 977) for i in range(500)]
    table = spark.createDataFrame(rows, "span int, place string, at long")
    got = spans.bursts(table, ["span", "place"], "at", 9, 30).collect()
    want = [eval(r) for r in plain_bursts([((s, p), t) for s, p, t in rows], 9)]
    assert sorted((r.span, r.place, r.first_ms, r.last_ms, r.n) for r in got) == sorted((*k, a, b, n) for k, a, b, n in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path_key string, path string, folder_id long, kind string, at_ms long")
    assert spans.bursts(none, ["path_key"], "at_ms", 10).collect() == []
    assert debounce.due_imports(none, 10).collect() == []


def test_notices_and_debounced_do_not_depend_on_spans(spark):
    rows = entries(3)
    table = spark.createDataFrame(rows, "key string, at_ms long")
    for make in (lambda s: notices.notices(table, ["key"], "at_ms", 15, s), lambda s: debounce.debounced(table, "key", "at_ms", 15, s)):
        assert sorted(map(repr, make(17).collect())) == sorted(map(repr, make(10**9).collect()))


@pytest.mark.parametrize("gap,span", [(20, 1), (20, 64), (5, 1000), (20, None)])
def test_due_imports_equal_a_plain_loop(spark, gap, span):
    rng = random.Random(gap)
    rows = [(k, t, rng.choice(["create", "modify", "remove"])) for k, t in entries(gap) if t is not None]
    table = spark.createDataFrame([(k, k, 1, kind, t, 9) for k, t, kind in rows], "path_key string, path string, folder_id long, kind string, at_ms long, span int").repartition(4)
    got = [(r.path_key, r.due_ms) for r in debounce.due_imports(table, gap, span).collect()]
    want = []
    for key in {k for k, _, _ in rows}:
        mine = sorted((t, kind) for k, t, kind in rows if k == key)
        for (t, kind), after in zip(mine, [*mine[1:], None]):
            if kind != "remove" and (after is None or after[0] - t >= gap):
                want.append((key, t + gap))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_few_rows_of_a_key_are_at_borders(spark):
    """What the second window sees of a key is two rows a span at most, dense or not."""
    dense = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") * 3).alias("at_ms"))
    assert [tuple(r) for r in spans.bursts(dense, ["key"], "at_ms", 4, 600).collect()] == [("hot", 0, 59_997, 20_000)]
    assert spans.pieces(dense, ["key"], "at_ms", 4, 600).where("inner is null").count() == 100
    apart = spans.pieces(dense, ["key"], "at_ms", 3, 600)
    assert apart.count() == 20_000 and apart.where("inner is null").count() == 200
    assert spans.bursts(dense, ["key"], "at_ms", 3, 600).where("n = 1").count() == 20_000


@pytest.mark.parametrize("window,forget,span", [(20, None, 1), (20, None, 7), (20, None, 20), (20, None, 64), (9, 50, 33), (20, 8, 50), (300, None, 100), (30, None, None), (0, None, 10), (10**6, 10**7, 40)])
def test_emitted_equals_a_plain_loop(spark, window, forget, span):
    rows = entries(window + (span or 0))
    got = notices.emitted(spark.createDataFrame(rows, "key string, at_ms long").repartition(5), "key", "at_ms", window, forget, span)
    assert got.columns == ["key", "at_ms", "suppressed"]
    want = []
    for key in {k for k, _ in rows}:
        last, held = None, 0
        for t in sorted(t for k, t in rows if k == key and t is not None):
            known = last is not None and (forget is None or t - last < forget)
            if known and t - last < window:
                held += 1
                continue
            want.append((key, t, held if known else 0))
            last, held = t, 0
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
