"""Queries over whole tables: no row is left out by its id, and no group has to fit in one row."""

import random

from pyspark.sql import functions as F

from stillmark.functions import sampling
from stillmark.operators import duplicates, mutations, recall, scenes
from stillmark.plans import catalog_queries, search_queries, stream_queries
from tests.test_queries import DATA


def test_change_lists_cover_every_order(spark):
    ids = {r.o_orderkey: (r.o_orderstatus, int(r.o_totalprice)) for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
    last = {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_id").collect():
        last[r.user_id * 4] = (r.event_type, "P" if r.event_type == "view" else "F")
    assert max(ids) > 500
    kept = {k for k in ids if k not in last}
    updated = {k for k, (kind, _) in last.items() if kind != "error"}

    def got(name):
        return sorted(r.id for r in getattr(stream_queries, name)(spark, DATA).collect())

    assert got("apply_changes") == sorted(kept | updated)
    assert got("unseen_changes") == sorted(updated - {k for k in ids if ids[k][0] == "F"}) != []
    assert got("apply_changes_filtered") == sorted({k for k in kept if ids[k][0] == "F"} | {k for k in updated if last[k][1] == "F" and k in ids and ids[k][0] == "F"})
    late, replayed = {}, got("snapshot_replay")
    for r in spark.read.parquet(f"{DATA}/events.parquet").where("event_id > 300").orderBy("event_id").collect():
        late[r.user_id * 4] = r.event_type
    assert replayed == sorted({k for k in ids if k not in late} | {k for k, kind in late.items() if kind != "error"})


def test_short_plans_resume_too(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    got = {r.o_orderkey: r.resume_at for r in catalog_queries.resume_index(spark, DATA).collect()}
    assert got.keys() == {r.o_orderkey for r in orders.collect()}
    short = orders.where("o_totalprice <= 20000 AND o_orderkey % 5 <> 0 AND o_custkey % 4 <> 0").collect()
    assert short and all(got[r.o_orderkey] == (r.o_orderkey % 7 if r.o_orderkey % 7 <= 1 else 0) for r in short)


def test_failures_come_as_rows(spark):
    rows = [(2, 1, 0, 1, 0, "second", ["c"]), (1, 1, 2, 2, 0, "first", ["b", "a"]), (3, 1, 0, 0, 0, None, []), (4, 0, 0, 0, 0, None, None)]
    results = spark.createDataFrame(rows, "position long, added long, skipped long, failed long, duplicates long, error string, failures array<string>")
    assert tuple(mutations.import_totals(results).first()) == (3, 2, 3, 0, "first", 3)
    assert [r.failure for r in mutations.import_failures(results).orderBy("position", "place").collect()] == ["b", "a", "c"]


def test_groups_and_kept_members_come_as_rows(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, False), (2, 3, 0.95, True), (8, 7, 0.9, False)], "id_a long, id_b long, score double, identical_file boolean")
    videos = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (7, None)], "id long, size long")
    found, members = duplicates.groups(pairs, videos)
    assert [tuple(r[c] for c in ("group_id", "n_members", "suggested_keep_id", "best_score", "identical_file")) for r in found.collect()] == [(1, 3, 2, 0.95, True), (7, 2, 7, 0.9, False)]
    assert sorted((r.group_id, r.id) for r in members.collect()) == [(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)]
    placed = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1), (3, 31, 2), (3, 30, 1), (None, 40, 1)], "group_id long, id long, place long")
    suggested = spark.createDataFrame([(1, 10), (2, 20), (3, None), (None, 41)], "group_id long, suggested_keep_id long")
    kept = spark.createDataFrame([(12,), (11,), (11,), (99,), (None,)], "id long")
    assert {r.group_id: r.keep_id for r in duplicates.kept_members(placed, suggested, kept).collect()} == {1: 11, 2: 20, 3: 30, None: 41}


def test_scene_points_fold_rows_as_the_arrays(spark):
    r = random.Random(7)
    cuts = {k: sorted(r.choice([0.0, 1e4]) + r.randrange(60_000) / 1000 for _ in range(n)) for k, n in ((1, 400), (2, 3), (3, 1))} | {4: [0.2, 0.5, 0.6, float("nan")], 5: [None], None: [7.0, 7.25, 7.75, 8.0]}
    rows = spark.createDataFrame([(k, t) for k, ts in cuts.items() for t in ts], "key long, at double").repartition(5)
    arrays = rows.groupBy("key").agg(F.collect_list("at").alias("c"))
    want = arrays.select("key", F.explode(sampling.scene_plan(F.col("c"), F.lit(None).cast("double"), F.lit(11))).alias("t"))
    order = lambda df: sorted((str(x.key), x.t) for x in df.collect())
    assert order(scenes.scene_points(rows, "key", "at", 11)) == order(want)


def test_no_group_is_collected_into_a_row(spark, capsys):
    for query in (catalog_queries.import_totals, catalog_queries.scene_plan, search_queries.duplicate_groups, search_queries.kept_members):
        query(spark, DATA).explain()
        assert "collect_" not in capsys.readouterr().out


def smallest_reachable(pairs):
    near, label = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in label:
                label[node] = start
                todo += near[node]
    return label


def test_components_of_chains_stars_and_random_links(spark):
    r = random.Random(5)
    chain = list(range(300))
    r.shuffle(chain)
    pairs = [*zip(chain, chain[1:])]  # a long chain in no order
    pairs += [(1000, 1001 + k) for k in range(400)] + [(1200, 999)]  # a star whose centre isn't its smallest
    pairs += [(2000 + r.randrange(600), 2000 + r.randrange(600)) for _ in range(420)]
    pairs += [(5000, 5000), (5001, 5002), (5002, 5001), (5001, 5002), (-3, 5002)]
    r.shuffle(pairs)
    rows = spark.createDataFrame([*pairs, (None, 7000), (7001, None)], "id_a long, id_b long").repartition(7)
    found = duplicates.components(rows).collect()
    assert {x.node: x.label for x in found} == smallest_reachable(pairs)
    assert len(found) == len({x.node for x in found})
    assert duplicates.components(rows.where("false")).isEmpty()


def test_recall_gives_the_same_in_several_blocks(spark, monkeypatch):
    frames = search_queries.frames_of(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    asked = frames.where("frame_index % 20 = 0").withColumn("query_id", F.col("frame_index"))

    def hits():
        return sorted(map(str, search_queries.shown(recall.recall(frames, asked, search_queries.STRUCT, min_score=search_queries.FLOOR, **search_queries.LIMITS)).collect()))

    whole = hits()
    monkeypatch.setattr(recall, "QUERY_BLOCK", 5)
    assert whole and hits() == whole
