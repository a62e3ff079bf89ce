"""Work that grows with the input: hot cells in slices, digests as keys, path keys once for a path, sizes beyond small keys."""

import duckdb
from pyspark.sql import functions as F

from stillmark.operators import catalog, duplicates
from stillmark.plans import catalog_queries
from tests.test_queries import ORACLES, plain


def test_sizes_of_large_keys_are_those_of_the_sql(spark, tmp_path):
    keys = [(1, 1, 1), (2_000_000, 500_000, 1), (900_000, 110_000, 1), (3_000_000, 120_000, 7), (1_073_742, 1000, 1), (4_000_000, 100_000, 1), (0, 1, 1)]
    rows = [(a, b, c, 12345.67, 0.05) for a, b, c in keys]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog_queries.unit_formats(spark, str(tmp_path)).collect()
    assert sorted(map(plain, got)) == sorted(map(plain, duck.execute(ORACLES["unit_formats"]).fetchall()))
    assert "2346.9 GB" in {r.file_size for r in got}


def test_a_path_is_put_in_normal_form_once(spark):
    items = spark.createDataFrame([(1, "C:\\Media\\1.mp4"), (2, "c:/media/Sub//x/")], "id long, path string")
    folders = spark.createDataFrame([(1, "c:\\media"), (2, "c:\\media\\sub")], "id long, path_key string")
    found = catalog.closest_folder(items, folders)
    assert {r.id: r.closest_id for r in found.select("id", F.col("closest_id")).collect()} == {1: 1, 2: 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 20


def test_hot_cells_are_sliced_and_keep_all_pairs(spark, monkeypatch):
    files = [(i, 7, 1.0 + i % 5 * 0.2) for i in range(60)] + [(100 + i, 8, 3.0) for i in range(4)] + [(200, 7, None), (201, None, 1.0)]
    videos = spark.createDataFrame(files, "id long, size long, duration double")
    want = sorted((a, b) for a, s, d in files for b, t, e in files if a < b and None not in (s, d, t, e) and s == t and abs(d - e) < 0.5)
    assert sorted(map(tuple, duplicates.identical_candidates(videos).collect())) == want
    monkeypatch.setattr(duplicates, "SLICE", 8)
    monkeypatch.setattr(duplicates, "PAIRS_A_TASK", 100)
    found = duplicates.identical_candidates(videos)
    assert sorted(map(tuple, found.collect())) == want
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 4 and max(sizes) < len(want) / 2


def test_files_of_one_size_meet_by_digest_only(spark, monkeypatch):
    met, joined = [], duplicates.identical_candidates
    monkeypatch.setattr(duplicates, "identical_candidates", lambda v, t=0.5, keys=("size",): met.append(keys) or joined(v, t, keys))
    assert not catalog_queries.identical_files(spark, "/root/testdata/sf0.01").isEmpty()
    assert met == [("size", "file_hash")]
