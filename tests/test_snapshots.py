"""Tables with snapshots: what stops in between leaves them whole, late writers are refused, other buckets stay untouched."""

import os

import pytest
from pyspark.sql import functions as F

from stillmark.operators import frame_index, snapshots
from stillmark.plans import search_queries as q
from tests.test_queries import DATA


def rows(spark, root):
    return sorted(tuple(r) for r in snapshots.read(spark, snapshots.current(spark, root)).drop("bucket").collect())


def numbers(spark, pairs):
    return spark.createDataFrame(pairs, "id long, size long")


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/parts") for f in names if f.endswith(".parquet")}


def test_a_table_is_appended_to_and_changed_by_bucket(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.current(spark, root) is None
    s = snapshots.create(numbers(spark, [(i, i) for i in range(50)]), root, "id", buckets=8)
    before = files(root)
    s = snapshots.append(numbers(spark, [(i, i) for i in range(50, 60)]), s)
    assert rows(spark, root) == [(i, i) for i in range(60)] and before < files(root)
    touched = {r[0] for r in numbers(spark, [(3, 0), (7, 0)]).select(snapshots.bucket_of(F.col("id"), 8)).collect()}
    before = files(root)
    new = snapshots.rewrite(numbers(spark, [(3, 0), (7, 0)]).select("id"), s, lambda x: x.withColumn("size", F.when(F.col("id").isin(3, 7), 100).otherwise(F.col("size"))))
    assert rows(spark, root) == sorted([(i, i) for i in range(60) if i not in (3, 7)] + [(3, 100), (7, 100)])
    assert {b for b in s.parts if s.parts[b] != new.parts[b]} == touched
    assert all(f"bucket={b}" in {f.split("/")[-2] for f in files(root) - before} for b in touched) and len(files(root) - before) == len(touched)
    assert [tuple(r) for r in snapshots.read(spark, snapshots.current(spark, root, 1)).where("id >= 50").collect()] == []  # older versions can be read


def test_a_commit_that_stops_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    s = snapshots.create(numbers(spark, [(1, 1), (2, 2)]), root, "id", buckets=2)
    change = lambda: snapshots.rewrite(numbers(spark, [(1, 0), (2, 0)]).select("id"), s, lambda x: x.withColumn("size", F.lit(9).cast("long")))
    for step in ("_write", "_commit", "place"):
        whole = getattr(snapshots, step)

        def stops(*args, step=step, whole=whole):
            if step == "_write":
                whole(*args)  # parts are there, but no snapshot names them
            raise OSError("stopped")

        monkeypatch.setattr(snapshots, step, stops)
        with pytest.raises(OSError, match="stopped"):
            change()
        monkeypatch.setattr(snapshots, step, whole)
        assert rows(spark, root) == [(1, 1), (2, 2)] and snapshots.current(spark, root) == s
    assert not [f for f in os.listdir(f"{root}/snapshots") if "json" not in f and not f.endswith(".crc")]
    change()
    assert rows(spark, root) == [(1, 9), (2, 9)]
    assert snapshots.clean(spark, root) > 0 and rows(spark, root) == [(1, 9), (2, 9)]
    assert len(files(root)) == len({r.id for r in numbers(spark, [(1, 1), (2, 2)]).select(snapshots.bucket_of(F.col("id"), 2).alias("id")).collect()})


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    s = snapshots.create(numbers(spark, [(1, 1)]), root, "id", buckets=2)
    snapshots.append(numbers(spark, [(2, 2)]), s)
    for late in (lambda: snapshots.append(numbers(spark, [(3, 3)]), s), lambda: snapshots.rewrite(numbers(spark, [(1, 0)]).select("id"), s, lambda x: x.where("false"))):
        with pytest.raises(snapshots.StaleWriter):
            late()
        assert rows(spark, root) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError, match="other buckets"):
        snapshots.rewrite(numbers(spark, [(1, 0)]).select("id"), snapshots.current(spark, root), lambda x: numbers(spark, [(i, 0) for i in range(20)]))


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    s = snapshots.create(numbers(spark, []), root, "id")
    assert rows(spark, root) == [] and snapshots.rows_of(spark, s, 4).collect() == []
    s = snapshots.rewrite(numbers(spark, []).select("id"), s, lambda x: x)
    s = snapshots.append(numbers(spark, [(None, 1)]), s)
    s = snapshots.append(numbers(spark, [(5, 2)]), s)
    assert [tuple(r) for r in snapshots.rows_of(spark, s, 5).collect()] == [(5, 2)]


def test_an_index_reads_one_videos_files_only(spark, tmp_path):
    frames = q.frames_of(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    index = frame_index.build(frames, str(tmp_path / "index"), buckets=8)
    video = frames.first().video_id
    one = frame_index.frames_of_video(spark, index, video)
    assert sorted(r.frame_index for r in one.collect()) == sorted(r.frame_index for r in frames.where(F.col("video_id") == video).collect())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    scan = frame_index.frames(spark, index).inputFiles()
    read = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert len(read) == 1 < len(scan)
    gone = frame_index.remove(one.select("video_id"), index)
    assert frame_index.frames_of_video(spark, gone, video).isEmpty() and len([b for b in index.parts if gone.parts.get(b) != index.parts[b]]) == 1


def test_a_search_needs_an_index(spark, tmp_path):
    frames = q.frames_of(spark.read.parquet(f"{DATA}/embeddings.parquet")).withColumn("query_id", F.col("frame_index"))
    with pytest.raises(FileNotFoundError):
        frame_index.search(frames, str(tmp_path / "none"), q.STRUCT)
