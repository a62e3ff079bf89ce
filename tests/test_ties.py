"""Equal sort keys: every result has one order, whatever the partitions."""

import itertools

from pyspark.sql import functions as F

from stillmark.operators import duplicates, mutations
from stillmark.streaming import changes, notices
from tests.test_queries import plain


def every_order(spark, rows, schema, run):
    """The one result of ``run`` over the rows in each of many orders and partitionings."""
    found = {tuple(sorted(map(plain, map(tuple, run(spark.createDataFrame(list(p), schema).repartition(n)).collect())), key=str)) for p in itertools.islice(itertools.permutations(rows), 6) for n in (1, 3)}
    assert len(found) == 1
    return found.pop()


def test_kept_members_in_one_place(spark):
    members = [(1, 1107, 4), (1, 107, 4), (1, 5, 9), (2, 9, 1), (2, 8, 1)]
    suggested = spark.createDataFrame([(1, 5), (2, None)], "group_id long, suggested_keep_id long")
    kept = spark.createDataFrame([(1107,), (107,)], "id long")
    got = every_order(spark, members, "group_id long, id long, place long", lambda m: duplicates.kept_members(m, suggested, kept))
    assert got == (("1", "107"), ("2", "8"))


def test_last_changes_of_one_revision(spark):
    rows = [(1, 5, "updated", 10), (1, 5, "updated", 12), (1, 5, "deleted", 99), (2, 1, "deleted", None)]
    got = every_order(spark, rows, "id long, revision long, type string, size long", changes.last_changes)
    assert got == (("1", "5", "updated", "12"), ("2", "1", "deleted", "None"))


def test_several_changes_of_a_row(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, status string, size long")
    got = every_order(spark, [(1, "x"), (1, "y"), (3, "z"), (1, None)], "id long, status string", lambda c: mutations.update_rows(rows, c))
    assert got == (("1", "y", "0"), ("2", "b", "0"))


def test_batches_with_equal_order(spark):
    frames = spark.createDataFrame([(1, 0, 5)], "video_id long, frame_index long, time_ms long")
    got = every_order(spark, [(1, 0, 7, 1), (1, 0, 9, 1), (1, 0, 11, 0)], "video_id long, frame_index long, time_ms long, n_try long", lambda b: mutations.commit_frames(frames, b, order="n_try"))
    assert got == (("1", "0", "9"),)


def test_incoming_files_of_equal_time_and_size(spark):
    videos = spark.createDataFrame([], "id long, path string, path_key string, name string, dir string, ext string, size long, mtime_ms long, duration double, width long, height long, video_codec string, frame_count long, status string, added_at long, processed_ms long, processed_timestamps array<long>, folder_id long, file_hash string")
    rows = [("/a/x.mp4", 1, 5, 2.0, 3, 4, "h", 1, None), ("/a/x.mp4", 1, 5, 2.0, 3, 4, "h", 2, None), ("/a/x.mp4", 1, 5, 2.0, 3, 4, "g", 2, None)]
    run = lambda df: mutations.upsert_videos(videos, df, F.lit(9)).select("path", "folder_id", "video_codec")
    got = every_order(spark, rows, "path string, size long, mtime_ms long, duration double, width long, height long, video_codec string, folder_id long, file_hash string", run)
    assert got == (("/a/x.mp4", "2", "h"),)


def test_notices_that_are_equally_new(spark):
    rows = [("info", x, 10, 20) for x in "edcba"] + [("warn", "z", 12, 20)]
    got = every_order(spark, rows, "level string, message string, first_ms long, last_ms long", lambda df: notices.shown(df, 21))
    assert [m for _, m, *_ in got] == ["a", "b", "c", "z"]
