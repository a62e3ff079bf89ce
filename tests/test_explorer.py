"""The tree of directories, classes of copies, and settings against plain versions of their rules."""

import random

from pyspark.sql import functions as F

from stillmark.operators import duplicates, explorer, mutations


def rows(spark, folders, videos, expanded, closed=(), **options):
    f = spark.createDataFrame(folders, "id long, path string, name string")
    v = spark.createDataFrame(videos, "id long, dir string, folder_id long, position long")
    keys = lambda k: spark.createDataFrame([(x,) for x in k], "path_key string")
    got = explorer.explorer_rows(f.repartition(2), v.repartition(3), keys(expanded), keys(closed), **options).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))
    return [(r.depth, r.name, r.n) if r.type == "folder" else (r.depth, r.video_id) if r.type == "video" else (r.depth, "-") for r in got]


FOLDERS = [(1, "/m", "media"), (2, "/m/z/中文/in", "in"), (3, "/é", "été"), (4, "/b", "Beta"), (5, "/mm", "啊")]
VIDEOS = [(10, "/m/z", 1, 1), (11, "/m/z/", 1, 0), (12, "/m/a-b", 1, 2), (13, "/m/ab", 1, 3), (14, "/m/z/中文/in/x", 2, 4), (15, "/m/é", 1, 5), (16, "/m/e", 1, 6), (20, "/other", 1, 8), (21, "/m", None, 7), (22, "/b", 99, 9)]


def test_directories_nest_and_loose_videos_come_last(spark):
    got = rows(spark, FOLDERS, VIDEOS, [], reveal_all=True)
    assert got == [
        (0, "啊", 0), (1, "-"), (0, "Beta", 0), (1, "-"), (0, "été", 0), (1, "-"),
        (0, "media", 7), (1, "a-b", 1), (2, 12), (1, "ab", 1), (2, 13), (1, "é", 1), (2, 15), (1, "e", 1), (2, 16),
        (1, "z", 3), (2, "中文", 1), (3, "in", 1), (4, "x", 1), (5, 14), (2, 11), (2, 10),
        (0, 21), (0, 20), (0, 22),
    ]


def test_only_what_is_expanded_and_not_closed_is_on_show(spark):
    head = [(0, "啊", 0), (0, "Beta", 0), (0, "été", 0)]
    loose = [(0, 21), (0, 20), (0, 22)]
    top = [(0, "media", 7), (1, "a-b", 1), (1, "ab", 1), (1, "é", 1), (1, "e", 1)]
    assert rows(spark, FOLDERS, VIDEOS, []) == [*head, (0, "media", 7), *loose]
    assert rows(spark, FOLDERS, VIDEOS, ["/m", "/m/z/中文"]) == [*head, *top, (1, "z", 3), *loose]  # a closed level between hides it
    assert rows(spark, FOLDERS, VIDEOS, ["/m", "/m/z", "/m/z/中文", "/b"], ["/m/z/中文"]) == [(0, "啊", 0), (0, "Beta", 0), (1, "-"), (0, "été", 0), *top, (1, "z", 3), (2, "中文", 1), (2, 11), (2, 10), *loose]
    assert rows(spark, FOLDERS, VIDEOS, [], ["/m"], reveal_all=True)[6:] == [(0, "media", 7), *loose]


def test_windows_paths_and_empty_libraries(spark):
    folders = [(1, "C:\\Media", "Media"), (2, "c:\\media\\Sub\\Deep", "Deep")]
    videos = [(1, "C:\\MEDIA\\sub", 1, 0), (2, "c:/media/sub/deep", 2, 1), (3, "C:\\Media2", 1, 2)]
    assert rows(spark, folders, videos, [], reveal_all=True) == [(0, "Media", 2), (1, "Sub", 2), (2, "Deep", 1), (3, 2), (2, 1), (0, 3)]
    assert rows(spark, [], [], []) == []
    assert rows(spark, [], [(1, "/a", None, 0)], []) == [(0, 1)]


def test_copies_give_a_row_each(spark):
    rng = random.Random(3)
    files = [(i, rng.choice([10, 20, 30]), rng.choice([1.0, 1.2, 1.49, 1.5, 1.9, 2.4, 7.0, None]), rng.choice("abc")) for i in range(120)] + [(500, None, 1.0, "a"), (501, 10, 1.0, None)]
    videos = spark.createDataFrame(files, "id long, size long, duration double, file_hash string")
    pairs = duplicates.identical_pairs(videos, duplicates.identical_candidates(videos))
    want = sorted((r.label, r.node) for r in duplicates.components(pairs).collect())
    classes = duplicates.identical_classes(videos)
    assert sorted(tuple(r) for r in classes.collect()) == want and len(want) > 60
    links = duplicates.identical_links(classes)
    assert links.count() == len(want) - len({c for c, _ in want}) and links.columns == pairs.columns
    assert sorted((r.label, r.node) for r in duplicates.components(links).collect()) == want
    twins = {r.id for r in duplicates.with_twins(videos).collect()}
    near = {i for r in duplicates.identical_candidates(videos).collect() for i in (r.id_a, r.id_b)}
    assert twins == near


def test_very_many_copies_stay_one_row_each(spark):
    copies = spark.range(100_000).select("id", F.lit(5).cast("long").alias("size"), F.lit(3.0).alias("duration"), F.lit("h").alias("file_hash"))
    classes = duplicates.identical_classes(copies)
    assert classes.count() == 100_000 and classes.select("class_id").distinct().collect()[0][0] == 0
    assert duplicates.with_twins(copies).count() == 100_000


def test_settings_of_broken_and_repeated_values(spark):
    one = lambda rows, **o: mutations.typed_settings(spark.createDataFrame(rows, "key string, value string, at long"), **o).first()
    default = one([("other", "1", 0)])
    assert (default.uniformIntervalSeconds, default.concurrency, default.minHashScore, default.pruneOnDelete, default.samplingMode) == (5, 2, 0.6, True, "uniform")
    got = one([("concurrency", "007", 0), ("uniformIntervalSeconds", "+9", 0), ("maxResults", "1.5", 0), ("awaitWriteMs", " 70 ", 0), ("minHashScore", "1e999", 0), ("pruneOnDelete", "False", 0), ("samplingMode", '"scene"', 0)])
    assert (got.concurrency, got.uniformIntervalSeconds, got.maxResults, got.awaitWriteMs, got.minHashScore, got.pruneOnDelete, got.samplingMode) == (2, 5, 40, 70, 0.6, True, "scene")
    got = one([("concurrency", "3", 1), ("concurrency", "9999", 2), ("minHashScore", "-3e0", 1), ("maxResults", None, 1)], order="at")
    assert (got.concurrency, got.minHashScore, got.maxResults) == (8, 0.0, 40)
