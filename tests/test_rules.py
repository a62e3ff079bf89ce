"""Small rules that no query runs: display paths, orders, scene plans, pictures, and what counts as a changed file."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillmark.functions import fingerprint, formats, paths, sampling
from stillmark.operators import catalog, mutations
from stillmark.plans import lifecycle
from stillmark.sources import media


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_short_paths(spark):
    roots = F.array(F.lit("/media/films"), F.lit("C:\\Films"))
    given = ["/media/films/a.mp4", "/media/films/2020/x/a.mp4", "/media/films2/a.mp4", "/a/b/c/d/e.mp4", "/e.mp4", "c:\\films\\Sub\\v.mkv", "D:\\x\\v.mkv", "v.mkv"]
    got = values(spark, [(p,) for p in given], "p string", paths.short_path(F.col("p"), roots))
    assert got == ["a.mp4", "2020/x/a.mp4", "…/media/films2/a.mp4", "…/c/d/e.mp4", "/e.mp4", "Sub\\v.mkv", "D:\\x\\v.mkv", "v.mkv"]


def test_folders_and_clicked_columns(spark):
    rows = [(1, False, 5), (2, True, 9), (3, True, 9), (4, False, 1), (5, True, 2)]
    folders = spark.createDataFrame(rows, "id long, pinned boolean, added_at long").repartition(3)
    assert [r.id for r in catalog.folders_in_order(folders).collect()] == [5, 2, 3, 4, 1]
    assert catalog.next_sort("name", "asc", "name") == ("name", "desc") and catalog.next_sort("name", "desc", "name") == ("name", "asc")
    assert catalog.next_sort("name", "asc", "size") == ("size", "desc") and catalog.next_sort("size", "desc", "name") == ("name", "asc")


def test_progress_lines(spark):
    lines = ["frame=12", "frame=  7 ", "frame=", "fps=30", "xframe=1", None, "frame=99999999999999999999"]
    assert values(spark, [(x,) for x in lines], "x string", formats.progress_frames(F.col("x"))) == [12, 7, None, None, None, None, None]


def test_thumbnail_windows(spark):
    rows = [(100.0, 10, False), (10.0, 100, False), (100.0, 10, True), (None, 10, False), (100.0, 0, False)]
    got = values(spark, rows, "d double, n long, s boolean", sampling.thumbnail_window(F.col("d"), F.col("n"), F.col("s")))
    assert got == [6.0, 2.0, 2.0, 2.0, 2.0]


def test_plans_by_scenes(spark):
    videos = spark.createDataFrame([(1, "/1", 20.0, 640, 480, "scene"), (2, "/2", 20.0, 640, 480, None), (3, "/3", 20.0, 640, 480, "scene"), (4, "/4", 4000.0, 640, 480, "scene")], "id long, path string, duration double, width long, height long, sampling_override string")
    scenes = spark.createDataFrame([(1, [4.0, 10.0]), (2, [4.0]), (3, []), (4, [float(k) for k in range(1, 4000)])], "video_id long, cuts array<double>")
    got = {r.video_id: r for r in lifecycle.sampling_plan(videos, scenes, 6).collect()}
    assert got[1].seconds == [2.0, 7.0, 12.5, 17.5]
    assert got[2].seconds == got[3].seconds == [3.0, 9.0, 15.0, 19.0]  # not by scenes, or without any
    assert len(got[4].seconds) == 4000 and not got[4].full_scan  # many frames, but by scenes: seeking is forced
    assert {r.video_id: r.seconds for r in lifecycle.sampling_plan(videos, scenes, 6, "scene").collect()}[2] == [2.0, *parts(4.0)]


def parts(cut):
    """Midpoints of three equal parts of the shot behind the cut."""
    return [cut + (k + 0.5) * 16 / 3 for k in range(3)]


def png(rgb):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_from_files(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (12, 9, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.webp").write_bytes(b"W" + rgb.tobytes())
    (tmp_path / "d.webp").write_bytes(b"broken")
    own = media.images(spark, str(tmp_path / "*.png")).collect()
    assert [(r.path.split("/")[-1], r.image.width, r.image.height) for r in own] == [("a.png", 9, 12)]
    shape = rgb.shape
    given = media.images(spark, str(tmp_path), lambda x: np.frombuffer(x[1:], np.uint8).reshape(shape) if x[:1] == b"W" else None)
    assert [r.path.split("/")[-1] for r in given.collect()] == ["c.webp"]
    both = [fingerprint.with_signature(x, ["path"]).drop("path").collect() for x in (media.images(spark, str(tmp_path / "*.png")), given)]
    assert both[0] == both[1] and len(both[0]) == 1  # the same pixels, the same fingerprint


COLUMNS = "id long, path string, path_key string, name string, dir string, ext string, size long, mtime_ms long, duration double, width long, height long, video_codec string, frame_count long, status string, added_at long, processed_ms long, processed_timestamps array<long>, folder_id long, file_hash string"
INCOMING = "path string, size long, mtime_ms long, duration double, width long, height long, video_codec string, folder_id long, file_hash string"


@pytest.mark.parametrize(
    "change, changed, folder, digest",
    [({}, False, 3, "h"), ({"duration": 2.5}, True, 3, "h"), ({"duration": None}, True, 3, "h"), ({"video_codec": "av1"}, True, 3, "h"), ({"width": 5}, True, 3, "h"), ({"mtime_ms": 6}, True, 3, "h"), ({"file_hash": "other"}, False, 3, "other"), ({"file_hash": None}, False, 3, None), ({"folder_id": None}, False, 3, "h"), ({"folder_id": 8}, False, 8, "h")],
)
def test_what_counts_as_a_changed_file(spark, change, changed, folder, digest):
    file = {"path": "/a/x.mp4", "size": 1, "mtime_ms": 5, "duration": 2.0, "width": 3, "height": 4, "video_codec": "h264", "folder_id": 3, "file_hash": "h"}
    row = file | {"id": 7, "path_key": "/a/x.mp4", "name": "x.mp4", "dir": "/a", "ext": ".mp4", "frame_count": 2, "status": "ready", "added_at": 1, "processed_ms": 0, "processed_timestamps": []}
    frame = lambda d, schema: spark.createDataFrame([tuple(d[f.split()[0]] for f in schema.split(", "))], schema)
    got = mutations.upsert_videos(frame(row, COLUMNS), frame(file | change, INCOMING), F.lit(9)).collect()
    assert [(r.id, r.created, r.changed, r.folder_id, r.file_hash) for r in got] == [(7, False, changed, folder, digest)]


def test_a_digest_that_became_known_is_a_change(spark):
    row = (7, "/a/x.mp4", "/a/x.mp4", "x.mp4", "/a", ".mp4", 1, 5, 2.0, 3, 4, "h264", 2, "ready", 1, 0, [], 3, None)
    got = mutations.upsert_videos(spark.createDataFrame([row], COLUMNS), spark.createDataFrame([("/a/x.mp4", 1, 5, 2.0, 3, 4, "h264", 3, "new")], INCOMING), F.lit(9)).first()
    assert got.changed and got.file_hash == "new"


def test_a_page_reads_only_what_it_shows(spark, tmp_path):
    spark.range(5).select("id", (-F.col("id")).alias("added_at"), F.lit(b"x").alias("thumbnail")).write.parquet(str(tmp_path / "v"))
    plan = catalog.page(spark.read.parquet(str(tmp_path / "v")).select("id", "added_at"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,added_at:bigint>" in plan
