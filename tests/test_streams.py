"""Streams with their state and restarts, and the sinks."""

import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from stillmark.operators import mutations, snapshots
from stillmark.sources import media, sinks, web
from stillmark.streaming import changes, debounce, notices, watchers


def files_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    os.rename(folder / f".{name}", folder / f"{name}.json")
    time.sleep(0.01)


def test_a_list_kept_by_a_stream_survives_a_restart(spark, tmp_path):
    schema = "id long, revision long, type string, size long"
    table = str(tmp_path / "list")
    snapshots.create(spark.createDataFrame([(1, 10), (2, 20)], "id long, size long"), table, "id", buckets=4)
    put(tmp_path / "in", "a", [{"id": 1, "revision": 1, "type": "updated", "size": 11}, {"id": 3, "revision": 2, "type": "updated", "size": 30}])
    apply = changes.upsert_batch(table)

    def run(step):
        query = debounce.apply_each(files_stream(spark, tmp_path / "in", schema), step, str(tmp_path / "check"))
        query.awaitTermination()

    rows = lambda: sorted(tuple(r) for r in snapshots.read(spark, snapshots.current(spark, table)).drop("bucket").collect())
    run(apply)
    assert rows() == [(1, 11), (2, 20), (3, 30)]
    put(tmp_path / "in", "b", [{"id": 2, "revision": 3, "type": "deleted"}, {"id": 1, "revision": 4, "type": "updated", "size": 12}])

    def fails(batch, number):
        apply(batch, number)
        raise RuntimeError("lost after the batch was applied")

    with pytest.raises(Exception, match="lost after"):
        run(fails)
    run(apply)  # the same batch again
    assert rows() == [(1, 12), (3, 30)]


def test_repeated_entries_of_a_stream(spark, tmp_path):
    put(tmp_path / "in", "a", [{"repeat_key": "x", "at_ms": 1000 + t} for t in (0, 10, 20)] + [{"repeat_key": "y", "at_ms": 1005}])
    put(tmp_path / "in", "b", [{"repeat_key": "x", "at_ms": 1000 + t} for t in (90, 105, 107)])
    out = notices.emitted_stream(files_stream(spark, tmp_path / "in", "repeat_key string, at_ms long"), window_ms=100)
    query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("x", 1000, 0), ("x", 1105, 3), ("y", 1005, 0)]
    batch = spark.createDataFrame([("x", t) for t in (0, 10, 20, 90, 105, 107)], "k string, t long")
    assert sorted(tuple(r) for r in notices.emitted(batch, "k", "t", 100).collect()) == [("x", 0, 0), ("x", 105, 3)]


def run_stream(out, tmp_path):
    """All that is there, file by file; the rows of state that are left."""
    query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_repeated_entries_leave_the_state_in_time(spark, tmp_path):
    rng = random.Random(2)
    at, rows = 0, []
    for _ in range(120):
        at += rng.choice([1, 5, 20, 60, 200, 900])
        rows.append((rng.choice("abcdef"), at))
    out = lambda: notices.emitted_stream(files_stream(spark, tmp_path / "in", "repeat_key string, at_ms long"), window_ms=100, forget_ms=1000, delay="1 millisecond")
    for i in range(0, 120, 12):
        put(tmp_path / "in", f"p{i:03}", [{"repeat_key": k, "at_ms": t} for k, t in rows[i : i + 12]])
        if i == 48:
            run_stream(out(), tmp_path)  # and again from where it stopped
    put(tmp_path / "in", "z1", [{"repeat_key": "z", "at_ms": at + 5000}])
    put(tmp_path / "in", "z2", [{"repeat_key": "z", "at_ms": at + 9000}])
    assert run_stream(out(), tmp_path) <= 2  # only the last key is young enough
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame([*rows, ("z", at + 5000), ("z", at + 9000)], "k string, t long")
    assert got == sorted(tuple(r) for r in notices.emitted(batch, "k", "t", 100, forget_ms=1000).collect())
    assert got != sorted(tuple(r) for r in notices.emitted(batch, "k", "t", 100).collect()) and any(r[2] for r in got)


def test_notices_of_a_stream_end_as_in_a_batch(spark, tmp_path):
    rng = random.Random(7)
    at, rows = 10, []
    for _ in range(150):
        at += rng.choice([1, 100, 300, 900, 1999, 2000, 2500])
        rows.append((rng.randrange(2), rng.choice(["info", "warn", "error"]), rng.choice("abc"), at))
    ends = [(v, "info", "end", at + 100_000 * (1 + i)) for i in range(3) for v in (0, 1, 2)]
    schema = "viewer long, level string, message string, at_ms long"
    batch = sorted(tuple(r) for r in notices.notice_log(spark.createDataFrame(rows + ends, schema).repartition(4), "viewer").collect())
    out = lambda: notices.notice_log_stream(files_stream(spark, tmp_path / "in", schema), "viewer", delay="1 millisecond")
    names = ["viewer", "level", "message", "at_ms"]
    for i in range(0, 150, 15):
        put(tmp_path / "in", f"p{i:03}", [dict(zip(names, r)) for r in rows[i : i + 15]])
        if i == 60:
            run_stream(out(), tmp_path)
    for i in range(3):
        put(tmp_path / "in", f"z{i}", [dict(zip(names, r)) for r in ends[3 * i : 3 * i + 3]])
    left = run_stream(out(), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    still = [r for r in batch if r[3] == at + 300_000]  # on show when the stream stops
    assert left == len(still) == 3 and got == [r for r in batch if r not in still]


def test_a_notice_that_was_pushed_out_begins_anew(spark):
    rows = [(1, "info", m, t) for t, m in enumerate(["a", "b", "c", "d", "e", "a"])] + [(2, "info", m, t) for t, m in enumerate(["a", "b", "c", "a", "d", "a"])]
    got = sorted(tuple(r) for r in notices.notice_log(spark.createDataFrame(rows, "viewer long, level string, message string, at_ms long"), "viewer").collect())
    assert [r for r in got if r[2] == "a"] == [(1, "info", "a", 0, 0, 1, 4), (1, "info", "a", 5, 5, 1, 5005), (2, "info", "a", 0, 5, 3, 5005)]
    assert len(got) == 10


def test_due_imports_of_a_stream(spark, tmp_path):
    event = lambda p, kind, t: {"path_key": p, "path": p, "folder_id": 1, "kind": kind, "at_ms": t}
    put(tmp_path / "in", "a", [event("/a", "create", 1), event("/a", "modify", 2), event("/b", "create", 1), event("/c", "create", 1)])
    put(tmp_path / "in", "b", [event("/b", "remove", 3)])
    stream = files_stream(spark, tmp_path / "in", "path_key string, path string, folder_id long, kind string, at_ms long")
    out = debounce.due_imports_stream(stream, 1500)
    query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        rows = []
        while len(rows) < 2 and time.time() < end:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = sorted(tuple(r) for r in spark.read.schema(debounce.DUE).parquet(str(tmp_path / "out")).collect())
    finally:
        query.stop()
    assert rows == [("/a", "/a", 1, 1502), ("/c", "/c", 1, 1501)]


def test_notices_on_show(spark):
    rows = spark.createDataFrame([("info", "a", 0, 0), ("warn", "b", 0, 0), ("error", "c", 100, 9000), ("error", "d", 9500, 9500), *[("error", f"e{i}", 8000 + i, 8000 + i) for i in range(4)]], "level string, message string, first_ms long, last_ms long")
    assert [r.message for r in notices.shown(rows, 4999).orderBy("message").collect()] == ["a", "b", "c"]
    assert sorted(r.message for r in notices.shown(rows, 9600).collect()) == ["c", "d", "e2", "e3"]


def test_import_reports_keep_the_last(spark):
    rows = spark.createDataFrame([(1, 0, 1, 5), (1, 50, 2, 5), (1, 210, 3, 5), (1, 220, 5, 5)], "id long, at_ms long, processed long, total long")
    assert sorted(r.processed for r in watchers.import_reports(rows).collect()) == [1, 3, 5]


def test_events_reports_and_logs(spark, tmp_path):
    events = spark.createDataFrame([("video-removed", 1, "/a"), ("stats", None, None)], "type string, video_id long, path string")
    for _ in range(2):
        sinks.append_events(events, str(tmp_path / "events"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "events")).collect())
    assert lines == ['{"type":"stats"}'] * 2 + ['{"type":"video-removed","video_id":1,"path":"/a"}'] * 2
    one = lambda **kv: spark.createDataFrame([tuple(kv.values())], list(kv))
    sinks.write_report(sinks.diagnostics(one(total=3), one(maxResults=40), one(enabled=2), one(running=False), 7), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("*.gz")
    report = json.loads(gzip.decompress(part.read_bytes()))
    assert report == {"schema_version": 1, "generated_at_ms": 7, "library": {"total": 3}, "settings": {"maxResults": 40}, "folders": {"enabled": 2}, "indexer": {"running": False}}
    log = str(tmp_path / "log")
    for text in ("first", "second", "third"):
        sinks.append_log(spark.createDataFrame([(text * 10,)], "value string"), log, max_bytes=60)
    assert [r.value for r in spark.read.text(log).collect()] == ["third" * 10]
    assert sorted(r.value for r in spark.read.text(log + ".1").collect()) == ["first" * 10, "second" * 10]


def test_frame_pictures_of_the_current_writer(spark):
    rows = [(1, 1, 5, bytearray(b"abc"), 1, 1), (1, 2, 6, bytearray(b"def"), 1, 1), (2, 1, 7, bytearray(b"gh"), 1, 1), (3, 1, 8, bytearray(b"ijk"), 1, 1)]
    frames = spark.createDataFrame(rows, "video_id long, generation long, time_ms long, rgb binary, width int, height int")
    current = spark.createDataFrame([(1, 2), (2, 1)], "video_id long, generation long")
    got = {r.name: bytes(r.content) for r in sinks.frame_pictures(frames, current, lambda d, w, h: b"J" + d).collect()}
    assert got == {"1/6.jpg": b"Jdef"}


def test_scanning_a_folder(spark, tmp_path):
    for name in ("a.mp4", "sub/b.MKV", "sub/list.m3u8", "sub/part1.ts", "up.ts", "notes.txt", ".hidden", ".git/c.mp4", "sub/NODE_MODULES/d.mp4", "README"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("#EXTM3U\npart1.ts\n../up.ts\nhttp://x/y.ts\n" if name.endswith("m3u8") else name)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = {os.path.relpath(r.path, tmp_path): r.size for r in media.scan_folder(spark, root).collect()}
        assert got.keys() == {"a.mp4", "sub/b.MKV", "sub/list.m3u8"} and got["a.mp4"] == 5
    assert {os.path.relpath(r.path, tmp_path) for r in media.scan_folder(spark, str(tmp_path), recursive=False).collect()} == {"a.mp4", "up.ts"}


def scanned(spark, root, **options):
    return sorted(os.path.relpath(r.path, root) for r in media.scan_folder(spark, str(root), **options).collect())


def test_a_scan_passes_over_broken_playlists_and_links(spark, tmp_path):
    root = tmp_path / "root"
    (root / "in").mkdir(parents=True)
    for name in ("a.mp4", "b.ts", "in/c.ts"):
        (root / name).write_text(name)
    (root / "latin.m3u8").write_bytes("#EXTM3U\nb.ts\nétoile.ts\n".encode("latin-1"))
    (root / "good.M3U8").write_text("#EXTM3U\nin/c.ts\n")
    (root / "large.m3u8").write_text("#EXTM3U\na.mp4\n" + "#" * media.PLAYLIST_BYTES)
    (root / "folder.m3u8").mkdir()
    os.symlink(root / "a.mp4", root / "link.mp4")
    os.symlink(root, root / "in" / "loop")
    os.symlink(root / "gone", root / "dangling.mp4")
    os.mkfifo(root / "pipe.mp4")
    assert scanned(spark, root) == ["a.mp4", "b.ts", "good.M3U8", "large.m3u8", "latin.m3u8"]


def test_a_scan_needs_a_folder(spark, tmp_path):
    (tmp_path / "file.mp4").write_text("x")
    for root in (tmp_path / "file.mp4", tmp_path / "none"):
        with pytest.raises(NotADirectoryError):
            media.scan_folder(spark, str(root))
    (tmp_path / "empty").mkdir()
    assert scanned(spark, tmp_path / "empty") == []


def test_a_scan_ends_below_24_levels(spark, tmp_path):
    folder = tmp_path / "deep"
    for k in range(26):
        folder.mkdir()
        (folder / f"v{k}.mp4").write_text("x")
        folder = folder / "d"
    assert [os.path.basename(p) for p in sorted(scanned(spark, tmp_path / "deep"), key=len)] == [f"v{k}.mp4" for k in range(25)]
    assert scanned(spark, tmp_path / "deep", recursive=False) == ["v0.mp4"]


def test_directories_are_listed_by_tasks(spark, tmp_path):
    for i in range(30):
        (tmp_path / "wide" / f"d{i}").mkdir(parents=True)
        for k in range(7):
            (tmp_path / "wide" / f"d{i}" / f"{k}.mp4").write_text("x" * k)
    found = media.scan_folder(spark, str(tmp_path / "wide"))
    assert found.count() == 210 and found.agg(F.sum("size")).first()[0] == 30 * 21
    assert "BinaryFile" not in found._jdf.queryExecution().executedPlan().toString()


def test_probing_and_fetching(spark):
    files = spark.createDataFrame([("/a",), ("/b",)], "path string")
    info = {r.path: r.info for r in media.probe(files, lambda p: '{"streams":[{"duration":"3","width":4,"height":2,"codec_name":"h"}]}' if p == "/a" else "broken").collect()}
    assert (info["/a"].duration, info["/a"].width, info["/a"].height, info["/a"].video_codec, info["/a"].error) == (3.0, 4, 2, "h", None)
    assert (info["/b"].duration, info["/b"].error) == (None, "no picture")

    def get(url):
        if url.endswith("down"):
            raise OSError("no route")
        return ("image/png", b"x" * (11 << 20)) if url.endswith("big") else ("text/html", b"page")

    urls = spark.createDataFrame([("http://a/",), ("ftp://a/",), ("https://a/down",), ("https://a/big",), (None,)], "url string")
    got = {r.url: (r.content, r.error) for r in web.fetch(urls, get).collect()}
    assert bytes(got["http://a/"][0]) == b"page" and got["ftp://a/"] == (None, "unsupported-protocol") and got[None][1] == "unsupported-protocol"
    assert got["https://a/down"][1] == "network: no route" and got["https://a/big"] == (None, "too-large")


def test_fetching_over_http(spark):
    import http.server
    import threading

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path.startswith("/turn"):
                self.send_response(302)
                self.send_header("Location", f"/turn{self.path}" if "loop" in self.path else "/page")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("Content-Type", "image/png" if self.path == "/picture" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"x" * (3 << 20) if self.path in ("/picture", "/large") else b"page")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r.url: (len(r.content or b""), r.kind, r.error) for r in web.fetch(spark.createDataFrame([(base + p,) for p in ("/page", "/turn", "/turn-loop", "/large", "/picture")], "url string")).collect()}
    server.shutdown()
    assert got[base + "/page"] == got[base + "/turn"] == (4, "text/html", None)
    assert got[base + "/large"] == (0, "text/html", "too-large") and got[base + "/picture"] == (3 << 20, "image/png", None)
    assert got[base + "/turn-loop"][2].startswith("network:")


def test_removals_take_everything_along(spark):
    videos = spark.createDataFrame([(1, "/a/x"), (2, "/a/b/y"), (3, "/a"), (4, "/ab/z"), (5, "C:\\M\\v.mp4")], "id long, path string").withColumn("path_key", F.lower("path"))
    frames = spark.createDataFrame([(i, k) for i in range(1, 6) for k in range(2)], "video_id long, frame_index long")
    events, (left, rest) = mutations.remove_under("/a", videos, frames)
    assert sorted((r.type, r.video_id, r.path) for r in events.collect()) == [("video-removed", 1, "/a/x"), ("video-removed", 2, "/a/b/y")]
    assert sorted(r.id for r in left.collect()) == [3, 4, 5] and rest.count() == 6
    events, (left, rest) = mutations.remove_by_path("c:/m/V.mp4", videos, frames)
    assert [r.video_id for r in events.collect()] == [5] and left.count() == 4 and rest.where("video_id = 5").isEmpty()
    assert [t.count() for t in mutations.cleared(videos, frames)] == [0, 0]


def test_inserting_folders(spark):
    schema = "id long, path string, path_key string, name string, pinned boolean, enabled boolean, recursive boolean, watch_state string, message string, added_at long, last_scan_at long"
    folders = spark.createDataFrame([(1, "/f", "/f", "f", True, False, True, "idle", None, 0, None), (2, "/g", "/g", "g", False, False, True, "idle", None, 0, None)], schema)
    state = lambda df: {r.path_key: (r.id, r.pinned, r.enabled) for r in df.collect()}
    assert state(mutations.insert_folder(folders, "/f/", True, True, 5)) == {"/f": (1, True, False), "/g": (2, False, False)}  # a pause stays
    assert state(mutations.insert_folder(folders, "/g", True, True, 5))["/g"] == (2, True, True)
    assert state(mutations.insert_imported_folder(folders, "/h", False, 5)) == {"/f": (1, True, False), "/g": (2, False, False), "/h": (3, False, False)}
