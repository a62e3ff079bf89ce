"""Decoding in committed batches: what stops or fails in one leaves the earlier ones, and the next run goes on behind them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillmark.functions import fingerprint
from stillmark.operators import frame_index, mutations, snapshots
from stillmark.plans import lifecycle
from stillmark.sources import media

VIDEO = "id long, path string, status string, error string, duration double, width long, height long, frame_count long, indexed_at long, processed_ms long, processed_timestamps array<long>, sampling_override string"
FRAME = f"video_id long, frame_index long, time_ms long, {fingerprint.SIGNATURE}"
LENGTHS = {1: 100, 2: 40, 3: 1, 4: 70, 5: 20}


@pytest.fixture
def library(spark, tmp_path):
    rows = [(i, f"/v{i}", "ready" if i == 5 else "pending", None, float(n), 640, 480, 0, None, 0, [], None) for i, n in LENGTHS.items()]
    videos = snapshots.create(spark.createDataFrame(rows, VIDEO), str(tmp_path / "videos"), "id", buckets=4)
    index = frame_index.build(spark.createDataFrame([], FRAME), str(tmp_path / "frames"), buckets=4)
    seconds = F.transform(F.sequence(F.lit(0), F.col("duration").cast("int") - 1), lambda k: k.cast("double"))
    plan = spark.createDataFrame(rows, VIDEO).select(F.col("id").alias("video_id"), "path", seconds.alias("seconds"), (F.col("id") == 4).alias("full_scan"))
    return videos, index, plan


def decoder(log, breaks=None):
    def decode(path, seconds, full):
        with open(log, "a") as f:
            f.write(json.dumps([path, seconds[0], len(seconds)]) + "\n")
        for s in seconds:
            if [path, s] == breaks:
                raise OSError("broken stream")
            yield s, np.full((8, 8, 3), int(s) % 250, np.uint8)

    return decode


def calls(log):
    return sorted(tuple(json.loads(x)) for x in open(log))


def state(spark, videos, index):
    v = snapshots.read(spark, snapshots.current(spark, videos.root)).collect()
    f = frame_index.frames(spark, snapshots.current(spark, index.root)).select("video_id", "frame_index", "time_ms").collect()
    return {r.id: (r.status, len(r.processed_timestamps), r.frame_count) for r in v}, sorted(map(tuple, f))


def whole(*ids):
    return sorted((i, k, k * 1000) for i in ids for k in range(LENGTHS[i]))


def test_every_batch_once(spark, library, tmp_path):
    videos, index, plan = library
    lifecycle.index_in_batches(videos, index, plan, decoder(tmp_path / "log"), F.lit(9).cast("long"))
    table, frames = state(spark, videos, index)
    assert frames == whole(1, 2, 3, 4)
    assert table == {1: ("ready", 100, 100), 2: ("ready", 40, 40), 3: ("ready", 1, 1), 4: ("ready", 70, 70), 5: ("ready", 0, 0)}
    assert calls(tmp_path / "log") == sorted([("/v1", 0.0, 32), ("/v1", 32.0, 32), ("/v1", 64.0, 32), ("/v1", 96.0, 4), ("/v2", 0.0, 32), ("/v2", 32.0, 8), ("/v3", 0.0, 1), ("/v4", 0.0, 70)])


def test_a_decoder_that_fails_in_the_third_batch(spark, library, tmp_path):
    videos, index, plan = library
    videos, index = lifecycle.index_in_batches(videos, index, plan, decoder(tmp_path / "log", ["/v1", 70.0]), F.lit(9).cast("long"))
    table, frames = state(spark, videos, index)
    assert table[1] == ("error", 64, 0) and table[2] == ("ready", 40, 40)
    assert frames == sorted(whole(2, 3, 4) + whole(1)[:64])
    assert [r.error for r in snapshots.rows_of(spark, videos, 1).collect()] == ["OSError: broken stream"]
    again = spark.createDataFrame([(1,)], "id long")
    videos = snapshots.rewrite(again, videos, lambda rows: mutations.set_pending(rows, again))
    left = lifecycle.pending_plan(snapshots.read(spark, videos), frame_index.frames(spark, index), plan).collect()
    assert [(r.video_id, r.resume_at, r.seconds[0]) for r in left] == [(1, 64, 64.0)]
    lifecycle.index_in_batches(videos, index, plan, decoder(tmp_path / "second"), F.lit(9).cast("long"))
    table, frames = state(spark, videos, index)
    assert table[1] == ("ready", 100, 100) and frames == whole(1, 2, 3, 4)
    assert calls(tmp_path / "second") == [("/v1", 64.0, 32), ("/v1", 96.0, 4)]


@pytest.mark.parametrize("step", ["frames", "progress"])
def test_a_run_that_stops_in_the_third_round(spark, library, tmp_path, monkeypatch, step):
    videos, index, plan = library
    module, name = (frame_index, "add") if step == "frames" else (mutations, "record_progress")
    real, times = getattr(module, name), []

    def stops(*args):
        times.append(1)
        if len(times) == 3:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(module, name, stops)
    with pytest.raises(RuntimeError, match="lost"):
        lifecycle.index_in_batches(videos, index, plan, decoder(tmp_path / "log"), F.lit(9).cast("long"))
    monkeypatch.setattr(module, name, real)
    table, frames = state(spark, videos, index)
    assert table[1] == ("indexing", 64, 0) and len([f for f in frames if f[0] == 1]) == (64 if step == "frames" else 96)
    now = [snapshots.current(spark, s.root) for s in (videos, index)]
    lifecycle.index_in_batches(*now, plan, decoder(tmp_path / "second"), F.lit(9).cast("long"))
    table, frames = state(spark, videos, index)
    assert frames == whole(1, 2, 3, 4) and {t[0] for t in table.values()} == {"ready"}
    assert [c for c in calls(tmp_path / "second") if c[0] == "/v1"] == [("/v1", 64.0, 32), ("/v1", 96.0, 4)]


def test_batches_that_give_too_few_frames(spark):
    plan = spark.createDataFrame([(1, "/a", [1.0, 2.0], False, 5), (2, "/b", [1.0], False, 0), (3, "/c", [1.0, 2.0], True, 0)], "video_id long, path string, seconds array<double>, full_scan boolean, first long")
    got = media.decode_batches(plan, lambda path, seconds, full: [(7.0, np.zeros((8, 8, 3), np.uint8))]).collect()
    assert sorted((r.video_id, r.frame_index, r.time_ms, r.error) for r in got) == [(1, None, None, "ValueError: 1 of 2 frames"), (2, 0, 1000, None), (3, 0, 7000, None)]
