"""From pictures to hits: fingerprints, packing, scores, rerank, refinement, search and duplicates on pictures made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillmark.functions import fingerprint as fp
from stillmark.functions import similarity as S
from stillmark.operators import recall
from stillmark.plans import lifecycle
from stillmark.schemas import STRUCT_WORDS

W, H = 64, 48


def solid(color, w=32, h=32):
    return np.tile(np.array(color, np.uint8), (h, w, 1))


def picture(video, second):
    """A picture whose shapes belong to its video and move with time."""
    rng = np.random.default_rng(video)
    out = np.tile(rng.integers(0, 256, 3).astype(np.uint8), (H, W, 1))
    for k in range(6):
        x, y = (int(v) for v in rng.integers(0, (W - 20, H - 14)))
        x = (x + int(second) * (k % 3)) % (W - 20)
        out[y : y + 14, x : x + 20] = rng.integers(0, 256, 3)
    return out


def test_fingerprints_of_a_solid_picture():
    p = solid([120, 60, 30])
    assert fp.structure_hash(p) == b"\xff" * 128  # every cell is the mean
    assert fp.difference_hash(fp.gray(p, 9, 8)) == 0
    histogram = fp.color_histogram(solid([10, 200, 90]))
    assert histogram.sum() == pytest.approx(1) and (histogram > 0).sum() == 1
    assert fp.spatial_layout(p).tolist() == [120] * 16 + [60] * 16 + [30] * 16


def test_fingerprints_of_halves():
    p = np.concatenate([solid([0, 0, 0], 16), solid([255, 255, 255], 16)], axis=1)
    words = np.frombuffer(fp.structure_hash(p), "<u2")
    assert set(words.tolist()) == {0xFF00}  # the right half of every row of cells, in all four planes
    bits = fp.difference_hash(fp.gray(p, 9, 8))
    assert bits.bit_count() in (8, 16)
    assert fp.quantized(np.array([0.0, 0.5, 1.0, 1 / 510], np.float32)).tolist() == [0, 128, 255, 1]


def test_overlapping_and_disjoint_boxes():
    assert fp._overlapping(10, 4) == [(0, 3), (2, 5), (5, 8), (7, 10)]
    assert fp._disjoint(10, 4) == [(0, 2), (2, 5), (5, 7), (7, 10)]


def test_structural_similarity():
    a = (np.arange(32 * 24 * 3) % 251).astype(np.uint8).reshape(24, 32, 3)
    gray = fp.gray(a, 48, 48)
    assert fp.ssim(gray, gray) == 1.0
    other = np.minimum(a.astype(int) + 12, 255).astype(np.uint8)
    assert 0.0 < fp.ssim(gray, fp.gray(other, 48, 48)) < 1.0
    assert fp.ssim(gray[:4], gray[:4]) == 0.0


def images(spark, rows):
    data = [(*key, ("", p.shape[0], p.shape[1], 3, 16, bytearray(p[:, :, ::-1].tobytes()))) for *key, p in rows]
    return spark.createDataFrame(data, "video_id long, frame_index long, time_ms long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def test_signatures_by_spark_are_those_of_the_pictures(spark):
    rows = [(v, i, i * 1000, picture(v, i)) for v in range(3) for i in range(2)]
    broken = spark.createDataFrame([(9, 9, 9, ("", 0, 0, 3, 16, bytearray()))], images(spark, rows).schema)
    got = {(r.video_id, r.frame_index): r for r in fp.with_signature(images(spark, rows).unionByName(broken), ["video_id", "frame_index", "time_ms"]).collect()}
    assert len(got) == 6
    for v, i, _, p in rows:
        want = fp.signature(p)
        assert all(got[v, i][c] == want[c] or c == "luma" for c in want)


@pytest.fixture(scope="module")
def library(spark):
    """Six videos of five frames; video 6 is video 2 again with a little noise."""
    rng = np.random.default_rng(1)
    shown = {v: [picture(2 if v == 6 else v, i) for i in range(5)] for v in range(1, 7)}
    shown[6] = [np.clip(p.astype(int) + rng.integers(-3, 4, p.shape), 0, 255).astype(np.uint8) for p in shown[6]]
    rows = [(v, i, i * 1000, p) for v, ps in shown.items() for i, p in enumerate(ps)]
    frames = fp.with_signature(images(spark, rows), ["video_id", "frame_index", "time_ms"]).drop("luma").cache()
    videos = spark.createDataFrame([(v, f"/v/{v}.mp4", f"{v}.mp4", 5.0, 5, 100 + v, None) for v in shown], "id long, path string, name string, duration double, frame_count long, size long, file_hash string")
    return shown, frames, videos


def query_rows(spark, p, query_id=0):
    return fp.with_signature(images(spark, [(query_id, 0, 0, p)]), ["video_id"]).withColumnRenamed("video_id", "query_id").drop("luma")


def plain_score(frame, query):
    distance = sum(((frame[w] ^ query[w]) & (2**64 - 1)).bit_count() for w in STRUCT_WORDS)
    hash_score = 1 - distance / 1024
    common = sum(min(x * frame["color_total"], y * query["color_total"]) for x, y in zip(query["color"], frame["color"]))
    histogram = common / (frame["color_total"] * query["color_total"])
    layout = max(0.0, 1 - sum(abs(x - y) for x, y in zip(frame["spatial"], query["spatial"])) / (48 * 255))
    weight = 0.3 + 0.4 * max(query["color"]) / 255
    return distance, hash_score * (1 - weight) + (histogram * 0.65 + layout * 0.35) * weight


def test_scores_over_1024_bits(spark, library):
    _, frames, _ = library
    asked = query_rows(spark, picture(3, 2))
    got = {(r.video_id, r.frame_index): r for r in recall.score_frames(frames, asked, STRUCT_WORDS, max_dhash=64, max_struct=1024, min_score=0.0).collect()}
    query, held = asked.first(), {(r.video_id, r.frame_index): r for r in frames.collect()}
    assert len(got) == len(held)
    for key, r in got.items():
        distance, score = plain_score(held[key], query)
        assert (r.hash_distance, r.frame_score) == (distance, pytest.approx(score))
    raw = {(r.video_id, r.frame_index): r.frame_score for r in recall.score_pixels(images(spark, [(3, 2, 0, picture(3, 2)), (1, 0, 0, picture(1, 0))]), asked, ["video_id", "frame_index"]).collect()}
    assert raw == {k: pytest.approx(got[k].frame_score) for k in ((3, 2), (1, 0))} and raw[3, 2] == pytest.approx(1)


def test_search_from_end_to_end(spark, library):
    shown, frames, videos = library
    asked = query_rows(spark, shown[4][3])
    hits = lifecycle.search(frames, videos, asked, max_results=3).collect()
    assert (hits[0].video_id, hits[0].time_seconds, hits[0].path) == (4, 3.0, "/v/4.mp4") and hits[0].score > 0.9
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1)) and all(h.score == round(h.score, 4) for h in hits)


def test_rerank_blends_and_a_failed_decode_keeps_the_score(spark, library):
    shown, frames, videos = library
    asked = query_rows(spark, shown[2][1])
    pixels = spark.createDataFrame([(0, W, H, bytearray(shown[2][1].tobytes()))], "query_id long, width int, height int, data binary")
    hits = recall.recall(frames, asked, STRUCT_WORDS, k=8, min_score=0.3, max_dhash=64, max_struct=1024)
    before = {r.video_id: r for r in hits.collect()}

    def decode(path, seconds):
        number = int(path.split("/")[-1][:-4])
        return [] if number == 6 else [shown[number][int(seconds[0])]]

    after = {r.video_id: r for r in recall.rerank(hits, pixels, decode, videos).collect()}
    assert after.keys() == before.keys() and len(after) > 2 and after[2]["rank"] == 1
    small = lambda p: fp.gray(p, 48, 48)
    for v, r in after.items():
        other = fp.ssim(small(shown[2][1]), small(shown[v][before[v].time_ms // 1000]))
        assert r.score == pytest.approx(before[v].score if v == 6 else before[v].score * 0.7 + other * 0.3)


def test_refinement_moves_to_the_best_second(spark, library):
    _, _, videos = library
    hits = spark.createDataFrame([(0, 1, 4, 2000, 0.9), (1, 1, 2, 4000, 0.8)], "query_id long, rank int, video_id long, time_ms long, score double")
    got = {r.video_id: r.refined_seconds for r in recall.refine(hits, videos, lambda path, seconds, query: [-abs(s - query["want"]) + 1 for s in seconds], {"want": 2.6}).collect()}
    assert got == {4: 2.5, 2: 3.0}


def test_duplicate_videos(spark, library):
    _, frames, videos = library
    pairs = [(r.id_a, r.id_b) for r in lifecycle.find_duplicates(frames, videos, threshold=0.85).collect()]
    assert [tuple(sorted(p)) for p in pairs] == [(2, 6)]
    files = spark.createDataFrame([("/v/1.mp4", bytearray(b"same")), ("/v/9.mp4", bytearray(b"same")), ("/v/8.mp4", bytearray(b"else"))], "path string, content binary")
    more = spark.createDataFrame([(9, "/v/9.mp4", "9", 5.2, 5, 101, None), (8, "/v/8.mp4", "8", 5.0, 5, 101, None)], videos.schema)
    first = lifecycle.find_duplicates(frames, videos.unionByName(more), files, threshold=0.85).first()
    assert (first.id_a, first.id_b, first.identical_file, first.score) == (1, 9, True, 1.0)


def test_indexing_resuming_and_replaced_files(spark):
    videos = spark.createDataFrame(
        [(1, "/v/1", "pending", 12.0, 64, 48, None, [], 7, 70, 0, None, None), (2, "/v/2", "indexing", 12.0, 64, 48, None, [2500], 7, 70, 1, None, "x"), (3, "/v/3", "ready", 12.0, 64, 48, None, [], 7, 70, 3, None, None), (4, "/v/4", "indexing", 12.0, 64, 48, None, [2500], 7, 70, 1, None, None)],
        "id long, path string, status string, duration double, width long, height long, sampling_override string, processed_timestamps array<long>, size long, mtime_ms long, frame_count long, indexed_at long, error string",
    )
    decode = lambda path, seconds, full: [(s, picture(int(path[3:]), int(s))) for s in seconds]
    plan = lifecycle.sampling_plan(videos, None, 5)
    assert [r.seconds for r in plan.where("video_id = 1").collect()] == [[2.5, 7.5, 11.0]]
    all_frames = lifecycle.index_videos(videos, decode).drop("luma").cache()
    assert all_frames.groupBy("video_id").count().where("count <> 3").isEmpty()
    saved = all_frames.where("video_id = 2 and frame_index = 0")
    left = {r.video_id: (r.resume_at, r.seconds) for r in lifecycle.pending_plan(videos, saved, plan).collect()}
    assert left == {1: (0, [2.5, 7.5, 11.0]), 2: (1, [7.5, 11.0]), 4: (0, [2.5, 7.5, 11.0])}
    seen = spark.createDataFrame([(1, 7, 70), (2, 7, 71)], "video_id long, size long, mtime_ms long")
    v, f = lifecycle.commit_unchanged(videos, saved, all_frames.where("video_id in (1, 2)"), seen, F.lit(99).cast("long"))
    assert {r.id: (r.status, r.frame_count) for r in v.collect()} == {1: ("ready", 3), 2: ("pending", 0), 3: ("ready", 3), 4: ("indexing", 1)}
    assert sorted((r.video_id, r.frame_index) for r in f.collect()) == [(1, 0), (1, 1), (1, 2)]
    short = lambda path, seconds, full: [(s, picture(1, 0)) for s in seconds[1:]]
    with pytest.raises(Exception, match="of 3 frames"):
        lifecycle.index_videos(videos, short).collect()


def test_packed_records_are_cut_and_padded(spark):
    one = spark.createDataFrame([(bytearray(range(200)),)], "r binary").select(*[c.alias(k) for k, c in fp.unpack_frame(F.col("r")).items()]).first()
    raw = bytes(range(200)) + bytes(56)
    assert one.dhash == int.from_bytes(raw[:8], "little", signed=True) and one.s15 == int.from_bytes(raw[128:136], "little", signed=True)
    assert one.color == list(raw[136:200]) and one.spatial == [0] * 48 and one.time_ms == 0


def test_thresholds_and_weights(spark):
    r = spark.range(1).select(S.color_weight(F.lit(2.0)).alias("a"), S.color_weight(F.lit(0.5)).alias("b"), S.histogram_similarity(F.array(F.lit(0)), F.lit(0), F.array(F.lit(1)), F.lit(1)).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.7, 0.5, 0.0)
