"""Retrieval measured from pixels to ranks: families of pictures, changed in several ways, against plain Python."""

import numpy as np
import pytest
from tests.test_pictures import images, plain_score

from stillmark.functions import fingerprint as fp
from stillmark.operators import catalog, evaluation
from stillmark.schemas import STRUCT_WORDS

H, W = 72, 128
EACH, HELD_OUT = 4, 2


def tiles(rng):
    grid = rng.integers(20, 236, (rng.integers(3, 7), rng.integers(3, 9), 3))
    return grid[np.arange(H) * len(grid) // H][:, np.arange(W) * grid.shape[1] // W]


def discs(rng):
    out, (y, x) = np.tile(rng.integers(0, 256, 3), (H, W, 1)), np.mgrid[:H, :W]
    for _ in range(7):
        out[np.hypot(y - rng.integers(H), x - rng.integers(W)) < rng.integers(8, 26)] = rng.integers(0, 256, 3)
    return out


def ramps(rng):
    y, x = np.mgrid[:H, :W]
    along = np.cos(angle := rng.uniform(0, 2 * np.pi)) * x / W + np.sin(angle) * y / H
    share = ((along - along.min()) / np.ptp(along))[..., None]
    return rng.integers(0, 256, 3) * share + rng.integers(0, 256, 3) * (1 - share) + 20 * np.sin(x / rng.integers(4, 20))[..., None]


def ripples(rng):
    y, x = np.mgrid[:H, :W]
    waves = [np.sin(x * rng.uniform(0.02, 0.2) + y * rng.uniform(0.02, 0.2) + rng.uniform(0, 6)) for _ in range(3)]
    return 128 + 120 * np.stack(waves, axis=2)


FAMILIES = {f.__name__: f for f in (tiles, discs, ramps, ripples)}


def made(family, n):
    return np.clip(FAMILIES[family](np.random.default_rng([list(FAMILIES).index(family), n])), 0, 255).astype(np.uint8)


def letterboxed(p):
    out = np.zeros((H + 24, W + 32, 3), np.uint8)
    out[12:-12, 16:-16] = p
    return out


def occluded(p):
    out = p.copy()
    out[46:62, 12:100] = 0
    return out


VARIANTS = {
    "exact": lambda p: p,
    "small": lambda p: p[::3, ::3],
    "crop": lambda p: p[9:-9, 16:-16],
    "letterbox": letterboxed,
    "occluded": occluded,
    "grey": lambda p: np.repeat(p.mean(axis=2, keepdims=True).astype(np.uint8), 3, axis=2),
    "flipped": lambda p: p[:, ::-1],
    "noise": lambda p: np.clip(p + np.random.default_rng(3).integers(-20, 21, p.shape), 0, 255).astype(np.uint8),
}


@pytest.fixture(scope="module")
def measured(spark):
    """(gallery, queries, evaluated): each picture is the one frame of a video, asked for in every variant."""
    gallery = {family_at * 100 + n: (family, made(family, n)) for family_at, family in enumerate(FAMILIES, 1) for n in range(EACH)}
    asked = [(family, variant, video, change(p)) for video, (family, p) in gallery.items() for variant, change in VARIANTS.items()]
    asked += [(family, "held-out", None, made(family, 1000 + n)) for family in FAMILIES for n in range(HELD_OUT)]
    frames = fp.with_signature(images(spark, [(v, 0, 0, p) for v, (_, p) in gallery.items()]), ["video_id", "frame_index", "time_ms"]).drop("luma").cache()
    stated = spark.createDataFrame([(i, f, v, e) for i, (f, v, e, _) in enumerate(asked)], "query_id long, family string, variant string, expected long")
    signed = fp.with_signature(images(spark, [(i, 0, 0, np.ascontiguousarray(q[-1])) for i, q in enumerate(asked)]), ["video_id"]).withColumnRenamed("video_id", "query_id").drop("luma")
    queries = stated.join(signed, "query_id").cache()
    return frames, queries, evaluation.evaluate(frames, queries, STRUCT_WORDS).cache()


def test_ranks_are_those_of_a_plain_search(measured):
    frames, queries, evaluated = measured
    held, got = frames.collect(), {r.query_id: r for r in evaluated.collect()}
    assert len(got) == len(FAMILIES) * (EACH * len(VARIANTS) + HELD_OUT)
    for q in queries.collect():
        scores = []
        for f in held:
            distance, score = plain_score(f, q)
            if ((f.dhash ^ q.dhash) & (2**64 - 1)).bit_count() <= 24 and distance <= 448 and 1 - distance / 1024 >= 0.6:
                scores.append((-score, f.video_id))
        order, r = [v for _, v in sorted(scores)], got[q.query_id]
        assert r.n_hits == len(order) and [t.video_id for t in r.top] == order[:5]
        assert r["rank"] == (order.index(q.expected) + 1 if q.expected in order else None)
        assert [t.score for t in r.top] == [pytest.approx(-s) for s, _ in sorted(scores)[:5]]


def test_unchanged_pictures_come_first(measured):
    _, _, evaluated = measured
    assert evaluation.exact_are_first(evaluated)
    rows = {(r.family, r.variant): r for r in catalog.evaluation_summary(evaluated).collect()}
    whole, exact = rows[None, None], rows[None, "exact"]
    assert exact.queries == exact.top1 == EACH * len(FAMILIES) and rows[None, "noise"].top1 == rows[None, "small"].top1 == exact.top1
    assert whole.queries == evaluated.count() and rows["tiles", None].queries == EACH * len(VARIANTS) + HELD_OUT
    wrong = evaluation.failures(evaluated).collect()
    assert whole.false_positives == sum(r.expected is None for r in wrong)
    assert whole.top1 == sum(r.expected is not None for r in evaluated.collect()) - sum(r.expected is not None for r in wrong)


def test_queries_without_hits_and_an_empty_gallery(measured):
    frames, queries, _ = measured
    none = evaluation.evaluate(frames.limit(0), queries, STRUCT_WORDS)
    assert {(r["rank"], r.n_hits, len(r.top)) for r in none.collect()} == {(None, 0, 0)} and none.count() == queries.count()
    assert not evaluation.exact_are_first(none)
    assert evaluation.evaluate(frames, queries.limit(0), STRUCT_WORDS).isEmpty()
