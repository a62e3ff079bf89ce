"""The quality classifier: statistics against a plain count, its algebra against numpy's, and accuracy on held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from stillmark.llm import quality, queries, wordscan
from stillmark.llm.common import table

DATA = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, stats int, good string, fold double, score string, label_id int, lang string, source string"


def plain(text):
    """``SUMS`` of one text, word by word."""
    out = dict.fromkeys(quality.SUMS, 0)
    data = (text or "").encode()
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    for i, (a, _, w) in enumerate(words):
        upper, letters = sum(65 <= b <= 90 for b in w), sum(b >= 128 or chr(b).isalpha() for b in w)
        odd = lambda b: 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()"
        out["words"] += 1
        out["length"] += len(w)
        out["length2"] += min(len(w), 1000) ** 2
        out["upper"] += upper
        out["letters"] += letters
        out["digits"] += sum(48 <= b <= 57 for b in w)
        out["marks"] += sum(chr(b) in ".,;:!?'\"-()" for b in w)
        out["symbols"] += sum(map(odd, w))
        out["loud"] += upper == letters and upper > 1
        out["wordless"] += letters == 0
        out["odd_end"] += odd(w[-1])
        out["loud_end"] += w[-1:] in (b"!", b"?")
        out["short"] += len(w) <= 3
        if i:
            out["again"] += w == words[i - 1][2]
            out["lines"] += b"\n" in data[words[i - 1][1] : a]
    only = [w for _, _, w in words]
    for i in range(0, len(only), quality.BLOCK):
        block = only[i : i + quality.BLOCK]
        out["distinct"] += len(set(block))
        out["pairs"] += len(block) - 1
        out["distinct_pairs"] += len(set(zip(block, block[1:])))
    return [float(out[c]) for c in quality.SUMS]


def texts():
    rng = random.Random(6)
    words = ["The", "OK!!", "###", "über", "日本", "x\x00", "a1", "no,", "why?", "==", "A", "loud***", "the"]
    rows = ["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t\r"]) for _ in range(rng.randrange(300))) for _ in range(60)]
    return [None, "", " \n", "one", *rows, "again " * 200, "Z" * 5000]


def test_statistics_are_those_of_a_plain_count():
    column = pa.array(["cut", *texts()]).slice(1)
    assert quality.sums_of(column).tolist() == [plain(t) for t in texts()]
    stats = quality.statistics(column)
    assert stats.shape == (len(texts()), quality.FEATURES) and np.isfinite(stats).all() and (stats >= 0).all()
    assert (stats * quality.ROUND == np.round(stats * quality.ROUND)).all()
    assert quality.statistics(pa.array([], pa.string())).shape == (0, quality.FEATURES)


def test_a_text_over_several_slices_counts_whole():
    word = "Abc" * 21 + "! "  # blocks of words end where slices end
    text = word * (2 * wordscan.SLICE_BYTES // len(word) + 50)
    got, want = quality.sums_of(pa.array(["short one", text, "x"])), plain(text)
    differs = [c for c, a, b in zip(quality.SUMS, got[1], want) if a != b]
    assert set(differs) <= {"again", "lines", "pairs", "distinct", "distinct_pairs"}  # what a cut between slices parts
    assert np.allclose(got[1], want, atol=12)
    assert got[0].tolist() == plain("short one") and got[2].tolist() == plain("x")


def test_isotonic_values_are_the_nearest_that_never_fall():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 9, 30).astype(float)
        y = rng.integers(0, n.astype(int) + 1).astype(float)
        got = quality.isotonic(n, y)
        # the minimax form of the solution
        mean = lambda a, b: y[a:b].sum() / n[a:b].sum()  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i + 1, 31)) for a in range(i + 1)) for i in range(30)]
        assert np.allclose(got, want)
    assert quality.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_features_approximate_a_gaussian_kernel():
    x = np.random.default_rng(2).normal(size=(30, 5))
    z = quality.fourier(x, np.zeros(5), np.ones(5), 20_000, 3, 2.0)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 8)
    assert np.abs(z[:, :-1] @ z[:, :-1].T * 2 / 20_000 - kernel).max() < 0.05


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, 1, "x", 0.5, "y", 3, "en", "s") for d, t in rows], COLUMNS).repartition(parts)


def labelled(n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        make = (lambda: "".join(rng.choices("abcdefgh", k=4))) if good else (lambda: "".join(rng.choices("ABCD", k=3)) + "##")
        rows.append((i, " ".join(make() for _ in range(rng.randrange(5, 60)))))
        labels.append((i, int(good), 0))
    return rows, labels


def test_weights_solve_the_normal_equations_whatever_the_partitions(spark):
    rows, labels = labelled()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = quality.train(frame(spark, rows, 1), marks, features=40)
    b = quality.train(frame(spark, rows, 7), marks.repartition(5), features=40)
    assert (a.weights == b.weights).all() and (a.raw == b.raw).all() and (a.calibrated == b.calibrated).all()
    used = [(t, q) for (d, t), (_, q, _) in zip(rows, labels) if zlib.crc32(str(d).encode()) % 5]
    stats, y = quality.statistics(pa.array([t for t, _ in used])), np.array([q for _, q in used], float)
    assert np.allclose(a.mean, stats.mean(axis=0)) and np.allclose(a.scale - 1e-3, stats.std(axis=0), atol=1e-2)
    z = quality.fourier(stats, a.mean, a.scale, 40, a.seed, a.width)
    want = np.linalg.solve(z.T @ z + 1e-3 * len(y) * np.eye(41), z.T @ y)
    assert np.allclose(a.weights, want, atol=1e-6)


def test_defined_results(spark):
    rows, labels = labelled(200)
    odd = [(1000, None), (1001, ""), (None, "some text"), (0, rows[0][1]), (1002, "word " * 700_000)]
    marks = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 0), (6, 7, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(spark, rows + odd), marks, features=30)
    got = quality.score_quality(frame(spark, rows + odd), model).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted([d for d, _ in rows + odd if d is not None])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[0]) == 1 and by[1000] == by[1001] and len(by[None]) == 1
    assert quality.score_quality(frame(spark, []), model).collect() == []
    for none in (quality.train(frame(spark, rows), marks.limit(0)), quality.train(frame(spark, []), marks)):
        assert {(r.score, r.predicted) for r in quality.score_quality(frame(spark, odd), none).collect()} == {(0.5, 1)}
    one = quality.train(frame(spark, rows), marks.where("quality = 1"), features=30)
    assert all(r.score == 1 for r in quality.score_quality(frame(spark, rows), one).collect())


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    got = queries.op11_quality_classifier(spark, DATA).collect()
    assert len(got) == table(spark, DATA, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, truth[r.doc_id], r.score) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 50 and np.mean([p == q for p, q, _ in held]) >= 0.95
    good, bad = [s for _, q, s in held if q], [s for _, q, s in held if not q]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) >= 0.98
