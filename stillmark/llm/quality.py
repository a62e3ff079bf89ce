"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features approximate a Gaussian kernel over the statistics of a text. Tasks sum normal equations over their rows, one for
each fold, so weights without a fold cost no further pass; scores of rows by weights that have not seen them are calibrated.
Statistics and features are rounded to binary fractions short enough for their sums to be exact, so every run learns the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .wordscan import byte_class, dense, word_slices

SPACE = byte_class((32, 32), (9, 13))
UPPER, LOWER_CASE, DIGIT = byte_class((65, 90)), byte_class((97, 122)), byte_class((48, 57))
MARK = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?'\"-()"])
SYMBOL = byte_class((33, 126)) & ~UPPER & ~LOWER_CASE & ~DIGIT & ~MARK
LETTER = UPPER | LOWER_CASE | byte_class((128, 255))
NEVER = np.zeros(256, bool)
BLOCK = 64  # words within which repetition is looked for
SUMS = "words length length2 upper letters digits marks symbols loud wordless odd_end loud_end again short distinct distinct_pairs pairs lines".split()
FEATURES = 18
ROUND = 1 << 16  # statistics are whole multiples of 1 / ROUND
SCORE_BINS = 4096


def _distinct(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code


def sums_of(column: pa.Array) -> np.ndarray:
    """A row of ``SUMS`` for each text of a string column; the slices of a long text add up."""
    out = {name: np.zeros(len(column)) for name in SUMS}
    for w in word_slices(column, ~SPACE, NEVER, fold=False):
        low, high = int(w.row[0]), int(w.row[-1]) + 1
        row, n = w.row - low, w.end - w.start

        def add(name, values, at=row, low=low, high=high):
            out[name][low:high] += np.bincount(at, values, high - low)

        def within(kind, w=w):
            seen = np.zeros(len(w.data) + 1, np.int32)
            np.cumsum(kind[w.data], out=seen[1:])
            return seen[w.end] - seen[w.start]

        upper, letters, last = within(UPPER), within(LETTER), w.data[w.end - 1]
        form, forms = w.encoded()
        blocks = 1 + len(form) // BLOCK
        place = row * blocks + (np.arange(len(form)) - np.searchsorted(row, row, "left")) // BLOCK
        follows, pair = np.r_[False, row[1:] == row[:-1]], np.r_[False, place[1:] == place[:-1]]
        code = place * np.int64(len(forms)) + form
        pairs = dense([code[pair], form[:-1][pair[1:]]], [(high - low) * blocks * len(forms), len(forms)])
        pair_rows = row[pair]
        order = np.argsort(pairs, kind="stable")
        fresh = np.r_[True, pairs[order][1:] != pairs[order][:-1]][: len(order)]
        lines = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(w.data == 10, out=lines[1:])
        add("words", None)
        add("length", n)
        add("length2", np.minimum(n, 1000) ** 2)
        add("upper", upper)
        add("letters", letters)
        add("digits", within(DIGIT))
        add("marks", within(MARK))
        add("symbols", within(SYMBOL))
        add("loud", (upper == letters) & (upper > 1))
        add("wordless", letters == 0)
        add("odd_end", SYMBOL[last])
        add("loud_end", (last == 33) | (last == 63))
        add("again", follows & (form == np.r_[-1, form[:-1]]))
        add("short", n <= 3)
        add("distinct", None, _distinct(code) // (blocks * len(forms)))
        add("pairs", pair)
        add("distinct_pairs", None, pair_rows[order[fresh]])
        add("lines", follows & (lines[w.start] > np.r_[0, lines[w.end[:-1]]]))
    return np.stack([out[name] for name in SUMS], axis=1) if len(column) else np.zeros((0, len(SUMS)))


def statistics(column: pa.Array) -> np.ndarray:
    """``FEATURES`` numbers for each text, all between 0 and about 10: sizes as logarithms, the rest as shares."""
    s = dict(zip(SUMS, sums_of(column).T))
    words, letters, pairs, size = (np.maximum(s[c], 1) for c in ("words", "letters", "pairs", "length"))
    mean = s["length"] / words
    spread = np.sqrt(np.maximum(s["length2"] / words - mean**2, 0))
    columns = [np.log1p(s["words"]) / 4, np.log1p(mean), np.log1p(spread), s["upper"] / letters, (s["words"] == 0).astype(float), s["distinct_pairs"] / pairs]
    columns += [s[c] / size for c in ("letters", "digits", "marks", "symbols")]
    columns += [s[c] / words for c in ("loud", "wordless", "odd_end", "loud_end", "again", "short", "distinct", "lines")]
    return np.round(np.stack(columns, axis=1) * ROUND) / ROUND


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class QualityModel:
    """At most ``features`` weights and ``SCORE_BINS`` steps, whatever it was learned from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # rising ridge scores
    calibrated: np.ndarray  # what they mean, never falling
    seed: int
    width: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(column), self.calibrated[0])
        stats = statistics(column)
        out = np.zeros(len(stats))
        for at in range(0, len(out), 512):
            out[at : at + 512] = fourier(stats[at : at + 512], self.mean, self.scale, len(self.weights) - 1, self.seed, self.width) @ self.weights
        return np.clip(np.interp(np.round(out, 9), self.raw, self.calibrated), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int, seed: int, width: float) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of that ``width``, and a constant; whole multiples of 1 / 4096."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(size=(stats.shape[1], features)) / width, rng.uniform(0, 2 * np.pi, features)
    waves = np.cos(np.clip((stats - mean) / scale, -6, 6) @ w + shift)
    return np.c_[np.round(waves * 4096) / 4096, np.ones(len(stats))]


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The never falling values nearest to ``ones / total`` in weighted least squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for n, y in zip(total.tolist(), ones.tolist()):
        pools.append([n, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, y, size = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + y, pools[-1][2] + size]
    return np.concatenate([np.full(int(size), y / n) for n, y, size in pools]) if pools else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 200_000, features: int = 512, folds: int = 5, ridge: float = 1e-3, width: float = 4.0, seed: int = 11) -> QualityModel:
    """Learn from the texts of labelled documents that are not held out, about ``most_labelled`` of them at most.

    The bounded sample is chosen by a hash of doc_id; each text is read whole. A doc_id with several labels counts as good if
    half of them or more say so; labels other than 0 and 1 are ignored. The driver gets sums of fixed size only: of
    the statistics, of the normal equations of ``folds`` folds, and of labels in ``SCORE_BINS`` bins of scores.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("quality")).where("label_id is not null and quality in (0, 1)")
    known = known.where(~is_held_out(F.col("label_id"))).groupBy("label_id").agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    share = min(1.0, most_labelled / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit("quality-sample"), "label_id"), F.lit(1 << 31)) < int(share * 2**31))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("quality-fold"), "doc_id"), F.lit(folds)).cast("int")
    # by the sample's bound, the small side has 2 * 10^5 rows of two numbers
    sample = rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", "good", fold.alias("fold"))

    def measure(batches):
        for batch in batches:
            stats = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([_lists(stats), batch.column(1), batch.column(2)], ["stats", "good", "fold"])

    measured = saved(sample.mapInArrow(measure, "stats array<double>, good double, fold int").repartition(16), "quality-sample")

    def moments(batches):
        total = np.zeros((3, FEATURES))
        for batch in batches:
            stats = _matrix(batch.column(0))
            total += [np.full(FEATURES, len(stats)), stats.sum(axis=0), (np.round(stats**2 * ROUND) / ROUND).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["sums"])

    parts = [r.sums for r in measured.mapInArrow(moments, "sums array<double>").collect()]
    n, first, second = np.sum(parts, axis=0).reshape(3, -1) if parts else np.zeros((3, FEATURES))
    if not n[0]:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(0), np.zeros(1), np.array([0.5]), seed, width)
    mean = first / n
    scale = np.sqrt(np.maximum(second / n - mean**2, 0)) + 1e-3

    def normal_equations(batches):
        sums = np.zeros((folds, features + 1, features + 2))
        for batch in batches:
            stats, good, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(folds):
                for at in np.array_split(np.flatnonzero(fold == k), 1 + int((fold == k).sum()) // 2048):
                    z = fourier(stats[at], mean, scale, features, seed, width)
                    sums[k] += z.T @ np.c_[z, good[at]]
        for k in range(folds):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(features + 1, k, np.int32)), pa.array(np.arange(features + 1, dtype=np.int32)), _lists(sums[k])], ["fold", "line", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = _matrix(group["sums"].combine_chunks()).sum(axis=0)
        return pa.table({"fold": group["fold"][:1], "line": group["line"][:1], "sums": _lists(total[None, :])})

    lines = measured.mapInArrow(normal_equations, "fold int, line int, sums array<double>").groupBy("fold", "line").applyInArrow(add, "fold int, line int, sums array<double>")
    equations = np.zeros((folds, features + 1, features + 2))
    for r in lines.toLocalIterator():
        equations[r.fold, r.line] = r.sums

    def solve(e: np.ndarray) -> np.ndarray:
        rows = max(1.0, e[-1, -2])
        return np.linalg.solve(e[:, :-1] + ridge * rows * np.eye(features + 1), e[:, -1])

    whole = equations.sum(axis=0)
    without = [np.round(solve(whole - e) * 2**40) / 2**40 for e in equations]

    def bins(batches):
        out = np.zeros((SCORE_BINS, 2))
        for batch in batches:
            z, fold = fourier(_matrix(batch.column(0)), mean, scale, features, seed, width), batch.column(2).to_numpy()
            raw = np.einsum("ij,ij->i", z, np.stack(without)[fold])
            place = np.clip(((raw + 0.5) / 2 * SCORE_BINS).astype(int), 0, SCORE_BINS - 1)
            np.add.at(out, place, np.c_[np.ones(len(raw)), batch.column(1).to_numpy()])
        used = np.flatnonzero(out[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used, 0]), pa.array(out[used, 1])], ["bin", "n", "good"])

    found = measured.mapInArrow(bins, "bin long, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").toPandas()
    raw = (found["bin"].to_numpy() + 0.5) / SCORE_BINS * 2 - 0.5
    return QualityModel(mean, scale, solve(whole), raw, isotonic(found["n"].to_numpy(), found["good"].to_numpy()), seed, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every whole text: how likely it is marked as good, and whether that is ``threshold`` or more.

    Defined results: null and empty texts are scored as texts without words; very long texts are read whole, slice by slice;
    equal texts have equal scores; repeated rows each give a row; without any label all have score 0.5; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["doc_id", "score"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
