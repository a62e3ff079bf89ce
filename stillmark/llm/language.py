"""Language ID by multilingual mixture inference over hashed character n-grams.

Each language is a distribution over n-grams. A document is a mixture of them: expectation-maximisation estimates its
proportions, and the set of languages that it is said to hold is the one of highest penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .encoder import text_slices

UNDETERMINED = "und"
# every ASCII byte that is no letter parts words; case was folded before
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed byte trigrams of the whole text's words, and how often each occurs."""
    data = b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    counts = np.bincount(bucket, minlength=1 << bits)
    grams = np.flatnonzero(counts)
    return grams, counts[grams].astype(np.float64)


@dataclass
class LanguageModel:
    """``log_p``: n-gram buckets by languages. At most ``2**bits`` rows of one float for each language."""

    languages: list[str]
    log_p: np.ndarray
    bits: int
    penalty: float
    rounds: int

    def __post_init__(self):
        self.p = np.exp(self.log_p)

    def _mix(self, p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        total, share = counts.sum(), np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(self.rounds):
            mixed = p @ share
            new = share * (p.T @ (counts / mixed)) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(counts @ np.log(p @ share))

    def proportions(self, text: str | None) -> dict[str, float]:
        """The chosen languages and their shares; none if the text has no letter."""
        if text is None or not any(map(str.isalpha, text)) or not self.languages:
            return {}
        grams, counts = gram_counts(text, self.bits)
        if not len(grams):  # letters, but none that n-grams can tell apart
            return {self.languages[0]: 1.0}
        single = counts @ self.log_p[grams]
        best = int(np.argmax(single))
        if len(self.languages) == 1:
            return {self.languages[0]: 1.0}
        cost = self.penalty * np.log(counts.sum() + 1)
        p = self.p[grams]
        chosen = np.arange(len(self.languages))
        share, fit = self._mix(p, counts)
        if fit - single[best] <= cost:  # no set can fit better than all languages together
            return {self.languages[best]: 1.0}
        while len(chosen) > 1:
            rest = np.delete(chosen, np.argmin(share))
            smaller, smaller_fit = self._mix(p[:, rest], counts) if len(rest) > 1 else (np.ones(1), float(single[rest[0]]))
            if fit - smaller_fit > cost:
                break
            chosen, share, fit = rest, smaller, smaller_fit
        if len(chosen) == 1:
            return {self.languages[best]: 1.0}
        return {self.languages[k]: float(s) for k, s in zip(chosen, share)}


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, docs_per_language: int = 2000, bits: int = 15, smoothing: float = 0.1, penalty: float = 8.0, rounds: int = 30) -> LanguageModel:
    """Learn n-gram distributions from the text and lang of rows that are not held out.

    The model is fitted on a bounded sample: of every language about ``docs_per_language`` documents (all, if it has no
    more), chosen by a hash of their doc_id. Each is read whole. Counts are summed on the executors; the driver gets one
    number for each language and bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = {r.lang: r["count"] for r in rows.where(F.col("text").isNotNull()).groupBy("lang").count().collect()}
    if not known:
        return LanguageModel([], np.zeros((1 << bits, 0)), bits, penalty, rounds)
    limit = F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, int(2**31 * min(1.0, docs_per_language / n)))])
    sample = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64(F.lit("language-sample"), "doc_id"), F.lit(1 << 31)) < limit[F.col("lang")]))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for texts in text_slices(batch.column(0)):
                for text in texts:
                    grams, counts = gram_counts(text, bits)
                    np.add.at(sums.setdefault(langs[at], np.zeros(1 << bits)), grams, counts)
                    at += 1
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["lang", "bucket", "n"])

    found = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(known)
    totals = np.full((1 << bits, len(languages)), smoothing)
    totals[found["bucket"].to_numpy(), found["lang"].map(languages.index).to_numpy(np.int64)] += found["n"].to_numpy()
    return LanguageModel(languages, np.log(totals / totals.sum(axis=0)), bits, penalty, rounds)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, proportions for every whole text. Nothing but the text is looked at.

    ``lang_pred`` is the language with the largest share and ``score`` that share.

    Defined results: ``und`` with score 0 if the text is null, has no letter, or nothing was learned; equal shares go to
    the language first in order; very long texts are read whole, one at a time; repeated
    rows each give a row; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.proportions(t) for texts in text_slices(batch.column(1)) for t in texts]
            top = [max(sorted(f), key=f.__getitem__) if f else UNDETERMINED for f in found]
            score = [min(1.0, f[t]) if f else 0.0 for f, t in zip(found, top)]
            shares = pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.string()), pa.array(score, pa.float64()), shares], ["doc_id", "lang_pred", "score", "proportions"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language can be told, all columns as they are; no shuffle, rows stay where they are.

    Nothing else is rejected: mixed and noisy documents stay. An empty table stays empty; extra columns may have any name.
    """
    shared, mark = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "lang_pred")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [shared.value.proportions(t) for texts in text_slices(batch.column(at)) for t in texts]
            yield batch.append_column(mark, pa.array([bool(f) for f in found], pa.bool_()))

    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.BooleanType())])
    return docs.mapInArrow(run, schema).where(F.col(mark)).drop(mark)
