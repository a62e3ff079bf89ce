"""Phrase collocation mining by Apriori: level by level, a phrase of k words is counted only where both phrases of k - 1 words
in it are frequent; the cuts of the frequent ones are then scored from the tables of all levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, saved
from .wordscan import byte_class, dense, summed, word_slices

U = np.uint64
STOPS = ".,;:!?\n\x0b\x0c\r"
STOP = byte_class(*[(ord(c), ord(c)) for c in STOPS])
WORD = ~(byte_class((32, 32), (9, 9)) | STOP)
LEVEL = "lang string, phrase binary, n long"
CHUNK = 1 << 16  # bytes of the filter that one row carries


def _next(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(h * U(0x9E3779B97F4A7C15) + word)


def _hash(data: bytes | str) -> int:
    return xxhash.xxh64_intdigest(data)


def frequent_filter(level: DataFrame, bits_each: int = 16, most_bytes: int = 1 << 24) -> np.ndarray:
    """The frequent phrases of a level as a bitmap over their hashes, for the broadcast.

    It has about ``bits_each`` bits for each phrase and ``most_bytes`` bytes at most, however many phrases there are; the
    driver gets those bytes and nothing else. A bit that is set by chance lets a phrase be counted that needn't be; its
    count is right all the same and then falls under the threshold, so a full bitmap costs time and no result.
    """
    wanted = max(1, level.count()) * bits_each
    bits = min(max(wanted - 1, CHUNK * 8 - 1).bit_length(), (most_bytes * 8).bit_length() - 1)

    def places(batches):
        for batch in batches:
            langs = {x: _hash(x) for x in pc.unique(batch.column(0)).to_pylist()}
            seed = np.array([langs[x] for x in batch.column(0).to_pylist()], U)
            words = [[_hash(w) for w in p.split(b" ")] for p in batch.column(1).to_pylist()]
            for column in np.array(words, U).reshape(len(words), -1).T:
                seed = _next(seed, column)
            place = np.unique(seed >> U(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place // (CHUNK * 8)), pa.array(place % (CHUNK * 8))], ["chunk", "bit"])

    def fill(group: pa.Table) -> pa.Table:
        marks = np.zeros(CHUNK * 8, bool)
        marks[group["bit"].to_numpy()] = True
        return pa.table({"chunk": group["chunk"][:1], "bytes": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    found = level.select("lang", F.col("phrase").cast("binary")).mapInArrow(places, "chunk long, bit long").distinct().groupBy("chunk").applyInArrow(fill, "chunk long, bytes binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.bytes, np.uint8)
    return out


def level_counts(docs: DataFrame, k: int, known: np.ndarray | None) -> DataFrame:
    """lang, phrase, n: the phrases of ``k`` words both of whose phrases of ``k - 1`` words may be frequent by the filter.

    Level 1 has every word, and for each language a row without phrase: the number of all its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def has(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
        place = h >> U(64 - (len(filter_) * 8).bit_length() + 1)
        return (filter_[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1

    def tables(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            lang_of, lang_names = np.asarray(langs.indices), langs.dictionary
            seeds = np.array([_hash(x) for x in lang_names.to_pylist()], U)
            for words in word_slices(batch.column(0), WORD, STOP, carry=k - 1):
                form, forms = words.encoded()
                lang = lang_of[words.row]
                if k == 1:
                    at = np.arange(words.carried, len(form))
                    totals = np.bincount(lang[at], minlength=len(seeds))
                    some = np.flatnonzero(totals)
                    yield _rows(lang_names.take(pa.array(some)), pa.nulls(len(some), pa.large_binary()), totals[some])
                else:
                    hashes = np.array([_hash(w) for w in forms.to_pylist()], U)[form]
                    h = _next(seeds[lang], hashes)
                    for j in range(1, k - 1):
                        h = _next(h[:-1], hashes[j:])
                    both = has(shared.value, h) if len(h) > 1 else np.zeros(len(h), bool)
                    at = np.flatnonzero(both[:-1] & both[1:])
                    at = at[(words.piece[at] == words.piece[at + k - 1]) & (at + k - 1 >= words.carried)]
                if not len(at):
                    continue
                code = dense([lang[at], *[form[at + j] for j in range(k)]], [len(seeds), *[len(forms)] * k])
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                first = at[first]
                parts = [forms.take(pa.array(form[first + j])) for j in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                yield _rows(lang_names.take(pa.array(lang[first])), phrase, n)

    def count(batches):
        yield from summed(tables(batches), ["lang", "phrase"], ["n"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = rows.mapInArrow(count, LEVEL).withColumn("phrase", F.col("phrase").cast("string"))
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"lang": lang, "phrase": phrase.cast(pa.binary()), "n": pa.array(n.astype(np.int64))})


def level_tables(docs: DataFrame, min_count: int = 100, most_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, levels): each language's number of words ``n``; lang, phrase, k, f of every phrase of 1 to ``most_words``
    words that occurs ``min_count`` times or more. Each level is written before the next one is counted.
    """
    first = saved(level_counts(docs, 1, None).where((F.col("n") >= min_count) | F.col("phrase").isNull()), "collocation-level")
    levels = [first.where(F.col("phrase").isNotNull())]
    for k in range(2, most_words + 1):
        known = frequent_filter(levels[-1])
        if not known.any():  # nothing longer can be frequent
            break
        levels.append(saved(level_counts(docs, k, known).where(F.col("n") >= min_count), "collocation-level"))
    named = [x.select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("f")) for k, x in enumerate(levels, 1)]
    every = named[0]
    for x in named[1:]:
        every = every.unionByName(x)
    return first.where(F.col("phrase").isNull()).select("lang", "n"), every


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741  the names of the result
    """floor(1000 a n / (l r)) in whole decimals; it is 1000 n at most, as a is neither above l nor above r."""
    a, n, l, r = (x.cast("decimal(17,0)") for x in (a, n, l, r))  # noqa: E741
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), l * r)


def find_collocations(docs: DataFrame, min_count: int = 100, most_words: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of every language, by the lowest score of their cuts.

    A phrase of 2 to ``most_words`` words with ``min_count`` occurrences is a candidate unless a longer candidate, with as
    many occurrences, holds it. Whatever holds it in two words more has a phrase between with as many, so one word more is
    looked at. Cutting behind word k gives l and r, the counts of both parts; ties between cuts go to the smallest k,
    between phrases to more occurrences, then to the first in byte order.

    Defined results: null and empty texts have no words; a null lang is ``und``; very long texts are read whole, slice by
    slice; repeated rows each count; a language without candidates gives no rows, an empty table none; other columns,
    whatever their names, are ignored. Counts are exact up to 10^17 words a language.
    """
    totals, levels = level_tables(docs, min_count, most_words)
    longer = levels.where("k > 1").withColumnRenamed("phrase", "longer").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    held = longer.where("k > 2").select("lang", "f", F.expr("substring_index(longer, ' ', if(side = 0, k - 1, 1 - k))").alias("phrase"))
    candidates = levels.where("k > 1").join(held, ["lang", "phrase", "f"], "left_anti")
    cuts = candidates.withColumn("cut", F.expr("explode(sequence(1, k - 1))")).select(
        "lang", "phrase", "cut", F.col("f").alias("a"), F.expr("substring_index(phrase, ' ', cut)").alias("left_part"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right_part")
    )
    left = levels.where(F.col("k") < most_words).select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = left.select("lang", F.col("left_part").alias("right_part"), F.col("l").alias("r"))
    scored = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"]).join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
levels AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
words AS (SELECT *, string_split(phrase, ' ') AS w FROM levels),
candidates AS (
  SELECT * FROM words c WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM (SELECT lang, f, array_to_string(w[1 : k - 1], ' ') AS part FROM words WHERE k > 2
                   UNION ALL SELECT lang, f, array_to_string(w[2 : k], ' ') FROM words WHERE k > 2) b
    WHERE b.lang = c.lang AND b.part = c.phrase AND b.f = c.f)),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score, cut
  FROM cuts c JOIN levels x ON x.lang = c.lang AND x.phrase = c.head JOIN levels y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
