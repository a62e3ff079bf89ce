"""Source divergence audit: how far apart the sources of a language are in their use of words, and by which words.

Sums over all pairs of sources and all kept terms are split by how many sources have a term. Every term starts as absent from
both sources of a pair. Terms that many sources have (heavy) are corrected in dense tiles, sources by terms; of the others
(light) only the postings count: a correction for each posting alone, taken from how often each share occurs in a source,
and one for each pair of postings of a term. All numbers are whole, so the partial sums add up exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .wordscan import byte_class, dense, summed, word_slices

LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NO_STOP = np.zeros(256, bool)
SCALE_STEPS = 3  # thousands: shares are parts of 1000 ** 3
POSTINGS = "lang string, source string, term binary, c long, docs long"
TILE = 64  # sources
TILE_TERMS = 1024  # terms of a dense tile
PAIRS_TOGETHER = 1 << 19


def share(count: Column, of: Column) -> Column:
    """floor(10^9 (count + 1) / of) + 1 by long division in thousands: exact in 64 bits as long as ``of`` is below 9 * 10^15."""
    whole, rest = F.call_function("div", count + 1, of), (count + 1) % of
    for _ in range(SCALE_STEPS):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, of), (rest * 1000) % of
    return whole + 1


def postings(docs: DataFrame) -> DataFrame:
    """lang, source, term, c, docs: occurrences of every term in every group and the documents with it; a group's own row
    has a null term. Tasks send sums, not occurrences."""

    def tables(batches):
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (1, 2))
            group = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)

            def rows(groups, terms, c, n, langs=langs.dictionary, sources=sources.dictionary):
                lang, source = np.divmod(groups, max(1, len(sources)))
                return pa.table({"lang": langs.take(pa.array(lang)), "source": sources.take(pa.array(source)), "term": terms.cast(pa.binary()), "c": pa.array(c), "docs": pa.array(n)})

            every = np.unique(group)
            zero = np.zeros(len(every), np.int64)
            yield rows(every, pa.nulls(len(every), pa.large_binary()), zero, zero)
            open_row, open_terms = -1, None  # what a text that goes on in the next slice has had so far
            for words in word_slices(batch.column(0), LETTERS, NO_STOP):
                form, forms = words.encoded()
                code, c = np.unique(dense([words.row, form], [batch.num_rows, len(forms)]), return_counts=True)
                row, form = np.divmod(code, len(forms))
                new = np.ones(len(row), np.int64)
                mine = forms.take(pa.array(form[row == row[-1]]))
                if row[0] == open_row:
                    head = np.flatnonzero(row == open_row)
                    new[head[pc.is_in(forms.take(pa.array(form[head])), value_set=open_terms).to_numpy(zero_copy_only=False)]] = 0
                    if row[-1] == open_row:
                        mine = pc.unique(pa.concat_arrays([open_terms, mine]))
                open_row, open_terms = row[-1], mine
                code, back = np.unique(dense([group[row], form], [int(every[-1]) + 1, len(forms)]), return_inverse=True)
                at = np.zeros(len(code), np.int64)
                at[back] = np.arange(len(back))
                count, n = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
                np.add.at(count, back, c)
                np.add.at(n, back, new)
                yield rows(group[row[at]], forms.take(pa.array(form[at])), count, n)

    def count(batches):
        yield from summed(tables(batches), ["lang", "source", "term"], ["c", "docs"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted = docs.select(*text).mapInArrow(count, POSTINGS).withColumn("term", F.col("term").cast("string"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tile_sums(rows: pa.Table) -> pa.Table:
    """Of one chunk of terms and one or two tiles of sources: what the chunk adds to the sum of each ordered pair of sources.

    Sums are of differences to the terms' absence; where a row of a source has ``terms``, that many absent ones come too.
    """
    is_group = pc.is_null(rows["term"]).to_numpy(zero_copy_only=False)
    member, post = rows.filter(pa.array(is_group)), rows.filter(pa.array(~is_group))
    idx = member["idx"].to_numpy()
    order = np.argsort(idx)
    idx, p0 = idx[order], member["p"].to_numpy()[order].astype(np.int64)
    terms = int(member["terms"][0].as_py())
    names = member["source"].take(pa.array(order)).combine_chunks()
    side, n = idx // TILE, len(idx)
    wanted = ~np.eye(n, dtype=bool) if rows["a"][0] == rows["b"][0] else side[:, None] != side[None, :]
    absent = far(p0[:, None], p0[None, :])
    total = absent * terms
    who, p = np.searchsorted(idx, post["idx"].to_numpy()), post["p"].to_numpy().astype(np.int64)
    term = np.asarray(post["term"].combine_chunks().dictionary_encode().indices).astype(np.int64) if post.num_rows else np.zeros(0, np.int64)
    heavy = post["heavy"].to_numpy(zero_copy_only=False).astype(bool) if post.num_rows else np.zeros(0, bool)

    kinds, term_h = np.unique(term[heavy], return_inverse=True)
    by_term = np.argsort(term_h, kind="stable")
    term_h, who_h, p_h = term_h[by_term], who[heavy][by_term], p[heavy][by_term]
    for low in range(0, len(kinds), TILE_TERMS):
        size = min(TILE_TERMS, len(kinds) - low)
        a, b = np.searchsorted(term_h, [low, low + size])
        dense_tile = np.repeat(p0[:, None], size, axis=1)
        dense_tile[who_h[a:b], term_h[a:b] - low] = p_h[a:b]
        for i in range(n):
            some = np.flatnonzero(wanted[i])
            total[i, some] += far(dense_tile[i][None, :], dense_tile[some]).sum(axis=1) - absent[i, some] * size

    who, p, term = who[~heavy], p[~heavy], term[~heavy]
    for i in range(n):
        shares, times = np.unique(p[who == i], return_counts=True)
        total[i] += (far(shares[:, None], p0[None, :]) * times[:, None]).sum(axis=0) - absent[i] * times.sum()
        total[:, i] += (far(p0[None, :], shares[:, None]) * times[:, None]).sum(axis=0) - absent[:, i] * times.sum()
    order = np.argsort(term, kind="stable")
    who, p, term = who[order], p[order], term[order]
    first = np.searchsorted(term, term, "left")
    size = np.searchsorted(term, term, "right") - first
    done = np.cumsum(size)
    at = 0
    while at < len(term):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_TOGETHER, "right")))
        x = np.repeat(np.arange(at, to), size[at:to])
        y = np.arange(len(x)) - np.repeat(done[at:to] - size[at:to] - (done[at - 1] if at else 0), size[at:to]) + first[x]
        some = wanted[who[x], who[y]]
        x, y = x[some], y[some]
        i, j = who[x], who[y]
        np.add.at(total, (i, j), far(p[x], p[y]) - far(p[x], p0[j]) - far(p0[i], p[y]) + absent[i, j])
        at = to
    i, j = np.nonzero(wanted)
    lang = rows["lang"].combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
    return pa.table({"lang": lang, "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": pa.array(total[i, j])})


def audit_sources(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, heavy_share: float = 0.25, terms_per_chunk: int = 2048) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to each other one of its language (part ``pair``)
    and the terms that it uses more than its language does (part ``term``, up to rank ``top_terms``).

    ``heavy_share``: a term is heavy from that share of the language's sources on; it changes the work and no result.
    ``terms_per_chunk`` terms, or about that, are one task's for each pair of tiles of sources.

    Defined results: null text, lang and source are ''; very long texts are read whole, slice by slice, and are one document
    each; repeated rows each count; equal values go by item in byte order; a group without terms has every pair; a language
    without kept terms has pairs of value 0, one of a single source none; an empty table gives no rows; other columns, whatever their names, are
    ignored. Counts are exact up to 9 * 10^15 occurrences of a language.
    """
    counted = saved(postings(docs), "divergence-postings")
    same = Window.partitionBy("lang", "term")
    spread = counted.where(F.col("term").isNotNull()).select(
        "lang", "source", "term", "c", F.sum("docs").over(same).alias("in_docs"), F.sum("c").over(same).alias("lang_c"), F.count("*").over(same).alias("spread"), F.row_number().over(same.orderBy("source")).alias("nth")
    )
    kept = saved(spread.where(F.col("in_docs") >= min_docs).drop("in_docs"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).alias("terms"), F.sum("c").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = counted.where(F.col("term").isNull()).select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    in_lang = Window.partitionBy("lang")
    groups = saved(
        groups.select(
            "lang", "source", *map(zero, ("n", "terms", "lang_n")), (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("idx"), F.count("*").over(in_lang).alias("sources")
        ),
        "divergence-groups",
    )
    known = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("n") + F.col("terms")))

    q = share(F.col("lang_c"), F.col("lang_n") + F.col("terms"))
    over = known.withColumn("q", q).where(F.col("p") > F.col("q"))
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / terms_per_chunk)).cast("long")
    none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("n") + F.col("terms"))).otherwise(F.lit(1).cast("long"))
    every_chunk = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    members = groups.where("sources > 1").withColumn("chunk", every_chunk).select(
        "lang", "chunk", "sources", "idx", "source", none.alias("p"), F.when(F.col("chunk") == 0, F.col("terms")).otherwise(0).alias("terms"), F.lit(None).cast("string").alias("term"), F.lit(False).alias("heavy")
    )
    placed = known.where("sources > 1").select(
        "lang", F.pmod(F.xxhash64("term"), chunks).alias("chunk"), "sources", "idx", F.lit(None).cast("string").alias("source"), "p", F.lit(0).cast("long").alias("terms"), "term",
        (F.col("spread") >= F.col("sources") * heavy_share).alias("heavy"),
    )
    tile = F.floor(F.col("idx") / TILE)
    dealt = members.unionByName(placed).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE))))
    dealt = dealt.select("lang", "chunk", F.least(tile, "other").alias("a"), F.greatest(tile, "other").alias("b"), "idx", "source", "p", "terms", "term", "heavy")
    sums = dealt.groupBy("lang", "chunk", "a", "b").applyInArrow(tile_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    pair_part = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pair_part.unionByName(term_part)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_c FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) s USING (lang, source)
  LEFT JOIN langs USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (lang_c + 1) // (lang_n + v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""
