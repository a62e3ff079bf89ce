"""The divergence audit against sums over every pair of sources and every term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stillmark.llm import divergence
from stillmark.llm.wordscan import SLICE_BYTES

COLUMNS = "doc_id long, text string, lang string, source string, term int, c string, idx double, chunk string, value int, rank long"


def brute(rows, least=3, top=200):
    seen, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        seen.update((lang, w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for (at, w), n in seen.items() if at == lang and n >= least]
        v = len(kept)

        def shares(count):
            n = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (n + v) for w in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][w] - whole[w]) ** 2 // whole[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > whole[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -x, rank) for rank, (x, item) in enumerate(items, 1)]
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, 1, "c", 0.5, "x", 3, 9) for i, r in enumerate(rows)], COLUMNS).repartition(3)
    return sorted(map(tuple, divergence.audit_sources(docs, **options).collect()))


def corpus(sources, n=400, seed=1):
    rng = random.Random(seed)
    words = ["The", "of", "über", "ÉTÉ", "日本", "x1y", "don't"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    weights = [40] * 7 + [1 + i % 9 for i in range(120)]
    rows = []
    for _ in range(n):
        s = rng.randrange(sources)
        text = " ".join(rng.choices(words[s % 5 :], weights[s % 5 :], k=rng.randrange(25)))
        rows.append((text, rng.choice(["en", "de"]), f"s{s}"))
    rows += [(None, "en", "s1"), ("12 34", "en", "empty"), ("", None, None), ("the the", None, ""), ("rare", "xx", "a"), ("rare", "xx", "b"), ("alone alone", "yy", "a")]
    return rows + [rows[0]] * 3 + [("alone", "yy", "a")] * 3


@pytest.mark.parametrize("heavy_share, terms_per_chunk", [(0.25, 2048), (0, 10), (2, 7), (0.6, 40)])
def test_against_every_pair_and_term(spark, heavy_share, terms_per_chunk):
    rows = corpus(9)
    assert found(spark, rows, heavy_share=heavy_share, terms_per_chunk=terms_per_chunk) == brute(rows)


@pytest.mark.parametrize("heavy_share", [0, 0.3, 2])
def test_sources_over_several_tiles(spark, monkeypatch, heavy_share):
    rows = corpus(150, 600, 5)
    assert found(spark, rows, heavy_share=heavy_share, terms_per_chunk=60) == brute(rows)


def test_ranks_end_and_empty_tables(spark):
    rows = corpus(4)
    assert found(spark, rows, top_terms=5, min_docs=2) == brute(rows, 2, 5)
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
    assert found(spark, [(None, None, "a"), (None, None, "b")]) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_a_text_over_several_slices_is_one_document(spark):
    rng = random.Random(3)
    long = " ".join(f"q{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(int(2.3 * SLICE_BYTES / 4)))
    rows = [(long, "en", "a"), ("qaa qab", "en", "b"), ("qaa", "en", "b")]
    assert found(spark, rows) == brute(rows)


def test_shares_beyond_64_bits(spark):
    cases = [(0, 1), (0, 7), (6, 7), (10**15, 4 * 10**15 + 3), (9 * 10**15 - 1, 9 * 10**15), (123456789012345, 8 * 10**15 + 1)]
    df = spark.createDataFrame(cases, "c long, m long")
    got = df.select("c", "m", divergence.share(df.c, df.m).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.c + 1) // r.m for r in got]
    assert divergence.far(np.array([10**9]), np.array([1])).tolist() == [(10**9 - 1) ** 2]
