"""Words in slices, and collocations against a brute-force count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stillmark.llm import collocations, wordscan

COLUMNS = "doc_id long, text string, lang string, phrase int, n string, k double, longer string, score int"


def brute(rows, least, most_words=5, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, most_words + 1) for i in range(len(words) - k + 1))
    frequent = {x: f for x, f in counts.items() if f >= least}
    held = {(lang, w[a:b]) for (lang, w), f in frequent.items() for a in range(len(w)) for b in range(a + 1, len(w) + 1) if b - a < len(w) and frequent[lang, w[a:b]] <= f}
    out = []
    for lang in totals:
        found = []
        for (at, w), a in frequent.items():
            if at == lang and len(w) > 1 and (lang, w) not in held:
                score, _, l, r = min((1000 * a * totals[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k, frequent[lang, w[:k]], frequent[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
                found.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(n=150):
    rng = random.Random(4)
    words = ["New", "york", "the", "of", "über", "straße", "日本", "a", "b", "x\x00y", "\x1f", "don't", "a-b"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", " "]
    make = lambda: "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))
    rows = [(make() + (" out of the Blue sky" if i % 3 else ""), rng.choice(["en", "de", None, "und", ""])) for i in range(n)]
    return rows + [(None, "en"), ("", "fr"), (" .,", None), ("a a a a a a a a", "en"), rows[0], rows[0]]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, 1, "n", 0.5, "x", 7) for i, (t, lang) in enumerate(rows)], COLUMNS).repartition(3)
    return sorted(map(tuple, collocations.find_collocations(docs, **options).collect()))


@pytest.mark.parametrize("least, words, top", [(4, 5, 2000), (2, 3, 7), (30, 5, 2000)])
def test_against_every_phrase(spark, least, words, top):
    got = found(spark, corpus(), min_count=least, most_words=words, top=top)
    assert got == brute(corpus(), least, words, top) and got


def test_empty_tables_and_no_candidates(spark):
    assert found(spark, []) == [] == found(spark, [(None, None), ("a b c", "en")])


def test_a_very_long_text_without_stops(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefghijklm") + str(rng.randrange(3)) for _ in range(2_000_000))  # 6 MB, two slices
    assert found(spark, [(text, "en")], min_count=1200, top=50) == brute([(text, "en")], 1200, top=50)


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    """Where the bitmap is too small for its phrases, more is counted and the same is found."""
    monkeypatch.setattr(collocations, "frequent_filter", lambda level, **_: np.full(1 << 16, 255, np.uint8))
    assert found(spark, corpus(40), min_count=3) == brute(corpus(40), 3)


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 10**16 + 7, 10**17 - 1, 10**16 + 9, 3 * 10**16 + 1  # noqa: E741
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(collocations.score(df.a, df.n, df.l, df.r)).first()[0] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("most", [1, 3, 16, 50, 1000])
@pytest.mark.parametrize("carry", [0, 2, 4])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_lose_no_phrase(most, carry, kind):
    texts = [t for t, _ in corpus(25)]
    column = pa.array(["cut off", *texts, "cut off"], kind).slice(1, len(texts))
    want, got = Counter(), Counter()
    for row, text in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((row, *words[i : i + carry + 1]) for i in range(len(words) - carry))
    for s in wordscan.word_slices(column, collocations.WORD, collocations.STOP, carry, most):
        form, forms = s.encoded()
        names = [x.decode() for x in forms.to_pylist()]
        got.update((s.row[i], *[names[form[i + j]] for j in range(carry + 1)]) for i in range(len(form) - carry) if s.piece[i] == s.piece[i + carry] and i + carry >= s.carried)
    assert got == want


def test_numbers_of_rows_of_many_columns():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 1 << 30, 500) for _ in range(5)]
    columns = [np.concatenate([c, c]) for c in columns]
    code = wordscan.dense(columns, [1 << 30] * 5)
    assert (code[:500] == code[500:]).all() and len(np.unique(code)) == 500


def test_sums_in_bounded_memory():
    rng = random.Random(1)
    rows = [(rng.choice("abcdefgh"), rng.randrange(40), rng.randrange(9)) for _ in range(3000)]
    tables = [pa.table({"x": [r[0] for r in rows[i : i + 50]], "y": [r[1] for r in rows[i : i + 50]], "n": [r[2] for r in rows[i : i + 50]]}) for i in range(0, 3000, 50)]
    want, got = Counter(), Counter()
    for x, y, n in rows:
        want[x, y] += n
    for b in wordscan.summed(tables, ["x", "y"], ["n"], most_rows=120):
        for r in b.to_pylist():
            got[r["x"], r["y"]] += r["n"]
    assert got == want
