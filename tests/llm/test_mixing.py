"""Source mixing: targets by water filling, budgets to the word, and the mixed rows."""

import re

import pytest

from stillmark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def corpus():
    rows = [(i, " ".join(f"w{j}" for j in range(i % 23))) for i in range(300)] + [(900, None), (901, ""), (902, "one\ttwo three \n four")]
    source = {i: ["web", "book", None, "Code", "wiki"][i % 5] if i % 3 else "web" for i, _ in rows}
    return rows, source


@pytest.mark.parametrize("per_part", [7, 1000])
def test_budgets(spark, documents, per_part):
    rows, source = corpus()
    quality = spark.createDataFrame([(i, 3.0 if i % 2 else -1.0) for i in range(100)] + [(5, None)], "doc_id long, weight double")
    got = mixing.mix_sources(documents(rows, source=source), quality, rows_per_part=per_part).collect()
    size = {d: len(WORD.findall(t or "")) for d, t in rows}
    per = {}
    for d, _ in rows:
        per[source[d]] = per.get(source[d], 0) + size[d]
    want = targets(per)
    taken = {}
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], per[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.epochs * r.size <= r.taken <= min(2, r.epochs + 1) * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_part_size_does_not_change_the_choice(spark, documents):
    rows, source = corpus()
    runs = [sorted((r.doc_id, r.taken) for r in mixing.mix_sources(documents(rows, n, source=source), rows_per_part=b).collect()) for n, b in ((1, 3), (4, 50), (2, 1000))]
    assert runs[0] == runs[1] == runs[2]


def test_mixed_rows(spark, documents):
    rows, source = corpus()
    docs = documents(rows, source=source)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_corpus(docs)
    assert out.columns == docs.columns
    words, text = {}, dict(rows)
    for r in out.collect():
        assert text[r.doc_id].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {d: n for d, n in taken.items() if n}


def test_odd_tables(documents):
    assert mixing.mix_sources(documents([])).collect() == []
    got = mixing.mix_sources(documents([(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x")])).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 6
    assert all(r.target == 0 for r in mixing.mix_sources(documents([(1, None)])).collect())


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    rows = [(None, "a " * 10, "s", 1, "x"), (None, "b " * 10, "s", 2, "y"), (7, "c " * 10, "t", 3, None), (7, "d " * 10, "t", 4, None), (8, None, "t", 5, None), (9, "e", None, 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, row string")
    out = mixing.mixed_corpus(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.size] = words.get(r.size, 0) + len(r.text.split())
    plan = mixing.mix_sources(docs).collect()
    assert sorted(words.values()) == sorted(r.taken for r in plan if r.taken)
    assert mixing.mixed_corpus(docs.where("doc_id > 99")).collect() == []


def test_parts_stay_even_under_unlike_weights_and_equal_ids(spark, monkeypatch):
    n, seen = 20_000, []
    docs = spark.range(n).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "'one two' AS text", "'s' AS source")
    quality = spark.range(n).selectExpr("id AS doc_id", "if(id % 2 = 0, 2.0D, 0.05D) AS weight")
    write = mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda df, name: seen.append(out) or out if (out := write(df, name)) is not None and name == "mix-order" else out)
    mixing.mix_sources(docs, quality, rows_per_part=1000).count()
    assert seen[0].groupBy("part").count().agg({"count": "max"}).first()[0] < 3000
