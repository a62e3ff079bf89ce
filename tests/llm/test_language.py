"""Language identification: held-out accuracy, mixtures and odd texts."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from stillmark.llm import language

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(DATA))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(DATA)
    found = language.identify(docs, model).select("doc_id", "lang_pred", "score")
    held = docs.where(language.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang")
    right = [r.lang == r.lang_pred for r in held.join(found, "doc_id").collect() if r.lang_pred != "und"]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def em(model, text, chosen):
    """Shares and log-likelihood of a set of languages by plain EM over single n-grams."""
    grams, counts = language.gram_counts(text, model.bits)
    rows = [{k: math.exp(model.log_p[g][model.languages.index(k)]) for k in chosen} for g in grams]
    share = {k: 1 / len(chosen) for k in chosen}
    for _ in range(200):
        new = dict.fromkeys(chosen, 0.0)
        for p, n in zip(rows, counts):
            total = sum(share[k] * p[k] for k in chosen)
            for k in chosen:
                new[k] += n * share[k] * p[k] / total
        share = {k: x / counts.sum() for k, x in new.items()}
    return share, sum(n * math.log(sum(share[k] * p[k] for k in chosen)) for p, n in zip(rows, counts))


def test_mixtures_have_both_languages_and_their_shares(spark, model):
    docs = spark.read.parquet(DATA).where("length(text) between 600 and 4000 and lang is not null").orderBy("doc_id").collect()
    one = {}
    for d in docs:
        found = model.proportions(d.text)
        if max(found.values()) == 1.0 and d.lang in found:
            one.setdefault(d.lang, d.text)
    pairs = list(itertools.combinations(sorted(one), 2))
    assert len(pairs) >= 3
    for a, b in pairs:
        text = one[a][:600] + " " + one[b][:600]
        found = model.proportions(text)
        assert set(found) == {a, b} and sum(found.values()) == pytest.approx(1)
        want, fit = em(model, text, [a, b])
        assert all(found[k] == pytest.approx(want[k], abs=0.02) and found[k] > 0.25 for k in (a, b))
        # the set of highest penalised likelihood, by trying all
        n = language.gram_counts(text, model.bits)[1].sum()
        cost = {s: em(model, text, s)[1] - model.penalty * math.log(n + 1) * len(s) for r in (1, 2) for s in itertools.combinations(sorted(one), r)}
        assert set(max(cost, key=cost.get)) == {a, b}


def test_odd_texts(documents, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "日本語"), (5, "a"), (6, "a"), (None, "word " * 50_000)]
    got = {r.doc_id: r for r in language.identify(documents(rows), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [got[k].score for k in (1, 2, 3)] == [0.0] * 3
    assert all(got[k].lang_pred in model.languages for k in (4, 5, 6, None))
    assert got[5].lang_pred == got[6].lang_pred
    kept = language.keep_identified(documents(rows), model)
    assert kept.columns == documents([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "None"]


def test_nothing_to_learn_from(documents):
    empty = language.train(documents([]))
    assert [r.lang_pred for r in language.identify(documents([(1, "words")]), empty).collect()] == ["und"]
    assert language.identify(documents([]), empty).collect() == []


def test_held_out_rows_are_not_learned(spark, documents):
    ids = [r.id for r in spark.range(40).where(language.is_held_out(F.col("id"))).collect()]
    learned = language.train(documents([(i, "some text") for i in range(40)], lang={i: "held" if i in ids else "seen" for i in range(40)}))
    assert learned.languages == ["seen"]
