"""Corpus queries against SQL, and the pipeline against what its stages must keep."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from stillmark.llm import queries
from stillmark.llm.common import table
from tests.test_queries import DATA, duck, same_rows  # noqa: F401  duck is a fixture

from .test_decontaminate import brute, words
from .test_mixing import WORD, targets
from .test_simhash import components
from .test_tokens import reference


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    same_rows(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline(spark):
    source = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    docs, kept = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, DATA), name)
        assert docs.columns == table(spark, DATA, "documents").columns
        kept[name] = docs.collect()
    letters = {d for d, r in source.items() if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in kept["language_id"]} == letters
    firsts = {d for d, _, c in components([(d, source[d].text) for d in letters]) if d == c}
    assert {r.doc_id for r in kept["near_dedup"]} == firsts
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    clean = {d for d, _, hit, _ in brute([(d, source[d].text) for d in firsts], items, 10) if not hit}
    assert {r.doc_id for r in kept["decontamination"]} == clean and clean
    sizes, taken = {}, {}
    for d in clean:
        sizes[source[d].source] = sizes.get(source[d].source, 0) + len(WORD.findall(source[d].text))
    for r in kept["mixing"]:
        assert source[r.doc_id].text.startswith(r.text)
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    want = targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 0.5 for s in want)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).orderBy("start").collect()
    ref = reference()
    crc = lambda t: zlib.crc32(np.r_[ref(t), np.uint32(1)].astype("<u4").tobytes())
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == sorted((r.doc_id, crc(r.text)) for r in kept["mixing"])
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    assert words("A-b") == ["a", "b"]
