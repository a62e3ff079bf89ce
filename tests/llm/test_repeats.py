"""Repeated substrings against a brute-force version over all windows."""

import hashlib
import random

import numpy as np
import pytest
import zstandard

from stillmark.llm import repeats

SCHEMA = "doc_id long, text string, block string, doc_ids int, spans string"


def brute(rows, length):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1 if doc_id is not None else 0):
            w = data[i : i + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[i : i + length]] < doc_id:
                gone[i : i + length] = True
        edge = np.diff(gone.astype(int), prepend=0, append=0)
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(3)
    got = repeats.find_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s["from"], s["to"]) for s in r.spans], r.kept_sha256) for r in got), key=repr)


def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "zeta", "日本", "eta", "theta\n", "io\x00ta"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passage = make(25)
    rows = [(i, make(rng.randrange(0, 30)) + (passage if i % 3 == 0 else "") + make(5)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    rows += [(200 + i, "a" * (40 + 10 * i)) for i in range(5)] + [(300, "ab" * 300), (301, "ba" * 200)]
    rows += [(400, None), (401, ""), (402, "short"), (None, passage), (100, passage), (100, passage)]
    return rows


@pytest.mark.parametrize("hot_documents", [1000, 0, 3])
@pytest.mark.parametrize("block_bytes, part_bytes", [(1500, 1 << 19), (1500, 700), (4_000_000, 1 << 19), (4_000_000, 999)])
def test_all_windows_are_found(spark, hot_documents, block_bytes, part_bytes):
    rows = corpus()
    assert found(spark, rows, hot_documents=hot_documents, block_bytes=block_bytes, part_bytes=part_bytes) == brute(rows, 50)


def test_other_length(spark):
    rows = corpus()[:40]
    assert found(spark, rows, length=24, hot_documents=2) == brute(rows, 24)


def several_sources(between):
    rng = random.Random(11)
    strings = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(96)) for _ in range(200)]
    rows = [(1, "#".join(s[:70] for s in strings)), (2, "%".join(s[27:] for s in strings))]
    return rows, "@".join(strings), "".join(rng.choice("0123456789") for _ in range(between))


@pytest.mark.parametrize("hot_documents", [10_000, 0])
def test_a_run_of_several_sources_at_both_ends_of_a_long_text(spark, hot_documents):
    rows, every, between = several_sources(600_000)
    rows.append((3, every + between + every))
    assert found(spark, rows, hot_documents=hot_documents) == brute(rows, 50)


@pytest.mark.parametrize("hot_documents", [10_000, 0])
@pytest.mark.parametrize("block_bytes", [4_000_000, 1000])
def test_a_run_of_several_sources_in_rows_that_share_an_id(spark, hot_documents, block_bytes):
    rows, every, between = several_sources(40)
    rows += [(3, every), (3, between + every), (4, every + between)]
    assert found(spark, rows, hot_documents=hot_documents, block_bytes=block_bytes) == brute(rows, 50)


@pytest.mark.parametrize("hot_documents", [10_000, 0])
def test_random_texts_over_several_parts(spark, hot_documents):
    rng = random.Random(17)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randrange(30, 140))) for _ in range(30)]
    rows = [(rng.randrange(12), "-".join(rng.choice(pool)[rng.randrange(20) :] for _ in range(rng.randrange(1, 25)))) for _ in range(50)]
    assert found(spark, rows, hot_documents=hot_documents, block_bytes=5000, part_bytes=600) == brute(rows, 50)


def test_empty_and_tiny_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")], 50)


def test_a_passage_in_every_document_and_a_long_text(spark):
    rng = random.Random(8)
    passage = " ".join(str(rng.randrange(10**9)) for _ in range(40))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(300)]
    rows.append((1000, " ".join(str(rng.randrange(10**12)) for _ in range(60_000)) + passage))  # 0.8 MB, one block
    assert found(spark, rows, hot_documents=20, block_bytes=4000, part_bytes=50_000) == brute(rows, 50)


def padded(strings, width):
    size = np.array([len(s) for s in strings])
    rows = repeats.padded_strings(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, width)
    return rows.view(np.uint8).reshape(len(strings), -1), size


def test_longest_previous_factors_against_all_pairs():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    doc = np.array([rng.randrange(40) for _ in strings])
    rows, size = padded(strings, 9)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for least in (1, 3):
        want = [max((common(s, t) for t, e in zip(strings, doc) if e < d), default=0) for s, d in zip(strings, doc)]
        assert repeats.longest_previous_factors(rows, size, doc, least).tolist() == [n if n >= least else 0 for n in want]


def test_equal_hashes_of_different_windows_stay_apart(monkeypatch):
    rows = corpus()[:30]
    monkeypatch.setattr(repeats, "window_hash", lambda data, start, length: np.zeros(len(start), np.uint64))
    data = [t.encode() for _, t in rows]
    row = {"block": 0, "doc_ids": [d for d, _ in rows], "lens": list(map(len, data)), "payload": zstandard.compress(b"".join(data))}
    block = repeats.Block(row, 50, 1 << 19)
    (runs,) = block.parts()
    keys = np.unique(runs.key >> np.uint64(64 - repeats.FILTER_BITS))
    made = repeats.Entries(runs, keys, np.ones(len(keys), bool))
    raw = np.concatenate([runs.data[a : a + n + 49] for a, n in zip(made.start, made.n)])
    bits = made.copied(repeats.answers(made.key, made.doc, made.n, raw, 50))
    first = {}
    for d, text in zip(row["doc_ids"], data):
        for i in range(len(text) - 49):
            first.setdefault(text[i : i + 50], d)
    for start, n, doc, got in zip(made.run_start, made.run_n, made.run_doc, bits):
        want = [first[block.data[start + i : start + i + 50].tobytes()] < doc for i in range(n)]
        assert [bool(int(got) >> i & 1) for i in range(n)] == want
