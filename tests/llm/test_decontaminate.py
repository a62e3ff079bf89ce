"""Benchmark windows against brute force, proximity, and several blocks of items."""

import random
import re

import pytest

from stillmark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window):
    out = []
    for d, text in rows:
        w, hit, named = words(text), set(), set()
        for item_id, item in items:
            q = words(item)
            if not q or item_id is None:
                continue
            n = min(window, len(q))
            wanted = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    named.add(str(item_id))
        out.append((d, len(w), sorted(hit), sorted(named)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    vocab = ["the", "of", "Cat", "dog", "bird", "ÉTÉ", "été", "7", "x1", "tree"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(rng.randrange(1, 30))) for i in range(25)] + [(50, None), (51, "!?"), (52, "the"), (None, make(12)), (53, "the the the the the the the the the the the the")]
    rows = [(i, make(rng.randrange(0, 60))) for i in range(60)]
    rows += [(100 + i, make(10) + "; " + items[i][1].upper() + "-" + make(5)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "the " * 40), (None, items[3][1]), (100, "dog"), (203, "word " * 100_000 + items[0][1])]
    return rows, items


def found(result):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s["from"], s["to"])], list(r.item_ids)) for r in result.collect()), key=repr)


@pytest.mark.parametrize("window", [10, 3])
def test_windows(spark, documents, window):
    rows, items = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert found(decontaminate.find_contamination(documents(rows), table, window)) == brute(rows, items, window)


def test_items_in_several_blocks(spark, documents, monkeypatch):
    rows, items = corpus()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 400)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.find_contamination(documents(rows), table)) == brute(rows, items, 10)


def test_small_segments(spark, documents):
    rows, items = corpus()
    index = decontaminate.build_index(documents(rows), segment_chars=300)
    block = [(str(i), w) for i, t in items if i is not None and (w := decontaminate.words_of(t))]
    assert found(decontaminate.find_windows(index, block, 10)) == brute(rows, items, 10)


def test_proximity(spark, documents):
    rows = [(1, "red fox and a lazy dog"), (2, "dog " + "x " * 20 + "red fox"), (3, "fox dog red dog"), (4, None)]
    index = decontaminate.build_index(documents(rows))
    items = spark.createDataFrame([("q", "red fox dog")], "item_id string, text string")
    got = sorted((r.doc_id, r["from"], r["to"]) for r in decontaminate.find_near(index, items, slack=3).collect())
    assert got == [(1, 0, 6), (3, 0, 3)]


def test_empty_tables_and_dropping(spark, documents):
    items = spark.createDataFrame([(1, "some benchmark passage")], "item_id long, text string")
    assert decontaminate.find_contamination(documents([]), items).collect() == []
    docs = documents([(1, "clean"), (2, "has Some benchmark-passage in"), (None, "clean too"), (3, None)])
    assert found(decontaminate.find_contamination(docs, items.where("item_id > 5"))) == [(1, 1, [], []), (2, 5, [], []), (3, 0, [], []), (None, 2, [], [])]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert decontaminate.drop_contaminated(documents([]), items).collect() == []


def test_only_hit_rows_are_dropped(spark):
    items = spark.createDataFrame([(1, "some benchmark passage")], "item_id long, text string")
    rows = [(1, "clean", 1, "a"), (1, "has some benchmark passage", 2, "b"), (None, "some benchmark passage", 3, "c"), (None, "clean", 4, "d"), (2, None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, hit_doc_id string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.row for r in kept.collect()) == [1, 4, 5]


def test_possible_items_are_those_with_a_window_of_known_words():
    rng = random.Random(4)
    block = [(str(i), [rng.choice(b"abcdefgh").to_bytes() for _ in range(rng.randrange(1, 9))]) for i in range(80)]
    for window in (3, None):
        items = decontaminate.ItemSet(block, window)
        for _ in range(20):
            known = {rng.choice(b"abcdefghz").to_bytes() for _ in range(rng.randrange(7))}
            size = lambda w: len(w) if window is None else min(window, len(w))
            want = [b for b in block if any(set(b[1][i : i + size(b[1])]) <= known for i in range(len(b[1]) - size(b[1]) + 1))]
            assert items.possible(known) == want


def near(rows, items, slack):
    """The shortest stretch that holds all words of an item, the first of several, by trying all."""
    out = []
    for d, text in rows:
        w = words(text)
        for item_id, item in items:
            need = set(words(item))
            spans = [(b - a, a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + len(words(item)) + slack) + 1) if need <= set(w[a:b])]
            if spans:
                out.append((d, item_id, *min(spans)[1:]))
    return sorted(out, key=repr)


def test_proximity_against_all_stretches(spark, documents):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40)))) for i in range(40)]
    items = [(str(i), " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6)))) for i in range(12)]
    found = decontaminate.find_near(decontaminate.build_index(documents(rows)), spark.createDataFrame(items, "item_id string, text string"), slack=2)
    assert sorted(((r.doc_id, r.item_id, r["from"], r["to"]) for r in found.collect()), key=repr) == near(rows, items, 2)
