"""SimHash components against all pairs, and the vantage-point tree against a scan."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from stillmark.llm import simhash
from stillmark.llm.components import LocalUnion


def fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, distance=4):
    prints = [fp(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    smallest = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in label}
    return sorted(((r[0], f"{p:016x}", smallest[x]) for r, p, x in zip(rows, prints, label)), key=repr)


def corpus():
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") * 2 + str(rng.randrange(50)) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
        rows.append((1000 - i, " ".join(w)))
    return rows + [(1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "É é"), (None, rows[0][1]), (7, "a b c d e"), (1, "a b c d e")]


def got(result):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in result.collect()), key=repr)


@pytest.mark.parametrize("leaf_weight", [8192, 5])
def test_components(documents, leaf_weight):
    rows = corpus()
    assert got(simhash.near_duplicates(documents(rows), leaf_weight=leaf_weight)) == components(rows)


def pairs(fps, distance=4):
    return {(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= distance}


def balls(seed, n=400):
    """Fingerprints in clusters whose members differ by a few bits, some of them all in one band's value."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    centres[6:] = (centres[6:] & ~np.uint64(0xFFFF)) | np.uint64(0x1234)
    out = []
    for _ in range(n):
        x = int(rng.choice(centres))
        for b in rng.choice(64, rng.integers(0, 8), replace=False).tolist():
            x ^= 1 << b
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_links_of_a_shard_are_those_of_all_pairs():
    for seed in range(3):
        fps = balls(seed)
        want = LocalUnion(len(fps))
        a, b = zip(*pairs(fps))
        want.link(np.array(a), np.array(b))
        found, root = simhash.link_in_shard(np.ones(len(fps), bool), fps, 4, leaf_rows=8, most=500)
        at = {int(x): i for i, x in enumerate(fps)}
        union = LocalUnion(len(fps))
        union.link(np.array([at[int(x)] for x in found], int), np.array([at[int(x)] for x in root], int))
        assert (union.roots() == want.roots()).all()


def test_every_pair_meets_in_a_shard():
    fps = balls(5, 800)
    together = set()
    for band in range(4):
        mask = np.uint64(0xFFFF << 16 * band)
        values, counts = np.unique(fps & mask, return_counts=True)
        tree = simhash.VantageTree(values, counts, int(mask), 1, 4, 20, fps[::2])
        home = tree.home(fps)
        rows, leaves = tree.reached(fps)
        visits = {(i, leaf) for i, leaf in zip(rows.tolist(), leaves.tolist()) if leaf >= home[i]}
        together |= {(i, j) for i, j in pairs(fps) if (i, int(home[j])) in visits or (j, int(home[i])) in visits}
        if band == 0:  # one value holds half of them and is divided by all bits
            assert counts.max() > 100 and np.bincount(home).max() < 60
    assert together == pairs(fps)


@pytest.mark.parametrize("leaf_weight", [8192, 20])
def test_classes_with_a_heavy_band_value(spark, leaf_weight):
    fps = balls(7, 600)
    prints = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = simhash.linked_classes(prints, leaf_weight=leaf_weight, sample_rows=200).collect()
    union, at = LocalUnion(len(fps)), {int(x): i for i, x in enumerate(fps.view(np.int64))}
    a, b = zip(*pairs(fps))
    union.link(np.array(a), np.array(b))
    groups = {}
    for r in rows:
        groups.setdefault(r.root, set()).add(int(union.roots()[at[r.class_fp]]))
    assert len(rows) == len(fps) and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(union.roots().tolist()))


def test_empty_tables(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.keep_one(documents([])).collect() == []


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    rows.append((1, rows[5][1]))  # the doc_id of other texts
    docs = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, fp int, gone_row string").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [fp(t) for _, t in rows]
    union = LocalUnion(len(rows))
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    union.link(*map(np.array, zip(*linked)))
    root = union.roots().tolist()
    got = [r.fp for r in kept.collect()]
    assert sorted(root[i] for i in got) == sorted(set(root))
    for i in got:
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        assert rows[i][0] == min(ids, default=None)


def test_a_very_long_text(documents):
    text = " ".join(f"w{i % 9973}" for i in range(300_000))
    assert {r.component_id for r in simhash.near_duplicates(documents([(4, text), (2, text + " end"), (9, "other words stand here alone")])).collect()} == {2, 9}
