"""Chat perspectives and licence digests on small tables."""

import os
import random

import duckdb
import pytest

from stillmark.llm import chat, licenses


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "a<|im_end|>")]
    got = {r.participant: r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got.keys() == {"ann", "bob"} and all(r.n_messages == 4 for r in got.values())
    ann = got["ann"]
    assert ann.rendered == "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\na< |im_end|><|im_end|>\n"
    assert [ann.rendered[s["from"] : s["to"]] for s in ann.mask_spans] == ["Hi<|im_end|>", "a< |im_end|><|im_end|>"]
    assert [got["bob"].rendered[s["from"] : s["to"]] for s in got["bob"].mask_spans] == ["<|im_end|>"]


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, piece string, messages int, part int, number long"
    rows = [(None, None, None, None), (None, 1, "z", "a"), (2, 1, "system", "alone"), (3, 70, "p", "late"), (3, 1, "q", ""), (3, 1, "p", "tie"), (4, None, "a", "ok"), (4, None, "a", "ok"), (4, None, "b", "ok")]
    talk = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema).repartition(3)
    got = {(r.conv_id, r.participant): r for r in chat.rotate_perspectives(talk).collect()}
    assert {k: r.n_messages for k, r in got.items()} == {(3, "p"): 3, (3, "q"): 3, (None, "z"): 2, (4, "a"): 3, (4, "b"): 3}
    assert all(r.piece == 0 for r in got.values()) and len(got[4, "a"].mask_spans) == 2
    assert chat.rotate_perspectives(spark.createDataFrame([], schema)).collect() == []


def dialogue(messages, participant):
    """The whole rendering and what is masked in, by hand."""
    rendered, masked = "", []
    for _, role, text in sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or "", m[2] or "")):
        name = "assistant" if role == participant else "user" if role is None else role if role == "system" else f"user name={role}"
        body = (text or "").replace("<|", "< |") + "<|im_end|>"
        masked += [body] if role == participant else []
        rendered += f"<|im_start|>{name}\n{body}\n"
    return rendered, masked


@pytest.mark.parametrize("piece_chars, part_chars", [(4_000_000, 64_000_000), (300, 64_000_000), (300, 20_000), (1, 64_000_000)])
def test_whole_dialogues_with_repeats_and_long_texts(spark, piece_chars, part_chars):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(90)]), rng.choice([None, "system", "ann", "bob", "eve"]), rng.choice(["ok", "yes", None, "<|x", "日本", str(rng.random())])) for c in (1, 2, None) for _ in range(150)]
    rows += [(2, 5, "ann", "long " * 100_000)] + [(9, 1, "ann", "ok")] * 40
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got, pieces = {}, 0
    for r in chat.rotate_perspectives(talk, piece_chars=piece_chars, part_chars=part_chars).orderBy("piece").collect():
        text, spans = got.get((r.conv_id, r.participant), ("", []))
        got[r.conv_id, r.participant] = text + r.rendered, spans + [(s["from"], s["to"]) for s in r.mask_spans]
        pieces += 1
        assert len(r.rendered) <= 3 * piece_chars + 600_000 and (piece_chars > 1 or r.n_messages == 1)
    masked = {k: (text, [text[a:b] for a, b in spans]) for k, (text, spans) in got.items()}
    want = {(c, p): dialogue([m[1:] for m in rows if m[0] == c], p) for c in (1, 2, None) for p in ("ann", "bob", "eve")} | {(9, "ann"): dialogue([r[1:] for r in rows[-40:]], "ann")}
    assert masked == want and (pieces == len(want)) == (piece_chars > 1000)


def test_licences_are_found_in_any_dress(documents):
    mit = licenses.KNOWN_LICENSES["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.upper()),
        (2, mit.replace(" ", "\n\n").replace('"', "“")),
        (3, mit.replace('"', "'").replace(",", " ;")),
        (4, mit + " and more"),
        (5, None),
        (6, ""),
        (7, "Licenced under CC BY-NC 4.0"),
        (7, "LICENSED, under cc by nc 4.0"),
        (8, "word " * 100_000),
    ]
    got = sorted((r.doc_id, r.license_id, r.is_license) for r in licenses.scan_licenses(documents(rows)).collect())
    note = "CC-BY-NC-4.0 (notice)"
    assert got == [(1, "MIT", True), (2, "MIT", True), (3, "MIT", True), (4, None, False), (5, None, False), (6, None, False), (7, note, True), (7, note, True), (8, None, False)]
    assert licenses.scan_licenses(documents([])).collect() == []


def test_headings_of_published_licences(spark, documents):
    known = licenses.KNOWN_LICENSES
    cases = [("BSD 3-Clause License", "BSD-3-Clause"), ("The BSD 2-Clause License", "BSD-2-Clause"), ("ISC License", "ISC"), ("zlib License", "Zlib"), ("The MIT License (MIT)", "MIT"), ("BSD Zero Clause License", "0BSD"), ("The Unlicense", "Unlicense")]
    rows = [(k, f"{title.upper()}\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n{known[name]}") for k, (title, name) in enumerate(cases)]
    rows.append((100, "Another License\n\n" + known["ISC"]))
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(documents(rows)).collect()}
    assert got.pop(100) is None and [got[k].split(" (titled: ")[0] for k in range(len(cases))] == [name for _, name in cases]
    digests = licenses.known_digests(spark)
    assert digests.count() == digests.select("license_digest").distinct().count()


def test_wrapping_makes_no_licence_and_loses_none(spark, documents):
    import textwrap

    mit = licenses.KNOWN_LICENSES["MIT"]
    whole = {name: text for name, text in licenses.KNOWN_LICENSES.items() if "(" not in name}
    wrapped = [(name, "\n".join(textwrap.wrap(text, width))) for name, text in whole.items() for width in (*range(40, 121, 8), 72, 78, 100_000)]
    assert any(line.startswith("copyright notice and this permission") for _, text in wrapped for line in text.split("\n"))
    notices = ["Copyright (c) 2020 A", "COPYRIGHT: A", "\tCopyright 1999-2001 A. All rights reserved.", "Copyright \u00a9 A", "\u00a9 A", "(c) 2020 A", "(C) Copyright 2020 A", "All rights reserved.\r"]
    rows = [
        *((1000 + k, text) for k, (_, text) in enumerate(wrapped)),
        *((100 + k, f"{notice}\n{mit}") for k, notice in enumerate(notices)),
        (200, mit.replace("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR\n", "")),
        (201, "(c) you must retain all notices\n" + mit),
        (202, "All rights reserved by nobody\n" + mit),
        (203, "Copyright holders may do more\n" + mit),
        (300, mit.replace(" ", "\n\n").replace('"', "\u201c")),
    ]
    docs = documents(rows)
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    duck = duckdb.connect()
    duck.register("documents", docs.select("doc_id", "text").toPandas())
    assert sorted(duck.execute(licenses.oracle_sql()).fetchall()) == sorted((r.doc_id, r.digest, r.license_id, r.is_license) for r in licenses.scan_licenses(docs).collect())
    assert got == {1000 + k: name for k, (name, _) in enumerate(wrapped)} | {100 + k: "MIT" for k in range(len(notices))} | {200: None, 201: None, 202: None, 203: None, 300: "MIT"}


def test_known_licences_from_a_table(spark, documents):
    known = licenses.known_digests(spark, spark.createDataFrame([("own", "You may\ncopyright nothing here.")], "license_id string, license_text string"))
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(documents([(1, "You may copyright nothing here"), (2, "You may")]), known).collect()}
    assert got == {1: "own", 2: None}


def test_main_paths_stay_in_the_engine(spark, documents, capsys):
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for made in (chat.rotate_perspectives(talk), licenses.scan_licenses(documents([]))):
        made.explain()
        plan = capsys.readouterr().out
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equal_spellings_side_by_side(spark, documents):
    import duckdb

    docs = documents([(1, "A licence, licence: licence"), (2, "a license license license"), (3, "https://https noncommercial noncommercial whilst"), (4, "http http non commercial non-commercial while"), (5, "licence")])
    got = {r.doc_id: r.digest for r in licenses.scan_licenses(docs).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3
    duck = duckdb.connect()
    duck.register("documents", docs.select("doc_id", "text").toPandas())
    assert got == {i: d for i, d in duck.sql(f"SELECT doc_id, digest FROM ({licenses.oracle_sql()})").fetchall()}


def test_long_licences_by_their_digests(documents):
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [(f, name) for f, name in files.items() if os.path.exists(f"{folder}/{f}")]
    if not there:
        pytest.skip("no system licences")
    texts = [open(f"{folder}/{f}").read() for f, _ in there]
    rows = [(k, " ".join(t.split()) if name == "CC0-1.0" else t.replace("\n", "\n\t")) for k, (t, (_, name)) in enumerate(zip(texts, there))]
    rows += [(100 + k, t + " more") for k, t in enumerate(texts)]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(documents(rows)).collect()}
    assert got == {k: name for k, (_, name) in enumerate(there)} | {100 + k: None for k in range(len(texts))}
