"""Token ids, shards, the perfect hash and length sums against the tokenizer library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stillmark.llm import lengths, token_shards
from stillmark.llm.encoder import ChunkEncoder, pieces_of
from stillmark.llm.mph import PerfectHash

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (5, "Plain words, here. And THERE."),
    (2, None),
    (9, ""),
    (1, "<|endoftext|> inside a<|startoftext|>b and <|x"),
    (4, "<|EndOfText|> a <|endoftext|><|endoftext|>. <| endoftext |> x<|startoftext|>\ty\n<|endoftext|>"),
    (7, "x" * 300 + " don't it's WE'LL 12345 ½ ß ẞ İ ǆ é é 日本語 🙂🙂 a b c\u0085d"),
    (3, "tabs\tand\r\nlines\n\n  many   spaces \x0b\x0c\x1f end"),
    (11, "Word. comma, ., ,, a.b a, é. É, µ, ª. ÿ. ĳ."),
    (12, "long text of words " * 30_000),
    (13, "q" * 5000),
]


def reference():
    t = Tokenizer.from_file(PATH)
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids, np.uint32)


def test_encoder_equals_the_library():
    ref, enc = reference(), ChunkEncoder(PATH, capacity=20)
    texts = [t for _, t in ROWS]
    for _ in range(2):
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [ref(t).tolist() for t in texts]


def test_pieces_join_to_the_text():
    for text in ("", "abc", "a bc def  gh " * 9, "x" * 50):
        assert "".join(pieces_of(text, 7)) == text


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False)
    made = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made.lookup(keys).tolist()) == list(range(n))
    assert (made.lookup(keys + (1 << 50)) == -1).all()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([4, 4]))


def expected(rows):
    ref, at, out = reference(), 0, []
    for d, t in rows:
        ids = np.r_[ref(t), np.uint32(1)].astype("<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip_through_files(spark, documents):
    manifest, folder = token_shards.write_token_shards(documents(ROWS), PATH, shards=3)
    got = [tuple(r) for r in token_shards.read_token_shards(manifest, folder).orderBy("doc_id").collect()]
    assert got == expected(sorted(ROWS, key=lambda r: r[0]))
    ref = reference()
    for d, t in ROWS:
        assert [x.tolist() for x in token_shards.lookup(manifest, folder, d)] == [[*ref(t).tolist(), 1]]
    assert token_shards.lookup(manifest, folder, 6) == []


def test_nulls_and_repeated_ids(spark, documents):
    rows = [(None, "first"), (None, None), (4, "one two"), (4, "one two"), (4, "three"), (1, "x")]
    manifest, folder = token_shards.write_token_shards(documents(rows), PATH, shards=2)
    got = token_shards.read_token_shards(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 4, 4, 4]
    assert sorted(r.ids_crc32 for r in got) == sorted(r[3] for r in expected(rows))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert len(token_shards.lookup(manifest, folder, 4)) == 3


def test_shards_grow_with_the_bytes(spark, documents):
    """A shard for every few bytes of text: as many as that asks for, beyond the session's partitions, with the same rows."""
    rows = [(i, "word " * (i % 7)) for i in range(300)] + ROWS[:4] + [(None, "x" * 90), (500, None)]
    counted, folder = token_shards.write_token_shards(documents(rows), PATH, shard_bytes=1000)
    whole, other = token_shards.write_token_shards(documents(rows), PATH, shards=1)
    assert counted.count() > 20 and whole.count() == 1
    assert counted.agg({"n_docs": "max"}).first()[0] < 40
    got, want = (sorted(map(tuple, token_shards.read_token_shards(m, f).collect()), key=lambda r: r[1]) for m, f in ((counted, folder), (whole, other)))
    assert got == want and len(got) == len(rows)


def test_empty_table(spark, documents):
    manifest, folder = token_shards.write_token_shards(documents([]), PATH)
    assert token_shards.read_token_shards(manifest, folder).collect() == []
    assert lengths.exact_lengths(documents([]), PATH).collect() == []


def test_length_sums(spark, documents):
    ref = reference()
    rows = [(i, "word " * (i % 37)) for i in range(200)] + ROWS
    n = np.array([len(ref(t)) for _, t in rows])
    sums = lengths.suffix_sums(lengths.length_histogram(documents(rows), PATH), block=8).cache()
    for r in sums.collect():
        L = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((n == L).sum(), (n >= L).sum(), n[n >= L].sum())
        assert r.truncated_total == np.minimum(n, L).sum()
        assert r.quantile == pytest.approx((n <= L).mean())
    for r in lengths.at_limits(sums, [0, 10, 36, 50, 10**6]).collect():
        assert (r.docs_over, r.truncated_total) == ((n > r.context_limit).sum(), np.minimum(n, r.context_limit).sum())
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == np.sort(n)[int(np.ceil(r.share * len(n))) - 1]
