"""Exact token ids from a public tokenizer file, with a bounded memory of what was encoded before.

The tokenizer drops white space and never forms a token across it, so the ids of a text are the ids of its
space-separated chunks one after another. Each chunk is encoded by the library once and then remembered.
"""

from __future__ import annotations

import os

import numpy as np

LONGEST_CHUNK = 64
PIECE_CHARS = 200_000


class ChunkEncoder:
    """Texts to little-endian id bytes, for tokenizers that split at and drop white space.

    For a BPE with word ends (``</w>``) over lower-case text. ``capacity`` bounds the memory: two generations of about
    that many chunks, and as many words, are kept. Texts are taken in pieces, cut at spaces, so a very long one costs no
    more memory than its ids.
    """

    def __init__(self, path: str, capacity: int = 300_000, separator: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.separator, self.sep_id = separator, self.whole.token_to_id(separator)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain = Tokenizer.from_file(path)  # for words that need no normalising and no splitting
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._bytes(self.whole.encode(m, add_special_tokens=False).ids) for m in ".,"}
        self.words: dict[str, bytes] = {}
        self.capacity = capacity
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _encode_apart(self, chunk: str) -> bytes:
        """A chunk by itself, as the library gives it: the form of a special token in a text is that token."""
        return self._bytes(self.whole.encode_batch_fast([chunk], add_special_tokens=False)[0].ids)

    def _encode_joined(self, chunks: list[str]) -> list[bytes]:
        """Many short chunks in one call, kept apart by a special token that none of them contains."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            ids = np.array(self.whole.encode_batch_fast([self.separator.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == self.sep_id)
            starts = np.r_[0, cuts + 1]
            ends = np.r_[cuts, len(ids)]
            out += [ids[a:b].tobytes() for a, b in zip(starts, ends)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Lower-case words of plain letters in one call: each is one piece, and its last id carries the word end."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.word_end[ids]) + 1) * self.dtype.itemsize
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Remember every chunk. A Latin word, capital or not, with a full stop or comma behind it or none, is put
        together from its lower-case form and the mark."""
        known, words, plain, other = self.young, self.words, [], []
        for c in chunks:
            if c in self.old:
                known[c] = self.old[c]
            elif len(c) > LONGEST_CHUNK or "<|" in c:
                known[c] = self._encode_apart(c)
            elif max(c) < "Ā" and (c[:-1] if c[-1] in ".," else c).isalpha():
                plain.append(c)
            else:
                other.append(c)
        base = [(c[:-1] if c[-1] in ".," else c).lower() for c in plain]
        need = [w for w in set(base) if w not in words]
        words.update(zip(need, self._encode_words(need)))
        for c, w in zip(plain, base):
            known[c] = words[w] + self.marks[c[-1]] if c[-1] in ".," else words[w]
        known.update(zip(other, self._encode_joined(other)))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > self.capacity:
            self.old, self.young = self.young, {"": b""}
        if len(self.words) > self.capacity:
            self.words = {}
        split = [p.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for p in pieces]
        known = self.young
        missing = {c for chunks in split for c in chunks if c not in known}
        if missing:
            self._learn(missing)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for c in missing:
            if len(c) > LONGEST_CHUNK:
                del known[c]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The id bytes of each whole text; null counts as empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, owner, size = [], [], 0

        def settle():
            for k, ids in zip(owner, self._encode_pieces(held)):
                out[k].append(ids)

        for k, text in enumerate(texts):
            for piece in pieces_of(text or ""):
                held.append(piece)
                owner.append(k)
                size += len(piece)
                if size >= PIECE_CHARS:
                    settle()
                    held, owner, size = [], [], 0
        settle()
        return [b"".join(parts) for parts in out]


def pieces_of(text: str, chars: int = PIECE_CHARS):
    """The text in pieces of about ``chars`` characters that begin at spaces."""
    at = 0
    while len(text) - at > chars:
        to = text.find(" ", at + chars)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def text_slices(values, most_rows: int = 256, most_chars: int = 2_000_000):
    """An Arrow string column in Python lists of bounded size; at its end Arrow gives back the memory it no longer uses."""
    import pyarrow as pa

    part, size = [], 0
    for v in values:
        t = v.as_py()
        part.append(t)
        size += len(t) if t else 0
        if len(part) >= most_rows or size >= most_chars:
            yield part
            part, size = [], 0
    if part:
        yield part
    pa.default_memory_pool().release_unused()
