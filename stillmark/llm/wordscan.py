"""Words of Arrow text columns as numpy arrays, in slices of bounded size, and sums by key in bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 marks, set in the given ranges (both ends included)."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


@dataclass
class Words:
    """The words of a slice in order. ``row``: in which row of the column; words of one ``piece`` follow one another without
    a stop. The first ``carried`` words were in the slice before as well."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    carried: int

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word's form, the distinct forms as binary)."""
        size = self.end - self.start
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        raw = self.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        forms = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        return np.asarray(forms.indices), forms.dictionary


def raw_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind a string column and where each row starts (one end more); null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_slices(column: pa.Array, word: np.ndarray, stop: np.ndarray, carry: int = 0, most: int = SLICE_BYTES, fold: bool = True) -> Iterator[Words]:
    """The words of a string column, A-Z in lower case if ``fold``. ``word`` and ``stop`` say which bytes are in words and which end a piece.

    Slices end between rows; in a row longer than ``most`` bytes behind a stop, or else between words: then the last
    ``carry`` words come again at the head of the next slice, so that no phrase of up to ``carry + 1`` words is lost.
    """
    data, offsets = raw_column(column)
    at, end, carried, reach = int(offsets[0]), int(offsets[-1]), 0, most
    while at < end:
        to, again = min(at + reach, end), False
        if to < end:
            boundary = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if boundary > at:
                to = boundary
            else:  # within one row
                stops = np.flatnonzero(stop[data[at:to]])
                if len(stops):
                    to = at + int(stops[-1]) + 1
                else:
                    gaps = np.flatnonzero(~word[data[at:to]])
                    if not len(gaps):
                        reach += most
                        continue
                    to, again = at + int(gaps[-1]) + 1, carry > 0
        found = _words(LOWER[data[at:to]] if fold else data[at:to], offsets, at, word, stop, carried)
        if again and len(found.start) <= carry:
            reach += most
            continue
        reach = most
        if len(found.start) > found.carried:
            yield found
        carried = carry if again else 0
        at = at + int(found.start[-carry]) if again else to


def _words(data: np.ndarray, offsets: np.ndarray, base: int, word: np.ndarray, stop: np.ndarray, carried: int) -> Words:
    fresh = np.zeros(len(data) + 1, bool)
    low, high = np.searchsorted(offsets, [base, base + len(data)])
    fresh[offsets[low:high] - base] = True
    fresh = fresh[:-1]
    w = word[data]
    begin, finish = w.copy(), w.copy()
    begin[1:] &= ~w[:-1] | fresh[1:]
    finish[:-1] &= ~w[1:] | fresh[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    piece = np.cumsum(stop[data] | fresh, dtype=np.int32)[start]
    row = np.searchsorted(offsets, start + base, "right") - 1
    return Words(data, start, end, row, piece, min(carried, len(start)))


def dense(parts: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row of several columns; equal rows get equal numbers. ``sizes``: above every value of a column."""
    code, size = parts[0].astype(np.int64), max(1, sizes[0])
    for x, n in zip(parts[1:], sizes[1:]):
        n = max(1, n)
        if size > (1 << 62) // n:
            kinds, code = np.unique(code, return_inverse=True)
            size = max(1, len(kinds))
        code, size = code * n + x, size * n
    return code


def summed(tables: Iterable[pa.Table], keys: list[str], sums: list[str], most_rows: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Sums by key, as far as ``most_rows`` rows of memory go: when they are full of different keys they are given out."""
    held, rows = [], 0

    def merged() -> pa.Table:
        out = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
        return out.select([*keys, *[f"{c}_sum" for c in sums]]).rename_columns([*keys, *sums])

    for t in tables:
        held.append(t)
        rows += t.num_rows
        if rows > most_rows:
            held = [merged()]
            rows = held[0].num_rows
            if rows > most_rows // 2:
                yield from held[0].to_batches(100_000)
                held, rows = [], 0
    if held:
        yield from merged().to_batches(100_000)
    pa.default_memory_pool().release_unused()
