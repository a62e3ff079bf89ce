"""Queries against frames by blocks: a task holds a batch of frames and a bounded block of queries, and compares them in numpy.

Of each batch only the best two frames of a video leave the task, and of videos that lie wholly in it only each query's first
``k``. For long videos all pairs get an upper bound of their score in 16-bit numbers; exact scores are those of the two with
the highest bounds and of whatever bound comes up to the lesser of these. They are ``recall.score_frames``' to the last bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import similarity as S
from .pivots import Pivots, radius_of, with_cell

PAIRS, SCORED, WIDE = 1 << 18, 1 << 15, 2048  # pairs compared and scored at once, frames bounded at once
WHOLE = 14000  # all of a histogram in bounds; the layout adds as much again, and 16 bits hold both
FRAMES_A_TASK = 8192
FAR = 32767
SHOWN = ["video_id", "frame_index", "time_ms"]


def fingerprints(rows: DataFrame, struct: list[str], dhash: list[str], keys: list[str]) -> DataFrame:
    """What is compared of frames or queries; rows without a hash are near to none."""
    return rows.select(*keys, *dict.fromkeys([*dhash, *struct]), "color", "color_total", "spatial").dropna(subset=[*dhash, *struct])


def best_two(frames: DataFrame, queries: DataFrame, struct: list[str], dhash: list[str], max_dhash: int, max_struct: int, min_score: float, bits: int, k: int, parts: int, pivots: Pivots | None = None) -> DataFrame:
    """What ``recall.score_frames`` gives, less those rows that are not among the best two of their video in a task's batch.

    ``queries`` is a bounded block, which the driver sends to all tasks. Frames are range-sorted by video, or by cells of
    ``pivots``; then a query meets only the cells that it visits.
    """
    rows = fingerprints(frames, struct, dhash, SHOWN)
    by = ["video_id", "frame_index"]
    if pivots:
        rows, by = with_cell(rows, pivots), ["pivot", "ring", *by]
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    asked = fingerprints(queries, struct, dhash, ["query_id"]).toArrow()
    sent = frames.sparkSession.sparkContext.broadcast(asked)
    doubles = [T.StructField(c, T.DoubleType()) for c in ("hash_score", "color_score", "frame_score")]
    schema = T.StructType([queries.schema["query_id"], *[frames.schema[c] for c in SHOWN], T.StructField("hash_distance", T.IntegerType()), *doubles])
    arrow = to_arrow_schema(schema)
    radius = radius_of(min_score, max_struct, bits)
    while radius >= 0 and 1 - radius / bits < min_score:  # it is rounded upwards
        radius -= 1
    compare = Comparison(tuple(struct), tuple(dhash), max_dhash, radius, bits, k, pivots)

    def run(batches):
        table, q = sent.value, None
        for batch in batches:
            if batch.num_rows and table.num_rows:
                q = q or Side(table, compare)
                for row, frame, distance, scores in compare.found(q, Side(batch, compare)):
                    columns = [table.column("query_id").take(pa.array(row)).combine_chunks(), *[batch.column(batch.schema.get_field_index(c)).take(pa.array(frame)) for c in SHOWN]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array(distance), *map(pa.array, scores)], arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _column(rows, name: str) -> pa.Array:
    column = rows.column(rows.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _cells(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows by cells, sizes, whether all cells are known)."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), n.max(initial=0)), np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    known = n > 0
    known[row[pc.is_null(values).to_numpy(zero_copy_only=False)]] = False
    return out, n, known


class Side:
    """Frames or queries as arrays."""

    def __init__(self, rows, of: Comparison):
        word = lambda c: _column(rows, c).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
        self.struct, self.dhash = [word(c) for c in of.struct], [word(c) for c in of.dhash]
        self.color, _, colored = _cells(_column(rows, "color"))
        self.spatial, self.size, self.laid_out = _cells(_column(rows, "spatial"))
        self.total = np.where(colored, pc.fill_null(_column(rows, "color_total"), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        share = np.clip(self.color.max(axis=1, initial=0) / 255, 0.0, 1.0)
        self.weight = S.COLOR_WEIGHT_MIN + (S.COLOR_WEIGHT_MAX - S.COLOR_WEIGHT_MIN) * share
        self._bound()
        if "video_id" in rows.schema.names:
            self.video = pc.dictionary_encode(_column(rows, "video_id"), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.place = np.empty(len(self.video), np.int64)
            self.place[pc.sort_indices(_column(rows, "frame_index"), null_placement="at_start").to_numpy()] = np.arange(len(self.video))
            self.cell = [_column(rows, c).to_numpy() for c in ("pivot", "ring")] if of.pivots else []
        elif of.pivots:
            words = np.stack([w.view(np.int64) for w in self.struct], axis=1)
            self.away = np.concatenate([of.pivots.distances(words[i : i + 2048]).astype(np.int16) for i in range(0, len(words), 2048)])
            self.nearest = self.away.min(axis=1)


    def _bound(self):
        """``cells``: colours and layout in 16-bit shares, rounded upwards, so that the sum of two rows' lesser cells is no less
        than what they have in common; ``laid``: the layout's own sum in a color_score. Odd values have no bounds."""
        wide = max(self.spatial.shape[1], 1) * 255
        share = np.ceil(self.color * (WHOLE / np.maximum(self.total, 1))[:, None]) * (self.total > 0)[:, None]
        layout = np.ceil(self.spatial * (2 * S.SPATIAL_WEIGHT / (1 - S.SPATIAL_WEIGHT) * WHOLE / wide))
        both = np.concatenate([share, layout], axis=1).T
        self.bounded = bool(self.color.min(initial=0) >= 0 and self.spatial.min(initial=0) >= 0 and self.spatial.max(initial=0) <= 255 and both.sum(axis=0).max(initial=0) < FAR)
        self.cells = np.ascontiguousarray(both.astype(np.int16)) if self.bounded else None
        self.laid = (self.spatial.sum(axis=1) * (S.SPATIAL_WEIGHT / wide)).astype(np.float32)


@dataclass(frozen=True)
class Comparison:
    """``radius``: the largest structure distance that counts."""

    struct: tuple[str, ...]
    dhash: tuple[str, ...]
    max_dhash: int
    radius: int
    bits: int
    k: int
    pivots: Pivots | None

    def found(self, q: Side, f: Side):
        """(query, frame, distance, scores) by stretches of queries, each pair at most once."""
        n, kept = len(q.weight), []
        for rows, low, high in self.meetings(q, f, n):
            step = max(1, PAIRS // (high - low))
            for i in range(0, len(rows), step):
                pairs = self.best(f, *self.judged(q, f, *self.near(q, f, rows[i : i + step], low, high)))
                kept.append(pairs)
        if not kept:
            return
        pairs = [np.concatenate(x) for x in zip(*kept)]
        pairs = self.best(f, *pairs) if self.pivots else self.first_videos(f, *pairs)
        for i in range(0, len(pairs[0]), PAIRS):
            row, frame, distance, *scores = (x[i : i + PAIRS] for x in pairs)
            yield row, frame, distance, scores

    def meetings(self, q: Side, f: Side, n: int):
        """(queries, first frame, end) that have to be compared."""
        if not self.pivots:
            yield np.arange(n), 0, len(f.video)
            return
        pivot, ring = f.cell
        starts = np.flatnonzero(np.r_[True, (np.diff(pivot) != 0) | (np.diff(ring) != 0)])
        for low, high in zip(starts, np.r_[starts[1:], len(pivot)]):
            radius, away = self.pivots.radius, q.away[:, pivot[low]]
            at = ring[low] * (radius + 1)
            seen = (away <= q.nearest + 2 * radius) & (away >= at - radius) & (away <= at + 2 * radius)
            yield np.flatnonzero(seen), low, high

    def near(self, q: Side, f: Side, rows: np.ndarray, low: int, high: int):
        """(query, frame, distance) within both bounds that may be among the best two of their video."""
        sides = [(self.radius, q.struct, f.struct), (self.max_dhash, q.dhash, f.dhash)]
        first = min((0, 1), key=lambda s: sides[s][0] / len(sides[s][1]))
        bound, mine, theirs = sides[first]
        off = np.bitwise_count(mine[0][rows, None] ^ theirs[0][None, low:high])
        close = off <= bound
        if np.count_nonzero(close) * 8 < close.size:  # the first word tells most pairs apart
            i, j = np.nonzero(close)
            i, j = rows[i], j + low
            for bound, mine, theirs in (sides[first], sides[1 - first]):
                off = np.zeros(len(i), np.int16)
                for a, b in zip(mine, theirs):
                    off += np.bitwise_count(a[i] ^ b[j])
                within = off <= bound
                i, j = i[within], j[within]
            return i, j, self.distance(q, f, i, j)
        distance = np.zeros((len(rows), high - low), np.int16)
        for at in range(low, high, WIDE):
            end, off = min(at + WIDE, high), []
            for _, mine, theirs in sides:
                off.append(np.zeros((len(rows), end - at), np.int16))
                for a, b in zip(mine, theirs):
                    off[-1] += np.bitwise_count(a[rows, None] ^ b[None, at:end])
            off[0][(off[0] > self.radius) | (off[1] > self.max_dhash)] = FAR
            distance[:, at - low : end - low] = off[0]
        starts = np.flatnonzero(np.r_[True, np.diff(f.video[low:high]) != 0])
        close = distance < FAR
        if high - low >= 16 * len(starts) and q.bounded and f.bounded and len(q.cells) == len(f.cells):
            highest = self.highest(q, f, rows, low, high, distance)
            for a, b in zip(starts, np.r_[starts[1:], high - low]):
                if b - a > 2:
                    close[:, a:b] &= self.in_reach(q, f, rows, low + a, distance[:, a:b], highest[:, a:b])
        i, j = np.nonzero(close)
        return rows[i], j + low, distance[i, j]

    def highest(self, q: Side, f: Side, rows: np.ndarray, low: int, high: int, distance: np.ndarray) -> np.ndarray:
        """No less than the frame_score of each pair (but for float32's last bits); minus infinity for those out of bounds."""
        weight, mine = q.weight[rows].astype(np.float32)[:, None], np.ascontiguousarray(q.cells[:, rows])
        fixed, slope = 1 - weight + weight * (S.SPATIAL_WEIGHT - q.laid[rows, None]), (1 - weight) / np.float32(self.bits)
        out = np.empty(distance.shape, np.float32)
        for at in range(low, high, WIDE):
            end = min(at + WIDE, high)
            common, least = np.zeros((len(rows), end - at), np.int16), np.empty((len(rows), end - at), np.int16)
            for a, b in zip(mine, f.cells[:, at:end]):
                np.minimum(b[None, :], a[:, None], out=least)
                common += least
            color = common * np.float32((1 - S.SPATIAL_WEIGHT) / WHOLE) - f.laid[None, at:end]
            out[:, at - low : end - low] = fixed + weight * color - slope * distance[:, at - low : end - low]
        out[distance == FAR] = -np.inf
        return out

    def in_reach(self, q: Side, f: Side, rows: np.ndarray, start: int, distance: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """Which frames of one video may score as much as the lesser of the two with the highest bounds does."""
        every, floor = np.arange(len(rows)), np.full(len(rows), -np.inf)
        one = highest.argmax(axis=1)
        most = highest[every, one]
        highest[every, one] = -np.inf
        two = highest.argmax(axis=1)
        both = np.flatnonzero(highest[every, two] > -np.inf)
        highest[every, one] = most
        if len(both):
            scores = [self.judged(q, f, rows[both], start + at[both], distance[both, at[both]])[-1] for at in (one, two)]
            floor[both] = np.minimum(*scores) - 1e-5
        return highest >= floor[:, None].astype(np.float32)

    def distance(self, q: Side, f: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        off = np.zeros(len(i), np.int16)
        for a, b in zip(q.struct, f.struct):
            off += np.bitwise_count(a[i] ^ b[j])
        return off

    def judged(self, q: Side, f: Side, i: np.ndarray, j: np.ndarray, distance: np.ndarray):
        """The pairs with hash_score, color_score and frame_score."""
        color = np.empty(len(i), np.float64)
        for at in range(0, len(i), SCORED):
            part = slice(at, at + SCORED)
            color[part] = self.color_score(q, f, i[part], j[part])
        hash_score = 1 - distance.astype(np.float64) / self.bits
        return i, j, distance, hash_score, color, hash_score * (1 - q.weight[i]) + color * q.weight[i]

    def color_score(self, q: Side, f: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b, mine, theirs = q.color[i], f.color[j], q.total[i], f.total[j]
        if max(a.max(initial=0) * int(theirs.max(initial=0)), b.max(initial=0) * int(mine.max(initial=0))) * max(a.shape[1], 1) >= 2**31:
            a, b = a.astype(np.int64), b.astype(np.int64)
        wide = min(a.shape[1], b.shape[1])
        common = np.minimum(a[:, :wide] * theirs.astype(a.dtype)[:, None], b[:, :wide] * mine.astype(a.dtype)[:, None]).sum(axis=1)
        colored = (mine > 0) & (theirs > 0)
        histogram = np.where(colored, common / np.where(colored, mine * theirs, 1), 0.0)
        wide = min(q.spatial.shape[1], f.spatial.shape[1])
        off = np.abs(q.spatial[i, :wide] - f.spatial[j, :wide]).sum(axis=1)
        laid_out = q.laid_out[i] & f.laid_out[j]
        spatial = np.where(laid_out, np.maximum(0.0, 1 - off / np.where(laid_out, q.size[i] * 255, 1)), 0.0)
        return histogram * (1 - S.SPATIAL_WEIGHT) + spatial * S.SPATIAL_WEIGHT

    def best(self, f: Side, i, j, *values):
        """The two best frames of each query and video, in order, ties to the smaller frame_index."""
        order = np.lexsort((f.place[j], -values[-1], f.video[j], i))
        i, j = i[order], j[order]
        other = (np.diff(i) != 0) | (np.diff(f.video[j]) != 0)
        third = np.zeros(len(i), bool)
        third[2:] = ~other[1:] & ~other[:-1]
        return i[~third], j[~third], *[v[order][~third] for v in values]

    def first_videos(self, f: Side, i, j, *values):
        """Of the videos that lie wholly between others in this batch only the ``k`` first of each query: the others can't be
        among its first ``k`` of all."""
        if not len(i):
            return i, j, *values
        video, score = f.video[j], values[-1]
        head = np.r_[True, (np.diff(i) != 0) | (np.diff(video) != 0)]
        at = np.flatnonzero(head)
        last = np.r_[at[1:], len(i)] - 1
        blend = S.BEST_WEIGHT * score[at] + S.SECOND_WEIGHT * score[last]
        inner = (video[at] != f.video[0]) & (video[at] != f.video[-1])
        order = np.lexsort((video[at], -blend, ~inner, i[at]))
        change = np.r_[True, np.diff(i[at][order]) != 0]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
        kept = ~inner
        kept[order] |= place < self.k
        keep = np.repeat(kept, last - at + 1)
        return i[keep], j[keep], *[v[keep] for v in values]
