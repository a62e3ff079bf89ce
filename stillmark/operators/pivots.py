"""Exact pruning of similarity joins by pivots and the triangle inequality of bit distances.

Every frame belongs to the cell of its nearest pivot, in the ring of its distance to it. A query that looks for frames within
``radius`` bits visits a cell only if its pivot is no more than twice the radius farther than the query's nearest one, and in
it the rings that are within the radius of its own distance. So pairs meet by an equal (pivot, ring), and none that counts
is lost: a frame is in one ring of one cell, which is among those that each query within the radius visits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SAMPLE, MOST_PIVOTS = 4096, 512


@dataclass(frozen=True)
class Pivots:
    """``words``: a row of 64-bit words for each pivot, at most ``MOST_PIVOTS``. ``share``: of the sample's pairs, those that
    still meet."""

    struct: tuple[str, ...]
    words: np.ndarray
    radius: int
    share: float

    def distances(self, words: np.ndarray) -> np.ndarray:
        """Rows by pivots."""
        out = np.zeros((len(words), len(self.words)), np.int64)
        for i in range(self.words.shape[1]):
            out += np.bitwise_count((words[:, i, None] ^ self.words[None, :, i]).view(np.uint64))  # of signed numbers it would count the absolute value's
        return out

    def home(self, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, ring) of frames."""
        nearest = distance.argmin(axis=1)
        return nearest, distance[np.arange(len(distance)), nearest] // (self.radius + 1)

    def visits(self, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, ring) of what queries visit, each once."""
        width = self.radius + 1
        row, pivot = np.nonzero(distance <= distance.min(axis=1, keepdims=True) + 2 * self.radius)
        d = distance[row, pivot]
        low, high = np.maximum(d - self.radius, 0) // width, (d + self.radius) // width
        n = high - low + 1
        again = np.repeat(np.arange(len(row)), n)
        return row[again], pivot[again], low[again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)


def radius_of(min_score: float, max_struct: int, bits: int) -> int:
    """The largest structure distance that a pair may have: the score's bound where that is tighter than the prune."""
    return min(max_struct, int((1 - min_score) * bits + 1e-6))


def choose(frames: DataFrame, struct: list[str], radius: int, most: int = MOST_PIVOTS) -> Pivots:
    """Pivots from a bounded sample: the distinct fingerprints of the ``SAMPLE`` frames with the smallest hashes; about the
    square root of the number of frames of them, ``most`` at most. What the sample is changes the work and no result.
    """
    order = [F.xxhash64(*struct, "video_id", "frame_index"), F.col("video_id"), F.col("frame_index")]
    rows = frames.orderBy(*order).limit(SAMPLE).select(*struct).collect()
    sample = np.array([list(r) for r in rows], np.int64).reshape(-1, len(struct))
    _, first = np.unique(sample, axis=0, return_index=True)
    words = sample[np.sort(first)[: max(1, min(most, int(frames.count() ** 0.5)))]]
    made = Pivots(tuple(struct), words, radius, 1.0)
    if not len(sample):
        return made
    distance = made.distances(sample)
    cells: dict[tuple[int, int], int] = {}
    for cell in zip(*(x.tolist() for x in made.home(distance))):
        cells[cell] = cells.get(cell, 0) + 1
    met = sum(cells.get(cell, 0) for cell in zip(*(x.tolist() for x in made.visits(distance[:512])[1:])))
    return Pivots(tuple(struct), words, radius, met / (len(sample) * min(512, len(sample))))


def with_cell(frames: DataFrame, pivots: Pivots) -> DataFrame:
    """Frames with ``pivot`` and ``ring``."""
    return _mapped(frames, pivots, lambda d: (np.arange(len(d)), *pivots.home(d)))


def with_visits(queries: DataFrame, pivots: Pivots) -> DataFrame:
    """Queries, a row for each (``pivot``, ``ring``) that they visit."""
    return _mapped(queries, pivots, pivots.visits)


def _mapped(rows: DataFrame, pivots: Pivots, places) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("pivot", T.LongType()), T.StructField("ring", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):  # times the pivots, so distances stay small
                part = batch.slice(at, 2048)
                words = np.stack([part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in pivots.struct], axis=1)
                row, pivot, ring = places(pivots.distances(words))
                for some in (slice(i, i + 4096) for i in range(0, len(row), 4096)):  # a query may visit hundreds of cells
                    columns = [*part.take(pa.array(row[some])).columns, pa.array(pivot[some].astype(np.int64)), pa.array(ring[some].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def pairs_compared(frames: DataFrame, queries: DataFrame, pivots: Pivots) -> tuple[int, int]:
    """(pairs that meet in cells, all pairs)."""
    cell = ["pivot", "ring"]
    n = with_cell(frames, pivots).groupBy(*cell).count().join(with_visits(queries, pivots).groupBy(*cell).agg(F.count("*").alias("asked")), cell)
    return n.agg(F.coalesce(F.sum(F.col("count") * F.col("asked")), F.lit(0))).first()[0], frames.count() * queries.count()
