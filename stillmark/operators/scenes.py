"""Scene plans over cuts given as rows, for videos with any number of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

APART_S, TAIL_S = 0.5, 5.0


def shots(cuts: DataFrame, key: str, seconds: str) -> DataFrame:
    """key, a, b: shots between cuts at least half a second apart, the last one up to five seconds after the last cut.

    A key without finite cuts has one row with nulls. Whether a cut counts depends on the one kept before, so a key's
    cuts are folded in order of time; the task that reads them, sorted, holds one batch and the last edge.
    """
    kind = StructType([cuts.schema[key], StructField("a", DoubleType()), StructField("b", DoubleType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, of, edge, end = False, None, 0.0, None

        def closed() -> tuple:
            return (of, None, None) if end is None else (of, edge, end + TAIL_S)

        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or k != of:
                    if begun:
                        out.append(closed())
                    begun, of, edge, end = True, k, 0.0, None
                if t is None or not math.isfinite(t):
                    continue
                end = t
                if t - edge > APART_S:
                    out.append((k, edge, t))
                    edge = t
            yield table(out, batch.schema.field(0).type)
        if begun:
            yield table([closed()], batch.schema.field(0).type)

    def table(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (of, pa.float64(), pa.float64()))], [key, "a", "b"])

    rows = cuts.select(key, F.col(seconds).cast("double").alias("t")).repartition(F.col(key)).sortWithinPartitions(key, "t")
    return rows.mapInArrow(fold, kind)


def scene_points(cuts: DataFrame, key: str, seconds: str, interval: float) -> DataFrame:
    """key, t: each shot's midpoints of equal parts of at most ``interval`` seconds; 0 where no cut is known."""
    n = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / interval).cast("int"))
    parts = shots(cuts, key, seconds).withColumn("n", F.coalesce(n, F.lit(1)))
    parts = parts.select(key, "a", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return parts.select(key, F.coalesce(F.col("a") + (F.col("k").cast("double") + 0.5) * (F.col("b") - F.col("a")) / F.col("n"), F.lit(0.0)).alias("t"))
