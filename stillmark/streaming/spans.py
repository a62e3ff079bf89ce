"""Neighbours in time within a key, found in two levels, so that no key is ever one task's.

Entries are put in spans of time. A window over (key, span) settles all that has both neighbours in its span; what lies at a
span's borders, two rows for each span at most, is settled by a second window over the key. So a task holds one span of a key,
or a key's borders, whose number grows with the time covered and not with the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def free_names(taken: list[str], names: list[str]) -> list[str]:
    """``names``, each with underscores behind it while a column has that name (names compare in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def span_for(gap_ms: int) -> int:
    """The length of spans where none is given: long against the gap, so that few entries are at borders."""
    return max(16 * gap_ms, HOUR_MS)


def span_of(time_ms: Column, span_ms: int) -> Column:
    """The beginning of the span that a time lies in."""
    return time_ms - F.pmod(time_ms, F.lit(span_ms))


def bursts(rows: DataFrame, keys: list[str], time_ms: str, gap_ms: int, span_ms: int | None = None) -> DataFrame:
    """Runs of entries less than ``gap_ms`` apart: keys, first_ms, last_ms, n.

    An entry ``gap_ms`` or more after the one before begins a run. Null keys are a key like others; every entry without a
    time is a run of its own; an empty table gives no rows. ``span_ms`` changes the work and no result.
    """
    fresh, place = free_names(keys, ["fresh", "place"])
    found = pieces(rows, keys, time_ms, gap_ms, span_ms or span_for(gap_ms))
    along = Window.partitionBy(*keys, "inner").orderBy("first_ms", "last_ms")  # inner runs are alone there
    found = found.withColumn(fresh, _begins(F.col("first_ms"), F.lag("last_ms").over(along), gap_ms))
    found = found.withColumn(place, F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = found.groupBy(*keys, "inner", place).agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("n").alias("n"))
    return joined.select(*keys, "first_ms", "last_ms", "n")


def pieces(rows: DataFrame, keys: list[str], time_ms: str, gap_ms: int, span_ms: int) -> DataFrame:
    """Runs within spans: keys, first_ms, last_ms, n and inner, which names a run and is null for a span's first and last."""
    span, fresh, place, most, at = free_names(keys, ["span", "fresh", "place", "most", "at"])
    found = rows.select(*keys, F.col(time_ms).cast("long").alias(at))
    found = found.withColumn(span, span_of(F.col(at), span_ms))
    whole = Window.partitionBy(*keys, span)
    order = whole.orderBy(at)
    marked = found.withColumn(fresh, _begins(F.col(at), F.lag(at).over(order), gap_ms))
    marked = marked.withColumn(place, F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(most, F.sum(fresh).over(whole))
    runs = marked.groupBy(*keys, span, place, most).agg(F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), F.count("*").alias("n"))
    return runs.select(*keys, "first_ms", "last_ms", "n", F.when((F.col(place) > 1) & (F.col(place) < F.col(most)), F.struct(span, place)).alias("inner"))


def _begins(first: Column, before: Column, gap_ms: int) -> Column:
    return F.coalesce(first - before >= gap_ms, F.lit(True)).cast("int")


def with_next(rows: DataFrame, key: str, time_ms: str, ties: list[str], span_ms: int, into: str) -> DataFrame:
    """``rows`` with ``into``: the time of the key's following entry in order of time and ``ties``, null for its last one.

    Entries without a time come first in their key. ``span_ms`` changes the work and no result.
    """
    span, last, first = free_names([*rows.columns, into], ["span", "last", "first"])
    found = rows.withColumn(span, span_of(F.col(time_ms).cast("long"), span_ms))
    whole = Window.partitionBy(key, span)
    order = whole.orderBy(time_ms, *ties)
    found = found.withColumn(into, F.lead(time_ms).over(order)).withColumn(last, F.lead(F.lit(1)).over(order).isNull()).withColumn(first, F.min(time_ms).over(whole))
    ends = found.where(F.col(last)).withColumn(into, F.lead(first).over(Window.partitionBy(key).orderBy(span)))
    return found.where(~F.col(last)).unionByName(ends).drop(span, last, first)
