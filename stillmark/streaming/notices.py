"""Repeated messages: notices that refresh within a window, and log entries that are held back and counted."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import spans

NOTICE_WINDOW_MS, REPEAT_WINDOW_MS, FORGET_MS, MAX_NOTICES = 2000, 30_000, 3_600_000, 4
TTL_MS = {"info": 5000, "warn": 8000, "error": 12000}


def notices(events: DataFrame, keys: list[str], time_ms: str, window_ms: int = NOTICE_WINDOW_MS, span_ms: int | None = None) -> DataFrame:
    """Equal messages less than ``window_ms`` after the one before are one notice: keys, first_ms, last_ms, n. Spans as in
    ``spans.bursts``."""
    return spans.bursts(events, keys, time_ms, window_ms, span_ms)


def shown(found: DataFrame, at_ms: int) -> DataFrame:
    """The notices on show at a time: not past their level's life, the newest four (of equally new ones those
    that began later, then by level and message)."""
    ttl = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in TTL_MS.items()], F.lit(TTL_MS["info"]))
    return found.where((F.col("first_ms") <= at_ms) & (F.col("last_ms") + ttl > at_ms)).orderBy(F.desc("last_ms"), F.desc("first_ms"), "level", "message").limit(MAX_NOTICES)


class NoticeStack:
    """What one viewer has on show, newest first: ``MAX_NOTICES`` at most, whatever has been pushed.

    An equal notice less than ``window_ms`` old is refreshed and comes to the front; any other push takes a place, and the
    last one beyond the limit goes. One that was pushed out or has lived its time is not there to be refreshed.
    """

    def __init__(self, entries: list[list], window_ms: int):
        self.entries, self.window_ms = entries, window_ms

    def expire(self, now: int) -> list[tuple]:
        """(entry..., end) of those whose time is over."""
        over = [e for e in self.entries if self.end(e) <= now]
        self.entries = [e for e in self.entries if self.end(e) > now]
        return [(*e, self.end(e)) for e in over]

    def push(self, level: str, message: str, now: int) -> list[tuple]:
        ended = self.expire(now)
        same = next((e for e in self.entries if e[:2] == [level, message] and now - e[3] < self.window_ms), None)
        if same:
            self.entries = [[level, message, same[2], now, same[4] + 1], *[e for e in self.entries if e is not same]]
            return ended
        ended += [(*e, now) for e in self.entries[MAX_NOTICES - 1 :]]
        self.entries = [[level, message, now, now, 1], *self.entries[: MAX_NOTICES - 1]]
        return ended

    @staticmethod
    def end(entry: list) -> int:
        return entry[3] + TTL_MS.get(entry[0], TTL_MS["info"])


def _log_schema(key: T.StructField) -> T.StructType:
    return T.StructType([key, *T.StructType.fromDDL("level string, message string, first_ms long, last_ms long, n long, ended_ms long").fields])


def notice_log(events: DataFrame, viewer: str, window_ms: int = NOTICE_WINDOW_MS) -> DataFrame:
    """viewer, level, message, first_ms, last_ms, n, ended_ms: every notice that was on show, from events (viewer, level,
    message, at_ms), in order of time, level and message. A task holds one viewer's stack and a batch of entries at a time.

    Null times are left out; a null level lives as ``info`` does.
    """
    schema = _log_schema(events.schema[viewer])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stack = None, NoticeStack([], window_ms)

        def told(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.string(), pa.string(), *[pa.int64()] * 4])], schema.names)

        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for key, level, message, at in zip(*(c.to_pylist() for c in batch.columns)):
                if key != of:
                    out += [(of, *e, stack.end(e)) for e in stack.entries]
                    of, stack = key, NoticeStack([], window_ms)
                out += [(of, *e) for e in stack.push(level, message, at)]
            yield told(out)
        if stack.entries:
            yield told([(of, *e, stack.end(e)) for e in stack.entries])

    rows = events.select(viewer, "level", "message", F.col("at_ms").cast("long").alias("at_ms")).where("at_ms is not null")
    return rows.repartition(F.col(viewer)).sortWithinPartitions(viewer, "at_ms", "level", "message").mapInArrow(fold, schema)


def notice_log_stream(events: DataFrame, viewer: str, window_ms: int = NOTICE_WINDOW_MS, delay: str = "10 seconds") -> DataFrame:
    """The same on a stream, by event time: a notice comes out when it ends. A viewer without notices leaves no state.

    A viewer's entries count in the order of micro-batches, and of time within one; those ``delay`` or more behind the newest
    of earlier micro-batches are left out.
    """
    schema = _log_schema(events.schema[viewer])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        stack = NoticeStack(json.loads(state.get[0]) if state.exists else [], window_ms)
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at_ms", "level", "message"], kind="stable")
            for level, message, at in zip(rows["level"], rows["message"], rows["at_ms"].tolist()):
                out += stack.push(level, message, at)
        out += stack.expire(now)
        if stack.entries:
            state.update((json.dumps(stack.entries),))
            state.setTimeoutTimestamp(min(map(stack.end, stack.entries)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *e) for e in out], columns=schema.names)

    timed = events.where("at_ms is not null").withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    return timed.groupBy(viewer).applyInPandasWithState(step, schema, "stack string", "append", GroupStateTimeout.EventTimeTimeout)


def emitted(events: DataFrame, key: str, time_ms: str, window_ms: int = REPEAT_WINDOW_MS, forget_ms: int | None = None, span_ms: int | None = None) -> DataFrame:
    """key, at_ms, suppressed: entries that come through, with how many were held back since the one before.

    An entry is held back if less than ``window_ms`` passed since the last that came through. With ``forget_ms``, the number
    is dropped once that long has passed. Which entries come through depends on the one before, so spans of time are
    first summed up: for each place where a span may be entered, the last entry that then comes through in it. One walk over
    a key's summaries tells where each span is entered, and the spans are folded by themselves. A task holds the distinct
    times of one span of a key; ``span_ms`` (64 times the window if not given) changes the work and no result.

    Null times are left out, a null key is a key like others, and an empty table gives no rows.
    """
    wait = window_ms if forget_ms is None else min(window_ms, forget_ms)
    rows = events.select(F.col(key).alias("k"), F.col(time_ms).cast("long").alias("t")).where("t is not null")
    kind = events.schema[key].dataType
    if wait <= 0:  # nothing is held back
        return rows.select(F.col("k").alias(key), F.col("t").alias("at_ms"), F.lit(0).cast("long").alias("suppressed"))
    span_ms = span_ms or 64 * wait
    counted = rows.groupBy("k", spans.span_of(F.col("t"), span_ms).alias("span"), "t").agg(F.count("*").alias("n"))
    by_span = counted.repartition("k", "span")
    longs = [T.StructField(c, T.LongType()) for c in ("span", "total", "entry", "last", "ahead")]
    summed = by_span.sortWithinPartitions("k", "span", "t").mapInArrow(_summaries(wait), T.StructType([T.StructField("k", kind), *longs]))
    entered = T.StructType([T.StructField("k", kind), *[T.StructField(c, T.LongType()) for c in ("span", "t", "n", "anchor")]])
    heads = summed.repartition("k").sortWithinPartitions("k", "span", "entry").mapInArrow(_entries(wait), entered)
    both = heads.unionByName(by_span.withColumn("anchor", F.lit(None).cast("long"))).repartition("k", "span")
    out = T.StructType([T.StructField("k", kind), T.StructField("at_ms", T.LongType()), T.StructField("suppressed", T.LongType())])
    through = both.sortWithinPartitions("k", "span", F.asc_nulls_first("t")).mapInArrow(_through(wait, forget_ms), out)
    return through.withColumnRenamed("k", key)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[pa.int64()] * (len(names) - 1)])], names)


def _summaries(wait: int):
    """Of each (k, span), from its sorted times and their counts: where it may be entered (``entry``: the first entry at or
    behind the end of the window that is open), the ``last`` that then comes through and how many entries lie ``ahead`` of that. Of
    neighbouring places with one result only the latest is kept."""

    def summary(k, span: int, times: list[int], counts: list[int]) -> list[tuple]:
        t, n = np.array(times, np.int64), np.array(counts, np.int64)
        after = np.searchsorted(t, t + wait)
        last = np.where(after < len(t), after, np.arange(len(t)))
        while (last[last] != last).any():
            last = last[last]
        some = min(len(t), int(np.searchsorted(t, span + wait - 1)) + 1)  # an earlier window ends before that
        kept = np.flatnonzero(np.r_[last[1:some] != last[: some - 1], True])
        ahead = np.cumsum(n) - n
        end = last[kept]
        return [(k, span, int(n.sum()), *x) for x in zip(t[kept].tolist(), t[end].tolist(), ahead[end].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, times, counts, kind = None, [], [], None
        names = ["k", "span", "total", "entry", "last", "ahead"]
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, span, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, span) != of:
                    out += summary(*of, times, counts) if of else []
                    of, times, counts = (k, span), [], []
                times.append(t)
                counts.append(n)
            yield _batch(out, kind, names)
        if of:
            yield _batch(summary(*of, times, counts), kind, names)

    return run


def _entries(wait: int):
    """Of each (k, span), from the key's summaries in order: the ``anchor`` that was last to come through before it and ``n``,
    how many were held back since. ``t`` is null, which puts the row before the span's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen, anchor, place, found = None, 0, None, 0, False  # place: of the anchor among the key's entries
        total = 0
        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for k, span, size, entry, last, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, span) != of:
                    if of is None or k != of[0]:
                        seen, anchor = 0, None
                    else:
                        seen += total
                    of, total, found, before = (k, span), size, False, anchor
                    out.append((k, span, None, seen - place - 1 if anchor is not None else 0, anchor))
                if not found and (before is None or entry >= before + wait):
                    found, anchor, place = True, last, seen + ahead
            yield _batch(out, kind, ["k", "span", "t", "n", "anchor"])

    return run


def _through(wait: int, forget_ms: int | None):
    """The entries of each (k, span) that come through, behind the row that says where it is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            out = []
            for k, _, t, n, anchor in zip(*(c.to_pylist() for c in batch.columns)):
                if t is None:
                    last, held = anchor, n
                elif last is not None and t - last < wait:
                    held += n
                else:
                    known = last is not None and (forget_ms is None or t - last < forget_ms)
                    out.append((k, t, held if known else 0))
                    last, held = t, n - 1
            yield _batch(out, batch.schema.field(0).type, ["k", "at_ms", "suppressed"])

    return run


def emitted_stream(events: DataFrame, window_ms: int = REPEAT_WINDOW_MS, forget_ms: int = FORGET_MS, delay: str = "10 seconds") -> DataFrame:
    """The same on a stream (repeat_key, at_ms), by event time, with the anchor and the count as state.

    A key leaves the state ``forget_ms`` (``window_ms`` at least) after its last entry that came through, so state holds
    the keys of that time and not all that ever were. Entries ``delay`` or more behind the newest of earlier
    micro-batches are left out; one that comes in a later micro-batch than a newer one is a repeat of that.
    """
    forget = max(forget_ms, window_ms)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = state.get if state.exists else (None, 0)
        out = []
        for at in sorted(t for b in batches for t in b["at_ms"].tolist()):
            known = last is not None and at - last < forget
            if known and at - last < window_ms:
                held += 1
            else:
                out.append((key[0], at, held if known else 0))
                last, held = at, 0
        if last + forget > state.getCurrentWatermarkMs():
            state.update((last, held))
            state.setTimeoutTimestamp(last + forget)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["repeat_key", "at_ms", "suppressed"])

    timed = events.where("at_ms is not null").withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    return timed.groupBy("repeat_key").applyInPandasWithState(step, "repeat_key string, at_ms long, suppressed long", "last long, held long", "append", GroupStateTimeout.EventTimeTimeout)
