"""File events: debounce by path, with deletes that cancel, as a batch fold and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import spans

DUE = "path_key string, path string, folder_id long, due_ms long"


def debounced(events: DataFrame, key: str, time_ms: str, gap_ms: int, span_ms: int | None = None) -> DataFrame:
    """Bursts of events less than ``gap_ms`` apart: key, first, due (last plus gap), n. Spans as in ``spans.bursts``."""
    found = spans.bursts(events, [key], time_ms, gap_ms, span_ms)
    return found.select(key, "first_ms", (F.col("last_ms") + gap_ms).alias("due_ms"), "n")


def due_imports(events: DataFrame, gap_ms: int, span_ms: int | None = None) -> DataFrame:
    """events (path_key, path, folder_id, kind, at_ms) to imports that came due: a create or change followed by ``gap_ms``
    without another event on the path. A removal cancels what is pending. Spans as in ``spans.with_next``."""
    rows = events.select("path_key", "path", "folder_id", "kind", "at_ms")
    following = spans.with_next(rows, "path_key", "at_ms", ["kind"], span_ms or spans.span_for(gap_ms), "next_ms")
    quiet = F.col("next_ms").isNull() | (F.col("next_ms") - F.col("at_ms") >= gap_ms)
    return following.where(F.col("kind").isin("create", "modify") & quiet).select("path_key", "path", "folder_id", (F.col("at_ms") + gap_ms).alias("due_ms"))


def due_imports_stream(events: DataFrame, gap_ms: int) -> DataFrame:
    """The same on a stream, by processing time: each event sets the path's timer anew, a removal clears it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            path, folder, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], path, folder, last + gap_ms)], columns=["path_key", "path", "folder_id", "due_ms"])
            return
        rows = pd.concat(list(batches)).sort_values(["at_ms", "kind"], kind="stable")
        last = rows.iloc[-1]
        if last["kind"] == "remove":
            if state.exists:
                state.remove()
            return
        state.update((last["path"], int(last["folder_id"]), int(last["at_ms"])))
        state.setTimeoutDuration(gap_ms)

    return events.groupBy("path_key").applyInPandasWithState(step, DUE, "path string, folder_id long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def removals(events: DataFrame, prune: bool = True) -> DataFrame:
    """Paths whose last event is a removal; none if pruning is off."""
    last = events.groupBy("path_key").agg(F.max_by("kind", F.struct("at_ms", "kind")).alias("kind"))
    return last.where((F.col("kind") == "remove") & F.lit(prune)).select("path_key")


def vanished(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of an earlier scan that a later one doesn't have: removals for sources that only report new files."""
    return before.join(after.select("path_key"), "path_key", "left_anti")


def apply_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run a function on every micro-batch, resumable from ``checkpoint``; a batch seen again has the same number."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
