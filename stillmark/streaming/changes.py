"""Lists kept current from change events: last event for each key, snapshots with replay, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_changes(events: DataFrame, key: str = "id", revision: str = "revision") -> DataFrame:
    """The event with the highest revision for each key (all columns); of equal revisions the one with the largest columns,
    taken from left to right."""
    rest = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(rest, F.struct(F.col(revision), rest)).alias("last")).select(key, "last.*")


def apply_changes(rows: DataFrame, events: DataFrame, key: str = "id", status: str | None = None, insert: bool = True) -> DataFrame:
    """``rows`` after the events (key, revision, type ``updated`` or ``deleted``, and the columns of ``rows``).

    An update replaces its row, or inserts it where the view takes new rows; it drops the row if it no longer has the
    status that the view shows. A delete removes it.
    """
    last = last_changes(events, key)
    kept = rows.join(last.select(key), key, "left_anti")
    updated = last.where("type = 'updated'")
    known = updated.join(rows.select(key), key, "left_semi")
    if status and status != "all":
        known = known.where(F.col("status") == status)
    out = kept.unionByName(known.select(*rows.columns))
    if insert:
        out = out.unionByName(updated.join(rows.select(key), key, "left_anti").select(*rows.columns))
    return out


def takes_new_rows(keyword: str | None, status: str | None, folder_id: int | None, sort: str) -> bool:
    """Only an unfiltered view in order of arrival can take rows it hasn't loaded."""
    return not (keyword or "").strip() and status in (None, "", "all") and folder_id is None and sort in ("", "added", None)


def unseen_changes(events: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Updates of rows that the view doesn't have: a reason to load it again."""
    return last_changes(events, key).where("type = 'updated'").join(rows.select(key), key, "left_anti")


def replay(snapshot: DataFrame, events: DataFrame, since: int, key: str = "id", **view) -> DataFrame:
    """A snapshot read at revision ``since`` brought up to date with later events only."""
    return apply_changes(snapshot, events.where(F.col("revision") > since), key, **view)


def import_progress(events: DataFrame) -> DataFrame:
    """The newest batch's last progress (id, seq, finished, ...); nothing once it has finished."""
    newest = events.agg(F.max_by(F.struct(*events.columns), F.struct("id", "seq")).alias("last"))
    return newest.where(~F.col("last.finished")).select("last.*")


def running_highest(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Only counters above all earlier ones of their key count."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("highest", F.max(value).over(before)).where(F.col("highest").isNull() | (F.col(value) > F.col("highest"))).drop("highest")


def upsert_batch(root: str, key: str = "id"):
    """A foreachBatch function that folds a batch into a table of ``snapshots``; folding a batch twice changes nothing.

    Only the buckets of the batch's keys are read and written again. A batch that stops anywhere leaves the table as it was
    or as it will be.
    """
    from ..operators import snapshots

    def apply(batch: DataFrame, number: int) -> None:
        now = snapshots.current(batch.sparkSession, root)
        snapshots.rewrite(batch.select(key), now, lambda rows: apply_changes(rows, batch, key))

    return apply
