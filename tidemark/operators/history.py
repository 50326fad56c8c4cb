"""Change logs and what is made of them: current state, history, upserts, differences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Operations of a change log.
SNAPSHOT, INSERT, UPDATE, DELETE = "S", "I", "U", "D"


def no_deletes(log: DataFrame, op: str = "change_op") -> DataFrame:
    """The log without delete records; the sources never delete, so one is left out rather than applied."""
    return log.where(F.col(op) != DELETE)


def scd1(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key, picked by partial aggregation."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def scd2(log: DataFrame, keys: Sequence[str], order: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Versions of each key with start_at and end_at; only a change of a tracked column starts one.

    Rows that repeat a version in the log (re-reads) fall together; the newest version has no end.
    """
    by_time = Window.partitionBy(*keys).orderBy(*order)
    state = F.struct(*tracked)
    rows = log.withColumn("_new", F.coalesce(~F.lag(state).over(by_time).eqNullSafe(state), F.lit(True)) | (F.row_number().over(by_time) == 1))
    rows = rows.where("_new").drop("_new")
    return rows.withColumn("start_at", F.col(order[0])).withColumn("end_at", F.lead(order[0]).over(by_time))


def current(versions: DataFrame) -> DataFrame:
    """The open version of each key."""
    return versions.where("end_at IS NULL").drop("start_at", "end_at")


def as_of(versions: DataFrame, moment: str) -> DataFrame:
    """The versions in force at a moment."""
    t = F.lit(moment).cast("timestamp_ntz")
    return versions.where((F.col("start_at") <= t) & (F.col("end_at").isNull() | (F.col("end_at") > t)))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with the updates' rows in place of those with their keys."""
    return target.join(updates, list(keys), "left_anti").unionByName(updates)


def fill_late(target: DataFrame, updates: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Target with `column` filled from the updates where it was null, plus the updates' new keys."""
    new = updates.select(*keys, F.col(column).alias("_late"))
    filled = target.join(new, list(keys), "left").withColumn(column, F.coalesce(column, "_late")).drop("_late")
    return filled.unionByName(updates.join(target, list(keys), "left_anti"))


def difference(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed (null-safe) between two states, with the kind of change."""
    a = old.select(*keys, F.struct(*compared).alias("_old"))
    b = new.select(*keys, F.struct(*compared).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, list(keys), "full").select(*keys, kind.alias("change")).where("change IS NOT NULL")


def vanished(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that the new state no longer has: none, as sources never delete."""
    return old.join(new, list(keys), "left_anti").select(*keys)


def change_set(old: DataFrame, new: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Rows of the new state to insert or to update, with change_op. A row that has vanished is an error."""
    lost = vanished(old, new, keys).limit(3).collect()
    if lost:
        raise ValueError(f"rows have vanished, such as {lost[0].asDict()}")
    kind = F.when(F.col("change") == "added", INSERT).otherwise(UPDATE).alias("change_op")
    return new.join(difference(old, new, keys, compared).select(*keys, kind), list(keys))


def changes_between(log: DataFrame, state: DataFrame, keys: Sequence[str], version: str, after: int, upto: int) -> DataFrame:
    """Changes with after < version <= upto, each with the present row of its key; a deleted row's columns are null."""
    some = log.where((F.col(version) > after) & (F.col(version) <= upto)).select(*keys, version, "change_op")
    return some.join(state, list(keys), "left")


def first_copy(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_marks(log: DataFrame, name: str, ts: str) -> DataFrame:
    """The latest watermark row of each table."""
    return scd1(log, [name], [ts])


@dataclass(frozen=True)
class Read:
    """What to read of a table: everything, or the changes after a version."""

    table: str
    kind: str
    after: int | None
    upto: int


def plan_reads(present: dict[str, dict], marks: dict[str, dict]) -> list[Read]:
    """A snapshot where nothing was read before, the log no longer goes back far enough, or the table is another one.

    present: table -> version, min_valid, created; marks: table -> version, created.
    """
    out = []
    for table, now in sorted(present.items()):
        mark = marks.get(table)
        known = mark is not None and mark["version"] >= now["min_valid"] and mark.get("created") is not None and mark["created"] == now["created"]
        out.append(Read(table, "changes" if known else "snapshot", mark["version"] if known else None, now["version"]))
    return out
