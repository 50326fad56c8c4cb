"""Joins on time: points in intervals, as-of lookups, ranges before a moment, validity and shifted self-joins.

Each keeps an equality key, so Spark hashes or sorts on it and AQE can split skewed keys; nothing here is a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp, zoned or not, as a double."""
    return F.col(ts).cast("timestamp").cast("double") if isinstance(ts, str) else ts.cast("timestamp").cast("double")


def interval_join(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, how: str = "inner", bin_seconds: int | None = None) -> DataFrame:
    """Points with the intervals of their key that hold them: start <= ts < end, an absent end is open.

    With `bin_seconds`, both sides are also keyed by time bins, an interval once for each bin that it touches up to
    the last point. That keeps a key with many intervals from comparing each point with all of them.
    """
    points, intervals = points.alias("p"), intervals.alias("i")
    inside = (F.col(f"p.{ts}") >= F.col(f"i.{start}")) & (F.col(f"i.{end}").isNull() | (F.col(f"p.{ts}") < F.col(f"i.{end}")))
    same = F.col(f"p.{key}") == F.col(f"i.{key}")
    rest = [F.col(f"i.{c}") for c in intervals.columns if c != key]
    if bin_seconds is None:
        return points.join(intervals, same & inside, how).select("p.*", *rest)
    last = points.agg(F.max(F.floor(seconds(ts) / bin_seconds)).alias("last_bin"))
    binned = intervals.crossJoin(F.broadcast(last))  # one row
    first_bin = F.floor(seconds(F.col(f"i.{start}")) / bin_seconds)
    last_bin = F.least(F.coalesce(F.floor(seconds(F.col(f"i.{end}")) / bin_seconds), F.col("last_bin")), F.col("last_bin"))
    bins = F.when(last_bin >= first_bin, F.sequence(first_bin, last_bin))
    binned = binned.withColumn("bin", F.explode(bins)).drop("last_bin").alias("i")
    points = points.withColumn("bin", F.floor(seconds(F.col(f"p.{ts}")) / bin_seconds)).alias("p")
    joined = points.join(binned, same & (F.col("p.bin") == F.col("i.bin")) & inside, how)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns if c != "bin"], *rest)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: Sequence[str], tie: str | None = None, strict: bool = False, fallback: bool = False) -> DataFrame:
    """Each left row with `values` of the last right row of its key at or before it (before it, if `strict`).

    Both sides are merged by time and the last right row is carried forward: one shuffle, one sort, no pairs. Equal
    right times are decided by the largest `tie`. With `fallback`, rows before every right row take the earliest.
    A null key equals none and a null time is at no moment: such right rows are not found, such left rows find nothing.
    """
    payload = F.struct(*values)
    known = F.col(key).isNotNull() & F.col(left_ts).isNotNull()
    right = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    a = left.where(known).select(F.col(key).alias("k"), F.col(left_ts).alias("t"), F.lit(0 if strict else 1).alias("side"), F.lit(None).alias("tie"), F.struct(*left.columns).alias("row"), F.lit(None).alias("value"))
    b = right.select(F.col(key).alias("k"), F.col(right_ts).alias("t"), F.lit(1 if strict else 0).alias("side"), (F.col(tie) if tie else F.lit(None)).alias("tie"), F.lit(None).alias("row"), payload.alias("value"))
    both = a.unionByName(b)
    order = Window.partitionBy("k").orderBy("t", "side", "tie")
    found = F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if fallback:
        found = F.coalesce(found, F.first("value", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = both.withColumn("found", found).where("row IS NOT NULL")
    rows = rows.select("row.*", *[F.col(f"found.{v}").alias(v) for v in values])
    # rows without a key stay out of the exchange, where they would all meet in one task
    nothing = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    return rows.unionAll(left.where(~known).select("*", *nothing))


def range_before(grid: DataFrame, facts: DataFrame, key: str, at: str, ts: str, hours: int) -> DataFrame:
    """Grid rows, each with the facts of its key in [at - hours, at); rows without any stay once."""
    g, f = grid.alias("g"), facts.alias("f")
    width = F.expr(f"INTERVAL {hours} HOURS")
    inside = (F.col(f"f.{ts}") >= F.col(f"g.{at}") - width) & (F.col(f"f.{ts}") < F.col(f"g.{at}"))
    return g.join(f, (F.col(f"g.{key}") == F.col(f"f.{key}")) & inside, "left").select("g.*", *[F.col(f"f.{c}") for c in facts.columns if c != key])


def valid_at(entities: DataFrame, facts: DataFrame, key: str, at: str, start: str, stop: str) -> DataFrame:
    """Facts in force for each entity at its moment: start <= at, and stop absent or later."""
    e, f = entities.alias("e"), facts.alias("f")
    inside = (F.col(f"f.{start}") <= F.col(f"e.{at}")) & (F.col(f"f.{stop}").isNull() | (F.col(f"f.{stop}") > F.col(f"e.{at}")))
    return e.join(f, (F.col(f"e.{key}") == F.col(f"f.{key}")) & inside, "left").select("e.*", *[F.col(f"f.{c}") for c in facts.columns if c != key])


def shifted(rows: DataFrame, keys: Sequence[str], ts: str, hours: int, value: str, alias: str) -> DataFrame:
    """Adds the value that the same key has exactly `hours` earlier, or null."""
    moved = rows.select(*keys, (F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")).alias(ts), F.col(value).alias(alias))
    return rows.join(moved, [*keys, ts], "left")


def first_per_key(rows: DataFrame, key: str, ts: str, columns: Sequence[str], tie: str) -> DataFrame:
    """The earliest row of each key, by partial aggregation instead of a sort."""
    picked = rows.groupBy(key).agg(F.min_by(F.struct(ts, *columns), F.struct(ts, tie)).alias("first"))
    return picked.select(key, "first.*")
