"""Numbers over a whole table, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed


#: monotonically_increasing_id() is the partition shifted by so many bits, and the row in it.
ROW_BITS = 33


def in_ranges(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in ranges of the order, as a written table with _part (the range) and _own (the place in it, from 1).

    The table is written once, since two plans of the same range partitioning need not have the same bounds: each samples
    the columns that it still has.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, own = F.shiftright("_id", ROW_BITS).alias("_part"), (F.col("_id").bitwiseAND((1 << ROW_BITS) - 1) + 1).alias("_own")
    return checkpointed(sorted_rows.select(*rows.columns, part, own), "ranges")


def dense_number(rows: DataFrame, order: Sequence[str | Column], alias: str) -> DataFrame:
    """Adds 1, 2, ... in the given order.

    Rows are range-partitioned and numbered within their partition; what stands before each partition is a sum over
    as many rows as there are partitions, which are broadcast.
    """
    dealt = in_ranges(rows, order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(alias, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def rank_slice(array: str | Column, k: int, by) -> Column:
    """The k elements of an array with the largest `by`, stable."""
    array = F.col(array) if isinstance(array, str) else array
    keyed = F.transform(array, lambda x, i: F.struct((-by(x)).alias("key"), i.alias("place"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["value"])


def top_k_per_key(rows: DataFrame, key: str, order: Sequence[Column], k: int, alias: str = "place") -> DataFrame:
    """The first k rows of each key with their place; Spark keeps only k rows of a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(alias, place).where(F.col(alias) <= k)


def hashed_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows, the same at each run and in any engine: those whose keys hash (MD5) lowest."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def numbered(rows: DataFrame, key: str, order: Sequence[str | Column], alias: str) -> DataFrame:
    """Adds 0, 1, ... within each key."""
    return rows.withColumn(alias, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def running_sum(rows: DataFrame, order: Sequence[Column], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds cum_<column>: the sum up to and including each row, within the `by` columns, in the given order.

    Like `dense_number`: no task sees more than its own range of rows, whatever the size of a group. The order must
    tell rows of a group apart.
    """
    dealt = in_ranges(rows, [*[F.col(b) for b in by], *order])
    within = Window.partitionBy("_part", *by).orderBy("_own").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({f"_own_{c}": F.sum(c).over(within) for c in columns})
    sizes = dealt.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", *by, *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns])
    on = (F.col("d._part") == F.col("s._part")) & F.lit(True)
    for b in by:
        on &= F.col(f"d.{b}").eqNullSafe(F.col(f"s.{b}"))
    joined = dealt.alias("d").join(sizes.alias("s"), on).select("d.*", *[f"s._before_{c}" for c in columns])
    joined = joined.withColumns({f"cum_{c}": F.col(f"_before_{c}") + F.col(f"_own_{c}") for c in columns})
    return joined.drop("_part", "_own", *[f"_{k}_{c}" for k in ("own", "before") for c in columns])
