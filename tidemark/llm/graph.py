"""Connected components of an edge table, without ever gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed, discard

#: Edges that a task writes.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds (Kiveris and others, 2014). A round sends each node the smallest
    of its neighbours, which partial aggregation finds even for a node that most edges share; rounds end when the
    edges stay as they are. Each round is written to the shared folder, by as many tasks as its edges need.
    """
    now = checkpointed(_small_star(edges.where("a <> b").select("a", "b")), "components")
    size, mark = _state(now)
    while size:
        last = now
        now = checkpointed(_small_star(_large_star(last)).coalesce(1 + size // EDGES), "components")
        discard(last)
        before, (size, mark) = (size, mark), _state(now)
        if before == (size, mark):
            break
    inner = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return inner.unionByName(inner.select(F.col("component").alias("id"), "component").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count("*").alias("n"), F.sum(hashed).alias("mark")).first()
    return row.n, row.mark


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges from each node's larger neighbours to the smallest of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.where("b > a").join(least, F.col("a") == F.col("u"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges from each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
