"""Structured Streaming counterparts: the same rules and keys as the batch operators, run until no input is left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history, quality
from tidemark.sources.ingest import with_lineage


def json_stream(spark: SparkSession, folder: str, ddl: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of JSON-lines files, each file once over the life of a checkpoint, with lineage columns."""
    reader = spark.readStream.schema(ddl)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_lineage(reader.json(folder))


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """One row of each key within the delay. Later copies of a key that state no longer has come through; rows later
    than the watermark are dropped and show up as missing in the reconciliation."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def split(stream: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with the names of the rules they break."""
    return quality.valid(stream, rules), quality.quarantine(stream, rules)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what there is to Parquet, then stops; running it again takes up only new input."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Folders that a key's hash deals state to: a batch writes those anew that it has rows for.
BUCKETS = 16


def drain_scd1(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str) -> None:
    """Keeps the latest row of each key below `path`, in BUCKETS parts by the keys' hash.

    A batch merges its latest rows with the parts that they belong to, writes those under its own number, and leaves the
    others as they are. A repeated batch reads the same parts, those before its number, and writes the same again. What
    two batches ago was superseded goes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        new = history.scd1(history.no_deletes(batch), keys, order).withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
            before = {b: n for b, n in _parts(spark, path, number).items() if b in touched}
            rows = new
            if before:
                old = spark.read.parquet(*[f"{path}/bucket={b}/batch={n}" for b, n in before.items()]).withColumn("bucket", bucket)
                rows = history.scd1(old.unionByName(new), keys, order)
            rows.withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
            _clean(spark, path, number - 1)
        finally:
            new.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _listed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(bucket, batch) of every part of the state."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/batch=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [tuple(int(x.rpartition("=")[2]) for x in s.getPath().toString().rsplit("/", 2)[1:]) for s in found or ()]


def _parts(spark: SparkSession, path: str, before: int) -> dict[int, int]:
    """The newest batch of each bucket before this one."""
    newest: dict[int, int] = {}
    for bucket, batch in _listed(spark, path):
        if batch < before:
            newest[bucket] = max(batch, newest.get(bucket, -1))
    return newest


def _clean(spark: SparkSession, path: str, upto: int) -> None:
    """Drops parts that had a newer one by the batch `upto`."""
    newest = _parts(spark, path, upto + 1)
    for bucket, batch in _listed(spark, path):
        if batch < newest.get(bucket, -1):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}/batch={batch}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The state that `drain_scd1` wrote: the newest part of each bucket."""
    parts = _parts(spark, path, 1 << 62)
    return spark.read.parquet(*[f"{path}/bucket={b}/batch={n}" for b, n in sorted(parts.items())])


def drain_scd2(stream: DataFrame, keys: Sequence[str], order: Sequence[str], tracked: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Appends the changes to a log, and gives the history that it makes: versions with start_at and end_at.

    A change that comes late falls in its place, as the history is made from the whole log.
    """
    drain(history.no_deletes(stream), path, checkpoint)
    log = stream.sparkSession.read.schema(stream.schema).parquet(path)
    return history.scd2(log, keys, order, tracked)


def hourly_windows(stream: DataFrame, key: str, ts: str, value: str, delay: str = "24 hours") -> DataFrame:
    """An extension beside the batch buckets: count, mean, min and max by event-time hour, emitted once final."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), key)
    sums = grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return sums.select(key, F.col("window.start").alias("bucket"), "n", "mean", "min", "max")
