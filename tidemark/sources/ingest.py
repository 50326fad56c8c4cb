"""Files in and out: JSON lines with rescue, typed projections, snapshots with checksums."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_ddl(fields: Mapping[str, str]) -> str:
    """name type, name type, ..."""
    return ", ".join(f"`{n}` {t}" for n, t in fields.items())


def with_lineage(rows: DataFrame) -> DataFrame:
    """Adds the file that a row came from, and when it was read. For file sources."""
    return rows.withColumns({"_source_file": F.col("_metadata.file_path"), "_ingest_ts": F.current_timestamp()})


def parse_lines(lines: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """The fields of JSON lines, and `rescued`: the line, where it is no JSON, a field doesn't fit its type, or there
    is a field that is not listed. Such a field is null, the others keep their values."""
    present = F.json_object_keys(column)
    text = F.col(column)
    values = {n: F.get_json_object(text, f"$.{n}") for n in fields}
    typed = {n: (values[n] if t == "string" else values[n].try_cast(t)) for n, t in fields.items()}
    misfit = [values[n].isNotNull() & typed[n].isNull() for n in fields]
    unknown = F.size(F.array_except(present, F.array(*map(F.lit, fields)))) > 0
    bad = present.isNull() | unknown
    for m in misfit:
        bad = bad | m
    return lines.select(*[c for c in lines.columns if c != column], *[v.alias(n) for n, v in typed.items()], F.when(F.coalesce(bad, F.lit(True)), text).alias("rescued"))


def typed(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Exactly these columns in these types; an absent one is null."""
    return rows.select(*[(F.col(n).try_cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in fields.items()])


def json_lines(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """`value`: a JSON object for each row, fields in order, absent values left out."""
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def write_json_lines(rows: DataFrame, fields: Sequence[str], path: str) -> None:
    """The same as text files."""
    json_lines(rows, fields).write.mode("errorifexists").text(path)


def recent(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` up to and including `as_of`."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return rows.where((F.col(ts) > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= end))


def export_window(facts: DataFrame, entities: DataFrame, scores: DataFrame, key: str, ts: str, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Recent facts and the entities they name. Refuses if one of them has no score."""
    some = recent(facts, ts, as_of, days)
    unscored = some.join(scores, [key, ts], "left_anti")
    if not unscored.isEmpty():
        raise ValueError("some rows of the window have no score yet")
    return some, entities.join(some, key, "left_semi")


def write_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Writes the tables as Parquet and returns the manifest: table, file, bytes, sha256 of each file."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    return manifest(spark, folder, list(tables))


def manifest(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """table, file, bytes, sha256 of the Parquet files in a snapshot; digests are taken by the executors."""
    parts = [
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{n}")
        .select(F.lit(n).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        for n in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_snapshot(spark: SparkSession, folder: str, expected: DataFrame) -> None:
    """Raises if a file is missing, new or other than the manifest says."""
    names = [r.table for r in expected.select("table").distinct().collect()]
    if any("/" in n or n.startswith(".") for n in names):
        raise ValueError("a table's name is a path")
    now = manifest(spark, folder, names)
    if not (now.exceptAll(expected).isEmpty() and expected.exceptAll(now).isEmpty()):
        raise ValueError(f"the files in {folder} are not those of the manifest")


def pointer(version: str, digest: str) -> str:
    """The small document that names the published snapshot."""
    return json.dumps({"version": version, "sha256": digest}, sort_keys=True)


def missing_columns(rows: DataFrame, needed: Sequence[str]) -> list[str]:
    """Names that the rows lack, in order."""
    return sorted(set(needed) - set(rows.columns))


def widened(rows: DataFrame, present: Mapping[str, str]) -> DataFrame:
    """The rows with a null column for each field that a table has and they lack: a table's fields only ever grow."""
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in present.items() if n not in rows.columns})


def publish_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str) -> str:
    """Writes a snapshot below <root>/<digest of its manifest>, then its pointer file; returns the pointer's text.

    A reader finds the old snapshot or the new one, whole: the pointer is the last thing that is written.
    """
    work = f"{root}/_new-{version}"
    listed = sorted(map(tuple, write_snapshot(spark, tables, work).collect()))
    text = pointer(version, hashlib.sha256(json.dumps(listed).encode()).hexdigest())
    fs = _file_system(spark, root)
    target = f"{root}/{json.loads(text)['sha256'][:16]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(path(target)):
        fs.rename(path(work), path(target))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/pointer")
    return text


def fetch_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the published snapshot, after its files were held against the pointer's digest."""
    text = spark.read.text(f"{root}/pointer").first()[0]
    digest = json.loads(text)["sha256"]
    folder = f"{root}/{digest[:16]}"
    status = _file_system(spark, root).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))
    names = sorted(s.getPath().getName() for s in status if s.isDirectory())
    listed = sorted(map(tuple, manifest(spark, folder, names).collect()))
    if hashlib.sha256(json.dumps(listed).encode()).hexdigest() != digest:
        raise ValueError(f"the files in {folder} are not those that were published")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def _file_system(spark: SparkSession, uri: str):
    return spark._jvm.org.apache.hadoop.fs.Path(uri).getFileSystem(spark._jsc.hadoopConfiguration())


def op_counts(log: DataFrame, op: str = "change_op") -> Column:
    """Counts of each operation, as one map column for a run log."""
    return F.map_from_entries(F.collect_list(F.struct(op, "n")))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
