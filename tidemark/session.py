"""Session settings and the two things every job needs from its session: a shared folder and its own code."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "tidemark", **more: str) -> SparkSession:
    """A session in UTC with AQE and Arrow on; `more` adds or overrides settings."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests, local mode) a temporary folder stands in for it. The folder
    goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    _FOLDERS.append(path)
    return path


#: Folders named so far, in order.
_FOLDERS: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Drops the folders that are made inside, but for the last one, which is the result."""
    first = len(_FOLDERS)
    yield
    for path in _FOLDERS[first:-1]:
        _drop(spark, path)
    del _FOLDERS[first:-1]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def checkpointed(df, purpose: str):
    """`df` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    return written(df, None, df.schema, purpose)


#: Bytes that a worker holds before it writes a row group.
ROW_GROUP = 8 << 20


def written(df, run, schema, purpose: str):
    """`df`, or what the mapInArrow function `run` makes of it, as a checkpointed table of this schema.

    Hadoop's local file system starts a process for each file and folder that it makes, to set its mode. So where the
    shared folder is a mount (file:), the Python workers write the Parquet files. An attempt of a task writes a hidden
    file of its own; the driver moves those of the attempts that Spark took, so what a lost or repeated attempt leaves
    is never read. On other file systems Spark's writer does it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    if not path.startswith("file:"):
        with shuffles_dropped(spark):
            (df if run is None else df.mapInArrow(run, schema)).write.parquet(path)
        release_shuffles(spark)
        return _read(spark, schema, path)
    local = "/" + path.removeprefix("file:").lstrip("/")
    hidden = os.path.join(local, "_attempts")
    os.makedirs(hidden)
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    wanted = None if run is None else to_arrow_schema(fields)

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        name, out, held, size = f"{uuid.uuid4().hex}.parquet", None, [], 0

        def flush():
            nonlocal out, held, size
            out = out or pq.ParquetWriter(os.path.join(hidden, name), held[0].schema, compression="snappy")
            out.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        for batch in batches if run is None else run(batches):
            if batch.num_rows:
                held.append(batch if wanted is None else batch.select(wanted.names).cast(wanted))
                size += batch.nbytes
                if size >= ROW_GROUP:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    with shuffles_dropped(spark):
        names = df.mapInArrow(write, "name string").collect()  # a name for each task
    for row in names:
        os.rename(os.path.join(hidden, row.name), os.path.join(local, row.name))
    release_shuffles(spark)
    return _read(spark, schema, path)


def settle(spark: SparkSession) -> None:
    """Executors and the driver collect their garbage, between the stages of a long job.

    A heap that has grown in one stage stays so while it is in little use, and would add to what the Python workers of the
    next stage need. A row goes to each core, twice, so that hardly an executor is left out; it is no matter if one is.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()
    release_shuffles(spark, now=True)


def trim(spark: SparkSession) -> None:
    """The driver gives freed native memory back: that of its JVM (compiling plans' code leaves about 100 MB) and its Python.

    A JVM or C library that has no such request goes without.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    with suppress(Py4JJavaError):
        jvm_command(spark, "systemTrimNativeHeap")


def jvm_command(spark: SparkSession, name: str) -> str:
    """What the driver's JVM answers to a diagnostic command without arguments.

    The server's own class is closed to reflection, so the call goes by its interface.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    lang, of = jvm.java.lang, jvm.java.lang.Class.forName
    values = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), name, array(lang.Object, 0), array(lang.String, 0)]
    kinds, given = array(lang.Class, 4), array(lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i], given[i] = of(kind), values[i]
    call = of("javax.management.MBeanServer").getMethod("invoke", kinds)
    return call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def _read(spark: SparkSession, schema, path: str):
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(table) -> None:
    """Deletes the files of a written table that nothing will read again."""
    _drop(table.sparkSession, table.written_to)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside runs once, so Spark may drop its shuffle files at its end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Seconds between two requests that the driver collects its garbage, and when the last one was.
COLLECT_EVERY = 2.0
_collected = [0.0]


def release_shuffles(spark: SparkSession, now: bool = False) -> None:
    """Have Spark drop the shuffle files of plans that nothing refers to any more, and the driver give back memory.

    It does so when the driver collects garbage, which a small heap in little use may put off until the disks are full.
    """
    if now or time.monotonic() - _collected[0] > COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        trim(spark)
        _collected[0] = time.monotonic()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "tidemark_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
