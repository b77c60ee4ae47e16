"""Shared helpers: tables in the cluster's shared folder, size-checked broadcasts, batch iteration."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from functools import reduce
from operator import add

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join may be broadcast after its rows have been measured.
BROADCAST_BYTES = 32 << 20
#: Written tables of a run after which the driver gives memory back.
REST_AFTER = 6


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are the driver itself gets one of its own; a cluster has to name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark._jvm, spark._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session has a number of its own: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def rest(spark: SparkSession) -> str:
    """Lets the driver's JVM collect garbage and give free memory back to the system; tells what it said.

    Loops plan many small jobs. Each of their exchanges has a thread of its own for a minute, and the C library keeps what
    threads and compilers have freed; a full collection shrinks the heap, a trim the rest.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:  # by reflection: the server's own class is not open to Py4J
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM or C library without that command
        return ""


class Scratch:
    """Written tables of one operator run under the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes tables that nothing later reads, ``only`` all but those that the result reads; these go when the
    driver ends, or by ``close``. With every ``REST_AFTER`` tables the driver gives memory back.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.base, self.names = spark, f"{shared_dir(spark)}/lattiq-{name}-{uuid.uuid4().hex[:12]}", set()
        self.written = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        self.names.add(name)
        self.written += 1
        if self.written % REST_AFTER == 0:
            rest(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
            self.names.discard(name)

    def settle(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs: it does when the driver has collected their frames, so
        callers drop theirs before. Large jobs call it, as a driver may otherwise not collect garbage for long."""
        for _ in range(4):  # the JVM hears of frames that Python has dropped only after a while
            gc.collect()
            rest(self.spark)
            time.sleep(0.3)

    def only(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # the session may be gone already
            pass


def _bytes(name: str, kind: T.DataType) -> Column:
    """About the memory that a column takes in a row."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        flat = isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24 if flat else F.length(F.coalesce(F.to_json(c), F.lit(""))) + 24
    return F.length(F.coalesce(F.to_json(c), F.lit(""))) + 24 if isinstance(kind, (T.StructType, T.MapType)) else F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``limit`` bytes (they are measured), else as it is.

    Meant for written tables, which are read again for it.
    """
    row = reduce(add, [_bytes(f.name, f.dataType).cast("long") for f in df.schema], F.lit(32).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the documents' texts, or of the files they are read from where nothing else happens on the way."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation" or node.nodeName().startswith("Relation"):
        return int(str(node.stats().sizeInBytes()))
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def fragments_for(docs: DataFrame, each: int, least: int) -> int:
    """Fragments of about ``each`` bytes of ``docs``; as many as it takes."""
    return max(least, -(-text_bytes(docs) // each))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(docs: DataFrame, bad: DataFrame, *marked: str) -> DataFrame:
    """``docs`` without the rows whose doc_id and hash of the columns ``marked`` are in ``bad`` (_d, _b)."""
    mark, d, b = (fresh(docs, x) for x in ("_mark", "_d", "_b"))
    hashed = docs.withColumn(mark, F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) if c == "text" else F.col(c) for c in marked]))
    bad = small(bad.select(F.col("_d").alias(d), F.col("_b").alias(b)))
    return hashed.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(mark) == F.col(b)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def local_tmp() -> tempfile.TemporaryDirectory:
    """A folder of a task's own, removed when the task leaves it."""
    os.makedirs(tempfile.gettempdir(), exist_ok=True)
    return tempfile.TemporaryDirectory(prefix="lattiq-")


def pieces(batches, column: str = "text", limit: int = 2 << 20):
    """Slices of Arrow record batches whose ``column`` holds about ``limit`` bytes at most, or one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).cast(pa.int64()).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def release() -> None:
    """Gives freed memory back to the system at a task's end: Python workers stay beside later stages."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work):
    """``work`` over batches, with memory given back to the system when a task ends."""

    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pools keep what they once had
        try:
            yield from work(batches)
        finally:
            release()

    return run
