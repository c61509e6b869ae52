"""What the corpus operators share: tables that cut lineage, column helpers, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in rows times an estimated row width, of anything that is broadcast by hint.
BROADCAST_BYTES = 32 << 20

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def release() -> None:
    """Gives memory that this Python worker no longer uses back to the machine; workers live on after a task, and an executor
    has several of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release_driver(spark: SparkSession) -> None:
    """The same for the driver's JVM: collects its garbage, and has its C library give freed memory back, where the JVM has that
    command. Compiling the plans of many jobs allocates and frees much outside the heap, and the library keeps it for each thread."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()

    def those(kind, *values):
        out = array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    with contextlib.suppress(Py4JError):
        kinds = [jvm.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", those(jvm.Class, *kinds))  # the server's own class is hidden
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), those(jvm.Object, commands, "systemTrimNativeHeap", None, None))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, with release() at the end of the task."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary folder of this machine
    serves, if the session runs on this machine alone, as in tests; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "facteng-checkpoints")
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder. A reader of such a table depends on its files and not on
    the executors that made it, so the loss of an executor costs one read and no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/facteng-{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None, codec: str | None = None, block: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.mode("overwrite")
        if codec:
            writer = writer.option("compression", codec)
        if block:  # bytes of a row group, which a task holds in memory
            writer = writer.option("parquet.block.size", block)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        # Shuffle files of the finished step are no longer needed; Spark deletes them once the driver has collected its plan.
        release_driver(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self) -> None:
        """Shuffle files of the last step go as well: right after it, what listens to Spark's events may still hold its plan."""
        time.sleep(0.5)
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks df for broadcasting if rows * row_bytes is within BROADCAST_BYTES; else leaves the choice to
    the planner, which then shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that would clash with the named output columns (case is ignored, as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
