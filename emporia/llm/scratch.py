"""Intermediate tables in the shared checkpoint folder.

Long jobs cut their lineage by writing a table and reading it back, so a lost
executor costs only the tasks it held.  The folder is the session's
checkpoint folder (``spark.checkpoint.dir``); on anything but a local master
it must be configured, because executors do not share a local folder.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emporia.session import ensure_checkpoint_dir


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_emporia_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="emporia-source-"), "emporia.zip")  # served by the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._emporia_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, deleted when the application ends."""
    ship(spark)
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{ensure_checkpoint_dir(spark)}/emporia-{name}-{uuid.uuid4().hex[:12]}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._emporia_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._emporia_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark's cleaner removes them once the driver's JVM has collected the
    objects of the job, which may otherwise be long after a large shuffle.
    Events of the job that listeners have not read yet hold them too, so that a
    second round follows a little later.
    """
    for pause in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def give_back() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def frugal(work):
    """``work`` (a generator over the batches of a task) that leaves a small Python worker: Spark keeps workers for later tasks."""
    def run(batches):
        yield from work(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
