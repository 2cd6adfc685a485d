"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a session inside one process gets a folder of its own;
    on a cluster that would lose rows, so there it is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return df.checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Delete the checkpoint of a saved table that nothing reads any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let go of what finished steps hold.

    Spark keeps shuffle files and broadcasts until the driver's garbage is
    collected. Executors keep the heap of their peak; a collection on each lets
    them give it back, for the Python workers of the next step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = max(1, spark.sparkContext.defaultParallelism)
    if not spark.sparkContext._jsc.sc().isLocal():
        spark.range(0, n, 1, n).where(F.expr("java_method('java.lang.System', 'gc') is not null")).count()


def lightened(spark: SparkSession, size: str = "8m") -> None:
    """From now on Arrow batches hold about so many bytes: 10,000 long texts a batch would fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidied() -> None:
    """At the end of a Python task: give memory back that its worker, which Spark keeps for later tasks, would hold on to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_of(name: str = "text") -> Column:
    """A text column as string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
