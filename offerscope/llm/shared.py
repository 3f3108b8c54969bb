"""Helpers of the operators: scratch tables in the shared folder, small checks."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for tables between jobs, in spark.checkpoint.dir.

    Where that is unset, a session in one process takes a new temporary folder (tests); on a cluster it is an error, as
    executors don't see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the application's tables between jobs; to be called when all results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> str:
    """From now on the session's Python workers get batches of at most BATCH rows, as texts are long; gives the setting before."""
    usual = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(BATCH, int(usual)) if int(usual) > 0 else BATCH))
    return usual


def give_back_heap(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, if its heap takes over half of its limit; at most a tenth of the time goes into that.

    Each stage, scan and broadcast leaves a block of some MB, so many short jobs blow the heap up to several times what
    is alive, and the JVM keeps that memory. A full collection gives it back.
    """
    heap, context = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext
    began = time.monotonic()
    if heap.totalMemory() > heap.maxMemory() // 2 and began >= getattr(context, "_offerscope_collects", began):
        spark._jvm.System.gc()
        ended = time.monotonic()
        context._offerscope_collects = ended + 10 * (ended - began)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder.

    Texts are long, so Python workers get batches of at most BATCH rows meanwhile, not the session's usual ten thousand.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    usual = small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, usual)
    give_back_heap(spark)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
