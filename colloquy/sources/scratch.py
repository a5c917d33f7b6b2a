"""Tables that a computation writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session gets a temporary folder and a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in that folder which nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: later steps read the table, so their plans stay short and a lost executor costs one task."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``saved`` that nothing reads any more."""
    spark = df.sparkSession
    files, own = df.inputFiles(), folder(spark).split(":", 1)[-1].lstrip("/")
    if files and own in files[0]:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more; by itself it waits for the driver's garbage
    collections, which are rare."""
    gc.collect()
    time.sleep(0.3)  # for listeners that still hold the last plan
    spark.sparkContext._jvm.System.gc()
