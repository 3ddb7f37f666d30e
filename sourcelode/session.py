"""Session and shared-storage helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir, with one folder for this application.

    Where the session names none, a local folder is set if all runs on one machine; on a cluster that is an error,
    because a lost executor would take the files with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints/sourcelode"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes every file that materialise() wrote for this application; results that read them must be done by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files outlive any executor, and their known size lets the optimizer
    pick a broadcast only where the table really is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished queries now; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
