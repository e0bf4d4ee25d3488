"""Folders and tables that a query keeps for itself until the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder, shared by driver and executors where spark.checkpoint.dir names one, that goes with the application."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/quernstone-store-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def stored(rows: DataFrame) -> DataFrame:
    """The rows, computed once and written to a scratch folder, so that what reads them several times doesn't compute them
    again and Spark knows their size when it plans joins."""
    spark = rows.sparkSession
    folder = f"{scratch(spark)}/rows"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
