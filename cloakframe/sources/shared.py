"""Tables that a plan is cut at, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the application ends. Only a local session may do without that setting."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "cloakframe-shared")
    where = f"{top.rstrip('/')}/cloakframe-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def stored(df: DataFrame, where: str | None = None) -> DataFrame:
    """Writes a table and reads it: it is computed once, and a lost executor costs nothing that was written."""
    where = where or folder(df.sparkSession)
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
