"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where none is set and all runs on one machine, as in tests, one in its temporary space is used.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + os.path.join(tempfile.gettempdir(), "pagefold-checkpoints")
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{shared_dir(spark)}/pagefold-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def settle(df: DataFrame, *measures: Column):
    """Writes ``df`` as a table in the shared folder and reads it again; with ``measures``, also their values.

    This cuts the lineage in a way that survives lost executors.  ``measures`` are aggregates of the
    rows, taken from the files and so from what was written.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return (written, *written.agg(*measures).first()) if measures else written
