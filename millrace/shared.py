"""Folders that the driver and all executors share, and lineage that ends in them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests on one machine, a folder under the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write; it goes when the JVM ends."""
    out = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)
