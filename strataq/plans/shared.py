"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a full URI: spark.checkpoint.dir. Where it is unset a local session has one of
    its own; on a cluster that would be a folder of one machine, so it is an error there."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full)


def run_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that read it must be saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
