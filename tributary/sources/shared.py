"""Scratch tables in the folder that the cluster names for them: they cut lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which must be set: executors do not share local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = hadoop_path(spark, path)
    fs.delete(where, True)


class Written:
    """A table written to the shared folder and read back from there; ``remove`` deletes its files."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession)
        df.write.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        remove(self.spark, self.path)
