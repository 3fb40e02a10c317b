"""The folder that all machines share: lineage is cut there, and tables of one run are written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, one of our own on a single machine only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """A new folder in the shared one, removed at the end of a `with`; through Hadoop's file system, so that any store will do."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *_: object) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
