"""Tables that cut the lineage of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one, but only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brightloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Steps:
    """The tables of an iteration: each one that is kept replaces the one before, which is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table; the last one stays for whoever reads it."""
        path = f"{folder(self.spark)}/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        before, self.path = self.path, path
        if before:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)
