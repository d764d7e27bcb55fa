"""What the training-data operators share: scratch tables, whole rows out of the way, hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only if
    all executors are this process (tests); on a cluster that would be another disk on each machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="brightloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, into: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back: the lineage ends in
    files that outlive any executor, and the reread has true sizes for the planner. The path is added
    to ``into``, for ``discard``; a table that a returned DataFrame still reads must stay."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/brightloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing will read again, in whatever file system they are."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def packed(df: DataFrame, *without: str) -> Column:
    """The columns of ``df`` but those named, as one struct: out of the way of any helper column,
    whatever they are called."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in df.columns if c not in without))


def unpacked(df: DataFrame, row: str, **instead: Column) -> list[Column]:
    """The columns of ``df`` in order, from the struct ``row`` or from ``instead``."""
    return [(instead[c] if c in instead else F.col(row).getField(c)).alias(c) for c in df.columns]


def quoted(name: str) -> str:
    """A column name as a reference, with dots and backticks taken literally."""
    return "`" + name.replace("`", "``") + "`"


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod ``modulus``: the fold rule of the labelled operators."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def unit_hash(*columns: Column) -> Column:
    """A uniform double in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def md5_number(text: Column) -> Column:
    """The first 60 bits of the MD5 of ``text`` as a non-negative long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
