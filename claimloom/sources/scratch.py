"""Intermediate tables in the folder that driver and executors share, and joins with tables whose size is counted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a
    session on one machine (tests); on a cluster that is an error, since executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/claimloom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has cut; for when all results that read them are stored."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` deletes with the others."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither repeat its work nor need its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(small: DataFrame, *, most: int = 100_000) -> DataFrame:
    """``small`` for a join: broadcast if it is counted to have at most ``most`` rows, else to be dealt by key and sorted."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small.hint("merge")
