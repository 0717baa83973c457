"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "FOLIANT_LOCAL_SHARED"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local, a temporary folder of this process."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or os.environ.get(_LOCAL)
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    os.environ[_LOCAL] = tempfile.mkdtemp(prefix="foliant-")
    return os.environ[_LOCAL]


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that what it gives is fixed and a lost executor repeats nothing before it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions than there are, as one small file does; as it is at scale."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
