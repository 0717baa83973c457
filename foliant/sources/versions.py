"""Versioned tables: each version is a Parquet folder, a manifest lists its files, and one small pointer file names the active one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: str | None = None) -> str:
    """Write df as a new version and return its name; nothing points to it yet."""
    version = version or uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    return version


def manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(file, size, sha256) of a version, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/{version}")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


_POINTER = "version string, number long"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_POINTER).json(f"{root}/_active")


def activate(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the active one. Pointers are only ever added, and the last one holds, so a reader between two writes sees the one before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_active")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    last = (_pointers(spark, root).agg(F.max("number")).first()[0] or 0) if there else 0
    spark.createDataFrame([(version, last + 1)], _POINTER).coalesce(1).write.mode("append").json(f"{root}/_active")


def active_version(spark: SparkSession, root: str) -> str:
    return _pointers(spark, root).agg(F.max_by("version", "number")).first()[0]


def active(spark: SparkSession, root: str) -> DataFrame:
    """The active version; a snapshot, since versions never change."""
    return spark.read.parquet(f"{root}/{active_version(spark, root)}")


def previous_versions(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """The versions that were active before, the last one first; those behind `keep` may be deleted."""
    rows = _pointers(spark, root).groupBy("version").agg(F.max("number").alias("n")).orderBy(F.desc("n")).limit(keep + 1).collect()
    return [r["version"] for r in rows[1:]]
