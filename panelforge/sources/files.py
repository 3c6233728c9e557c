"""Versioned folders on the shared file system, through Hadoop's API: any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it doesn't exist."""
    at, store = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the v=<n> folders in a folder."""
    return sorted(int(n[2:]) for n in names(spark, path) if n.startswith("v=") and n[2:].isdigit())


def delete(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, True)


def mark(spark: SparkSession, path: str, n: int) -> None:
    """Leaves an empty file named n: one step, so it is there or not."""
    at, store = _at(spark, f"{path}/{n:012d}")
    store.create(at, True).close()


def last_mark(spark: SparkSession, path: str) -> int | None:
    """The largest number left by mark()."""
    found = [int(n) for n in names(spark, path) if n.isdigit()]
    return max(found, default=None)
