"""Small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES, BATCH_ROWS = 2 << 20, 4_000
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one set here where none is set.

    A temporary folder lies on this machine, so only a local master gets one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends here and survives lost executors.

    The table stays, as results that have not run yet read it; inside scratch() it goes at the end of that block.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() wrote inside. Results must have been written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, whatever its kind."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores before it as long as a column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_side(df: DataFrame, most_bytes: int = 64 << 20, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast only if it is counted and small: rows times row_bytes under the bound. df should be stored.

    row_bytes must bound the size of a row; rows with lists or texts go through measured_side().
    """
    return hinted(df, df.count(), most_bytes, row_bytes)


def measured_side(df: DataFrame, size: str, most_bytes: int = 64 << 20, row_bytes: int = 64) -> DataFrame:
    """As small_side(), for rows of any size: `size` is an SQL expression for the bytes that a row has besides row_bytes."""
    rows, more = df.agg(F.count("*"), F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()
    return F.broadcast(df) if rows * row_bytes + more <= most_bytes else df


def hinted(df: DataFrame, rows: int, most_bytes: int = 64 << 20, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast only if the given bound of its rows is small."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to 2 MiB and 4,000 rows, where they are higher.

    A batch of ten thousand long texts takes hundreds of megabytes in each Python worker. A row longer than the limit is
    a batch of its own, so no text is cut.
    """
    most = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_tables: dict[str, list[Callable]] = {}
_owner: str | None = None


def held_by(owner: str) -> Callable:
    """Marks a cached function whose values belong to the tasks of `owner`; see lean()."""

    def mark(cached: Callable) -> Callable:
        _tables.setdefault(owner, []).append(cached)
        return cached

    return mark


def lean(function: Callable, owner: str) -> Callable:
    """`function` over batches, for Python workers that live on from stage to stage.

    At its start the tables that tasks of other owners cached in this worker go; at its end freed memory goes back to
    the system, which allocators otherwise keep for the worker's next stage.
    """

    @functools.wraps(function)
    def run(batches):
        _claim(owner)
        try:
            yield from function(batches)
        finally:
            _trim()

    return run


def _claim(owner: str) -> None:
    global _owner
    if _owner != owner:
        for other, cached in _tables.items():
            if other != owner:
                for c in cached:
                    c.cache_clear()
        _owner = owner
        _trim()


def _trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
