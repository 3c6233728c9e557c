"""Session settings shared by the command line, the benchmark and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "panelforge") -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution on."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the folder of spark.checkpoint.dir and reads it again.

    For tables that a query reads several times: they are computed once, and a lost executor costs no more than a read.
    Where the setting is unset, a local master gets a temporary folder; others must set it, as machines share nothing else.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or a temporary one set here for a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def small_side(df: DataFrame, most_bytes: int = 64 << 20, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast only if it is counted and small: rows times row_bytes (a bound of a row) under the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str, most_literals: int = 2_000) -> DataFrame:
    """A table of a few rows known to the driver, as literals of the plan: no Python worker makes it, as createDataFrame's would."""
    if len(rows) > most_literals:
        return spark.createDataFrame(rows, schema)
    fields = [f.split() for f in schema.split(", ")]
    row = lambda values: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(values, fields)])
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.array(*[row(r) for r in rows]))) if rows else one.select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields]).limit(0)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
