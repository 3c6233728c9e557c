"""Bars from trade-like rows, and files that hold bars, logs and models."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.expr import null_nan
from panelforge.operators.order import numbered, quantiles
from panelforge.session import stored, table

BAR_SCHEMA = T.StructType(
    [T.StructField("pair", T.StringType()), T.StructField("open_time", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
WEEK_MS = 604_800_000
HOUR_MS = 3_600_000


def ohlcv(ticks: DataFrame, order: list[str], unit: str) -> DataFrame:
    """Bars of (pair, ts, price, size) rows by calendar unit; `order` ranks ticks inside a bar without ties.

    One partial aggregate per bar and task: the shuffle carries bars, not ticks.
    """
    rank = F.struct(*order)
    start = F.unix_millis(F.date_trunc(unit, F.col("ts").cast("timestamp")))
    bars = ticks.withColumn("open_time", start).groupBy("pair", "open_time")
    return bars.agg(
        F.min_by("price", rank).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", rank).alias("close"),
        F.sum("size").alias("volume"),
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of the part brands, from line items. Brands are joined to lines by a small table of parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pair"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    ticks = lines.select("pair", F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ohlcv(ticks, ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "week")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type; an event counts as one unit of volume."""
    events = table(spark, sf_dir, "events")
    ticks = events.select(F.col("event_type").alias("pair"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id")
    return ohlcv(ticks, ["ts", "event_id"], "hour")


def keep_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the highest sequence number."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = ["pair", "open_time"]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_seq").drop("_seq")


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each pair."""
    w = Window.partitionBy("pair").orderBy(F.col("open_time").desc())
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def coverage(bars: DataFrame) -> DataFrame:
    """First and last bar and count of each pair."""
    return bars.groupBy("pair").agg(F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar"), F.count("*").alias("bars"))


def common_history(bars: DataFrame) -> DataFrame:
    """Pairs with the longest history that starts first and ends last."""
    c = coverage(bars)
    all_ = c.agg(F.min("first_bar").alias("_a"), F.max("last_bar").alias("_b"), F.max("bars").alias("_n"))
    return c.join(F.broadcast(all_)).filter("first_bar = _a and last_bar = _b and bars = _n").select("pair", "bars")


def bar_delta(bars: DataFrame) -> DataFrame:
    """Median gap of the distinct times, in ms; 0 for fewer than two."""
    times = stored(numbered(bars.select("open_time").distinct(), ["open_time"], "at"), "times")
    before = times.select((F.col("at") + 1).alias("at"), F.col("open_time").alias("before"))
    gaps = times.join(before, "at").select((F.col("open_time") - F.col("before")).alias("gap"))
    return quantiles(gaps, [], "gap", {"delta_ms": 0.5}).select(F.coalesce("delta_ms", F.lit(0.0)).alias("delta_ms"))


def normal_time(x: Column, kind: str) -> Column:
    """A UTC timestamp from milliseconds or from text, by the column's type; what cannot be read is NULL."""
    return F.timestamp_millis(x) if kind in ("int", "bigint", "long") else F.try_to_timestamp(x).cast("timestamp")


def parse_pairs(text: str | None, form: Callable[[str], str] = str.upper, blank: list[str] | None = None) -> list[str] | None:
    """The pairs of a comma-separated list in one form; None (all pairs) for `all`, `blank` for an empty list."""
    if text is not None and text.strip().lower() == "all":
        return None
    found = [form(x.strip()) for x in (text or "").split(",") if x.strip()]
    return found or blank


def filter_pairs(rows: DataFrame, pairs: list[str] | None) -> DataFrame:
    """Rows of the given pairs, all for None; ValueError if one of them has no row."""
    if pairs is None:
        return rows
    wanted = rows.filter(F.col("pair").isin(pairs))
    gone = sorted(set(pairs) - {r["pair"] for r in wanted.select("pair").distinct().collect()})
    if gone:
        raise ValueError(f"no rows for: {', '.join(gone)}")
    return wanted


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Bars of all given files, last copy of a key by file order; NaN is read as NULL."""
    out = None
    for k, path in enumerate(paths):
        part = spark.read.option("header", True).option("nanValue", "NaN").schema(schema).csv(path).withColumn("_seq", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    clean = out.select(*[F.when(F.isnan(c.name), None).otherwise(F.col(c.name)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else c.name for c in schema], "_seq")
    return keep_last(clean, ["pair", "open_time"], "_seq").drop("_seq")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends JSON lines, with logged_at unless the rows have one."""
    out = df if "logged_at" in df.columns else df.withColumn("logged_at", F.current_timestamp())
    out.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_safe(value):
    """A value that JSON can hold: times as ISO text, arrays as lists, numbers that are not finite as null, keys as text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if hasattr(value, "tolist"):  # numpy's arrays and numbers
        return json_safe(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def json_records(df: DataFrame) -> DataFrame:
    """One column, `record`: each row as a JSON object with all of its columns, numbers that are not finite as null."""
    kinds = dict(df.dtypes)
    clean = [null_nan(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("record"))


def save_model(spark: SparkSession, model: dict, kind: str, path: str) -> None:
    """A model artifact as one line of JSON; numbers that are not finite become null."""
    clean = json_safe({"artifact_version": 1, "kind": kind, **model})
    spark.createDataFrame([(json.dumps(clean),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str, kind: str) -> dict:
    model = json.loads(spark.read.text(path).first()[0])
    if model.get("kind") != kind:
        raise ValueError(f"expected a {kind} artifact, found {model.get('kind')}")
    return model
