"""Structured Streaming: bars of ticks with a watermark, upserts of late bars, and a running position per pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panelforge.sources import files
from panelforge.sources.bars import keep_last

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV bars of a stream of (pair, ts, price, size, seq); a bar closes once the watermark has passed its end."""
    rank = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("pair", F.window("ts", width).alias("w")).agg(
        F.min_by("price", rank).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", rank).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("pair", F.unix_millis(F.col("w.start").cast("timestamp")).alias("open_time"), "open", "high", "low", "close", "volume")


def upsert_batch(batch: DataFrame, batch_id: int, path: str, seq: str | None = None, keys: tuple[str, ...] = ("pair", "open_time")) -> None:
    """Merges a batch of bars into the days that it touches; files of other days stay as they are.

    A day's bars lie under day=<date>/v=<batch>. A batch reads the version before its own of each day it has rows for,
    keeps the last row of each key (by `seq` if given, later batches first among equals) and writes the day as its own
    version, so a batch that runs again after a failure replaces its own files with the same rows, and a failure in
    between leaves the version before. What is committed is named at the end; older versions than the one read then go.
    """
    spark = batch.sparkSession
    order = F.struct(seq) if seq else F.struct(*sorted(c for c in batch.columns if c not in keys))
    fresh = batch.withColumn("day", F.to_date(F.timestamp_millis("open_time"))).withColumn("_order", order).withColumn("_batch", F.lit(batch_id).cast("long"))
    fresh = keep_last(fresh, list(keys), "_order").drop("_order").persist()
    days = [r["day"].isoformat() for r in fresh.select("day").distinct().collect()]  # a batch touches few days
    before = {d: max((v for v in files.versions(spark, f"{path}/day={d}") if v < batch_id), default=None) for d in days}
    held = [f"{path}/day={d}/v={v}" for d, v in before.items() if v is not None]
    if held:
        old = spark.read.schema(fresh.schema).option("basePath", path).parquet(*held).select(*fresh.columns)
        last = F.struct(*([seq] if seq else []), "_batch")
        fresh_ = keep_last(old.unionByName(fresh).withColumn("_order", last), list(keys), "_order").drop("_order")
    else:
        fresh_ = fresh
    out = fresh_.withColumn("v", F.lit(batch_id)).repartition("day").sortWithinPartitions("day", *keys)
    out.write.partitionBy("day", "v").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    files.mark(spark, f"{path}/_committed", batch_id)
    fresh.unpersist()
    for d, v in before.items():
        for w in files.versions(spark, f"{path}/day={d}"):
            if v is not None and w < v:
                files.delete(spark, f"{path}/day={d}/v={w}")


def upsert_sink(bars: DataFrame, path: str, checkpoint: str, seq: str | None = None) -> StreamingQuery:
    """Writes a stream of bars as upsert_batch() does; stored_bars() reads them."""
    return bars.writeStream.foreachBatch(lambda batch, n: upsert_batch(batch, n, path, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_bars(spark: SparkSession, path: str) -> DataFrame | None:
    """The bars of all days as of the last committed batch; None before the first one."""
    done = files.last_mark(spark, f"{path}/_committed")
    if done is None:
        return None
    held = []
    for day in files.names(spark, path):
        if day.startswith("day="):
            found = [v for v in files.versions(spark, f"{path}/{day}") if v <= done]
            held += [f"{path}/{day}/v={max(found)}"] if found else []
    return spark.read.option("basePath", path).parquet(*held).drop("day", "v", "_batch") if held else None


class Positions(StatefulProcessor):
    """Quantity and cost of one pair, until it has had no fill for idle_ms of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("position", StructType([StructField("quantity", DoubleType()), StructField("cost", DoubleType()), StructField("last_ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        quantity, cost, last = self.held.get() if self.held.exists() else (0.0, 0.0, 0)
        fills = pd.concat(list(rows)).sort_values(["ts", "seq"])  # of one pair and batch; the trigger bounds a batch
        for side, q, p in zip(fills["side"], fills["quantity"], fills["price"]):
            if side == "BUY":
                quantity, cost = quantity + q, cost + q * p
            elif quantity > 0:
                cost -= cost * min(q, quantity) / quantity
                quantity = max(quantity - q, 0.0)
        latest = max(last, int(fills["ts"].max().timestamp() * 1000))
        if last and last != latest:
            self.handle.deleteTimer(last + self.idle_ms)
        if last != latest:
            self.handle.registerTimer(latest + self.idle_ms)
        self.held.update((quantity, cost, latest))
        yield pd.DataFrame({"pair": [key[0]], "quantity": [quantity], "cost": [cost], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        quantity, cost, _ = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"pair": [key[0]], "quantity": [quantity], "cost": [cost], "expired": [True]})

    def close(self) -> None:
        pass


def running_positions(fills: DataFrame, idle_ms: int = 30 * 86_400_000, late: str = "1 day") -> DataFrame:
    """Quantity and cost at average price of each pair after every batch of a stream of (pair, ts, seq, side, quantity, price).

    Fills of a batch apply in the order of ts and seq; a sell takes its share of the cost, and no more than is held. A
    pair without fills for idle_ms of event time gives a last row with `expired` and starts anew. State is kept in
    RocksDB, so its size is not bound to memory; the session's setting is put there.
    """
    fills.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = fills.withWatermark("ts", late).groupBy("pair")
    return keyed.transformWithStateInPandas(Positions(idle_ms), "pair string, quantity double, cost double, expired boolean", "Update", "EventTime")
