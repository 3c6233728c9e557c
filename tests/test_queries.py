"""Driver queries against their SQL on the smallest tables, and streaming on files."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.plans import diagnostics, registry  # noqa: F401
from panelforge.sources import bars as B
from panelforge.streaming import bars as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, values):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in values), key=str)


@pytest.mark.parametrize("name", ["bars_ohlcv", "vpin", "z_momentum_x_low_roll_impact", "ic_by_time", "ridge_select", "decision_features", "policy_grid", "asof_prior", "equity_metrics", "ic_summary", "shadow_filter_report", "forward_report", "health_issues", "walk_forward_metrics", "late_bars_upsert", "jsonl_slice", "json_records", "csv_roundtrip", "asof_hot_key", "ic_pooled_spearman", "walkforward_eval", "kmeans_fixed_init", "live_pair"])
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert rows(columns, map(tuple, df.select(*columns).collect())) == rows(columns, want)


def test_entry_and_names(spark):
    assert {"pair", "open_time", "z_momentum", "place"} == set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_bars_equal_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    S.upsert_sink(S.stream_bars(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.pair, r.open_time): r.close for r in S.stored_bars(spark, str(tmp_path / "out")).collect()}
    want = {(r.pair, r.open_time): r.close for r in B.hourly_bars(spark, SF).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 10
