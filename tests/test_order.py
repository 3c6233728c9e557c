"""Global places, ranks, quantiles and as-of joins against pandas and numpy: ties, nulls, hot keys, many blocks, speed."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import ic, order, reports


def test_numbered_places(spark):
    rows = [(k % 7, f"r{k * 37 % 100}") for k in range(100)]
    got = order.numbered(spark.createDataFrame(rows, "a int, b string").repartition(6), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows) and sorted(r.place for r in got) == list(range(100))
    assert order.numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_tie_ranks_match_pandas(spark):
    r = random.Random(1)
    rows = [(r.choice("uv"), r.choice([0.0, 0.0, 1.0, r.random()]), k) for k in range(400)]
    got = order.tie_ranks(spark.createDataFrame(rows, "g string, x double, k int"), ["g"], "x", ["k"], "rank").toPandas().set_index("k").sort_index()
    pdf = pd.DataFrame(rows, columns=["g", "x", "k"]).set_index("k").sort_index()
    assert np.allclose(got["rank"], pdf.groupby("g")["x"].rank())


def test_pooled_spearman_deals_one_feature_over_tasks(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"pair": [f"P{k % 5}" for k in range(3000)], "open_time": range(3000), "f": r.normal(size=3000).round(1), "y": r.normal(size=3000)})
    pdf.loc[::3, "f"] = 0.5  # a third of the rows share a value
    pdf.loc[5, "f"] = None
    df = spark.createDataFrame(pdf).withColumn("f", F.when(~F.isnan("f"), F.col("f")))
    got = ic.coefficients(df, ["f"], "y").first()
    assert got.n == 2999 and abs(got.ic - pdf.dropna()["f"].rank().corr(pdf.dropna()["y"].rank())) < 1e-9
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = order.numbered(df, ["f", "pair", "open_time"]).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread.max() <= 0.5 * spread.sum()


@pytest.mark.parametrize("most, buckets", [(4096, 1024), (8, 64)])
def test_quantiles_match_numpy(spark, most, buckets):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=500), "b": np.repeat([1.0, 2.0, 7.0], 100), None: np.exp(r.normal(size=300) * 20), "c": np.array([3.0]), "d": np.r_[[-1e300, 1e300], r.normal(size=60)], "e": np.zeros(50)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    wanted = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q0": 0.0, "q1": 1.0}
    got = {row.g: row for row in order.quantiles(df, ["g"], "x", wanted, most, buckets).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        for name, q in wanted.items():
            assert np.isclose(got[g][name], np.quantile(v, q), rtol=1e-12), (g, name)
    whole = order.quantiles(df, [], "x", {"m": 0.5}, most, buckets).collect()
    assert len(whole) == 1 and np.isclose(whole[0].m, np.median([x for _, x in rows if x is not None]))
    assert [tuple(x) for x in order.quantiles(df.limit(0), [], "x", {"m": 0.5}).collect()] == [(None,)]
    summed = order.with_quantiles(df.groupBy("g").agg(F.count("x").alias("n")), df, ["g"], "x", {"m": 0.5}, False).collect()
    assert {r.g: r.n for r in summed} == {**{g: len(v) for g, v in groups.items()}, "none": 0}


def test_fenwick():
    tree, held, r = order.Fenwick([0] * 50), [], random.Random(4)
    for _ in range(200):
        p = r.randrange(50)
        tree.add(p)
        held = sorted([*held, p])
        assert [tree.kth(k) for k in range(len(held))] == held


@pytest.mark.parametrize("block", [None, 16, 64])
@pytest.mark.parametrize("shape", ["noise", "trend", "ties"])
def test_expanding_quantile_matches_pandas(spark, block, shape):
    r = np.random.default_rng(5)
    v = {"noise": r.normal(size=700), "trend": np.arange(700) - 350 + r.normal(size=700), "ties": r.integers(0, 4, 700).astype(float)}[shape]
    v[r.integers(0, 700, 60)] = np.nan
    v[:5] = np.nan
    pdf = pd.DataFrame({"t": r.permutation(700) * 10, "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    pdf = pdf.sort_values("t")
    for q, least in ((0.5, 24), (0.8, 1)):
        got = order.expanding_quantile(df, "t", "v", q, least, "m", block).toPandas().sort_values("t")
        want = pdf["v"].expanding(least).quantile(q).shift(1)
        assert np.allclose(got["m"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("block", [4096, 1])
def test_rolling_quantile_matches_pandas(spark, block):
    r = np.random.default_rng(6)
    v = r.integers(0, 30, 500).astype(float)
    v[r.integers(0, 500, 50)] = np.nan
    pdf = pd.DataFrame({"t": r.permutation(500), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = order.rolling_quantile(df, "t", "v", 0.8, 37, "m", "n", block).toPandas().sort_values("t")
    past = pdf.sort_values("t")["v"].shift(1).rolling(37, min_periods=1)
    assert np.allclose(got["m"].astype(float), past.quantile(0.8), equal_nan=True) and (got["n"].to_numpy() == past.count().fillna(0).to_numpy()).all()


def test_running_sum(spark):
    df = spark.createDataFrame([(k * 3 % 101, k) for k in range(101)], "t int, v int")
    got = order.running_sum(df, "t", "v", "s", block=10).orderBy("t").collect()
    assert [r.s for r in got] == list(np.cumsum([r.v for r in got]))


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_asof_with_a_hot_key(spark, most):
    r = random.Random(7)
    key = lambda: r.choice(["hot", "hot", None, *"abcdef"])
    times = r.sample(range(2000), 1200)
    left, right = [(k, key(), t) for k, t in enumerate(times[:700])], [(key(), t, f"e{t}") for t in times[700:]] + [("hot", None, "never")]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, w int, v string")
    out = reports.prior_event(a, b, ["k"], "t", "w", ["v"], most)
    got = {x.id: (x.prior_time, x.prior_v) for x in out.collect()}
    for i, k, t in left:
        before = [(w, v) for g, w, v in right if g == k and w is not None and w < t]
        assert got[i] == (max(before) if before else (None, None)), (k, t)
    assert out.count() == len(left)


def test_asof_with_many_blocks(spark):
    """The work of a row doesn't grow with the number of blocks, here 8,000; equal times may lie on both sides of a cut."""
    ids = spark.range(400_000).select("id", (F.col("id") * 7919 % 40_009).alias("t"))
    events = ids.filter("id % 40 = 1").groupBy("t").agg(F.max("id").alias("e")).select(F.lit("hot").alias("k"), F.col("t").alias("w"), "e")
    rows = ids.filter("id % 40 <> 1").select(F.lit("hot").alias("k"), "id", "t")
    began = time.time()
    got = reports.prior_event(rows, events, ["k"], "t", "w", ["e"], most=50).toPandas().sort_values("id")
    took = time.time() - began
    want = pd.merge_asof(rows.toPandas().sort_values("t"), events.toPandas().sort_values("w"), left_on="t", right_on="w", allow_exact_matches=False).sort_values("id")
    assert len(got) == 390_000 and np.array_equal(got["prior_e"].fillna(-1), want["e"].fillna(-1)) and np.array_equal(got["prior_time"].fillna(-1), want["w"].fillna(-1))
    assert took < 30, took


@pytest.mark.parametrize("most", [1, 7])
def test_asof_with_equal_times(spark, most):
    """Blocks inside one time and one key, without keys' values and without events."""
    left = [(i, k, t) for i, (k, t) in enumerate([("a", 5)] * 30 + [("a", 6)] * 9 + [("b", 5)] * 8 + [(None, 4)] * 8 + [("a", None)] * 3)]
    right = [("a", 5, "x"), ("a", 4, "w"), (None, 3, "n"), ("c", 1, "c")]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, w int, v string")
    got = {x.id: x.prior_v for x in reports.prior_event(a, b, ["k"], "t", "w", ["v"], most).collect()}
    assert got == {i: {("a", 5): "w", ("a", 6): "x", (None, 4): "n"}.get((k, t)) for i, k, t in left}


def test_a_million_times(spark):
    """The expanding median of a million times ends in half a minute and takes several tasks."""
    df = spark.range(1_000_000).select(F.col("id").alias("t"), F.sin(F.col("id") * 1.7).alias("v"))
    began = time.time()
    out = order.expanding_quantile(df, "t", "v", 0.5, 24, "m")
    last = out.agg(F.max_by("m", "t"), F.count("m")).first()
    took = time.time() - began
    want = np.median(np.sin(np.arange(999_999) * 1.7))
    assert last[1] == 1_000_000 - 24 and abs(last[0] - want) < 1e-9 and took < 30, took
