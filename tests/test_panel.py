"""Features, labels, coefficients and regimes against hand values and plain formulas."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.expr import erf, pct_rank, zscore
from panelforge.operators import features as X
from panelforge.operators import ic, regime, reports, ridge
from panelforge.sources import bars as B

HOUR = 3_600_000


def panel(spark, pairs=3, n=40, seed=1):
    r = random.Random(seed)
    rows = []
    for p in range(pairs):
        price = 100.0
        for t in range(n):
            price *= 1 + r.uniform(-0.02, 0.02)
            rows.append((f"P{p}", t * HOUR, price, price * 1.01, price * 0.99, price, r.uniform(1, 5)))
    return spark.createDataFrame(rows, "pair string, open_time long, open double, high double, low double, close double, volume double")


def test_erf_series(spark):
    xs = [-7.0, -2.5, -0.1, 0.0, 0.3, 1.0, 5.9, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erf(F.col("x"))).collect()]
    assert np.allclose(got, [math.erf(x) for x in xs], atol=1e-14)


def test_micro_and_alpha_match_pandas(spark):
    w = 5
    df = panel(spark)
    got = X.alpha(X.microstructure(df, w), (4,)).toPandas().sort_values(["pair", "open_time"]).reset_index(drop=True)
    for _, g in got.groupby("pair"):
        p, v = g["close"], g["volume"]
        d = p.diff()
        assert np.allclose(g["roll_measure"], 2 * np.sqrt(d.rolling(w).cov(d.shift(1)).abs()), equal_nan=True)
        assert np.allclose(g["amihud"], (p.pct_change().abs() / (p * v)).rolling(w).mean(), equal_nan=True)
        assert np.allclose(g["kyle_lambda"], (p - p.shift(w)) / (np.sign(d) * v).rolling(w + 1).sum(), equal_nan=True)
        z = d / d.rolling(w).std()
        assert np.allclose(g["vpin"], z.map(lambda x: abs(math.erf(x / math.sqrt(2))), na_action="ignore").rolling(w).mean(), equal_nan=True)
        r = np.log(p / p.shift(1))
        assert np.allclose(g["vol_adj_momentum_4"], np.log(p / p.shift(4)) / r.rolling(4).std(), equal_nan=True)
        assert np.allclose(g["trend_persistence_4"], 2 * (r > 0).astype(float).rolling(4).mean() - 1, equal_nan=True)


def test_no_look_ahead(spark):
    full, cut = panel(spark), panel(spark).filter(F.col("open_time") < 30 * HOUR)
    make = lambda d: X.signals(X.cross_section(X.alpha(X.microstructure(d, 5), (4,)), (4,)), "vol_adj_momentum_4").toPandas().set_index(["pair", "open_time"]).sort_index()
    a, b = make(full), make(cut)
    pd.testing.assert_frame_equal(a.loc[b.index], b)


def test_flat_prices_and_missing_columns(spark):
    flat = spark.createDataFrame([("A", t, 1.0, 1.0, 1.0, 1.0, 0.0) for t in range(8)], "pair string, open_time long, open double, high double, low double, close double, volume double")
    r = X.alpha(X.microstructure(flat, 3), (3,)).orderBy("open_time").collect()[-1]
    assert r.amihud is None and r.vpin is None and r.vol_adj_momentum_3 is None and r.breakout_quality_3 is None
    with pytest.raises(ValueError, match="volume"):
        X.microstructure(flat.drop("volume"), 3)


def test_rank_and_zscore(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, None), (2, 3.0)], "open_time long, x double")
    got = df.select("open_time", "x", pct_rank(F.col("x")).alias("k"), zscore(F.col("x")).alias("z")).collect()
    assert sorted((r.x, r.k) for r in got if r.open_time == 1 and r.x) == [(1.0, 1 / 3), (5.0, 2.5 / 3), (5.0, 2.5 / 3)]
    assert all(r.k is None for r in got if r.x is None) and all(r.z is None for r in got if r.open_time == 2)


def test_labels(spark):
    df = panel(spark, 2, 6)
    got = X.target(X.forward_return(df, 2), 2).toPandas().sort_values(["pair", "open_time"])
    for _, g in got.groupby("pair"):
        assert np.allclose(g["forward_return_2"], g["close"].shift(-2) / g["close"] - 1, equal_nan=True)
    assert got["target_z"].dropna().abs().round(6).eq(round(1 / math.sqrt(2), 6)).all()
    with pytest.raises(ValueError):
        X.forward_return(df, 1, "other")


def test_spearman_ties_and_constants(spark):
    rows = [("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 5.0, None), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, f double, y double")
    got = {r.g: (r.n, r.ic) for r in ic.coefficients(df, ["f"], "y", ["g"]).collect()}
    want = pd.Series([1.0, 1.0, 2.0]).rank().corr(pd.Series([1.0, 2.0, 3.0]))
    assert got["a"][0] == 3 and abs(got["a"][1] - want) < 1e-12 and got["b"] == (3, None)


def test_folds_clamp_and_fail():
    folds = ridge.month_folds(datetime(2020, 1, 31), datetime(2020, 8, 1), 2, 1, 1)
    assert [f[1].day for f in folds][:3] == [31, 29, 29] and folds[0][3] == datetime(2020, 3, 31)
    with pytest.raises(ValueError):
        ridge.month_folds(datetime(2020, 1, 1), datetime(2020, 2, 1), 2, 1, 1)


def test_ridge_fit_matches_closed_form(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 2))
    y = x @ [0.5, -0.2] + r.normal(size=50) * 0.1
    df = spark.createDataFrame([(0, *map(float, a), float(b)) for a, b in zip(x, y)], "fold int, a double, b double, y double")
    beta = ridge.fit(df, ["a", "b"], "y", [3.0], ["fold"]).first().beta
    assert np.allclose(beta, np.linalg.solve(x.T @ x + 3 * np.eye(2), x.T @ y))


def test_stress_uses_prior_rows_only(spark):
    df = spark.createDataFrame([(t, float(t)) for t in range(6)], "open_time long, m double")
    got = {r.open_time: (r.threshold, r.is_stressed) for r in regime.market_stress(df, "m", 0.5, 10, 3).collect()}
    assert got[2] == (None, False) and got[3] == (1.0, True)


def test_kmeans_separates(spark):
    rows = [(float(i % 2 * 10 + i / 100), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double")
    centres = regime.kmeans(df, ["a", "b"], [[-0.1, -0.1], [0.1, 0.1]])
    assert centres[0][0] < -0.9 and centres[1][0] > 0.9


def test_asof_is_strict(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 5, "z"), ("a", None, "n")], "k string, w long, v string")
    got = {(r.k, r.t): r.prior_v for r in reports.prior_event(left, right, ["k"], "t", "w", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_files(spark, tmp_path):
    df = panel(spark, 1, 3)
    B.write_csv(df, str(tmp_path / "a"))
    B.write_csv(df.limit(1).withColumn("close", F.lit(7.0)), str(tmp_path / "b"))
    back = B.read_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")], df.schema)
    assert back.count() == 3 and back.filter("close = 7").count() == 1
    B.save_model(spark, {"beta": [1.0, float("nan")]}, "ridge", str(tmp_path / "m"))
    assert B.load_model(spark, str(tmp_path / "m"), "ridge")["beta"] == [1.0, None]
    with pytest.raises(ValueError):
        B.load_model(spark, str(tmp_path / "m"), "gate")
