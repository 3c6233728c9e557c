"""Fits inside the plan, models chosen per fold, the committed pair and what fails in between."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.expr import pearson
from panelforge.operators import live_models, ridge
from panelforge.sources import bars as B
from panelforge.sources import files

WEEK = B.WEEK_MS
X = ["z_momentum", "z_low_roll_impact", "z_momentum_x_low_roll_impact"]


def panel(spark, weeks=140, pairs=10, seed=0):
    r = np.random.default_rng(seed)
    start, rows = live_models._ms(datetime(2020, 1, 6)), []
    for p in range(pairs):
        close = 100.0
        for t in range(weeks):
            close *= math.exp(r.normal() * 0.02)
            a, b = r.normal(), r.normal()
            rows.append((f"P{p}", start + t * WEEK, close, float(a) if r.random() > 0.02 else None, float(b), float(a * b), float(0.4 * a - 0.2 * b + r.normal())))
    return spark.createDataFrame(rows, f"pair string, open_time long, close double, {', '.join(c + ' double' for c in X)}, target_z double")


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pseudo_inverse_of_all_ranks(spark, k):
    r = np.random.default_rng(k)
    cases = []
    for rank in range(k + 1):
        for _ in range(4):
            a = r.normal(size=(k, rank))
            cases.append((a @ a.T, r.normal(size=k)))
    cases += [(np.diag([2.0] * k), np.ones(k)), (np.ones((k, k)), np.arange(k) + 1.0)]
    rows = [(n, [[float(x) for x in row] for row in m], [float(x) for x in v]) for n, (m, v) in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, m array<array<double>>, v array<double>")
    solved = ridge.pseudo_solved([[F.col("m")[i][j] for j in range(k)] for i in range(k)], [F.col("v")[i] for i in range(k)])
    got = {x.n: x.b for x in df.select("n", F.array(*solved).alias("b")).collect()}
    for n, (m, v) in enumerate(cases):
        assert np.allclose(got[n], np.linalg.pinv(m, rcond=1e-10) @ v, atol=1e-6), (n, m)
    with pytest.raises(ValueError):
        ridge.pseudo_solved([[F.lit(1.0)] * 4] * 4, [F.lit(1.0)] * 4)


def test_all_models_in_one_pass(spark):
    df = panel(spark).withColumn("fold", F.lit(1))
    fits = {(r.model, r.alpha): r for r in ridge.fit_models(df, "target_z", [0.5, 5.0], ["fold"]).collect()}
    pdf = df.toPandas()
    for name, x in ridge.MODELS.items():
        whole = pdf.dropna(subset=[*x, "target_z"])
        m, y = whole[x].to_numpy(), whole["target_z"].to_numpy()
        for alpha in (0.5, 5.0):
            assert fits[name, alpha].n == len(whole) and np.allclose(fits[name, alpha].beta, np.linalg.solve(m.T @ m + alpha * np.eye(len(x)), m.T @ y))
    betas = ridge.fit_models(df, "target_z", [0.5, 5.0], ["fold"])
    scores = ridge.score_models(df, betas, ["fold"])
    assert scores.count() == df.count() * 8
    row = scores.filter("model = 'momentum_plus_low_roll' and alpha = 5.0 and z_momentum is not null").first()
    b = fits["momentum_plus_low_roll", 5.0].beta
    assert row.ridge_score == pytest.approx(row.z_momentum * b[0] + row.z_low_roll_impact * b[1])
    assert scores.filter("z_momentum is null and model <> 'low_roll_only' and ridge_score is not null").count() == 0
    chosen = ridge.choose_models(df, betas, "target_z", ["fold"], 3).collect()
    assert sorted(r.model for r in chosen) == sorted(ridge.MODELS)
    one = ridge.fit(df, X[:2], "target_z", [0.5, 5.0], ["fold"])
    best = ridge.select_alpha(df, one, X[:2], "target_z", ["fold"], 3).first()
    assert [(r.alpha, pytest.approx(r.mean_ic)) for r in chosen if r.model == "momentum_plus_low_roll"] == [(best.alpha, best.mean_ic)]


def test_no_job_at_query_building(spark):
    df = panel(spark, 20).withColumn("fold", F.lit(1))
    spark.sparkContext.setJobGroup("building", "none")
    ridge.fit(df, X, "target_z", [1.0], ["fold"])
    ridge.choose_models(df, ridge.fit_models(df, "target_z", [1.0], ["fold"]), "target_z", ["fold"], 3)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    spark.sparkContext.setJobGroup("tests", "all")


def trades_of(decided):
    """Buys of the first two ranks, sold a week later at a price that follows the score."""
    b = decided.filter("entry_rank <= 2")
    none = lambda kind: F.lit(None).cast(kind)
    buy = b.select(F.col("open_time").alias("event_time"), "pair", F.lit("BUY").alias("side"), F.col("close").alias("price"), F.lit(1.0).alias("quantity"), F.lit(0.0).alias("fee"), none("string").alias("reason"), none("long").alias("entry_time"), none("double").alias("pnl"), none("double").alias("return_pct"))
    gain = F.when(F.col("entry_rank") == 1, 0.02).otherwise(-0.01)
    sell = b.select((F.col("open_time") + WEEK).alias("event_time"), "pair", F.lit("SELL").alias("side"), F.col("close").alias("price"), F.lit(1.0).alias("quantity"), F.lit(0.0).alias("fee"), F.lit("rank_decay").alias("reason"), F.col("open_time").alias("entry_time"), (100 * gain).alias("pnl"), gain.alias("return_pct"))
    return buy.unionByName(sell), None


def test_train_commit_and_load(spark, tmp_path, monkeypatch):
    df, pairs, folder = panel(spark), [f"P{k}" for k in range(9)], str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        live_models.load_pair(spark, folder)
    train = lambda **more: live_models.train_live(df, pairs, datetime(2022, 8, 1), trades_of, **{"model": "momentum_plus_low_roll", "ridge_months": 12, "regime_months": 24, "label_ms": 4 * WEEK, "min_assets": 3, "clusters": 2, **more})
    first, gate = train()
    end = live_models._ms(datetime(2022, 8, 1)) - 4 * WEEK
    pdf = df.filter(F.col("pair").isin(pairs)).toPandas().dropna()
    pdf = pdf[(pdf.open_time >= live_models._ms(datetime(2021, 8, 1))) & (pdf.open_time <= end)]
    m, y = pdf[X[:2]].to_numpy(), pdf["target_z"].to_numpy()
    assert np.allclose(first["selection"]["beta"], np.linalg.solve(m.T @ m + first["selection"]["alpha"] * np.eye(2), m.T @ y)) and first["metadata"]["train_rows"] == len(pdf)
    assert len(gate["gate"]["centres"]) == 2 and gate["gate"]["average_return"] == pytest.approx(0.005)
    assert live_models.save_pair(spark, folder, first, gate) == 0
    loaded = live_models.load_pair(spark, folder)
    assert loaded[0]["selection"] == {**first["selection"]} and loaded[1]["gate"]["allowed"] == gate["gate"]["allowed"] and loaded[0]["metadata"]["as_of"] == "2022-08-01T00:00:00"

    written = []
    real = B.save_model

    def fails_at_the_gate(s, model, kind, path):
        if kind == "gate":
            raise OSError("disk lost")
        written.append(path)
        real(s, model, kind, path)

    monkeypatch.setattr(live_models.bars, "save_model", fails_at_the_gate)
    other = {**first, "selection": {**first["selection"], "alpha": 77.0}}
    with pytest.raises(OSError):
        live_models.save_pair(spark, folder, other, gate)
    monkeypatch.undo()
    assert written and live_models.load_pair(spark, folder)[0]["selection"]["alpha"] == first["selection"]["alpha"]  # half a write is not seen
    assert live_models.save_pair(spark, folder, other, gate) == 2 and live_models.load_pair(spark, folder)[0]["selection"]["alpha"] == 77.0
    assert live_models.save_pair(spark, folder, first, gate) == 3 and files.versions(spark, folder) == [2, 3]
    said = live_models.gated_by(spark.createDataFrame([(0.1, 0.2, 1.0), (None, 0.2, 1.0)], "score_gap double, universe_breadth double, top3_count_6 double"), loaded[1]["gate"])
    assert [r.gate.reason == "missing_features" for r in said.collect()] == [False, True]
    with pytest.raises(ValueError, match="P_none: missing"):
        live_models.train_live(df, [*pairs, "P_none"], datetime(2022, 8, 1), trades_of)
    with pytest.raises(ValueError, match="too_short"):
        train(regime_months=60)


def test_rebuilt_scores_equal_the_walk_forward(spark):
    df = panel(spark)
    metadata = {"model": "low_roll_only", "is_months": 6, "os_months": 3, "step_months": 3, "ridge_alphas": [1.0], "pairs": [f"P{k}" for k in range(9)]}
    got = live_models.rebuilt_scores(df, metadata, min_assets=3)
    assert got.columns == ["fold", *df.columns, "alpha", "ridge_score"] and {r.fold for r in got.select("fold").distinct().collect()} >= {0, 1, 2}
    pdf = df.filter("pair <> 'P9'").toPandas()
    start = datetime(2020, 1, 6)
    inside = pdf[(pdf.open_time < live_models._ms(datetime(2020, 7, 6)))]
    beta = (inside[X[1]] * inside.target_z).sum() / ((inside[X[1]] ** 2).sum() + 1.0)
    first = got.filter("fold = 0").first()
    assert start and first.ridge_score == pytest.approx(first.z_low_roll_impact * beta)
    with pytest.raises(ValueError):
        live_models.rebuilt_scores(df, {"pairs": ["none"]})


def test_json_safe_and_records(spark):
    odd = {1: float("nan"), "t": datetime(2020, 1, 2), "d": date(2020, 1, 2), "a": np.array([1.5, float("inf")]), "s": {3, 1}, "n": np.int64(4), "b": True, "x": None, "deep": [{"y": -float("inf")}]}
    assert B.json_safe(odd) == {"1": None, "t": "2020-01-02T00:00:00", "d": "2020-01-02", "a": [1.5, None], "s": [1, 3], "n": 4, "b": True, "x": None, "deep": [{"y": None}]}
    df = spark.createDataFrame([(1, float("nan"), "é\""), (2, None, None)], "n long, v double, s string")
    assert [r.record for r in B.json_records(df).collect()] == ['{"n":1,"v":null,"s":"é\\""}', '{"n":2,"v":null,"s":null}']


def test_coefficients_need_two_distinct_values(spark):
    df = spark.createDataFrame([("flat", 0.1, float(k)) for k in range(7)] + [("two", 0.1 + k % 2, float(k)) for k in range(7)], "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(pearson("x", "y").alias("c")).collect()}
    assert got["flat"] is None and got["two"] is not None
