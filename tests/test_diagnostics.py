"""Diagnostics and monitoring on small tables with known results."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelforge.functions.expr import erf
from panelforge.operators import diagnostics as D
from panelforge.operators import monitoring as M
from panelforge.operators import regime, ridge
from panelforge.plans import diagnostics, registry  # noqa: F401
from panelforge.sources import bars as B

TRADES = "event_time long, pair string, side string, price double, quantity double, fee double, reason string, entry_time long, pnl double, return_pct double"
H = 3_600_000


def trades(spark):
    buy = lambda t, p: (t * H, p, "BUY", 10.0, 1.0, 0.1, None, None, None, None)
    sell = lambda t, p, e, r, x: (t * H, p, "SELL", 10.0 + x, 1.0, 0.1, r, e * H, x, x / 10)
    return spark.createDataFrame([buy(1, "A"), sell(3, "A", 1, "loss_threshold", -1.0), buy(5, "A"), sell(6, "A", 5, "gain_threshold", 2.0), buy(20, "A"), buy(1, "B")], TRADES)


def test_pairing_and_prior_exits(spark):
    equity = spark.createDataFrame([(H, 2), (5 * H, 1)], "open_time long, positions long")
    paired = D.pair_trades(trades(spark), equity)
    got = {(r.pair, r.entry_time // H): r for r in D.prior_exits(paired).collect()}
    assert len(got) == 4 and got["A", 1].exit_reason == "loss_threshold" and got["A", 20].exit_time is None and got["B", 1].positions_at_entry == 2
    assert not got["A", 1].is_same_pair_reentry and got["A", 5].hours_since_prior_exit == 2 and got["A", 5].prior_exit_reason == "loss_threshold"
    assert got["A", 20].prior_exit_reason == "gain_threshold" and not got["B", 1].is_same_pair_reentry
    assert D.pair_trades(trades(spark).limit(0)).count() == 0


def test_filters_and_missing_inputs(spark):
    schema = "score_gap double, trailing_gap double, top3_count_3 long, universe_breadth double, is_same_pair_reentry boolean, prior_exit_reason string, entry_rank long, hours_since_prior_exit double, return_pct double, pnl double, tp_hit boolean, sl_hit boolean"
    rows = [(1.0, 0.5, 3, 0.6, False, None, 1, None, 0.1, 1.0, True, False), (1.0, None, 1, None, True, "loss_threshold", 2, 3.0, -0.1, -1.0, False, True), (None, 0.5, None, 0.9, None, None, 1, None, None, None, False, False)]
    got = {(r.filter, r.side): r.entries for r in D.filter_report(spark.createDataFrame(rows, schema)).collect()}
    assert got["avoid_recent_stopped_pair", "kept"] == 2 and got["avoid_recent_stopped_pair", "blocked"] == 1  # no prior exit: kept
    assert got["score_gap_top_half", "kept"] == 1 and got["momentum_hot", "blocked"] == 2 and got["same_pair_reentry_after_tp", "kept"] == 2


def test_gate_decisions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (None, 1.0)], "a double, b double")
    said = [r.d for r in df.select(regime.decide(["a", "b"], [0.0, 0.0], [1.0, 1.0], [[0.0, 0.0], [5.0, 5.0]], [0]).alias("d")).collect()]
    assert [x.reason for x in said] == ["allowed_cluster", "blocked_cluster", "missing_features"] and said[1].cluster_id == 1 and not said[2].allowed
    assert df.select(regime.decide(["a"], [], [], [], []).alias("d")).first().d.reason == "no_centroids"
    entries = spark.createDataFrame([(0.1, 0.2, 1.0)] * 2, "a double, return_pct double, pnl double")
    assert regime.train_gate(entries, ["a"], 3)["centres"] == []  # fewer entries than clusters
    many = spark.createDataFrame([(k % 2 * 9.0 + k / 100, 0.1 if k % 2 else -0.1, 1.0) for k in range(40)], "a double, return_pct double, pnl double")
    gate = regime.train_gate(many, ["a"], 2, first=[[-1.0], [1.0]])
    assert gate["allowed"] == [1] and gate["average_return"] == pytest.approx(0)


def test_folds_back_and_segments():
    folds = ridge.folds_back(datetime(2020, 1, 1), datetime(2022, 1, 1), 2, 12, 3, 30)
    assert [f[0] for f in folds] == [0, 1, 2] and folds[-1][4] == datetime(2022, 1, 1) and folds[0][3] == datetime(2021, 9, 2)
    with pytest.raises(ValueError):
        ridge.folds_back(datetime(2020, 1, 1), datetime(2021, 2, 1), 2, 12, 3, 30)
    cuts = ridge.refit_segments(datetime(2021, 1, 1), datetime(2021, 3, 1), 30, 1)
    assert [(a.month, a.day, x, y) for _, a, _, x, y in cuts] == [(1, 1, True, True), (1, 31, True, False), (2, 1, False, True)]
    assert len(ridge.refit_segments(datetime(2021, 1, 1), datetime(2021, 3, 1), 30, 1, scheduled=False)) == 1


def test_live_helpers(spark):
    state = spark.createDataFrame([("A/USD", 1.0, 2.0), ("B/USD", 1.0, None)], "pair string, quantity double, entry_price double")
    wallet = spark.createDataFrame([("B/USD", 3.0), ("C/USD", 1.0), ("A/USD", 0.0)], "pair string, quantity double")
    assert {(r.pair, r.quantity, r.entry_price) for r in M.reconciled(state, wallet).collect()} == {("B/USD", 3.0, None), ("C/USD", 1.0, None)}
    assets = spark.createDataFrame([("usd", 10.0, 1.0), ("b", 2.0, None), ("x", 5.0, 0.0)], "asset string, free double, locked double")
    ticker = spark.createDataFrame([("B/USD", 4.0), ("X/USD", 0.0)], "pair string, last_price double")
    scores = spark.createDataFrame([("X/USD", 1, 3.0), ("B/USD", 1, 9.0)], "pair string, open_time long, close double")
    prices = M.price_map(ticker, scores)
    assert {r.pair: r.price for r in prices.collect()} == {"B/USD": 4.0, "X/USD": 3.0}
    assert tuple(M.portfolio_value(assets, prices).first()) == (10.0, 34.0)
    assert [(r.pair, r.notional) for r in M.liquidation_intents(assets, ticker).collect()] == [("B/USD", 8.0)]
    now = F.lit("2021-01-02 00:00:00").cast("timestamp")
    logs = spark.createDataFrame([("2021-01-01 12:00:00",), ("2020-12-01 00:00:00",), ("no time",), (None,)], "logged_at string")
    assert M.since(logs, 24, now).count() == 1
    none = spark.createDataFrame([], "logged_at timestamp, execute boolean, success boolean, slippage_bps double, gross_pnl double, gross_return double")
    assert M.live_summary(none, none, none, 24).first().cycles == 0
    assert [r.issue for r in M.log_issues(none, none, now).collect()] == ["no_live_cycles"]


def test_pairs_and_history(spark):
    bars = spark.createDataFrame([("A", 1), ("A", 9), ("B", 5)], "pair string, open_time long")
    assert B.parse_pairs("all") is None and B.parse_pairs(" a, b,", str.upper) == ["A", "B"] and B.parse_pairs("", blank=["X"]) == ["X"]
    assert B.filter_pairs(bars, ["B"]).count() == 1 and B.filter_pairs(bars, None).count() == 3
    with pytest.raises(ValueError, match="C"):
        B.filter_pairs(bars, ["A", "C"])
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "pair string")
    with pytest.raises(ValueError, match="B: too_short; |C: missing"):
        ridge.require_history(bars, wanted, 1, 9)
    ridge.require_history(bars, wanted.limit(1), 1, 9)


def test_erf(spark):
    got = spark.range(-700, 701).select((F.col("id") / 100).alias("x")).select("x", erf(F.col("x")).alias("y")).collect()
    assert max(abs(math.erf(r.x) - r.y) for r in got) < 1e-14


def test_reports_are_written(spark, tmp_path):
    paths = D.write_reports({"a": spark.range(3), "b": spark.range(0)}, str(tmp_path), "run")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["run_a", "run_b"] and spark.read.option("header", True).csv(paths[0]).count() == 3
