"""The sequential rules of the simulation on small books."""

import pandas as pd
import pytest

from panelforge.operators import simulate as S


def test_buy_and_sell_book_keeping():
    policy = S.Policy(fee=0.001, slippage=0.0, precision=2)
    book = S.Book(1000.0)
    assert S.buy(book, "A", 100.0, 100.0, 1, policy) == (1.0, 100.0)
    assert book.cash == pytest.approx(899.9)
    quantity, fill, pnl, _ = S.sell(book, "A", 150.0, policy)
    assert book.cash == pytest.approx(1049.75) and pnl == pytest.approx(49.85) and not book.held


def test_rounding_slippage_and_minimum():
    assert S.rounded(12.345, 2) == 12.35 and S.rounded(2.9, 0) == 2.0
    book = S.Book(1000.0)
    assert S.buy(book, "A", 10.0, 100.0, 1, S.Policy(slippage=0.01))[1] == pytest.approx(10.1)
    assert S.sell(book, "A", 20.0, S.Policy(slippage=0.01))[1] == pytest.approx(19.8)
    assert S.buy(book, "A", 0.001, 0.5, 1, S.Policy()) is None


def test_stop_before_profit_and_held_pairs_take_top_places():
    policy = S.Policy(top_k=1, take_profit=0.03, stop_loss=0.015)
    p = S.Position(1.0, 100.0, 100.0, 0)
    assert S.exit_reason(p, 98.5, policy) == "stop_loss" and S.exit_reason(p, 103.0, policy) == "take_profit"
    assert S.exit_reason(p, None, policy) is None
    book = S.Book(500.0, {"A": p})
    assert S.intents(book, ["A", "B"], {"A": 100.0, "B": 5.0}, policy) == ([], [])
    exits, entries = S.intents(book, ["A", "B"], {"A": 90.0, "B": 5.0}, S.Policy(top_k=2, max_positions=1))
    assert exits == [("A", "stop_loss")] and entries == []  # the exiting pair still holds its place


def test_run_liquidates_at_the_end(spark):
    rows = [("A", t, 100.0 + t, 1.0) for t in range(5)] + [("B", t, 50.0, None) for t in range(5)]
    frame = pd.DataFrame(rows, columns=["pair", "open_time", "close", "score"])
    plain = S.run(frame, "0/base", S.Policy(take_profit=None, stop_loss=None))
    assert [r[2] for r in plain if r[2] != "EQUITY"] == ["BUY", "SELL"] and plain[-1][5] == "fold_end"
    df = spark.createDataFrame([(0, *r) for r in rows], "fold int, pair string, open_time long, close double, score double")
    got = S.simulate(df, {"base": S.Policy(take_profit=None, stop_loss=None)}).orderBy("seq").collect()
    assert [(r.side, r.pair) for r in got] == [(r[2], r[3]) for r in plain]


def test_equity_metrics(spark):
    eq = spark.createDataFrame([("r", t, v) for t, v in enumerate([100.0, 120.0, 90.0, 110.0, 130.0])], "run string, open_time long, equity double")
    m = S.equity_metrics(eq, every=1).first()
    assert m.total_return == pytest.approx(0.3) and m.max_drawdown == pytest.approx(0.25) and m.sortino is None
