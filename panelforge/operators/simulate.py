"""Portfolio simulation: one run is a fold under one policy, and runs are what Spark spreads over its tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expr import safe_div

EVENTS = "run string, seq long, side string, pair string, open_time long, label string, quantity double, price double, entry_time long, pnl double, return_pct double, equity double, cash double, positions long"
TOLERANCE = 1e-12


@dataclass(frozen=True)
class Policy:
    cash: float = 1_000.0
    fee: float = 0.001
    slippage: float = 0.0005
    top_k: int = 1
    max_positions: int = 3
    max_new: int = 1
    fraction: float = 0.3
    take_profit: float | None = 0.03
    stop_loss: float | None = 0.015
    precision: int = 2
    min_order: float = 1.0


@dataclass
class Position:
    quantity: float
    price: float
    value: float
    time: int


@dataclass
class Book:
    """Cash and positions in order of entry."""

    cash: float
    held: dict[str, Position] = field(default_factory=dict)

    def worth(self, prices: dict[str, float]) -> float:
        """Cash and positions; a position without a price counts as nothing."""
        return self.cash + sum(p.quantity * prices.get(k, 0.0) for k, p in self.held.items())


def rounded(quantity: float, precision: int) -> float:
    """Quantity in order units; without decimals it is cut off."""
    return round(quantity, precision) if precision else float(int(quantity))


def exit_reason(position: Position, price: float | None, policy: Policy) -> str | None:
    """stop_loss before take_profit, or None."""
    if price is None or not position.price:
        return None
    change = price / position.price - 1
    if policy.stop_loss is not None and change <= -policy.stop_loss + TOLERANCE:
        return "stop_loss"
    if policy.take_profit is not None and change >= policy.take_profit - TOLERANCE:
        return "take_profit"
    return None


def sell(book: Book, pair: str, price: float, policy: Policy) -> tuple[float, float, float, float] | None:
    """Sells a whole position: (quantity, fill, pnl, return); the entry fee is no part of pnl. None for dust."""
    position = book.held[pair]
    if not rounded(position.quantity, policy.precision) or rounded(position.quantity, policy.precision) * price < policy.min_order:
        return None
    fill = price * (1 - policy.slippage)
    proceeds = position.quantity * fill * (1 - policy.fee)
    book.cash += proceeds
    del book.held[pair]
    pnl = proceeds - position.value
    return position.quantity, fill, pnl, pnl / position.value if position.value else 0.0


def buy(book: Book, pair: str, price: float, notional: float, time: int, policy: Policy) -> tuple[float, float] | None:
    """Buys for about `notional`, capped by cash with fee: (quantity, fill). One position a pair."""
    fill = price * (1 + policy.slippage)
    quantity = min(rounded(notional / price, policy.precision), book.cash / ((1 + policy.fee) * fill))
    if pair in book.held or quantity <= 0 or quantity * price < policy.min_order:
        return None
    book.cash -= quantity * fill * (1 + policy.fee)
    book.held[pair] = Position(quantity, fill, quantity * fill, time)
    return quantity, fill


def intents(book: Book, ranked: list[str], prices: dict[str, float], policy: Policy) -> tuple[list[tuple[str, str]], list[tuple[str, float]]]:
    """(exits with reasons, entries with notionals), both from the state before any trade of this bar.

    The best top_k are taken first and held pairs skipped then; cash is set aside before entries without a price go.
    """
    exits = [(k, r) for k, p in book.held.items() if (r := exit_reason(p, prices.get(k), policy))]
    room = min(policy.max_positions - len(book.held), policy.max_new)
    worth, left, entries = book.worth(prices), book.cash, []
    for pair in [p for p in ranked[: policy.top_k] if p not in book.held][: max(room, 0)]:
        notional = min(worth * policy.fraction, left)
        if notional <= 0:
            break
        left -= notional
        if pair in prices:
            entries.append((pair, notional))
    return exits, entries


def run(frame: pd.DataFrame, name: str, policy: Policy) -> list[tuple]:
    """Trade and equity rows of one run; frame has pair, open_time, close, score."""
    book, rows, last = Book(policy.cash), [], {}
    note = lambda *x: rows.append((name, len(rows), *x))
    for time, bar in frame.sort_values(["open_time", "pair"]).groupby("open_time", sort=True):
        prices = {p: float(c) for p, c in zip(bar["pair"], bar["close"]) if c == c}
        last |= prices
        known = bar[bar["score"].notna()].sort_values(["score", "pair"], ascending=[False, True])
        exits, entries = intents(book, known["pair"].tolist(), prices, policy)
        for pair, reason in exits:
            since = book.held[pair].time
            if done := sell(book, pair, prices[pair], policy):
                note("SELL", pair, int(time), reason, *done[:2], since, *done[2:], None, book.cash, None)
        for pair, notional in entries:
            if done := buy(book, pair, prices[pair], notional, int(time), policy):
                note("BUY", pair, int(time), None, *done, int(time), None, None, None, book.cash, None)
        note("EQUITY", None, int(time), None, None, None, None, None, None, book.worth(prices), book.cash, len(book.held))
    for pair in list(book.held):
        since = book.held[pair].time
        if pair in last and (done := sell(book, pair, last[pair], policy)):
            note("SELL", pair, None, "fold_end", *done[:2], since, *done[2:], None, book.cash, None)
    return rows


def simulate(scores: DataFrame, policies: dict[str, Policy], run_col: str = "fold") -> DataFrame:
    """Events of every run: a run is one value of run_col under one policy, named `value/policy`.

    A run is sequential by nature; runs are independent groups. Every row carries only four columns.
    """
    names = scores.sparkSession.createDataFrame([(k,) for k in policies], "policy string")
    grid = scores.select(F.col(run_col).cast("string").alias("_run"), "pair", "open_time", "close", "score").join(F.broadcast(names))
    columns = [c.split()[0] for c in EVENTS.split(", ")]

    def play(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(run(frame, f"{key[0]}/{key[1]}", policies[key[1]]), columns=columns)
        return out.astype({c: "Int64" for c in ("open_time", "entry_time", "positions")})

    return grid.groupBy("_run", "policy").applyInPandas(play, EVENTS)


def equity_metrics(equity: DataFrame, every: int = 24, a_year: float = 365.0, by: str = "run") -> DataFrame:
    """Return, largest drawdown, Sharpe and Sortino ratio of each run's equity (columns run, open_time, equity).

    Ratios use every 24th row from the first one, population deviations, and need two changes.
    """
    w = Window.partitionBy(by).orderBy("open_time")
    out = equity.select(by, "open_time", "equity").withColumn("_n", F.row_number().over(w) - 1)
    out = out.withColumn("_peak", F.max("equity").over(w)).withColumn("_down", safe_div(F.col("_peak") - F.col("equity"), F.col("_peak")))
    days = out.filter(F.col("_n") % every == 0).withColumn("_r", safe_div(F.col("equity"), F.lag("equity").over(w)) - 1)
    daily = days.groupBy(by).agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"), F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r"))).alias("_l"), F.count(F.when(F.col("_r") < 0, 1)).alias("_k"), F.count("_r").alias("_c"))
    whole = out.groupBy(by).agg(F.min_by("equity", "open_time").alias("_first"), F.max_by("equity", "open_time").alias("_last"), F.max("_down").alias("max_drawdown"), F.count("*").alias("rows"))
    root = F.sqrt(F.lit(a_year))
    ratio = lambda s, ok: F.when(ok, safe_div(F.col("_m"), F.col(s)) * root)
    both = whole.join(daily, by).filter("rows >= 2")
    return both.select(by, (safe_div(F.col("_last"), F.col("_first")) - 1).alias("total_return"), "max_drawdown", ratio("_s", F.col("_c") >= 2).alias("sharpe"), ratio("_l", F.col("_k") > 1).alias("sortino"))
