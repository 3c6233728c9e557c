"""Trade logs paired to entries, the market state at entry, and the reports built on both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import reports
from panelforge.operators.order import edges, with_quantiles
from panelforge.session import stored

HOUR_MS = 3_600_000
SELL_COLUMNS = {"event_time": "exit_time", "price": "exit_price", "reason": "exit_reason", "fee": "exit_fee", "pnl": "pnl", "return_pct": "return_pct"}
FEATURES = [
    "entry_rank", "leader", "top_score", "second_score", "median_score", "score_gap", "median_gap", "trailing_gap", "pair_return",
    "universe_breadth", "universe_return", "universe_volatility", *[f"top3_count_{n}" for n in (3, 6, 12)], *[f"rank1_count_{n}" for n in (3, 6, 12)],
]


def pair_trades(trades: DataFrame, equity: DataFrame | None = None) -> DataFrame:
    """BUY rows with the SELL that closed them (pair and entry_time), if there is one, and the positions held then.

    trades: event_time, pair, side, price, quantity, fee, reason, entry_time (of sells), pnl, return_pct. A buy without a
    sell has NULL outcomes. Both sides are dealt by (pair, entry_time), so a pair with very many trades is no single task.
    """
    buys = trades.filter("side = 'BUY'").select("pair", F.col("event_time").alias("entry_time"), F.col("price").alias("entry_price"), "quantity", "fee")
    sells = trades.filter("side = 'SELL'").select("pair", "entry_time", *[F.col(a).alias(b) for a, b in SELL_COLUMNS.items()])
    out = buys.join(sells, ["pair", "entry_time"], "left")
    if equity is None:
        return out
    return out.join(equity.select(F.col("open_time").alias("entry_time"), F.col("positions").alias("positions_at_entry")), "entry_time", "left")


def entry_regime(entries: DataFrame, features: DataFrame, score: str = "ridge_score") -> DataFrame:
    """Paired entries with the decision features of their time, exit flags, holding hours and the pair's prior exit."""
    side = features.select("pair", F.col("open_time").alias("entry_time"), F.col(score).alias("entry_score"), *FEATURES)
    out = entries.join(side, ["pair", "entry_time"], "left")
    is_ = lambda reason: F.coalesce(F.col("exit_reason") == reason, F.lit(False))
    out = out.withColumn("tp_hit", is_("gain_threshold")).withColumn("sl_hit", is_("loss_threshold")).withColumn("fold_end_exit", is_("fold_end"))
    return prior_exits(out.withColumn("holding_hours", (F.col("exit_time") - F.col("entry_time")) / HOUR_MS))


def prior_exits(entries: DataFrame) -> DataFrame:
    """entries with the last exit of the same pair strictly before: its time, reason, the hours since, and whether there is one.

    Of exits at the same time, that of the latest entry counts.
    """
    exits = entries.filter("exit_time is not null").groupBy("pair", F.col("exit_time").alias("_t")).agg(F.max_by("exit_reason", "entry_time").alias("exit_reason_"))
    out = reports.prior_event(entries, exits, ["pair"], "entry_time", "_t", ["exit_reason_"])
    out = out.withColumnsRenamed({"prior_time": "prior_exit_time", "prior_exit_reason_": "prior_exit_reason"})
    out = out.withColumn("hours_since_prior_exit", (F.col("entry_time") - F.col("prior_exit_time")) / HOUR_MS)
    return out.withColumn("is_same_pair_reentry", F.col("prior_exit_time").isNotNull())


def outcome_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, closed count, mean and win rate of the returns, summed pnl, and shares of take-profit and stop exits."""
    r = F.col("return_pct")
    return rows.groupBy(*by).agg(
        F.count("*").alias("entries"), F.count(r).alias("closed"), F.avg(r).alias("mean_return"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"), F.sum("pnl").alias("pnl"),
        F.avg(F.col("tp_hit").cast("double")).alias("tp_rate"), F.avg(F.col("sl_hit").cast("double")).alias("sl_rate"),
    )


OUTCOME_COLUMNS = ["pair", "entry_time", "exit_time", "exit_reason", "entry_rank", "entry_score", "score_gap", "top3_count_3", "holding_hours", "return_pct", "pnl", "tp_hit", "sl_hit"]


def outcome_attribution(entries: DataFrame) -> DataFrame:
    """One row per entry: what it looked like and how it ended."""
    return entries.select(*OUTCOME_COLUMNS)


def rank_persistence(entries: DataFrame, windows: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Outcomes by metric (top-three counts over each window) and bucket; a missing count is a bucket of its own."""
    pairs = F.array(*[F.struct(F.lit(f"top3_count_{n}").alias("metric"), F.col(f"top3_count_{n}").cast("long").alias("bucket")) for n in windows])
    return outcome_summary(entries.withColumn("_m", F.explode(pairs)).select("*", "_m.*"), ["metric", "bucket"])


def known(condition: Column) -> Column:
    """The condition, false where an input is missing."""
    return F.coalesce(condition, F.lit(False))


def standard_filters() -> dict[str, Column]:
    """The five entry filters. Each comparison is false on missing inputs before it is negated or combined."""
    wide, steady = known(F.col("score_gap") >= F.col("trailing_gap")), known(F.col("top3_count_3") >= 2)
    reason = lambda x: known(F.col("prior_exit_reason") == x)
    return {
        "score_gap_top_half": wide,
        "rank_persistent_top3": steady,
        "momentum_hot": steady & wide & known(F.col("universe_breadth") >= 0.5),
        "same_pair_reentry_after_tp": ~known(F.col("is_same_pair_reentry")) | (reason("gain_threshold") & known(F.col("entry_rank") == 1) & known(F.col("score_gap") > 0)),
        "avoid_recent_stopped_pair": ~(reason("loss_threshold") & known(F.col("hours_since_prior_exit") <= 6)),
    }


def filter_report(entries: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """Outcomes of the entries that each filter would have kept and blocked; one pass over the entries."""
    tags = F.array(*[F.struct(F.lit(k).alias("filter"), F.when(c, "kept").otherwise("blocked").alias("side")) for k, c in (filters or standard_filters()).items()])
    return outcome_summary(entries.withColumn("_f", F.explode(tags)).select("*", "_f.*"), ["filter", "side"])


def same_pair_reentry(entries: DataFrame) -> DataFrame:
    """Entries into a pair that had an exit before."""
    return entries.filter("is_same_pair_reentry").select("pair", "entry_time", "prior_exit_time", "prior_exit_reason", "hours_since_prior_exit", "return_pct")


def post_exit_returns(exits: DataFrame, bars: DataFrame, horizons: list[int], bar_ms: int) -> DataFrame:
    """Each exit with the return from its price to the close exactly `horizon` bars later, NULL where there is none."""
    grid = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    at = exits.filter("exit_time is not null and exit_price > 0").select("pair", "exit_time", "exit_reason", "exit_price", grid)
    at = at.withColumn("_then", F.col("exit_time") + F.col("horizon").cast("long") * F.lit(bar_ms))
    later = bars.filter("close > 0").select("pair", F.col("open_time").alias("_then"), F.col("close").alias("_later"))
    return at.join(later, ["pair", "_then"], "left").select("pair", "exit_time", "exit_reason", "horizon", (F.col("_later") / F.col("exit_price") - 1).alias("post_exit_return"))


def build_reports(features: DataFrame, trades: DataFrame, equity: DataFrame, bars: DataFrame, horizons: list[int], bar_ms: int, score: str = "ridge_score", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The seven reports by name. `keep` may store the entries, which all of them read; else nothing runs before a read."""
    entries = keep(entry_regime(pair_trades(trades, equity), features, score))
    return {
        "entry_regime": entries,
        "trade_outcome_attribution": outcome_attribution(entries),
        "rank_persistence": rank_persistence(entries),
        "score_gap_report": score_gap_report(entries),
        "same_pair_reentry": same_pair_reentry(entries),
        "post_exit_returns": post_exit_returns(entries, bars, horizons, bar_ms),
        "shadow_regime_filters": filter_report(entries),
    }


def score_gap_report(entries: DataFrame, buckets: int = 4) -> DataFrame:
    """Outcomes by quantile bucket of the score gap (from 0; NULL for a missing gap)."""
    from panelforge.functions.expr import quantile_bucket

    cuts = edges(entries, "score_gap", buckets)
    return outcome_summary(entries.join(F.broadcast(cuts)).withColumn("bucket", quantile_bucket(F.col("score_gap"), F.col("_e"))), ["bucket"])


def write_reports(found: dict[str, DataFrame], folder: str, prefix: str) -> list[str]:
    """Each report as CSV with a header under <folder>/<prefix>_<name>; returns the paths."""
    paths = []
    for name, frame in found.items():
        paths.append(f"{folder}/{prefix}_{name}")
        frame.write.mode("overwrite").option("header", True).csv(paths[-1])
    return paths


def fold_gate_summary(checks: DataFrame) -> DataFrame:
    """Gate checks of each fold: how many, allowed and blocked; a missing decision counts as blocked."""
    ok = F.count_if(F.coalesce("allowed", F.lit(False)))
    return checks.groupBy("fold").agg(F.count("*").alias("checks"), ok.alias("allowed_checks"), (F.count("*") - ok).alias("blocked_checks"))


def fold_stress_summary(hours: DataFrame) -> DataFrame:
    """Bars of each fold under stress: how many, their percentage, and how many had entries blocked."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return hours.groupBy("fold").agg(yes("stressed").alias("stressed_bars"), (yes("stressed") / F.count("*") * 100).alias("stressed_pct"), yes("blocked").alias("blocked_bars"))


def fold_trade_summary(exits: DataFrame) -> DataFrame:
    """Exits of each fold by reason, mean loss of stopped ones in percent, mean and median hours held (fold ends left out)."""
    by = lambda r: F.count_if(F.col("exit_reason") == r)
    held = F.when(F.col("exit_reason") != "fold_end", F.col("holding_hours"))
    exits = stored(exits.withColumn("_held", held), "exits")
    out = exits.groupBy("fold").agg(
        by("loss_threshold").alias("stop_exits"), by("gain_threshold").alias("tp_exits"), by("rank_decay").alias("rank_decay_exits"),
        F.avg(F.when(F.col("exit_reason") == "loss_threshold", F.col("return_pct") * 100)).alias("avg_stopped_loss_pct"),
        F.avg("_held").alias("mean_holding_hours"),
    )
    return with_quantiles(out, exits, ["fold"], "_held", {"median_holding_hours": 0.5}, is_stored=True)


def walk_forward_aggregate(folds: DataFrame) -> DataFrame:
    """22 figures per label over one row per (label, fold).

    Inputs: total_return_pct, max_drawdown_pct, sharpe, sortino, win_rate, mean_return_pct, closed_trades, gross_profit,
    gross_loss, gate_checks, gate_blocked. A zero drawdown has no ratio, a label without losses no profit factor.
    """
    r, d, n = F.col("total_return_pct"), F.col("max_drawdown_pct"), F.col("closed_trades")
    lost, checks = F.sum(F.abs("gross_loss")), F.sum("gate_checks")
    mean = lambda c: F.avg(c)
    folds = stored(folds, "folds")
    out = folds.groupBy("label").agg(
        F.count("*").alias("folds"), F.count_if(r > 0).alias("positive_return_folds"), F.count_if(n > 0).alias("traded_folds"), F.count_if(n == 0).alias("flat_folds"),
        mean(r).alias("mean_return_pct"), mean(F.when(n > 0, r)).alias("mean_return_when_trading_pct"),
        F.stddev_pop(r).alias("std_return_pct"), F.min(r).alias("worst_return_pct"), F.max(r).alias("best_return_pct"),
        mean(d).alias("mean_max_drawdown_pct"), F.max(d).alias("worst_max_drawdown_pct"), mean("sharpe").alias("mean_sharpe"), mean("sortino").alias("mean_sortino"),
        mean(F.when(d != 0, r / d)).alias("mean_return_to_drawdown"), mean(n).alias("mean_closed_trades"), mean("win_rate").alias("mean_win_rate"),
        mean("mean_return_pct").alias("mean_trade_return_pct"), F.when(lost != 0, F.sum("gross_profit") / lost).alias("profit_factor"),
        F.sum("gross_profit").alias("total_gross_profit"), (-lost).alias("total_gross_loss"),
        F.when(checks != 0, F.sum("gate_blocked") / checks).otherwise(F.lit(0.0)).alias("gate_block_rate"),
    )
    return with_quantiles(out, folds, ["label"], "total_return_pct", {"median_return_pct": 0.5}, is_stored=True)


def fold_totals(folds: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """One row of sums and means over all folds of each label."""
    return folds.groupBy("label").agg(*[F.sum(c).alias(f"total_{c}") for c in sums], *[F.avg(c).alias(f"mean_{c}") for c in means])
