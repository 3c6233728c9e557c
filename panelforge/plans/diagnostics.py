"""Queries of the diagnostics and monitoring operators, each with its SQL.

The trade log is made from the panel: every entry (first three ranks of its time) buys 100 at the close, and sells one to
three weeks later if the pair has a bar then. Logs, wallet and ticker come from events and line items.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import diagnostics as D
from panelforge.operators import features as X
from panelforge.operators import ic, monitoring, regime, reports, ridge
from panelforge.operators.order import running_sum
from panelforge.plans import sql
from panelforge.plans.registry import (
    ALPHAS, CENTRES, END, FOLD_SQL, FOLDS, FRAME, GATE, GATED, KMEANS, LABEL, LLOYD_STEPS, MOMENTUM, POLICY, SCORED, SPLIT, START, WINDOWS,
    _decision, _entries, _folds, _ms, _policies, frame, query, r6, s6, scored,
)
from panelforge.session import stored, table
from panelforge.sources import bars as B

WEEK = B.WEEK_MS
COUNTS = [(name, n) for name in ("top3", "rank1") for n in (3, 6, 12)]

DECIDED = f"""{SCORED}, e0 AS (
    SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY open_time ORDER BY score DESC NULLS LAST, pair) END AS entry_rank,
        close / nullif(lag(close) OVER (PARTITION BY pair ORDER BY open_time), 0) - 1 AS pair_return
    FROM scored
), e1 AS (
    SELECT *, max(score) OVER t AS top_score, max(CASE WHEN entry_rank = 2 THEN score END) OVER t AS second_score, quantile_cont(score, 0.5) OVER t AS median_score,
        max(CASE WHEN entry_rank = 1 THEN pair END) OVER t AS leader, avg(CASE WHEN pair_return > 0 THEN 1.0 ELSE 0.0 END) OVER t AS universe_breadth,
        avg(pair_return) OVER t AS universe_return, stddev_samp(pair_return) OVER t AS universe_volatility,
        CASE WHEN entry_rank <= 3 THEN 1 ELSE 0 END AS in_top3, CASE WHEN entry_rank = 1 THEN 1 ELSE 0 END AS in_rank1
    FROM e0 WINDOW t AS (PARTITION BY open_time)
), e2 AS (
    SELECT *, top_score - second_score AS score_gap, top_score - median_score AS median_gap,
        {', '.join(f'CAST(sum(in_{c}) OVER {sql.frame(n)} AS BIGINT) AS {c}_count_{n}' for c, n in COUNTS)}
    FROM e1
), gaps AS (SELECT open_time, max(score_gap) AS gap FROM e2 GROUP BY open_time
), trail AS (
    SELECT open_time, CASE WHEN count(gap) OVER w >= 24 THEN quantile_cont(gap, 0.5) OVER w END AS trailing_gap
    FROM gaps WINDOW w AS (ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), decided AS (SELECT e2.*, trailing_gap FROM e2 JOIN trail USING (open_time))"""

TRADES = f"""{DECIDED}, buys AS (SELECT pair, open_time AS entry_time, close AS entry_price, 100 / close AS quantity FROM decided WHERE entry_rank <= 3 AND close > 0
), sells AS (
    SELECT b.pair, entry_time, x.open_time AS exit_time, x.close AS exit_price, x.close / entry_price - 1 AS return_pct, quantity * (x.close - entry_price) AS pnl,
        CASE WHEN x.close / entry_price - 1 > 0.03 THEN 'gain_threshold' WHEN x.close / entry_price - 1 < -0.03 THEN 'loss_threshold' ELSE 'rank_decay' END AS exit_reason
    FROM buys b JOIN bars x ON x.pair = b.pair AND x.open_time = entry_time + (1 + (entry_time // {WEEK}) % 3) * {WEEK}
), equity AS (
    SELECT open_time, CAST(sum(c) OVER (ORDER BY open_time) AS BIGINT) AS positions
    FROM (SELECT open_time, sum(c) AS c FROM (SELECT entry_time AS open_time, 1 AS c FROM buys UNION ALL SELECT exit_time, -1 FROM sells) GROUP BY open_time)
), paired AS (
    SELECT b.pair, b.entry_time, entry_price, quantity, exit_time, exit_price, exit_reason, return_pct, pnl, positions AS positions_at_entry
    FROM buys b LEFT JOIN sells s USING (pair, entry_time) LEFT JOIN equity q ON q.open_time = b.entry_time
), prior AS (
    SELECT p.pair, p.entry_time, x.exit_time AS prior_exit_time, x.exit_reason AS prior_exit_reason
    FROM paired p JOIN paired x ON x.pair = p.pair AND x.exit_time < p.entry_time
    QUALIFY row_number() OVER (PARTITION BY p.pair, p.entry_time ORDER BY x.exit_time DESC, x.entry_time DESC) = 1
), entries AS (
    SELECT p.*, d.score AS entry_score, d.* EXCLUDE (pair, open_time, close, score, ret), prior_exit_time, prior_exit_reason, (p.entry_time - prior_exit_time) / 3600000.0 AS hours_since_prior_exit,
        prior_exit_time IS NOT NULL AS is_same_pair_reentry, coalesce(exit_reason = 'gain_threshold', false) AS tp_hit, coalesce(exit_reason = 'loss_threshold', false) AS sl_hit,
        (exit_time - p.entry_time) / 3600000.0 AS holding_hours
    FROM paired p LEFT JOIN decided d ON d.pair = p.pair AND d.open_time = p.entry_time LEFT JOIN prior r ON r.pair = p.pair AND r.entry_time = p.entry_time
)"""
OUTCOME = """count(*) AS entries, count(return_pct) AS closed, round(avg(return_pct), 6) AS mean_return, round(avg(CASE WHEN return_pct > 0 THEN 1.0 WHEN return_pct IS NOT NULL THEN 0.0 END), 6) AS win_rate,
    round(sum(pnl), 4) AS pnl, round(avg(CASE WHEN tp_hit THEN 1.0 ELSE 0.0 END), 6) AS tp_rate, round(avg(CASE WHEN sl_hit THEN 1.0 ELSE 0.0 END), 6) AS sl_rate"""


def _decided(spark, sf_dir) -> DataFrame:
    return stored(regime.with_trailing_gap(_decision(spark, sf_dir)), "decided")


def trade_log(decided: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trade log, equity) of the rule above: the first three ranks of each time, sold one to three weeks later."""
    buys = decided.filter("entry_rank <= 3 and close > 0").select("pair", "open_time", "close", (100 / F.col("close")).alias("quantity"))
    hold = (1 + F.expr(f"(open_time div {WEEK}) % 3")) * WEEK
    at = buys.withColumn("_then", F.col("open_time") + hold).join(bars.select("pair", F.col("open_time").alias("_then"), F.col("close").alias("_exit")), ["pair", "_then"])
    none = lambda kind: F.lit(None).cast(kind)
    buy = buys.select(F.col("open_time").alias("event_time"), "pair", F.lit("BUY").alias("side"), F.col("close").alias("price"), "quantity", F.lit(0.1).alias("fee"), none("string").alias("reason"), none("long").alias("entry_time"), none("double").alias("pnl"), none("double").alias("return_pct"))
    gain = F.col("_exit") / F.col("close") - 1
    reason = F.when(gain > 0.03, "gain_threshold").when(gain < -0.03, "loss_threshold").otherwise("rank_decay")
    sell = at.select(F.col("_then").alias("event_time"), "pair", F.lit("SELL").alias("side"), F.col("_exit").alias("price"), "quantity", F.lit(0.1).alias("fee"), reason.alias("reason"), F.col("open_time").alias("entry_time"), (F.col("quantity") * (F.col("_exit") - F.col("close"))).alias("pnl"), gain.alias("return_pct"))
    log = stored(buy.unionByName(sell), "trades")
    steps = log.groupBy(F.col("event_time").alias("open_time")).agg(F.sum(F.when(F.col("side") == "BUY", 1).otherwise(-1)).alias("_c"))
    equity = running_sum(steps, "open_time", "_c", "positions").select("open_time", "positions")
    return log, equity


def _trades(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(decision features, trade log, equity, bars)."""
    decided, bars = _decided(spark, sf_dir), stored(B.weekly_bars(spark, sf_dir).select("pair", "open_time", "close"), "bars")
    return decided, *trade_log(decided, bars), bars


def _entry_regime(spark, sf_dir) -> DataFrame:
    decided, log, equity, _ = _trades(spark, sf_dir)
    return stored(D.entry_regime(D.pair_trades(log, equity), decided, "score"), "entries")


def _outcome(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "entries", "closed", r6("mean_return"), r6("win_rate"), F.round("pnl", 4).alias("pnl"), r6("tp_rate"), r6("sl_rate"))


_values = ["score_gap", "median_gap", "trailing_gap", "pair_return", "universe_breadth", "universe_return", "universe_volatility"]


@query("decision_features_full", f"{DECIDED} SELECT pair, open_time, entry_rank, leader, {', '.join(s6(c) for c in _values)}, {', '.join(f'{c}_count_{n}' for c, n in COUNTS)} FROM decided")
def decision_features_full(spark, sf_dir):
    return _decided(spark, sf_dir).select("pair", "open_time", F.col("entry_rank").cast("long").alias("entry_rank"), "leader", *[r6(c) for c in _values], *[f"{c}_count_{n}" for c, n in COUNTS])


@query("trade_pairs", f"{TRADES} SELECT pair, entry_time, round(entry_price, 6) AS entry_price, exit_time, round(exit_price, 6) AS exit_price, exit_reason, {s6('return_pct')}, {s6('pnl')}, positions_at_entry FROM paired")
def trade_pairs(spark, sf_dir):
    _, log, equity, _ = _trades(spark, sf_dir)
    return D.pair_trades(log, equity).select("pair", "entry_time", r6("entry_price"), "exit_time", r6("exit_price"), "exit_reason", r6("return_pct"), r6("pnl"), "positions_at_entry")


@query("entry_regime", f"{TRADES} SELECT pair, entry_time, entry_rank, {s6('entry_score')}, {s6('score_gap')}, {s6('trailing_gap')}, {s6('universe_breadth')}, top3_count_3, rank1_count_12, holding_hours::DOUBLE AS holding_hours, tp_hit, sl_hit, prior_exit_time, prior_exit_reason, hours_since_prior_exit::DOUBLE AS hours_since_prior_exit, is_same_pair_reentry FROM entries")
def entry_regime(spark, sf_dir):
    return _entry_regime(spark, sf_dir).select("pair", "entry_time", F.col("entry_rank").cast("long").alias("entry_rank"), r6("entry_score"), r6("score_gap"), r6("trailing_gap"), r6("universe_breadth"), "top3_count_3", "rank1_count_12", "holding_hours", "tp_hit", "sl_hit", "prior_exit_time", "prior_exit_reason", "hours_since_prior_exit", "is_same_pair_reentry")


@query("trade_outcome_attribution", f"{TRADES} SELECT pair, entry_time, exit_time, exit_reason, entry_rank, {s6('entry_score')}, {s6('score_gap')}, top3_count_3, holding_hours::DOUBLE AS holding_hours, {s6('return_pct')}, {s6('pnl')}, tp_hit, sl_hit FROM entries")
def trade_outcome_attribution(spark, sf_dir):
    rounded = {"entry_score", "score_gap", "return_pct", "pnl"}
    out = D.outcome_attribution(_entry_regime(spark, sf_dir)).withColumn("entry_rank", F.col("entry_rank").cast("long"))
    return out.select(*[r6(c) if c in rounded else c for c in D.OUTCOME_COLUMNS])


@query("rank_persistence_report", f"{TRADES}, m AS (" + " UNION ALL ".join(f"SELECT 'top3_count_{n}' AS metric, top3_count_{n} AS bucket, * FROM entries" for n in (3, 6, 12)) + f") SELECT metric, bucket, {OUTCOME} FROM m GROUP BY metric, bucket")
def rank_persistence_report(spark, sf_dir):
    return _outcome(D.rank_persistence(_entry_regime(spark, sf_dir)), "metric", "bucket")


@query("score_gap_report", f"{TRADES}, q AS (SELECT list_distinct(quantile_cont(score_gap, [0, 0.25, 0.5, 0.75, 1])) AS e FROM entries), k AS (SELECT *, CASE WHEN score_gap IS NOT NULL THEN greatest(len(list_filter(e, lambda v: v < score_gap)) - 1, 0) END::INTEGER AS bucket FROM entries, q) SELECT bucket, {OUTCOME} FROM k GROUP BY bucket")
def score_gap_report(spark, sf_dir):
    return _outcome(D.score_gap_report(_entry_regime(spark, sf_dir)), "bucket")


_FILTERS = {
    "score_gap_top_half": "coalesce(score_gap >= trailing_gap, false)",
    "rank_persistent_top3": "coalesce(top3_count_3 >= 2, false)",
    "momentum_hot": "coalesce(top3_count_3 >= 2, false) AND coalesce(score_gap >= trailing_gap, false) AND coalesce(universe_breadth >= 0.5, false)",
    "same_pair_reentry_after_tp": "NOT is_same_pair_reentry OR (coalesce(prior_exit_reason = 'gain_threshold', false) AND coalesce(entry_rank = 1, false) AND coalesce(score_gap > 0, false))",
    "avoid_recent_stopped_pair": "NOT (coalesce(prior_exit_reason = 'loss_threshold', false) AND coalesce(hours_since_prior_exit <= 6, false))",
}


@query("shadow_filter_report", f"{TRADES}, m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS filter, CASE WHEN {c} THEN 'kept' ELSE 'blocked' END AS side, * FROM entries" for k, c in _FILTERS.items()) + f") SELECT filter, side, {OUTCOME} FROM m GROUP BY filter, side")
def shadow_filter_report(spark, sf_dir):
    return _outcome(D.filter_report(_entry_regime(spark, sf_dir)), "filter", "side")


@query("same_pair_reentry", f"{TRADES} SELECT pair, entry_time, prior_exit_time, prior_exit_reason, hours_since_prior_exit::DOUBLE AS hours_since_prior_exit, {s6('return_pct')} FROM entries WHERE is_same_pair_reentry")
def same_pair_reentry(spark, sf_dir):
    out = D.same_pair_reentry(_entry_regime(spark, sf_dir))
    return out.select(*[c for c in out.columns if c != "return_pct"], r6("return_pct"))


@query("report_bundle", f"""{TRADES}, n AS (SELECT count(*) AS e, count(*) FILTER (WHERE exit_time IS NOT NULL) AS x, count(*) FILTER (WHERE is_same_pair_reentry) AS s FROM entries),
q AS (SELECT list_distinct(quantile_cont(score_gap, [0, 0.25, 0.5, 0.75, 1])) AS e FROM entries)
SELECT 'entry_regime' AS report, e AS n FROM n UNION ALL SELECT 'trade_outcome_attribution', e FROM n UNION ALL SELECT 'same_pair_reentry', s FROM n UNION ALL SELECT 'post_exit_returns', 2 * x FROM n
UNION ALL SELECT 'rank_persistence', (SELECT count(DISTINCT coalesce(top3_count_3, -1)) + count(DISTINCT coalesce(top3_count_6, -1)) + count(DISTINCT coalesce(top3_count_12, -1)) FROM entries)
UNION ALL SELECT 'score_gap_report', (SELECT count(DISTINCT coalesce(greatest(len(list_filter(q.e, lambda v: v < score_gap)) - 1, 0), -1)) FROM entries, q)
UNION ALL SELECT 'shadow_regime_filters', (SELECT {' + '.join(f'count(DISTINCT {c})' for c in _FILTERS.values())} FROM entries)""")
def report_bundle(spark, sf_dir):
    decided, log, equity, bars = _trades(spark, sf_dir)
    found = D.build_reports(decided, log, equity, bars, [1, 2], WEEK, "score", keep=lambda df: stored(df, "entries"))
    parts = [df.agg(F.lit(name).alias("report"), F.count("*").alias("n")) for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("post_exit_report", f"{TRADES} SELECT s.pair, exit_time, exit_reason, horizon, round(x.close / exit_price - 1, 6) AS post_exit_return FROM sells s CROSS JOIN (SELECT unnest([1, 2])::INTEGER AS horizon) LEFT JOIN bars x ON x.pair = s.pair AND x.open_time = exit_time + horizon::BIGINT * {WEEK} AND x.close > 0")
def post_exit_report(spark, sf_dir):
    _, log, _, bars = _trades(spark, sf_dir)
    out = D.post_exit_returns(D.pair_trades(log), bars, [1, 2], WEEK)
    return out.select("pair", "exit_time", "exit_reason", "horizon", r6("post_exit_return"))


# folds


FOLDED = f"{TRADES}, {FOLD_SQL}, fe AS (SELECT fold, entries.* FROM entries JOIN folds ON entry_time >= os_start AND entry_time < os_end)"


def _in_folds(spark, df: DataFrame, at: str) -> DataFrame:
    f = _folds(spark)
    return df.join(F.broadcast(f), (F.col(at) >= F.col("os_start")) & (F.col(at) < F.col("os_end")))  # one row a fold


@query("fold_trade_summary", f"{FOLDED} SELECT fold, count(*) FILTER (WHERE exit_reason = 'loss_threshold') AS stop_exits, count(*) FILTER (WHERE exit_reason = 'gain_threshold') AS tp_exits, count(*) FILTER (WHERE exit_reason = 'rank_decay') AS rank_decay_exits, round(avg(CASE WHEN exit_reason = 'loss_threshold' THEN return_pct * 100 END), 6) AS avg_stopped_loss_pct, round(avg(holding_hours), 6) AS mean_holding_hours, round(quantile_cont(holding_hours, 0.5), 6) AS median_holding_hours FROM fe WHERE exit_time IS NOT NULL GROUP BY fold")
def fold_trade_summary(spark, sf_dir):
    out = D.fold_trade_summary(_in_folds(spark, _entry_regime(spark, sf_dir).filter("exit_time is not null"), "entry_time"))
    return out.select("fold", "stop_exits", "tp_exits", "rank_decay_exits", r6("avg_stopped_loss_pct"), r6("mean_holding_hours"), r6("median_holding_hours"))


@query("fold_gate_summary", f"{FOLDED} SELECT fold, count(*) AS checks, count(*) FILTER (WHERE score_gap >= trailing_gap) AS allowed_checks, count(*) - count(*) FILTER (WHERE score_gap >= trailing_gap) AS blocked_checks FROM fe GROUP BY fold")
def fold_gate_summary(spark, sf_dir):
    return D.fold_gate_summary(_in_folds(spark, _entry_regime(spark, sf_dir), "entry_time").withColumn("allowed", F.col("score_gap") >= F.col("trailing_gap")))


_STRESSED = f"{FRAME}, {FOLD_SQL}, m AS (SELECT open_time, quantile_cont(vpin, 0.5) AS v FROM features GROUP BY open_time), p AS (SELECT open_time, v, count(v) OVER w AS h, quantile_cont(v, 0.8) OVER w AS q FROM m WINDOW w AS (ORDER BY open_time ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING)), st AS (SELECT open_time, v, coalesce(h >= 24 AND v >= q, false) AS stressed FROM p)"


@query("fold_stress_summary", f"{_STRESSED} SELECT fold, count(*) FILTER (WHERE stressed) AS stressed_bars, round(count(*) FILTER (WHERE stressed) / count(*) * 100, 6) AS stressed_pct, count(*) FILTER (WHERE stressed AND open_time % 2 = 0) AS blocked_bars FROM st JOIN folds ON open_time >= os_start AND open_time < os_end GROUP BY fold")
def fold_stress_summary(spark, sf_dir):
    market = regime.market_stress(frame(spark, sf_dir), "vpin", 0.8, 104, 24).select("open_time", F.col("is_stressed").alias("stressed"))
    hours = _in_folds(spark, market.withColumn("blocked", F.col("stressed") & (F.col("open_time") % 2 == 0)), "open_time")
    return D.fold_stress_summary(hours).select("fold", "stressed_bars", r6("stressed_pct"), "blocked_bars")


@query("market_mapped", f"{_STRESSED} SELECT pair, f.open_time, {s6('v', alias='market_value')}, {s6('vpin - v', alias='over_market')}, stressed FROM features f LEFT JOIN st USING (open_time)")
def market_mapped(spark, sf_dir):
    panel = frame(spark, sf_dir).select("pair", "open_time", "vpin")
    return regime.map_market(panel, regime.market_stress(panel, "vpin", 0.8, 104, 24)).select("pair", "open_time", r6("market_value"), F.round(F.col("vpin") - F.col("market_value"), 6).alias("over_market"), F.col("is_stressed").alias("stressed"))


FOLD_RESULTS = f"""{FOLDED}, fr AS (SELECT exit_reason AS label, fold, sum(return_pct) * 100 AS total_return_pct, (max(return_pct) - min(return_pct)) * 100 AS max_drawdown_pct, avg(return_pct) / nullif(stddev_samp(return_pct), 0) AS sharpe,
    avg(return_pct) / nullif(stddev_pop(return_pct), 0) AS sortino, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(return_pct) * 100 AS mean_return_pct, count(*) AS closed_trades,
    sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gross_profit, sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS gross_loss, count(*) AS gate_checks, count(*) FILTER (WHERE score_gap < trailing_gap) AS gate_blocked
    FROM fe WHERE exit_time IS NOT NULL GROUP BY exit_reason, fold)"""


def _fold_results(spark, sf_dir) -> DataFrame:
    rows = _in_folds(spark, _entry_regime(spark, sf_dir).filter("exit_time is not null"), "entry_time")
    r, p = F.col("return_pct"), F.col("pnl")
    return rows.groupBy(F.col("exit_reason").alias("label"), "fold").agg(
        (F.sum(r) * 100).alias("total_return_pct"), ((F.max(r) - F.min(r)) * 100).alias("max_drawdown_pct"), F.try_divide(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.try_divide(F.avg(r), F.stddev_pop(r)).alias("sortino"),
        F.avg((r > 0).cast("double")).alias("win_rate"), (F.avg(r) * 100).alias("mean_return_pct"), F.count("*").alias("closed_trades"), F.sum(F.greatest(p, F.lit(0.0))).alias("gross_profit"),
        F.sum(F.least(p, F.lit(0.0))).alias("gross_loss"), F.count("*").alias("gate_checks"), F.count_if(F.col("score_gap") < F.col("trailing_gap")).alias("gate_blocked"),
    )


_AGG = {
    "folds": "count(*)", "positive_return_folds": "count(*) FILTER (WHERE total_return_pct > 0)", "traded_folds": "count(*) FILTER (WHERE closed_trades > 0)", "flat_folds": "count(*) FILTER (WHERE closed_trades = 0)",
    "mean_return_pct": "avg(total_return_pct)", "mean_return_when_trading_pct": "avg(total_return_pct) FILTER (WHERE closed_trades > 0)", "median_return_pct": "quantile_cont(total_return_pct, 0.5)",
    "std_return_pct": "stddev_pop(total_return_pct)", "worst_return_pct": "min(total_return_pct)", "best_return_pct": "max(total_return_pct)", "mean_max_drawdown_pct": "avg(max_drawdown_pct)",
    "worst_max_drawdown_pct": "max(max_drawdown_pct)", "mean_sharpe": "avg(sharpe)", "mean_sortino": "avg(sortino)", "mean_return_to_drawdown": "avg(total_return_pct / nullif(max_drawdown_pct, 0))",
    "mean_closed_trades": "avg(closed_trades)", "mean_win_rate": "avg(win_rate)", "mean_trade_return_pct": "avg(mean_return_pct)", "profit_factor": "sum(gross_profit) / nullif(sum(abs(gross_loss)), 0)",
    "total_gross_profit": "sum(gross_profit)", "total_gross_loss": "-sum(abs(gross_loss))", "gate_block_rate": "coalesce(sum(gate_blocked) / nullif(sum(gate_checks), 0), 0)",
}
_whole = {"folds", "positive_return_folds", "traded_folds", "flat_folds"}


@query("walk_forward_metrics", f"{FOLD_RESULTS} SELECT label, {', '.join(f'{x} AS {k}' if k in _whole else s6(f'({x})::DOUBLE', alias=k) for k, x in _AGG.items())} FROM fr GROUP BY label")
def walk_forward_metrics(spark, sf_dir):
    return D.walk_forward_aggregate(_fold_results(spark, sf_dir)).select("label", *[k if k in _whole else r6(k) for k in _AGG])


@query("fold_totals", f"{FOLD_RESULTS} SELECT label, CAST(sum(closed_trades) AS BIGINT) AS total_closed_trades, {s6('sum(gross_profit)', alias='total_gross_profit')}, {s6('avg(win_rate)', alias='mean_win_rate')} FROM fr GROUP BY label")
def fold_totals(spark, sf_dir):
    out = D.fold_totals(_fold_results(spark, sf_dir), ["closed_trades", "gross_profit"], ["win_rate"])
    return out.select("label", "total_closed_trades", r6("total_gross_profit"), r6("mean_win_rate"))


@query("labelled_slice", f"{FRAME}, {FOLD_SQL} SELECT fold, count(*) AS n, max(open_time) AS last_time, {s6('sum(target_z * z_momentum)', alias='moment')} FROM features JOIN folds ON open_time >= is_start AND open_time < is_end AND open_time <= is_end - {4 * WEEK} WHERE target_z IS NOT NULL AND z_momentum IS NOT NULL GROUP BY fold")
def labelled_slice(spark, sf_dir):
    rows = ridge.in_folds(frame(spark, sf_dir).select("pair", "open_time", "z_momentum", "target_z"), _folds(spark), "is", purge_ms=4 * WEEK).dropna(subset=["z_momentum", "target_z"])
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.max("open_time").alias("last_time"), F.round(F.sum(F.col("target_z") * F.col("z_momentum")), 6).alias("moment"))


BACK = ridge.folds_back(START, END, 6, 12, 5, 91)
SEGMENTS = ridge.refit_segments(BACK[-1][3], BACK[-1][4], 30, 2)


@query("folds_stepped_back", f"WITH {sql.BARS}, f(fold, a, b) AS (VALUES {', '.join(f'({f[0]}, {_ms(f[3])}, {_ms(f[4])})' for f in BACK)}) SELECT fold, count(*) AS n, count(DISTINCT open_time) AS times FROM bars JOIN f ON open_time >= a AND open_time < b GROUP BY fold")
def folds_stepped_back(spark, sf_dir):
    rows = ridge.in_folds(B.weekly_bars(spark, sf_dir), ridge.fold_table(spark, BACK), "os")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("open_time").alias("times"))


@query("refit_segments", f"WITH {sql.BARS}, g(segment, a, b, ridge_refit, regime_refit) AS (VALUES {', '.join(f'({k}, {_ms(a)}, {_ms(b)}, {str(x).lower()}, {str(y).lower()})' for k, a, b, x, y in SEGMENTS)}) SELECT segment, ridge_refit, regime_refit, count(*) AS n FROM bars JOIN g ON open_time >= a AND open_time < b GROUP BY ALL")
def refit_segments(spark, sf_dir):
    cuts = spark.createDataFrame([(k, _ms(a), _ms(b), x, y) for k, a, b, x, y in SEGMENTS], "segment int, a long, b long, ridge_refit boolean, regime_refit boolean")
    rows = B.weekly_bars(spark, sf_dir).join(F.broadcast(cuts), (F.col("open_time") >= F.col("a")) & (F.col("open_time") < F.col("b")))  # one row a segment
    return rows.groupBy("segment", "ridge_refit", "regime_refit").agg(F.count("*").alias("n"))


_wanted = ["Brand#11", "Brand#55", "Brand#99"]


@query("pair_history", f"WITH {sql.BARS}, w AS (SELECT unnest({_wanted}) AS pair), c AS (SELECT pair, min(open_time) AS a, max(open_time) AS b FROM bars GROUP BY pair) SELECT pair, CASE WHEN a IS NULL THEN 'missing' WHEN a > {_ms(START)} OR b < {_ms(END)} THEN 'too_short' END AS problem FROM w LEFT JOIN c USING (pair)")
def pair_history(spark, sf_dir):
    return ridge.pair_history(B.weekly_bars(spark, sf_dir), spark.createDataFrame([(p,) for p in _wanted], "pair string"), _ms(START), _ms(END))


_three = """p AS (SELECT fold, alpha, sum(a * a) + alpha AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) + alpha AS bb, sum(b * c) AS bc, sum(c * c) + alpha AS cc, sum(a * y) AS ay, sum(b * y) AS byy, sum(c * y) AS cy FROM t, alphas GROUP BY fold, alpha),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM p)"""


@query("ridge_fit_interaction", f"""{FRAME}, {FOLD_SQL}, alphas(alpha) AS (VALUES {', '.join(f'({a:.1f}::DOUBLE)' for a in ALPHAS)}),
t AS (SELECT fold, z_momentum AS a, z_low_roll_impact AS b, z_momentum_x_low_roll_impact AS c, target_z AS y FROM features JOIN folds ON open_time >= is_start AND open_time < is_end WHERE z_momentum IS NOT NULL AND z_low_roll_impact IS NOT NULL AND z_momentum_x_low_roll_impact IS NOT NULL AND target_z IS NOT NULL),
{_three} SELECT fold, alpha, {s6('(ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / det', alias='beta_0')}, {s6('(aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / det', alias='beta_1')}, {s6('(aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det', alias='beta_2')} FROM d""")
def ridge_fit_interaction(spark, sf_dir):
    x = ridge.terms("momentum_low_roll_interaction")
    train = ridge.in_folds(frame(spark, sf_dir).select("open_time", *x, "target_z"), _folds(spark), "is")
    return ridge.fit(train, x, "target_z", ALPHAS, ["fold"]).select("fold", "alpha", *[F.round(F.col("beta")[i], 6).alias(f"beta_{i}") for i in range(3)])


@query("ridge_fit_low_roll", f"""{FRAME}, {FOLD_SQL}, alphas(alpha) AS (VALUES {', '.join(f'({a:.1f}::DOUBLE)' for a in ALPHAS)}),
t AS (SELECT fold, z_low_roll_impact AS x, target_z AS y FROM features JOIN folds ON open_time >= is_start AND open_time < is_end WHERE z_low_roll_impact IS NOT NULL AND target_z IS NOT NULL)
SELECT fold, alpha, count(*) AS n, {s6('sum(x * y) / (sum(x * x) + alpha)', alias='beta')} FROM t, alphas GROUP BY fold, alpha""")
def ridge_fit_low_roll(spark, sf_dir):
    train = ridge.in_folds(frame(spark, sf_dir).select("open_time", "z_low_roll_impact", "target_z"), _folds(spark), "is")
    return ridge.fit(train, ["z_low_roll_impact"], "target_z", ALPHAS, ["fold"]).select("fold", "alpha", "n", F.round(F.col("beta")[0], 6).alias("beta"))


# gates

_again = "list_transform(range(0, 3), lambda k: list_sum(list_transform([z0, z1, z2], lambda z, i: (z - c.c[k + 1][i]) ** 2))) AS far"


@query("gate_decide", f"{GATED}, ok AS (SELECT pair, open_time, cluster_id, sqrt(CASE cluster_id WHEN 0 THEN far0 WHEN 1 THEN far1 ELSE far2 END) AS distance FROM gated) SELECT pair, open_time, coalesce(cluster_id <> 1, false) AS allowed, cluster_id, round(distance, 6) AS distance, CASE WHEN cluster_id IS NULL THEN 'missing_features' WHEN cluster_id <> 1 THEN 'allowed_cluster' ELSE 'blocked_cluster' END AS reason FROM (SELECT pair, open_time FROM decision WHERE entry_rank <= 3 AND ret IS NOT NULL) LEFT JOIN ok USING (pair, open_time)")
def gate_decide(spark, sf_dir):
    means, stds = regime.scaling(_entries(spark, sf_dir), GATE)
    rows = _decision(spark, sf_dir).filter("entry_rank <= 3 and ret is not null").withColumn("persistence", F.col("top3_count_6").cast("double"))
    out = rows.select("pair", "open_time", regime.decide(GATE, means, stds, CENTRES, [0, 2]).alias("d")).select("pair", "open_time", "d.*")
    return out.select("pair", "open_time", "allowed", "cluster_id", r6("distance"), "reason")


@query(
    "gate_train",
    f"""{KMEANS}, kept AS (SELECT c.c AS c, return_pct, {_again} FROM g0, centres_{LLOYD_STEPS} c), near AS (SELECT *, list_position(far, list_min(far)) - 1 AS k FROM kept), o AS (SELECT avg(return_pct) AS m FROM near),
summed AS (SELECT k, count(*) >= 10 AND avg(return_pct) >= 0 AND avg(return_pct) > any_value(m) AS allowed FROM near, o GROUP BY k)
SELECT r.k::INTEGER AS cluster_id, coalesce(allowed, false) AS allowed, {', '.join(f'round(c[r.k + 1][{i + 1}], 4) AS {n}' for i, n in enumerate(GATE))} FROM centres_{LLOYD_STEPS}, range(0, 3) r(k) LEFT JOIN summed s ON s.k = r.k""",
)
def gate_train(spark, sf_dir):
    gate = regime.train_gate(_entries(spark, sf_dir), GATE, 3, first=CENTRES, min_entries=10)
    rows = [(k, k in gate["allowed"], *c) for k, c in enumerate(gate["centres"])]
    out = spark.createDataFrame(rows, "cluster_id int, allowed boolean, " + ", ".join(f"{c} double" for c in GATE))
    return out.select("cluster_id", "allowed", *[F.round(c, 4).alias(c) for c in GATE])


# coefficients and policies


MICRO_WINDOWS = (8, 16)


@query("ic_micro_windows", "WITH " + sql.BARS + "".join(f", {sql.features(w, WINDOWS[:1], 4).replace('features AS', f'panel{w} AS').replace('f1', f'a{w}f1').replace('f2', f'a{w}f2').replace('f3', f'a{w}f3').replace('f4', f'a{w}f4').replace('f5', f'a{w}f5').replace('f6', f'a{w}f6').replace('f7', f'a{w}f7').replace('f8', f'a{w}f8')}" for w in MICRO_WINDOWS) + " " + " UNION ALL ".join(f"SELECT {w} AS micro_window, feature, n, {s6('ic')} FROM ({sql.coefficients(f'panel{w}', ['roll_measure', 'amihud', 'vpin'], 'forward_return_4', [], 3, 'spearman')})" for w in MICRO_WINDOWS))
def ic_micro_windows(spark, sf_dir):
    bars, parts = B.weekly_bars(spark, sf_dir), []
    for w in MICRO_WINDOWS:
        panel = X.forward_return(X.microstructure(bars, w), 4)
        parts.append(ic.coefficients(panel, ["roll_measure", "amihud", "vpin"], "forward_return_4").select(F.lit(w).alias("micro_window"), "feature", "n", r6("ic")))
    return parts[0].unionByName(parts[1])


for _kind, _form in (("log", "ln(lead(close, 4) OVER w / nullif(close, 0))"), ("diff", "lead(close, 4) OVER w - close")):

    @query(f"forward_return_{_kind}", f"WITH {sql.BARS} SELECT pair, open_time, {s6(_form, alias='forward_return_4')} FROM bars WINDOW w AS (PARTITION BY pair ORDER BY open_time)")
    def _forward(spark, sf_dir, kind=_kind):
        return X.forward_return(B.weekly_bars(spark, sf_dir), 4, kind).select("pair", "open_time", r6("forward_return_4"))


CUTS = [_ms(datetime(1997, 1, 1)), SPLIT, _ms(datetime(2000, 1, 1))]


@query("cutoff_grid", f"{POLICY} SELECT cut, policy, CASE WHEN open_time < cut THEN 'is' ELSE 'os' END AS sample, count(*) AS periods, {s6('avg(net)', alias='mean_net')}, {s6('avg(net) / nullif(stddev_samp(net), 0)', alias='sharpe_like')} FROM pr CROSS JOIN (SELECT unnest({CUTS}) AS cut) GROUP BY ALL")
def cutoff_grid(spark, sf_dir):
    rows = _policies(spark, sf_dir).withColumn("cut", F.explode(F.array(*[F.lit(c) for c in CUTS])))
    out = rows.groupBy("cut", "policy", F.when(F.col("open_time") < F.col("cut"), "is").otherwise("os").alias("sample")).agg(F.count("*").alias("periods"), F.avg("net").alias("mean_net"), F.try_divide(F.avg("net"), F.stddev_samp("net")).alias("sharpe_like"))
    return out.select("cut", "policy", "sample", "periods", r6("mean_net"), r6("sharpe_like"))


@query("split_audit", f"{SCORED} SELECT CASE WHEN open_time < {SPLIT} THEN 'is' ELSE 'os' END AS sample, min(open_time) AS first_time, max(open_time) AS last_time, count(DISTINCT open_time) AS times, count(DISTINCT pair) AS pairs, count(*) AS n FROM scored GROUP BY ALL")
def split_audit(spark, sf_dir):
    return reports.split_audit(scored(spark, sf_dir).withColumn("sample", F.when(F.col("open_time") < SPLIT, "is").otherwise("os")), "sample")


@query("topk_wide", f"{POLICY}, w AS (SELECT policy, {', '.join(f'avg(net) FILTER (WHERE k = {k}) AS net_top{k}' for k in (1, 3))} FROM (SELECT policy, 3 AS k, net FROM pr UNION ALL SELECT policy, 1, r.net FROM (SELECT policy, open_time, avg(ret) - 0.001 AS net FROM v WHERE policy_score IS NOT NULL GROUP BY policy, open_time, pair, policy_score QUALIFY row_number() OVER (PARTITION BY policy, open_time ORDER BY policy_score DESC, pair) = 1) r) GROUP BY policy), m AS (SELECT policy, count(*) AS periods FROM pr GROUP BY policy) SELECT m.policy, periods, {s6('net_top1')}, {s6('net_top3')} FROM m LEFT JOIN w USING (policy)")
def topk_wide(spark, sf_dir):
    s = scored(spark, sf_dir)
    parts = [reports.policy_returns(s, "score", "ret", k, 10.0).select("policy", F.lit(f"net_top{k}").alias("k"), "net") for k in (1, 3)]
    wide = parts[0].unionByName(parts[1]).groupBy("policy").pivot("k", ["net_top1", "net_top3"]).agg(F.avg("net"))
    periods = parts[1].groupBy("policy").agg(F.count("*").alias("periods"))
    return periods.join(wide, "policy", "left").select("policy", "periods", r6("net_top1"), r6("net_top3"))


@query("top_abs_ic", f"{FRAME}, c AS ({sql.coefficients('features', ['roll_measure', 'amihud', 'vpin', MOMENTUM], LABEL, [], 3, 'pearson')}) SELECT feature, {s6('ic')} FROM c ORDER BY abs(ic) DESC, feature LIMIT 2")
def top_abs_ic(spark, sf_dir):
    c = ic.coefficients(frame(spark, sf_dir), ["roll_measure", "amihud", "vpin", MOMENTUM], LABEL, method="pearson")
    return ic.strongest(c, 2).select("feature", r6("ic"))


@query("rank_map", f"{SCORED}, r AS (SELECT open_time, pair, row_number() OVER (PARTITION BY open_time ORDER BY score DESC, pair) AS place FROM scored WHERE score IS NOT NULL) SELECT open_time, count(*) AS ranked, max(CASE WHEN place = 1 THEN pair END) AS leader, max(CASE WHEN pair = 'Brand#11' THEN place END) AS place_of_first FROM r GROUP BY open_time")
def rank_map(spark, sf_dir):
    places = reports.rank_maps(scored(spark, sf_dir), "score")
    first = F.filter(F.map_entries("ranks"), lambda e: e["value"] == 1)[0]["key"]
    return places.select("open_time", F.size("ranks").cast("long").alias("ranked"), first.alias("leader"), F.try_element_at("ranks", F.lit("Brand#11")).cast("long").alias("place_of_first"))


# live logs


HOURS, LAST = 168, "(SELECT max(ts) FROM events)"
ORDERS = f"""orders AS (SELECT event_id, ts AS logged_at, event_type AS pair, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, event_id % 7 <> 0 AS success, value AS reference_price, value + 0.01 * (event_id % 5) AS filled_avg_price,
    CASE WHEN value > 0 THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * ((value + 0.01 * (event_id % 5)) / value - 1) * 10000 END AS slippage_bps, CASE WHEN event_id % 3 = 0 THEN 'rank_decay' ELSE 'loss_threshold' END AS reason FROM events)"""
LOGS = f"WITH {ORDERS}, cycles AS (SELECT ts AS logged_at, event_id % 20 = 0 AS execute FROM events WHERE event_id % 10 = 0), closed AS (SELECT ts AS logged_at, value * (event_id % 3 - 1) AS gross_pnl, (event_id % 11 - 5) / 100.0 AS gross_return FROM events WHERE event_id % 5 = 0)"


def _now(spark, sf_dir):
    """The time of the last event as a literal: one value."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp")


def _orders(spark, sf_dir) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    out = e.select("event_id", F.col("ts").alias("logged_at"), F.col("event_type").alias("pair"), F.when(i % 2 == 0, "BUY").otherwise("SELL").alias("side"), (i % 7 != 0).alias("success"), F.col("value").alias("reference_price"), (F.col("value") + 0.01 * (i % 5)).alias("filled_avg_price"), F.when(i % 3 == 0, "rank_decay").otherwise("loss_threshold").alias("reason"))
    return out.withColumn("slippage_bps", reports.adverse_bps(F.col("side"), F.col("reference_price"), F.col("filled_avg_price")))


def _cycles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.col("ts").alias("logged_at"), (F.col("event_id") % 20 == 0).alias("execute"))


@query("live_summary", f"{LOGS}, a AS (SELECT count(*) AS cycles, count(*) FILTER (WHERE execute) AS executed_cycles FROM cycles WHERE logged_at >= {LAST} - INTERVAL {HOURS} HOUR), b AS (SELECT count(*) AS orders, count(*) FILTER (WHERE success) AS successful_orders, round(avg(slippage_bps), 4) AS mean_slippage_bps FROM orders WHERE logged_at >= {LAST} - INTERVAL {HOURS} HOUR), c AS (SELECT count(*) AS closed_trades, round(sum(gross_pnl), 4) AS gross_pnl, round(avg(gross_return) * 100, 6) AS mean_gross_return_pct FROM closed WHERE logged_at >= {LAST} - INTERVAL {HOURS} HOUR) SELECT {HOURS} AS since_hours, a.*, b.*, c.* FROM a, b, c")
def live_summary(spark, sf_dir):
    now, i = _now(spark, sf_dir), F.col("event_id")
    closed = table(spark, sf_dir, "events").filter("event_id % 5 = 0").select(F.col("ts").alias("logged_at"), (F.col("value") * (i % 3 - 1)).alias("gross_pnl"), ((i % 11 - 5) / 100.0).alias("gross_return"))
    logs = [monitoring.since(x, HOURS, now) for x in (_cycles(spark, sf_dir), _orders(spark, sf_dir), closed)]
    out = monitoring.live_summary(*logs, HOURS)
    return out.select("since_hours", "cycles", "executed_cycles", "orders", "successful_orders", F.round("mean_slippage_bps", 4).alias("mean_slippage_bps"), "closed_trades", F.round("gross_pnl", 4).alias("gross_pnl"), r6("mean_gross_return_pct"))


@query("recent_logs", "SELECT event_id FROM events WHERE event_id % 13 <> 0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def recent_logs(spark, sf_dir):
    text = F.when(F.col("event_id") % 13 == 0, "no time").otherwise(F.col("ts").cast("string")).alias("logged_at")
    return monitoring.since(table(spark, sf_dir, "events").select("event_id", text), 24, _now(spark, sf_dir)).select("event_id")


POSITIONS = """WITH st AS (SELECT p_brand AS pair, sum(l_quantity) AS q, CASE WHEN p_brand < 'Brand#2' THEN NULL ELSE 1.0 END AS entry_price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND p_brand < 'Brand#4' GROUP BY p_brand),
wa AS (SELECT p_brand AS pair, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_brand > 'Brand#2' GROUP BY p_brand)"""
ISSUES = f"""{POSITIONS}, po AS (SELECT coalesce(st.pair, wa.pair) AS key, st.q AS s, wa.q AS w, entry_price FROM st FULL JOIN wa ON st.pair = wa.pair),
issues AS (SELECT key, 'state_only_position' AS issue, 'warning' AS severity FROM po WHERE s IS NOT NULL AND coalesce(w, 0) <= 0 UNION ALL SELECT key, 'wallet_only_position', 'warning' FROM po WHERE s IS NULL AND w > 0
UNION ALL SELECT key, 'missing_entry_metadata', 'warning' FROM po WHERE s IS NOT NULL AND entry_price IS NULL UNION ALL SELECT key, 'quantity_mismatch', 'warning' FROM po WHERE abs(coalesce(w, 0) - coalesce(s, 0)) > 1e-12
UNION ALL SELECT 'logs', 'stale_live_cycle', 'critical' FROM (SELECT max(ts) AS t FROM events WHERE event_id % 10 = 0) WHERE date_diff('second', t, (SELECT max(ts) FROM events) + INTERVAL 3 HOUR) / 60.0 > 90
UNION ALL SELECT 'logs', 'failed_orders', 'warning' FROM (SELECT count(*) AS n FROM events WHERE event_id % 7 = 0) WHERE n > 0)"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    side = lambda where: lines.filter(where).groupBy(F.col("p_brand").alias("pair")).agg(F.sum("l_quantity").alias("quantity"))
    state = side("l_returnflag = 'A' and p_brand < 'Brand#4'").withColumn("entry_price", F.when(F.col("pair") >= "Brand#2", 1.0))
    return state, side("l_returnflag = 'R' and p_brand > 'Brand#2'")


def _issues(spark, sf_dir) -> DataFrame:
    state, wallet = _sides(spark, sf_dir)
    positions = reports.merged_positions(state, wallet).join(state.select("pair", "entry_price"), "pair", "left")
    later = _now(spark, sf_dir) + F.expr("INTERVAL 3 HOURS")
    return monitoring.position_issues(positions).unionByName(monitoring.log_issues(_cycles(spark, sf_dir), _orders(spark, sf_dir), later))


@query("health_issues", f"{ISSUES} SELECT * FROM issues")
def health_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


@query("health_status", f"{ISSUES} SELECT CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END AS status, count(*) AS issues FROM issues")
def health_status(spark, sf_dir):
    return monitoring.health_status(_issues(spark, sf_dir))


@query("reconciled_state", f"{POSITIONS} SELECT wa.pair, wa.q AS quantity, entry_price FROM wa LEFT JOIN st USING (pair) WHERE wa.q > 0")
def reconciled_state(spark, sf_dir):
    return monitoring.reconciled(*_sides(spark, sf_dir)).select("pair", "quantity", F.col("entry_price"))


LIVE = f"{DECIDED}, live AS (SELECT *, entry_rank <= 3 AND open_time % 2 = 0 AS intended_entry FROM decided WHERE score IS NOT NULL)"


def _live(spark, sf_dir) -> DataFrame:
    return _decided(spark, sf_dir).filter("score is not null").withColumn("intended_entry", (F.col("entry_rank") <= 3) & (F.col("open_time") % 2 == 0))


@query("forward_report", f"""{LIVE}, h AS (SELECT unnest([1, 4])::INTEGER AS horizon), fw AS (SELECT horizon, l.score, entry_rank, intended_entry, x.close / l.close - 1 AS r FROM live l, h JOIN bars x ON x.pair = l.pair AND x.open_time = l.open_time + h.horizon::BIGINT * {WEEK} WHERE l.close > 0 AND x.close > 0),
c AS ({sql.coefficients('fw', ['score'], 'r', ['horizon'], 3, 'spearman')}), a AS (SELECT horizon, count(*) AS observations, avg(CASE WHEN entry_rank = 1 THEN r END) AS t, avg(CASE WHEN intended_entry THEN r END) AS m, avg(CASE WHEN intended_entry THEN (CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) END) AS hit FROM fw GROUP BY horizon)
SELECT a.horizon, observations, {s6('ic', alias='spearman_ic')}, {s6('t', alias='top_rank_mean_return')}, {s6('m', alias='intent_mean_return')}, {s6('hit', alias='intent_hit_rate')} FROM a JOIN c USING (horizon)""")
def forward_report(spark, sf_dir):
    s = _live(spark, sf_dir).select("pair", "open_time", "close", "score", F.col("entry_rank").alias("rank"), "intended_entry")
    out = monitoring.forward_report(s, B.weekly_bars(spark, sf_dir), [1, 4], WEEK)
    return out.select("horizon", "observations", *[r6(c) for c in ("spearman_ic", "top_rank_mean_return", "intent_mean_return", "intent_hit_rate")])


_snap = ["score", "score_gap", "median_gap", "trailing_gap", "universe_breadth", "universe_return", "universe_volatility"]


@query("live_regime_snapshot", f"{LIVE} SELECT open_time, pair, {', '.join(s6(c) for c in _snap)}, top3_count_3, rank1_count_3, intended_entry FROM live WHERE entry_rank = 1")
def live_regime_snapshot(spark, sf_dir):
    return _live(spark, sf_dir).filter("entry_rank = 1").select("open_time", "pair", *[r6(c) for c in _snap], "top3_count_3", "rank1_count_3", "intended_entry")


@query("live_rank_persistence", f"{LIVE}, m AS (" + " UNION ALL ".join(f"SELECT 'top3_count_{n}' AS metric, top3_count_{n} AS bucket, * FROM live" for n in (3, 6, 12)) + ") SELECT metric, bucket, count(*) AS observations, round(avg(CASE WHEN intended_entry THEN 1.0 ELSE 0.0 END), 6) AS intended_entry_rate, round(avg(CASE WHEN entry_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS rank1_rate FROM m GROUP BY metric, bucket")
def live_rank_persistence(spark, sf_dir):
    return monitoring.live_rank_persistence(_live(spark, sf_dir)).select("metric", "bucket", "observations", r6("intended_entry_rate"), r6("rank1_rate"))


@query("live_score_gaps", f"{LIVE}, f AS (SELECT * FROM live WHERE entry_rank = 1), q AS (SELECT list_distinct(quantile_cont(score_gap, [0, 0.25, 0.5, 0.75, 1])) AS e FROM f), k AS (SELECT *, CASE WHEN score_gap IS NOT NULL THEN greatest(len(list_filter(e, lambda v: v < score_gap)) - 1, 0) END::INTEGER AS bucket FROM f, q) SELECT bucket, count(*) AS observations, round(avg(CASE WHEN intended_entry THEN 1.0 ELSE 0.0 END), 6) AS intended_entry_rate, round(avg(score_gap), 6) AS mean_score_gap, round(avg(universe_breadth), 6) AS mean_universe_breadth FROM k GROUP BY bucket")
def live_score_gaps(spark, sf_dir):
    out = monitoring.live_score_gaps(_live(spark, sf_dir).filter("entry_rank = 1"))
    return out.select("bucket", "observations", r6("intended_entry_rate"), r6("mean_score_gap"), r6("mean_universe_breadth"))


@query("live_reentries", f"WITH {ORDERS}, b AS (SELECT * FROM orders WHERE success AND side = 'BUY' AND event_id % 50 = 0), s AS (SELECT pair, logged_at AS exit_time, arg_max(reason, event_id) AS why FROM orders WHERE success AND side = 'SELL' GROUP BY pair, logged_at) SELECT event_id AS intent_id, b.pair, why AS prior_exit_reason, round(date_diff('millisecond', exit_time, logged_at) / 3600000.0, 6) AS hours_since_prior_exit FROM b ASOF JOIN s ON s.pair = b.pair AND b.logged_at > s.exit_time")
def live_reentries(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("intent_id", F.col("event_id")).filter("side = 'SELL' or event_id % 50 = 0")
    return monitoring.live_reentries(o).select("intent_id", "pair", "prior_exit_reason", r6("hours_since_prior_exit"))


@query("order_records", f"WITH {ORDERS} SELECT event_id, substr(sha1((event_id // 100)::VARCHAR || '|' || pair || '|' || side || '|' || reason), 1, 16) AS intent_id, round(slippage_bps, 4) AS slippage_bps FROM orders")
def order_records(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("cycle_id", F.expr("event_id div 100"))
    return monitoring.order_records(o).select("event_id", "intent_id", F.round("slippage_bps", 4).alias("slippage_bps"))


@query("closed_trade_records", f"WITH {ORDERS}, p AS (SELECT pair, min(reference_price) AS entry_price, CASE WHEN pair < 'm' THEN 2.0 END AS quantity FROM orders GROUP BY pair) SELECT event_id, round(CASE WHEN quantity IS NOT NULL AND entry_price > 0 THEN filled_avg_price / entry_price - 1 END, 4) AS gross_return, round((filled_avg_price - entry_price) * quantity, 4) AS gross_pnl FROM orders LEFT JOIN p USING (pair) WHERE side = 'SELL' AND success")
def closed_trade_records(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("filled_quantity", F.lit(0.0))
    p = o.groupBy("pair").agg(F.min("reference_price").alias("entry_price")).select("pair", "entry_price", F.when(F.col("pair") < "m", 2.0).alias("quantity"), F.lit(None).cast("long").alias("entry_time"), F.lit(None).cast("double").alias("entry_score"))
    return monitoring.closed_trade_records(o, p).select("event_id", F.round("gross_return", 4).alias("gross_return"), F.round("gross_pnl", 4).alias("gross_pnl"))


@query("score_snapshots", f"{DECIDED}, l AS (SELECT * FROM decided WHERE open_time = (SELECT max(open_time) FROM decided)) SELECT pair, entry_rank, round(close, 6) AS ticker_price, entry_rank <= 5 IS TRUE AS held, entry_rank <= 3 IS TRUE AS intended_entry, entry_rank > 20 IS TRUE AS intended_exit FROM l")
def score_snapshots(spark, sf_dir):
    d = _decided(spark, sf_dir)
    last = d.join(F.broadcast(d.agg(F.max("open_time").alias("open_time"))), "open_time")
    pick = lambda where: last.filter(where).select("pair")
    out = monitoring.score_snapshots(last.select("pair", "entry_rank"), pick("entry_rank <= 5"), pick("entry_rank <= 3"), pick("entry_rank > 20"), last.select("pair", F.col("close").alias("price")))
    return out.select("pair", F.col("entry_rank").cast("long").alias("entry_rank"), r6("ticker_price"), "held", "intended_entry", "intended_exit")


WALLET = """WITH wa AS (SELECT event_type AS asset, round(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END), 6) AS free, round(sum(CASE WHEN event_id % 3 = 1 THEN value ELSE 0 END), 6) AS locked FROM events GROUP BY event_type UNION ALL SELECT 'usd', 1000.0, 50.0),
tick AS (SELECT upper(event_type) || '/USD' AS pair, CASE WHEN event_type < 'm' THEN max(value) ELSE 0.0 END AS last_price, min(value) AS close FROM events GROUP BY event_type),
px AS (SELECT pair, CASE WHEN last_price > 0 THEN last_price ELSE close END AS price FROM tick)"""


def _wallet(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    part = lambda k: F.round(F.sum(F.when(F.col("event_id") % 3 == k, F.col("value")).otherwise(0.0)), 6)
    wallet = e.groupBy(F.col("event_type").alias("asset")).agg(part(0).alias("free"), part(1).alias("locked")).unionByName(spark.createDataFrame([("usd", 1000.0, 50.0)], "asset string, free double, locked double"))
    by = e.groupBy("event_type").agg(F.max("value").alias("_hi"), F.min("value").alias("close")).withColumn("pair", F.concat(F.upper("event_type"), F.lit("/USD")))
    ticker = by.select("pair", F.when(F.col("event_type") < "m", F.col("_hi")).otherwise(0.0).alias("last_price"))
    return wallet, ticker, by.select("pair", "close", F.lit(0).alias("open_time"))


@query("price_map", f"{WALLET} SELECT pair, round(price, 6) AS price FROM px")
def price_map(spark, sf_dir):
    _, ticker, scores = _wallet(spark, sf_dir)
    return monitoring.price_map(ticker, scores).select("pair", r6("price"))


@query("portfolio_value", f"{WALLET} SELECT 1000.0::DOUBLE AS cash, round(sum(CASE WHEN asset = 'usd' THEN free + locked ELSE (free + locked) * coalesce(price, 0) END), 2) AS value FROM wa LEFT JOIN px ON pair = upper(asset) || '/USD'")
def portfolio_value(spark, sf_dir):
    wallet, ticker, scores = _wallet(spark, sf_dir)
    return monitoring.portfolio_value(wallet, monitoring.price_map(ticker, scores)).select("cash", F.round("value", 2).alias("value"))


@query("liquidation_intents", f"{WALLET} SELECT pair, round(free, 6) AS quantity, round(last_price, 6) AS price, round(free * last_price, 4) AS notional FROM wa JOIN tick ON pair = upper(asset) || '/USD' WHERE free > 0 AND last_price > 0 AND asset <> 'usd'")
def liquidation_intents(spark, sf_dir):
    wallet, ticker, _ = _wallet(spark, sf_dir)
    return monitoring.liquidation_intents(wallet, ticker).select("pair", r6("quantity"), r6("price"), F.round("notional", 4).alias("notional"))


@query("fill_details", f"WITH {ORDERS} SELECT event_id, round(CASE WHEN event_id % 4 = 0 AND reference_price > 0 THEN 100 / reference_price ELSE CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 2.0 END END, 6) AS filled_quantity, round(CASE WHEN event_id % 6 = 0 OR filled_avg_price <= 0 THEN reference_price ELSE filled_avg_price END, 6) AS filled_avg_price FROM orders")
def fill_details(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("filled_quantity", F.when(F.col("event_id") % 4 != 0, 2.0)).withColumn("filled_avg_price", F.when(F.col("event_id") % 6 != 0, F.col("filled_avg_price"))).withColumn("notional", F.lit(100.0))
    return monitoring.fill_details(o).select("event_id", r6("filled_quantity"), r6("filled_avg_price"))


# values and texts


@query("coerced_values", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE (event_id * 0.5)::VARCHAR END AS DOUBLE) AS v, epoch_ms(date_trunc('day', ts)::TIMESTAMP) AS day_ms FROM events")
def coerced_values(spark, sf_dir):
    raw = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise((F.col("event_id") * 0.5).cast("string"))
    day = B.normal_time(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), "string")
    return table(spark, sf_dir, "events").select("event_id", raw.try_cast("double").alias("v"), F.unix_millis(day).alias("day_ms"))


@query("filtered_pairs", f"WITH {sql.BARS} SELECT pair, replace(upper(pair), '#', '_') AS name, count(*) AS n FROM bars WHERE pair IN ('Brand#11', 'Brand#23') GROUP BY pair")
def filtered_pairs(spark, sf_dir):
    rows = B.filter_pairs(B.weekly_bars(spark, sf_dir), B.parse_pairs(" brand#11, BRAND#23 ,", str.title))
    return rows.groupBy("pair").agg(F.count("*").alias("n")).select("pair", F.replace(F.upper("pair"), F.lit("#"), F.lit("_")).alias("name"), "n")


@query("joined_values", f"WITH {sql.BARS} SELECT pair, string_agg((open_time // {WEEK})::VARCHAR, ',' ORDER BY open_time) AS weeks FROM bars WHERE open_time < {SPLIT} GROUP BY pair")
def joined_values(spark, sf_dir):
    rows = B.weekly_bars(spark, sf_dir).filter(F.col("open_time") < SPLIT).groupBy("pair").agg(F.sort_array(F.collect_list(F.expr(f"open_time div {WEEK}"))).alias("w"))
    return rows.select("pair", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("weeks"))


@query("model_frame", f"{FRAME} SELECT pair, open_time, {s6('z_momentum')}, {s6('target_z')} FROM features WHERE pair IN ('Brand#11', 'Brand#23') AND z_momentum IS NOT NULL")
def model_frame(spark, sf_dir):
    return B.filter_pairs(frame(spark, sf_dir), ["Brand#11", "Brand#23"]).filter("z_momentum is not null").select("pair", "open_time", r6("z_momentum"), r6("target_z"))
