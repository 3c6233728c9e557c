"""Reports over live logs, wallet and ticker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expr import safe_div
from panelforge.operators import ic, reports
from panelforge.operators.order import edges

SEVERITY = {"ok": 0, "warning": 1, "critical": 2}


def since(logs: DataFrame, hours: int, now: Column, at: str = "logged_at") -> DataFrame:
    """Rows of the last `hours` hours before `now`; times that cannot be read are left out."""
    when = F.col(at) if dict(logs.dtypes)[at].startswith("timestamp") else F.try_to_timestamp(F.col(at))
    return logs.filter(when.cast("timestamp") >= now - F.make_dt_interval(hours=F.lit(hours)))


def live_summary(cycles: DataFrame, orders: DataFrame, closed: DataFrame, hours: int) -> DataFrame:
    """One row over three logs: counts, successes, mean slippage, summed pnl and mean return. Empty logs count 0."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    a = cycles.agg(F.count("*").alias("cycles"), yes("execute").alias("executed_cycles"))
    b = orders.agg(F.count("*").alias("orders"), yes("success").alias("successful_orders"), F.avg("slippage_bps").alias("mean_slippage_bps"))
    c = closed.agg(F.count("*").alias("closed_trades"), F.sum("gross_pnl").alias("gross_pnl"), (F.avg("gross_return") * 100).alias("mean_gross_return_pct"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).withColumn("since_hours", F.lit(hours))  # three rows of one


def position_issues(positions: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """key, issue, severity of each position (pair, state_quantity, wallet_quantity, entry_price).

    A position is in the state only, in the wallet only, without entry metadata, or of different quantities.
    """
    s, w = F.coalesce("state_quantity", F.lit(0.0)), F.coalesce("wallet_quantity", F.lit(0.0))
    flags = positions.select(
        "pair",
        (F.col("state_quantity").isNotNull() & (w <= 0)).alias("_state"),
        (F.col("state_quantity").isNull() & (w > 0)).alias("_wallet"),
        (F.col("state_quantity").isNotNull() & F.col("entry_price").isNull()).alias("_meta"),
        (F.abs(w - s) > tolerance).alias("_diff"),
    )
    rules = {"state_only_position": "_state", "wallet_only_position": "_wallet", "missing_entry_metadata": "_meta", "quantity_mismatch": "_diff"}
    return reports.health_issues(flags, {k: (c, "warning") for k, c in rules.items()}, "pair").withColumnRenamed("pair", "key")


def log_issues(cycles: DataFrame, orders: DataFrame, now: Column, max_age_minutes: int = 90) -> DataFrame:
    """key, issue, severity of the logs: no cycles, a stale last cycle (critical), failed orders."""
    last = cycles.agg(F.max(F.col("logged_at").cast("timestamp")).alias("_last"), F.count("*").alias("_n"))
    failed = orders.agg(F.count_if(~F.coalesce(F.col("success"), F.lit(True))).alias("_failed"))
    age = (F.unix_seconds(now) - F.unix_seconds("_last")) / 60
    flags = last.join(F.broadcast(failed)).select(
        F.lit("logs").alias("key"), (F.col("_n") == 0).alias("_none"), F.coalesce(age > max_age_minutes, F.lit(False)).alias("_stale"), (F.col("_failed") > 0).alias("_failing")
    )
    return reports.health_issues(flags, {"no_live_cycles": ("_none", "warning"), "stale_live_cycle": ("_stale", "critical"), "failed_orders": ("_failing", "warning")}, "key")


def health_status(issues: DataFrame) -> DataFrame:
    """One row: the worst severity (ok without issues) and how many issues there are."""
    level = F.when(F.col("severity") == "critical", 2).otherwise(1)
    worst = F.coalesce(F.max(level), F.lit(0))
    name = F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("ok")
    return issues.agg(name.alias("status"), F.count("*").alias("issues"))


def forward_report(scores: DataFrame, bars: DataFrame, horizons: list[int], bar_ms: int) -> DataFrame:
    """By horizon: observations, rank IC of score and forward return, mean return of the first rank and of intended entries."""
    rows = ic.forward_lookup(scores.filter("close > 0"), bars.filter("close > 0"), horizons, bar_ms)
    r = F.col("forward_return")
    out = rows.groupBy("horizon").agg(
        F.count("*").alias("observations"), F.avg(F.when(F.col("rank") == 1, r)).alias("top_rank_mean_return"),
        F.avg(F.when(F.col("intended_entry"), r)).alias("intent_mean_return"), F.avg(F.when(F.col("intended_entry"), (r > 0).cast("double"))).alias("intent_hit_rate"),
    )
    ics = ic.coefficients(rows, ["score"], "forward_return", ["horizon"], 3).select("horizon", F.col("ic").alias("spearman_ic"))
    return out.join(F.broadcast(ics), "horizon", "left")  # one row a horizon


def live_rank_persistence(rows: DataFrame, windows: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """By metric and bucket: observations, share of intended entries and of first ranks."""
    pairs = F.array(*[F.struct(F.lit(f"top3_count_{n}").alias("metric"), F.col(f"top3_count_{n}").cast("long").alias("bucket")) for n in windows])
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    long = rows.withColumn("_m", F.explode(pairs)).select("*", "_m.*")
    return long.groupBy("metric", "bucket").agg(F.count("*").alias("observations"), share(F.col("intended_entry")).alias("intended_entry_rate"), share(F.col("entry_rank") == 1).alias("rank1_rate"))


def live_score_gaps(first: DataFrame, buckets: int = 4) -> DataFrame:
    """First-ranked rows by quantile bucket of their score gap: observations, intended share, mean gap and breadth."""
    from panelforge.functions.expr import quantile_bucket

    cuts = edges(first, "score_gap", buckets)
    cut = first.join(F.broadcast(cuts)).withColumn("bucket", quantile_bucket(F.col("score_gap"), F.col("_e")))
    return cut.groupBy("bucket").agg(
        F.count("*").alias("observations"), F.avg(F.when(F.coalesce("intended_entry", F.lit(False)), 1.0).otherwise(0.0)).alias("intended_entry_rate"),
        F.avg("score_gap").alias("mean_score_gap"), F.avg("universe_breadth").alias("mean_universe_breadth"),
    )


def live_reentries(orders: DataFrame) -> DataFrame:
    """Successful buys with the last successful sell of the pair strictly before; buys without one are left out."""
    done = orders.filter("success")
    buys = done.filter("side = 'BUY'").select("pair", F.col("logged_at").alias("entry_time"), "filled_avg_price", "intent_id")
    sells = done.filter("side = 'SELL'").groupBy("pair", F.col("logged_at").alias("exit_time")).agg(F.max_by("reason", "intent_id").alias("reason"))
    out = reports.prior_event(buys, sells, ["pair"], "entry_time", "exit_time", ["reason"]).filter("prior_time is not null")
    hours = (F.unix_millis(F.col("entry_time").cast("timestamp")) - F.unix_millis(F.col("prior_time").cast("timestamp"))) / 3_600_000
    return out.select("intent_id", "pair", "entry_time", F.col("prior_time").alias("prior_exit_time"), F.col("prior_reason").alias("prior_exit_reason"), hours.alias("hours_since_prior_exit"), "filled_avg_price")


def score_snapshots(scores: DataFrame, held: DataFrame, entries: DataFrame, exits: DataFrame, prices: DataFrame) -> DataFrame:
    """Score rows of a cycle with ticker price and flags: held, intended_entry, intended_exit (each a table of pair)."""
    out = scores.join(prices.select("pair", F.col("price").alias("ticker_price")), "pair", "left")
    for name, pairs in (("held", held), ("intended_entry", entries), ("intended_exit", exits)):
        out = out.join(pairs.select("pair").distinct().withColumn(name, F.lit(True)), "pair", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def order_records(orders: DataFrame) -> DataFrame:
    """Orders with a stable intent_id and adverse slippage in basis points."""
    key = reports.stable_id(F.col("cycle_id"), F.col("pair"), F.col("side"), F.col("reason"))
    return orders.withColumn("intent_id", key).withColumn("slippage_bps", reports.adverse_bps(F.col("side"), F.col("reference_price"), F.col("filled_avg_price")))


def closed_trade_records(orders: DataFrame, positions: DataFrame) -> DataFrame:
    """Successful sells with their position: exit price and quantity fall back to reference price and held quantity.

    A missing price or quantity gives NULL results, an entry price of zero or less no return.
    """
    done = orders.filter("side = 'SELL' and success")
    both = done.join(positions.select("pair", "quantity", "entry_price", "entry_time", "entry_score"), "pair", "left")
    positive = lambda c, other: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col(other))
    both = both.withColumn("exit_price", positive("filled_avg_price", "reference_price")).withColumn("exit_quantity", positive("filled_quantity", "quantity"))
    whole = F.col("exit_price").isNotNull() & F.col("entry_price").isNotNull() & F.col("exit_quantity").isNotNull()
    gain = F.when(whole & (F.col("entry_price") > 0), safe_div(F.col("exit_price"), F.col("entry_price")) - 1)
    return both.withColumn("gross_return", gain).withColumn("gross_pnl", F.when(whole, (F.col("exit_price") - F.col("entry_price")) * F.col("exit_quantity")))


def price_map(ticker: DataFrame, scores: DataFrame) -> DataFrame:
    """pair, price: the ticker's last price where it is positive, else the close of the scores."""
    t = ticker.filter("last_price > 0").select("pair", F.col("last_price").alias("_t"))
    s = scores.filter("close is not null").groupBy("pair").agg(F.max_by("close", "open_time").alias("_s"))
    return t.join(s, "pair", "full_outer").select("pair", F.coalesce("_t", "_s").alias("price"))


def portfolio_value(wallet: DataFrame, prices: DataFrame, quote: str = "USD") -> DataFrame:
    """One row: cash and value of a wallet (asset, free, locked); assets without a price count nothing."""
    amount = F.coalesce("free", F.lit(0.0)) + F.coalesce("locked", F.lit(0.0))
    priced = wallet.withColumn("pair", F.concat(F.upper("asset"), F.lit(f"/{quote}"))).join(prices, "pair", "left")
    is_cash = F.upper("asset") == quote
    value = F.sum(F.when(is_cash, amount).otherwise(amount * F.coalesce("price", F.lit(0.0))))
    return priced.agg(F.coalesce(F.sum(F.when(is_cash, F.coalesce("free", F.lit(0.0)))), F.lit(0.0)).alias("cash"), F.coalesce(value, F.lit(0.0)).alias("value"))


def reconciled(state: DataFrame, wallet: DataFrame) -> DataFrame:
    """The state (pair, quantity, entry_price, entry_time) after a look at the wallet (pair, quantity).

    Positions that the wallet no longer holds go, quantities follow the wallet, and holdings unknown to the state are
    placeholders without entry data.
    """
    w = wallet.filter("quantity > 0").select("pair", F.col("quantity").alias("_w"))
    return w.join(state.drop("quantity"), "pair", "left").withColumnRenamed("_w", "quantity")


def fill_details(orders: DataFrame) -> DataFrame:
    """filled_quantity and filled_price with fallbacks: notional over reference price, and the reference price."""
    q, p = F.coalesce("filled_quantity", F.lit(0.0)), F.coalesce("filled_avg_price", F.lit(0.0))
    ref = F.col("reference_price")
    quantity = F.when((q <= 0) & (ref > 0), F.col("notional") / ref).otherwise(q)
    return orders.withColumn("filled_quantity", quantity).withColumn("filled_avg_price", F.when(p <= 0, ref).otherwise(p))


def liquidation_intents(wallet: DataFrame, ticker: DataFrame, quote: str = "USD") -> DataFrame:
    """Sell intents for the free balances of a wallet that have a positive price: pair, quantity, price, notional."""
    free = wallet.filter(F.upper("asset") != quote).select(F.concat(F.upper("asset"), F.lit(f"/{quote}")).alias("pair"), F.col("free").alias("quantity")).filter("quantity > 0")
    priced = free.join(ticker.select("pair", F.col("last_price").alias("price")).filter("price > 0"), "pair")
    return priced.withColumn("notional", F.col("quantity") * F.col("price"))
