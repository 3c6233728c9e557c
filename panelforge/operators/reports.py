"""Policies over scores, attribution and monitoring reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order import with_quantiles
from panelforge.session import small_side, stored


def top_k(frame: DataFrame, score: str, k: int, by: Sequence[str] = ("open_time",)) -> DataFrame:
    """The k best rows of each time by score, ties by pair; rows without a score are never among them."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), "pair")
    return frame.filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def return_summary(rows: DataFrame, ret: str, by: list[str]) -> DataFrame:
    """Count, mean, median, hit rate and 5 % and 95 % quantiles of returns."""
    r = F.col(ret)
    rows = stored(rows.select(*by, ret), "returns")
    out = rows.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("mean_return"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
    return with_quantiles(out, rows, by, ret, {"median_return": 0.5, "q05": 0.05, "q95": 0.95}, is_stored=True)


def policy_variants(frame: DataFrame, momentum: str, risk_rank: str = "micro_risk") -> DataFrame:
    """frame four times, with policy and policy_score: pure, gate at 2/3, low third only, scaled by 1 - rank.

    A missing risk rank fails the gates and the scaling, but stays in pure.
    """
    m, r = F.col(momentum), F.col(risk_rank)
    forms = {"pure": m, "gate_two_thirds": F.when(r <= 2 / 3, m), "low_third": F.when(r <= 1 / 3, m), "scaled": m * (1 - r)}
    pairs = F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("policy_score")) for k, v in forms.items()])
    return frame.withColumn("_v", F.explode(pairs)).select("*", "_v.policy", "_v.policy_score").drop("_v")


def policy_returns(frame: DataFrame, momentum: str, ret: str, k: int, cost_bps: float) -> DataFrame:
    """policy, open_time, gross, net and how many were selected: means over the k best of each time."""
    best = top_k(policy_variants(frame, momentum), "policy_score", k, ["policy", "open_time"])
    out = best.groupBy("policy", "open_time").agg(F.avg(ret).alias("gross"), F.count("*").alias("selected"))
    return out.withColumn("net", F.col("gross") - cost_bps / 1e4)


def attribution(trades: DataFrame, by: list[str]) -> DataFrame:
    """Closed trades, pnl, mean return and win rate per key; missing keys are a group of their own."""
    won = F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))
    return trades.groupBy(*by).agg(F.count("*").alias("closed_trades"), F.sum("pnl").alias("pnl"), F.avg("return_pct").alias("mean_return"), won.alias("win_rate"))


def prior_event(rows: DataFrame, events: DataFrame, keys: list[str], at: str, when: str, take: list[str], most: int = 1_000_000) -> DataFrame:
    """As-of join: rows with the values `take` of the latest event of their keys strictly before `at`, else NULL.

    One union and one window by key: both sides are sorted once, and no pair of rows is formed. If a key has more than
    `most` rows, all rows are sorted by range over all tasks and cut by their places into blocks of `most` rows; the last
    event before a block is carried in from a table of one row per block and key. Rows of one key and time share a task
    of that sort, but not a block.
    """
    value = F.struct(F.col(when).alias("prior_time"), *take)
    left = rows.withColumn("_row", F.struct(*rows.columns)).select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_late"), "_row", F.lit(None).cast(events.select(value.alias("v")).schema["v"].dataType).alias("_event"))
    right = events.filter(F.col(when).isNotNull()).select(*keys, F.col(when).alias("_t"), F.lit(1).alias("_late"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), value.alias("_event"))
    both = left.unionByName(right)
    if both.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).isEmpty():
        w = Window.partitionBy(*keys).orderBy("_t", "_late").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("_last", F.last("_event", ignorenulls=True).over(w))
    else:
        both = _in_blocks(both, keys, most)
    return both.filter("_row is not null").select("_row.*", "_last.prior_time", *[F.col(f"_last.{c}").alias(f"prior_{c}") for c in take])


def _in_blocks(both: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The union of prior_event() with `_last`, cut into blocks of `most` rows at most in the order of key and time.

    A row's block follows from its place in its partition, so the work of a row doesn't grow with the number of blocks.
    """
    order = [*keys, "_t", "_late"]
    held = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "asof_rows")
    cut = held.withColumn("_block", F.col("_at") - F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) % most)
    ends = cut.groupBy(*keys, "_block").agg(F.max(F.when(F.col("_event").isNotNull(), F.col("_at"))).alias("_end"))
    before = F.max("_end").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    wanted = stored(ends.withColumn("_before", before).filter("_before is not null").drop("_end"), "blocks")
    events = held.filter("_event is not null").select("_at", F.col("_event").alias("_carried"))
    carried = stored(events.join(small_side(wanted), F.col("_at") == F.col("_before")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_to"), "_carried"), "carried_events")
    same = F.col("_block") == F.col("_to")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_inside", F.last("_event", ignorenulls=True).over(w))
    return out.join(small_side(carried, row_bytes=256), same, "left").withColumn("_last", F.coalesce("_inside", "_carried"))


def shadow_filters(entries: DataFrame, predicates: dict[str, Column], ret: str) -> DataFrame:
    """How each predicate would have split the entries: predicate, kept, n, mean return, win rate. Unknown counts as not kept."""
    tags = F.array(*[F.struct(F.lit(k).alias("predicate"), F.coalesce(p, F.lit(False)).alias("kept")) for k, p in predicates.items()])
    long = entries.withColumn("_t", F.explode(tags)).select(F.col(ret).alias("_r"), "_t.*")
    return long.groupBy("predicate", "kept").agg(F.count("*").alias("n"), F.avg("_r").alias("mean_return"), F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def split_audit(rows: DataFrame, label: str) -> DataFrame:
    """First and last time, distinct times and pairs, and rows of each sample."""
    return rows.groupBy(label).agg(F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"), F.countDistinct("open_time").alias("times"), F.countDistinct("pair").alias("pairs"), F.count("*").alias("n"))


def rank_maps(frame: DataFrame, score: str) -> DataFrame:
    """open_time, ranks: a map from pair to its place by score (from 1); rows without a score are left out."""
    w = Window.partitionBy("open_time").orderBy(F.col(score).desc(), "pair")
    places = frame.filter(F.col(score).isNotNull()).select("open_time", F.struct("pair", F.row_number().over(w).alias("place")).alias("_e"))
    return places.groupBy("open_time").agg(F.map_from_entries(F.collect_list("_e")).alias("ranks"))


def paired_deltas(results: DataFrame, key: str, label: str, base: str, other: str, values: list[str]) -> DataFrame:
    """other minus base of each value on the keys both have."""
    side = lambda name, p: results.filter(F.col(label) == name).select(key, *[F.col(v).alias(f"{p}_{v}") for v in values])
    both = side(base, "a").join(side(other, "b"), key)
    return both.select(key, *[(F.col(f"b_{v}") - F.col(f"a_{v}")).alias(f"delta_{v}") for v in values])


def merged_positions(state: DataFrame, wallet: DataFrame) -> DataFrame:
    """Positions known to the state, the wallet or both, with flags for what only one side has."""
    s, w = state.select("pair", F.col("quantity").alias("state_quantity")), wallet.select("pair", F.col("quantity").alias("wallet_quantity"))
    both = s.join(w, "pair", "full_outer")
    return both.withColumn("missing_in_wallet", F.coalesce(F.col("wallet_quantity"), F.lit(0.0)) <= 0).withColumn("untracked", F.col("state_quantity").isNull())


def slippage_report(orders: DataFrame) -> DataFrame:
    """Orders, successes, mean and largest adverse slippage by pair and side."""
    return orders.groupBy("pair", "side").agg(F.count("*").alias("orders"), F.count_if(F.col("success")).alias("successes"), F.avg("slippage_bps").alias("mean_slippage"), F.max("slippage_bps").alias("max_slippage"))


def adverse_bps(side: Column, expected: Column, filled: Column) -> Column:
    """Slippage in basis points, positive where it costs; NULL for prices that are not positive."""
    change = F.when((expected > 0) & (filled > 0), (filled / expected - 1) * 10_000)
    return F.when(side == "BUY", change).when(side == "SELL", -change)


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the parts joined by bars; a missing part is empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def health_issues(flags: DataFrame, rules: dict[str, tuple[str, str]], key: str) -> DataFrame:
    """One row per issue: key, issue, severity. rules: issue -> (boolean column, severity)."""
    tags = F.array(*[F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"), F.col(c).alias("hit")) for k, (c, s) in rules.items()])
    return flags.select(key, F.explode(tags).alias("_i")).filter("_i.hit").select(key, "_i.issue", "_i.severity")
