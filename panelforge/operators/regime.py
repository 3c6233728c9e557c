"""Market stress, decision-time features and the cluster gate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.expr import at_time, by_pair, rolling, safe_div
from panelforge.operators.order import expanding_quantile, numbered, rolling_quantile, with_quantiles
from panelforge.session import stored


def market_stress(frame: DataFrame, metric: str, quantile: float = 0.8, lookback: int = 720, min_history: int = 168, agg: str = "median") -> DataFrame:
    """One row per time: market_value, threshold (quantile of prior rows only), history, is_stressed."""
    if agg not in ("median", "mean"):
        raise ValueError(f"agg must be median or mean: {agg}")
    value = F.percentile(metric, F.lit(0.5)) if agg == "median" else F.avg(metric)
    market = frame.groupBy("open_time").agg(value.alias("market_value"))
    out = rolling_quantile(market, "open_time", "market_value", quantile, lookback, "threshold", "history")
    out = out.withColumn("threshold", F.when(F.col("history") >= min_history, F.col("threshold")))
    return out.withColumn("is_stressed", F.coalesce(F.col("market_value") >= F.col("threshold"), F.lit(False)))


def map_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Every row of the panel with the market's figures at its time; NULL where the market has none."""
    return panel.join(market, "open_time", "left")


def throttle(market: DataFrame, min_history: int = 168) -> DataFrame:
    """blocked and reason of each time: empty_scores, insufficient_history, missing_threshold, stressed or normal."""
    reason = (
        F.when(F.col("market_value").isNull(), "empty_scores")
        .when(F.col("history") < min_history, "insufficient_history")
        .when(F.col("threshold").isNull(), "missing_threshold")
        .when(F.col("is_stressed"), "stressed")
        .otherwise("normal")
    )
    return market.withColumn("reason", reason).withColumn("blocked", F.col("reason") == "stressed")


def decision_features(scores: DataFrame, score: str = "ridge_score") -> DataFrame:
    """Ranks, gaps, breadth and persistence known at decision time, for rows of (pair, open_time, close, score).

    The breadth counts pairs without a return as not up, so it is 0 at a pair's first time.
    """
    s = F.col(score)
    order = Window.partitionBy("open_time").orderBy(s.desc_nulls_last(), "pair")
    out = scores.withColumn("entry_rank", F.when(s.isNotNull(), F.row_number().over(order)))
    out = out.withColumn("top_score", F.max(s).over(at_time())).withColumn("second_score", F.max(F.when(F.col("entry_rank") == 2, s)).over(at_time()))
    out = out.withColumn("median_score", F.percentile(score, F.lit(0.5)).over(at_time())).withColumn("score_gap", F.col("top_score") - F.col("second_score"))
    out = out.withColumn("leader", F.max(F.when(F.col("entry_rank") == 1, F.col("pair"))).over(at_time()))
    out = out.withColumn("median_gap", F.col("top_score") - F.col("median_score"))
    out = out.withColumn("pair_return", safe_div(F.col("close"), F.lag("close").over(by_pair())) - 1)
    out = out.withColumn("_up", F.when(F.col("pair_return") > 0, 1.0).otherwise(0.0)).withColumn("universe_breadth", F.avg("_up").over(at_time()))
    out = out.withColumn("universe_return", F.avg("pair_return").over(at_time())).withColumn("universe_volatility", F.stddev_samp("pair_return").over(at_time()))
    for name, most in (("top3", 3), ("rank1", 1)):
        out = out.withColumn(f"_{name}", F.when(F.coalesce(F.col("entry_rank") <= most, F.lit(False)), 1).otherwise(0))
        for n in (3, 6, 12):
            out = out.withColumn(f"{name}_count_{n}", F.sum(f"_{name}").over(rolling(n)))
    return out.drop("_up", "_top3", "_rank1")


def with_trailing_gap(features: DataFrame, min_periods: int = 24) -> DataFrame:
    """Decision features with trailing_gap, the median of all earlier gaps, mapped back to every row of its time."""
    medians = expanding_gap_median(features, min_periods).select("open_time", F.col("gap_median").alias("trailing_gap"))
    return features.join(medians, "open_time", "left")


def expanding_gap_median(features: DataFrame, min_periods: int = 24) -> DataFrame:
    """Per time: score_gap and the median of all earlier gaps (NULL under min_periods)."""
    gaps = features.groupBy("open_time").agg(F.max("score_gap").alias("score_gap"))
    return expanding_quantile(gaps, "open_time", "score_gap", 0.5, min_periods, "gap_median")


def scaling(entries: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations of the features; a deviation of 0 counts as 1."""
    r = entries.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    return [r[f"m_{c}"] for c in names], [r[f"s_{c}"] or 1.0 for c in names]


def decide(names: list[str], means: list[float], stds: list[float], centres: list[list[float]], allowed: list[int]) -> Column:
    """A struct of allowed, cluster_id, distance and reason: no_centroids, missing_features, allowed_cluster, blocked_cluster.

    A gate without centres blocks everything, and so does a row with a missing feature.
    """
    none = lambda reason: F.struct(F.lit(False).alias("allowed"), F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("double").alias("distance"), F.lit(reason).alias("reason"))
    if not centres:
        return none("no_centroids")
    z = [(F.col(c) - m) / s for c, m, s in zip(names, means, stds)]
    far = F.array(*[F.sqrt(sum(((a - b) * (a - b) for a, b in zip(z, centre)), F.lit(0.0))) for centre in centres])
    at = (F.array_position(far, F.array_min(far)) - 1).cast("int")
    ok = at.isin(allowed) if allowed else F.lit(False)
    found = F.struct(ok.alias("allowed"), at.alias("cluster_id"), F.array_min(far).alias("distance"), F.when(ok, "allowed_cluster").otherwise("blocked_cluster").alias("reason"))
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    return F.when(whole, found).otherwise(none("missing_features"))


def train_gate(entries: DataFrame, names: list[str], k: int = 4, first: list[list[float]] | None = None, order: list[str] | None = None, seed: int = 42, min_entries: int = 1, floor: float = 0.0, better: bool = True) -> dict:
    """A gate from complete entries: means, stds, centres, allowed clusters and the average return.

    Fewer complete entries than clusters give an empty gate, which blocks everything. The first centres are given, or
    drawn by seed from the entries in `order`. Only sums, k centres and k summary rows pass the driver.
    """
    data = entries.dropna(subset=[*names, "return_pct"])
    if data.limit(k).count() < k:
        return {"means": [], "stds": [], "centres": [], "allowed": [], "average_return": None}
    start = first if first is not None else first_centres(data.sparkSession, data, names, order or names, k, seed)
    means, stds = scaling(data, names)
    centres = kmeans(data, names, start)
    tagged = data.withColumn("cluster_id", nearest(names, means, stds, centres).cast("int"))
    keep = cluster_summary(tagged, min_entries=min_entries, floor=floor, better=better).filter("allowed").select("cluster_id").collect()
    average = data.agg(F.avg("return_pct")).first()[0]
    return {"means": means, "stds": stds, "centres": centres, "allowed": sorted(r["cluster_id"] for r in keep), "average_return": average}


def nearest(names: list[str], means: list[float], stds: list[float], centres: list[list[float]]) -> Column:
    """The index of the nearest centre of the scaled features, the lowest of equals; NULL if a feature is missing."""
    z = [(F.col(c) - m) / s for c, m, s in zip(names, means, stds)]
    far = F.array(*[sum(((a - b) * (a - b) for a, b in zip(z, centre)), F.lit(0.0)) for centre in centres])
    return F.when(far[0].isNotNull(), F.array_position(far, F.array_min(far)) - 1)


def kmeans(entries: DataFrame, names: list[str], first: list[list[float]], rounds: int = 200) -> list[list[float]]:
    """Lloyd's iterations over a DataFrame from given scaled centres; an empty cluster keeps its centre.

    Stops when nothing moves (relative 1e-5, absolute 1e-8) and returns the centres before that step. Only the k centres
    pass the driver.
    """
    entries = entries.select(*names).persist()
    means, stds = scaling(entries, names)
    centres = [list(map(float, c)) for c in first]
    for _ in range(rounds):
        tagged = entries.withColumn("_c", nearest(names, means, stds, centres))
        found = tagged.groupBy("_c").agg(*[F.avg((F.col(c) - m) / s).alias(c) for c, m, s in zip(names, means, stds)]).collect()
        moved = [list(c) for c in centres]
        for r in found:
            if r["_c"] is not None:
                moved[int(r["_c"])] = [r[c] for c in names]
        if np.allclose(moved, centres):
            break
        centres = moved
    entries.unpersist()
    return centres


def cluster_summary(entries: DataFrame, ret: str = "return_pct", pnl: str = "pnl", min_entries: int = 1, floor: float = 0.0, better: bool = True) -> DataFrame:
    """Size, mean, median, win rate and pnl of each cluster, and whether the gate lets it through."""
    entries = stored(entries.select("cluster_id", ret, pnl), "clustered")
    out = entries.groupBy("cluster_id").agg(
        F.count("*").alias("entries"),
        F.avg(ret).alias("mean_return"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum(pnl).alias("total_pnl"),
    )
    out = with_quantiles(out, entries, ["cluster_id"], ret, {"median_return": 0.5}, is_stored=True)
    overall = entries.agg(F.avg(ret).alias("_all"))
    keep = (F.col("entries") >= min_entries) & (F.col("mean_return") >= floor)
    if better:
        keep = keep & (F.col("mean_return") > F.col("_all"))
    return out.join(F.broadcast(overall)).withColumn("allowed", F.coalesce(keep, F.lit(False))).drop("_all")


def first_centres(spark: SparkSession, entries: DataFrame, names: list[str], order: list[str], k: int, seed: int) -> list[list[float]]:
    """k scaled rows drawn by numpy's generator from the rows in `order`; only those rows are read to the driver."""
    means, stds = scaling(entries, names)
    n = entries.count()
    if n < k:
        return []
    picks = np.random.default_rng(seed).choice(n, size=k, replace=False).tolist()
    drawn = numbered(entries, order, "_n").filter(F.col("_n").isin(picks))
    rows = {r["_n"]: [(r[c] - m) / s for c, m, s in zip(names, means, stds)] for r in drawn.collect()}
    return [rows[p] for p in picks]
