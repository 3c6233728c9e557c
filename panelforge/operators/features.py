"""Rolling features per pair, ranks and scores per time, labels. Two exchanges for the whole frame: pair, then time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expr import at_time, by_pair, erf, guarded, log_ratio, null_nan, pct_rank, rolling, safe_div, zscore

MICRO = ["roll_measure", "roll_impact", "amihud", "kyle_lambda", "vpin"]


def require(df: DataFrame, *names: str) -> None:
    """ValueError that lists the missing columns."""
    if gone := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")


def microstructure(bars: DataFrame, w: int = 50, dollars: str | None = None) -> DataFrame:
    """bars with roll_measure, roll_impact, amihud, kyle_lambda and vpin over w rows (w >= 2)."""
    require(bars, "pair", "open_time", "close", "volume", *([dollars] if dollars else []))
    if w < 2:
        raise ValueError("window must be at least 2")
    d, ld, p, v = F.col("_d"), F.col("_ld"), F.col("close"), F.col("volume")
    money = F.col(dollars) if dollars else p * v
    out = bars.withColumn("_p1", F.lag("close").over(by_pair())).withColumn("_pw", F.lag("close", w).over(by_pair()))
    out = out.withColumn("_d", p - F.col("_p1")).withColumn("_a", safe_div(F.abs(safe_div(p, F.col("_p1")) - 1), money))
    out = out.withColumn("_ld", F.lag("_d").over(by_pair())).withColumn("_sv", F.signum(d) * v)
    out = out.withColumn("_cov", guarded(F.covar_samp(d, ld), d * ld, w))
    out = out.withColumn("roll_measure", 2 * F.sqrt(F.abs("_cov")))
    out = out.withColumn("roll_impact", safe_div(F.col("roll_measure"), money))
    out = out.withColumn("amihud", guarded(F.avg("_a"), F.col("_a"), w))
    out = out.withColumn("kyle_lambda", safe_div(p - F.col("_pw"), guarded(F.sum("_sv"), F.col("_sv"), w + 1)))
    out = out.withColumn("_z", safe_div(d, guarded(F.stddev_samp(d), d, w)))
    out = out.withColumn("_imbalance", F.when(v != 0, F.abs(erf(F.col("_z") / math.sqrt(2.0)))))
    out = out.withColumn("vpin", guarded(F.avg("_imbalance"), F.col("_imbalance"), w))
    return out.drop("_p1", "_pw", "_d", "_a", "_ld", "_sv", "_cov", "_z", "_imbalance")


def micro_snapshot(frame: DataFrame) -> DataFrame:
    """The last value of each measure of each pair."""
    return frame.groupBy("pair").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("open_time"))).alias(c) for c in MICRO])


def alpha(frame: DataFrame, windows: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Per pair: log returns, realised volatility, volatility-adjusted momentum, trend persistence, breakout quality."""
    require(frame, "pair", "open_time", "high", "close", "volume")
    p = F.col("close")
    out = frame.withColumn("_r1", log_ratio(p, F.lag("close").over(by_pair())))
    for w in windows:
        r = F.col("_r1")
        out = out.withColumn(f"log_return_{w}", log_ratio(p, F.lag("close", w).over(by_pair())))
        out = out.withColumn(f"realized_vol_{w}", guarded(F.stddev_samp(r), r, w))
        out = out.withColumn(f"vol_adj_momentum_{w}", safe_div(F.col(f"log_return_{w}"), F.col(f"realized_vol_{w}")))
        up = F.when(r > 0, 1.0).otherwise(0.0)
        out = out.withColumn(f"trend_persistence_{w}", F.when(F.count(F.lit(1)).over(rolling(w)) == w, 2 * F.avg(up).over(rolling(w)) - 1))
        top = guarded(F.max("high"), F.col("high"), w, 1)
        usual = guarded(F.percentile("volume", F.lit(0.5)), F.col("volume"), w, 1)
        over = safe_div(p, top) - 1
        out = out.withColumn(f"breakout_quality_{w}", F.when(over.isNotNull(), F.greatest(over, F.lit(0.0))) * safe_div(F.col("volume"), usual))
    return out.drop("_r1")


def cross_section(frame: DataFrame, windows: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Per time: relative strength, residual momentum, and momentum damped by the rank of a risk measure."""
    out = frame
    for w in windows:
        r = F.col(f"log_return_{w}")
        out = out.withColumn(f"relative_strength_{w}", pct_rank(r)).withColumn(f"residual_momentum_{w}", r - F.avg(r).over(at_time()))
        for risk in ("vpin", "roll_impact"):
            damp = 1 - pct_rank(F.col(risk)) if risk in frame.columns else F.lit(None).cast("double")
            out = out.withColumn(f"momentum_low_{risk}_{w}", F.col(f"vol_adj_momentum_{w}") * damp)
    return out


def signals(frame: DataFrame, momentum: str) -> DataFrame:
    """z_momentum, z_low_roll_impact and the z-score of their product."""
    out = frame.withColumn("z_momentum", zscore(F.col(momentum))).withColumn("z_low_roll_impact", zscore(-F.col("roll_impact")))
    return out.withColumn("z_momentum_x_low_roll_impact", zscore(F.col("z_momentum") * F.col("z_low_roll_impact")))


def combined_risk(frame: DataFrame) -> DataFrame:
    """micro_risk: the percent rank of the mean of four risk ranks, missing ones left out; risk_tercile: low, mid, high."""
    names = ["roll_measure", "roll_impact", "amihud", "vpin"]
    out = frame
    for c in names:
        out = out.withColumn(f"_k_{c}", pct_rank(F.col(c)))
    total = sum((F.coalesce(F.col(f"_k_{c}"), F.lit(0.0)) for c in names), F.lit(0.0))
    found = sum((F.col(f"_k_{c}").isNotNull().cast("int") for c in names), F.lit(0))
    out = out.withColumn("_mean", safe_div(total, found)).withColumn("micro_risk", pct_rank(F.col("_mean")))
    tercile = F.when(F.col("micro_risk") <= 1 / 3, "low").when(F.col("micro_risk") <= 2 / 3, "mid").when(F.col("micro_risk").isNotNull(), "high")
    return out.withColumn("risk_tercile", tercile).drop("_mean", *[f"_k_{c}" for c in names])


def forward_return(frame: DataFrame, h: int, method: str = "pct") -> DataFrame:
    """forward_return_h by pct, log or diff; the last h rows of a pair have none."""
    later, p = F.lead("close", h).over(by_pair()), F.col("close")
    forms = {"pct": safe_div(later, p) - 1, "log": log_ratio(later, p), "diff": later - p}
    if method not in forms:
        raise ValueError(f"method must be one of {', '.join(forms)}: {method}")
    return frame.withColumn(f"forward_return_{h}", null_nan(forms[method]))


def target(frame: DataFrame, h: int) -> DataFrame:
    """target_z: the z-score of the label in its time."""
    out = frame if f"forward_return_{h}" in frame.columns else forward_return(frame, h)
    return out if "target_z" in out.columns else out.withColumn("target_z", zscore(F.col(f"forward_return_{h}")))


def feature_frame(bars: DataFrame, micro_window: int, windows: tuple[int, ...], h: int) -> DataFrame:
    """All features and labels of a bar panel."""
    frame = cross_section(alpha(microstructure(bars, micro_window), windows), windows)
    return combined_risk(target(signals(frame, f"vol_adj_momentum_{windows[-1]}"), h))
