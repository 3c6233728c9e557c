"""Information coefficients: pooled, per group and per time, over any number of features in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expr import pearson, safe_div
from panelforge.operators.order import tie_ranks, with_quantiles
from panelforge.session import stored

RANKS = ("average", "min", "max", "first", "dense")


def complete_pairs(frame: DataFrame, features: list[str], label: str, by: list[str]) -> DataFrame:
    """feature, x, y and the group columns, for rows where both values are there."""
    long = frame.select(*by, F.col(label).alias("y"), *features).unpivot([*by, "y"], features, "feature", "x")
    return long.filter("x is not null and y is not null")


def ranked(x: str, keys: list[str], method: str = "average", tie: tuple[str, ...] = ()):
    """Rank of x inside the keys by the given rule for ties; `first` needs columns that order ties."""
    if method not in RANKS:
        raise ValueError(f"rank method must be one of {', '.join(RANKS)}: {method}")
    w = Window.partitionBy(*keys).orderBy(x)
    if method == "dense":
        return F.dense_rank().over(w).cast("double")
    if method == "first":
        return F.row_number().over(Window.partitionBy(*keys).orderBy(x, *tie)).cast("double")
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    extra = {"min": F.lit(0), "max": ties - 1, "average": (ties - 1) / 2}[method]
    return (F.rank().over(w) + extra).cast("double")


def coefficients(frame: DataFrame, features: list[str], label: str, by: list[str] | None = None, min_periods: int = 3, method: str = "spearman", rank_method: str = "average") -> DataFrame:
    """feature, group columns, n, ic: NULL under min_periods complete pairs or with a constant side.

    Ranks inside groups come from one window a group; pooled average ranks are global places of a range sort.
    """
    by = by or []
    keys = ["feature", *by]
    pairs = complete_pairs(frame, features, label, by)
    if method == "spearman" and not by and rank_method == "average":  # few groups that grow with the table
        tie = [c for c in ("pair", "open_time") if c in frame.columns]
        pairs = complete_pairs(frame, features, label, tie)
        pairs = tie_ranks(tie_ranks(pairs, ["feature"], "x", tie, "_x"), ["feature"], "y", tie, "_y").select("feature", F.col("_x").alias("x"), F.col("_y").alias("y"))
    elif method == "spearman":
        pairs = pairs.select(*keys, ranked("x", keys, rank_method).alias("x"), ranked("y", keys, rank_method).alias("y"))
    elif method != "pearson":
        raise ValueError(f"method must be pearson or spearman: {method}")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), pearson("x", "y").alias("_ic")).select(*keys, "n", F.when(F.col("n") >= min_periods, F.col("_ic")).alias("ic"))


def summary(ics: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, deviation and count of coefficients, and the share of positive ones (missing ones count as not positive).

    Coefficients that are zero up to the order of summation count as zero.
    """
    ics = stored(ics.select(*by, F.round("ic", 9).alias("ic")), "coefficients")
    out = ics.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("std_ic"),
        F.count("ic").alias("periods"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive_rate"),
    )
    return with_quantiles(out, ics, by, "ic", {"median_ic": 0.5}, is_stored=True)


def strongest(ics: DataFrame, n: int) -> DataFrame:
    """The n coefficients of largest absolute value, ties by feature; missing ones last."""
    return ics.orderBy(F.abs("ic").desc_nulls_last(), "feature").limit(n)


def forward_lookup(scores: DataFrame, bars: DataFrame, horizons: list[int], bar_ms: int) -> DataFrame:
    """scores with horizon and forward_return, from the bar exactly `horizon` bars later; rows without it are dropped."""
    grid = scores.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int")
    at = scores.join(F.broadcast(grid)).withColumn("_then", F.col("open_time") + F.col("horizon").cast("long") * F.lit(bar_ms))
    later = bars.select(F.col("pair").alias("_p"), F.col("open_time").alias("_t"), F.col("close").alias("_later"))
    joined = at.join(later, (F.col("pair") == F.col("_p")) & (F.col("_then") == F.col("_t")))
    return joined.withColumn("forward_return", safe_div(F.col("_later"), F.col("close")) - 1).drop("_then", "_p", "_t", "_later")
