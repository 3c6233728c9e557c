"""Training, committing and loading the live pair of models: a ridge score and the cluster gate over its trades."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from dateutil.relativedelta import relativedelta
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import diagnostics, regime, ridge
from panelforge.session import stored
from panelforge.sources import bars, files

TradesOf = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def _ms(t: datetime) -> int:
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def one_model(train: DataFrame, model: str, target: str, alphas: list[float], by: list[str], min_assets: int) -> DataFrame:
    """Each group's coefficients of one model with its chosen alpha."""
    models = {model: ridge.terms(model)}
    return ridge.choose_models(train, ridge.fit_models(train, target, alphas, by, models), target, by, min_assets, models)


def train_live(
    frame: DataFrame, pairs: list[str], as_of: datetime, trades_of: TradesOf, model: str = "momentum_only", alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0), ridge_months: int = 3, regime_months: int = 24,
    target: str = "target_z", label_ms: int = 0, min_assets: int = 8, gate_features: tuple[str, ...] = ("score_gap", "universe_breadth", "top3_count_6"), clusters: int = 4,
    first: list[list[float]] | None = None, min_entries: int = 10, floor: float = 0.0, better: bool = True, metadata: dict | None = None,
) -> tuple[dict, dict]:
    """(ridge, gate) trained on the history of `pairs` before `as_of`.

    frame: pair, open_time, close, the model's terms and the target. The ridge takes rows of the last ridge_months whose
    label (known label_ms after the bar) was known at as_of. Its scores of the last regime_months give decision features;
    trades_of turns those into a trade log (and equity, or None), whose paired and closed entries train the gate. Pairs
    without the whole history and empty windows are errors.
    """
    spark = frame.sparkSession
    end, ridge_start, regime_start = _ms(as_of), _ms(as_of - relativedelta(months=ridge_months)), _ms(as_of - relativedelta(months=regime_months))
    wanted = spark.createDataFrame([(p,) for p in pairs], "pair string")
    mine = stored(frame.join(F.broadcast(wanted), "pair", "left_semi").select("pair", "open_time", "close", *ridge.terms(model), target), "live_frame")  # a list of pairs
    ridge.require_history(mine, wanted, regime_start, end)
    at = F.col("open_time")
    train = mine.filter((at >= ridge_start) & (at < end) & (at <= end - label_ms)).withColumn("_group", F.lit(0))
    chosen = one_model(train, model, target, list(alphas), ["_group"], min_assets).first()
    if chosen is None:
        raise ValueError("the ridge has no rows to train on")
    selection = {"model": model, "alpha": chosen["alpha"], "terms": ridge.terms(model), "beta": list(chosen["beta"]), "mean_ic": chosen["mean_ic"], "hit_rate": chosen["hit_rate"]}
    decided = stored(regime.with_trailing_gap(regime.decision_features(scored_by(mine.filter((at >= regime_start) & (at < end)), selection))), "live_decided")
    trades, equity = trades_of(decided)
    entries = diagnostics.entry_regime(diagnostics.pair_trades(trades, equity), decided).filter("exit_time is not null")
    gate = regime.train_gate(stored(entries.select("pair", "entry_time", *gate_features, "return_pct", "pnl"), "live_entries"), list(gate_features), clusters, first, ["pair", "entry_time"], min_entries=min_entries, floor=floor, better=better)
    common = {**(metadata or {}), "pairs": sorted(pairs), "as_of": as_of, "alphas": list(alphas), "model": model}
    return (
        {"selection": selection, "metadata": {**common, "train_months": ridge_months, "train_rows": chosen["n"]}},
        {"gate": {**gate, "features": list(gate_features)}, "metadata": {**common, "train_months": regime_months}},
    )


def scored_by(rows: DataFrame, selection: dict) -> DataFrame:
    """rows with the ridge_score of a saved selection; NULL where a term is missing."""
    return rows.withColumn("ridge_score", sum((F.col(c) * F.lit(float(b)) for c, b in zip(selection["terms"], selection["beta"])), F.lit(0.0)))


def gated_by(rows: DataFrame, gate: dict) -> DataFrame:
    """rows with the decision of a saved gate: allowed, cluster_id, distance, reason."""
    said = regime.decide(gate["features"], gate["means"], gate["stds"], gate["centres"], gate["allowed"])
    return rows.withColumn("gate", said)


def save_pair(spark: SparkSession, folder: str, ridge_model: dict, gate: dict) -> int:
    """Commits both models as one version and returns its number.

    Both are written under v=<n>, and only then n is named: a reader sees the pair before or this one, never a mix, also
    while it is written or after a failure between the two. The version before stays for readers that have begun.
    """
    done = files.last_mark(spark, f"{folder}/_committed")
    n = max([done if done is not None else -1, *files.versions(spark, folder)]) + 1
    bars.save_model(spark, ridge_model, "ridge", f"{folder}/v={n}/ridge")
    bars.save_model(spark, gate, "gate", f"{folder}/v={n}/gate")
    files.mark(spark, f"{folder}/_committed", n)
    for old in files.versions(spark, folder):
        if done is not None and old < done:
            files.delete(spark, f"{folder}/v={old}")
    return n


def load_pair(spark: SparkSession, folder: str) -> tuple[dict, dict]:
    """The last committed (ridge, gate); FileNotFoundError if there is none."""
    n = files.last_mark(spark, f"{folder}/_committed")
    if n is None:
        raise FileNotFoundError(f"no committed models under {folder}")
    return bars.load_model(spark, f"{folder}/v={n}/ridge", "ridge"), bars.load_model(spark, f"{folder}/v={n}/gate", "gate")


def rebuilt_scores(frame: DataFrame, metadata: dict, target: str = "target_z", min_assets: int = 8) -> DataFrame:
    """The out-of-sample scores of a walk-forward run, rebuilt from its saved metadata: fold, alpha, the frame's columns, ridge_score.

    metadata: model, pairs (none: all), is_months, os_months, step_months, ridge_alphas, start and end (ISO dates; missing
    ones are the frame's first and last time).
    """
    model = metadata.get("model", "momentum_only")
    if metadata.get("pairs"):
        frame = frame.filter(F.col("pair").isin(list(metadata["pairs"])))
    frame = stored(frame, "rebuilt_frame")
    first, last = frame.agg(F.min("open_time"), F.max("open_time")).first()
    if first is None:
        raise ValueError("no rows of the saved pairs")
    of = lambda key, ms: datetime.fromisoformat(metadata[key]) if metadata.get(key) else datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
    folds = ridge.fold_table(frame.sparkSession, ridge.month_folds(of("start", first), of("end", last), int(metadata.get("is_months", 4)), int(metadata.get("os_months", 4)), int(metadata.get("step_months", 1))))
    chosen = one_model(ridge.in_folds(frame, folds, "is"), model, target, [float(a) for a in metadata.get("ridge_alphas", (0.1, 1.0, 10.0, 100.0))], ["fold"], min_assets)
    test = ridge.in_folds(frame, folds, "os").select("fold", *frame.columns)
    return ridge.score_models(test, chosen, ["fold"], {model: ridge.terms(model)}).drop("model")
