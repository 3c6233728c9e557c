"""Walk-forward ridge scores without intercept: folds, closed-form fits from grouped sums, selection by rank IC."""

from __future__ import annotations

from datetime import datetime, timedelta

from dateutil.relativedelta import relativedelta
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators.ic import coefficients

# The models and their terms.
MODELS = {
    "momentum_only": ["z_momentum"],
    "low_roll_only": ["z_low_roll_impact"],
    "momentum_plus_low_roll": ["z_momentum", "z_low_roll_impact"],
    "momentum_low_roll_interaction": ["z_momentum", "z_low_roll_impact", "z_momentum_x_low_roll_impact"],
}


def terms(model: str) -> list[str]:
    if model not in MODELS:
        raise ValueError(f"unknown model {model}; known: {', '.join(MODELS)}")
    return MODELS[model]


def month_folds(start: datetime, end: datetime, is_months: int, os_months: int, step: int) -> list[tuple[int, datetime, datetime, datetime, datetime]]:
    """(fold, is_start, is_end, os_start, os_end); the start moves on from the start before, so month ends stay clamped."""
    folds, at = [], start
    while (os_end := at + relativedelta(months=is_months) + relativedelta(months=os_months)) <= end:
        cut = at + relativedelta(months=is_months)
        folds.append((len(folds), at, cut, cut, os_end))
        at = at + relativedelta(months=step)
    if not folds:
        raise ValueError("the history is too short for one fold")
    return folds


def folds_back(first: datetime, end: datetime, os_months: int, required_months: int, folds: int, step_days: int) -> list[tuple[int, datetime, datetime, datetime, datetime]]:
    """The latest out-of-sample windows, each step_days before the next, in time order: as month_folds() gives them.

    `end` is exclusive. Each window needs required_months of history before it; ValueError if there are fewer than `folds`.
    """
    if min(os_months, required_months, folds, step_days) <= 0:
        raise ValueError("months, folds and step_days must be positive")
    latest, found = end - relativedelta(months=os_months), []
    for k in range(folds):
        start = latest - timedelta(days=step_days * k)
        stop, needed = start + relativedelta(months=os_months), start - relativedelta(months=required_months)
        if needed < first:
            break
        if stop <= end:
            found.append((needed, start, start, stop))
    if len(found) < folds:
        raise ValueError(f"only {len(found)} of {folds} folds have {required_months} months of history before them")
    return [(k, *x) for k, x in enumerate(reversed(found))]


def refit_segments(start: datetime, end: datetime, ridge_days: int, regime_months: int, scheduled: bool = True) -> list[tuple[int, datetime, datetime, bool, bool]]:
    """(segment, start, end, ridge_refit, regime_refit): the window cut at every refit; one segment if nothing is scheduled."""
    if end <= start or ridge_days <= 0 or regime_months <= 0:
        raise ValueError("the window and both steps must be positive")
    ridge, regime = {start}, {start}
    if scheduled:
        n = 1
        while (at := start + timedelta(days=ridge_days * n)) < end:
            ridge.add(at)
            n += 1
        at = start + relativedelta(months=regime_months)
        while at < end:
            regime.add(at)
            at = at + relativedelta(months=regime_months)
    cuts = sorted(ridge | regime | {end})
    return [(k, a, b, a in ridge, a in regime) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def pair_history(bars: DataFrame, pairs: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """pair, problem (missing, too_short or NULL) of each wanted pair, by the bars from start_ms to end_ms."""
    span = bars.groupBy("pair").agg(F.min("open_time").alias("_a"), F.max("open_time").alias("_b"))
    problem = F.when(F.col("_a").isNull(), "missing").when((F.col("_a") > start_ms) | (F.col("_b") < end_ms), "too_short")
    return pairs.select("pair").distinct().join(span, "pair", "left").select("pair", problem.alias("problem"))


def require_history(bars: DataFrame, pairs: DataFrame, start_ms: int, end_ms: int) -> None:
    """ValueError that lists the pairs with problems; only those pass the driver."""
    bad = pair_history(bars, pairs, start_ms, end_ms).filter("problem is not null").orderBy("problem", "pair").collect()
    if bad:
        raise ValueError("; ".join(f"{r['pair']}: {r['problem']}" for r in bad))


def fold_table(spark: SparkSession, folds: list[tuple]) -> DataFrame:
    """fold, is_start, is_end, os_start, os_end in ms."""
    from datetime import timezone

    ms = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
    rows = [(f[0], *[ms(x) for x in f[1:]]) for f in folds]
    return spark.createDataFrame(rows, "fold int, is_start long, is_end long, os_start long, os_end long")


def in_folds(panel: DataFrame, folds: DataFrame, sample: str, purge_ms: int = 0) -> DataFrame:
    """Rows of the panel in the half-open window of each fold (is or os), tagged with the fold.

    Overlapping folds repeat rows by design. purge_ms keeps labels inside the window: rows later than its end less
    purge_ms go.
    """
    a, b = F.col(f"{sample}_start"), F.col(f"{sample}_end")
    late = F.col("open_time") <= b - purge_ms if purge_ms else F.lit(True)
    return panel.join(F.broadcast(folds), (F.col("open_time") >= a) & (F.col("open_time") < b) & late)


def normal_sums(rows: DataFrame, x: list[str], y: str, by: list[str]) -> DataFrame:
    """Sums of X'X and X'y of complete rows, one row per group: xx_i_j, xy_i and n."""
    whole = rows.dropna(subset=[*x, y])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return whole.groupBy(*by).agg(*sums, *[F.sum(F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(x)], F.count("*").alias("n"))


def _det2(a: Column, b: Column, c: Column) -> Column:
    """Determinant of the symmetric [[a, b], [b, c]]."""
    return a * c - b * b


def pseudo_solved(m: list[list[Column]], v: list[Column], zero: float = 1e-14) -> list[Column]:
    """M^+ v for a symmetric M without negative eigenvalues, of one to three rows, as column expressions.

    Where a determinant is under `zero` of the trace's power, M counts as singular: of rank 1 it has the pseudo-inverse
    M / t^2, and of rank 2 among three rows M^+ = ((t^2 - s) M - t M^2) / s^2, with t the trace and s the sum of the
    principal minors of two rows (by Cayley-Hamilton). A zero matrix gives zeros.
    """
    k = len(v)
    if not 1 <= k <= 3:
        raise ValueError(f"one to three terms are solved in the plan: {k}")
    times = lambda x, w: [sum((x[i][j] * w[j] for j in range(1, k)), x[i][0] * w[0]) for i in range(k)]
    t = sum((m[i][i] for i in range(1, k)), m[0][0])
    mv = times(m, v)
    flat = [F.when(t > 0, x / (t * t)).otherwise(0.0) for x in mv]
    if k == 1:
        return [F.when(t > 0, v[0] / t).otherwise(0.0)]
    if k == 2:
        det = _det2(m[0][0], m[0][1], m[1][1])
        whole = [(m[1][1] * v[0] - m[0][1] * v[1]) / det, (m[0][0] * v[1] - m[0][1] * v[0]) / det]
        return [F.when(det > zero * t * t, x).otherwise(y) for x, y in zip(whole, flat)]
    (a, b, c), (_, d, e), (_, _, f) = m
    adjugate = [[_det2(d, e, f), c * e - b * f, b * e - c * d], [c * e - b * f, _det2(a, c, f), b * c - a * e], [b * e - c * d, b * c - a * e, _det2(a, b, d)]]
    det = a * adjugate[0][0] + b * adjugate[0][1] + c * adjugate[0][2]
    s = adjugate[0][0] + adjugate[1][1] + adjugate[2][2]
    plane = [((t * t - s) * x - t * y) / (s * s) for x, y in zip(mv, times(m, mv))]
    whole = [x / det for x in times(adjugate, v)]
    return [F.when(det > zero * t * t * t, x).when(s > zero * t * t, y).otherwise(z) for x, y, z in zip(whole, plane, flat)]


def fit(rows: DataFrame, x: list[str], y: str, alphas: list[float], by: list[str]) -> DataFrame:
    """Group columns, alpha, n, beta (array): (X'X + alpha I)^+ X'y of all groups and alphas, inside the plan."""
    sums = normal_sums(rows, x, y, by).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    at = range(len(x))
    m = [[F.col(f"xx_{min(i, j)}_{max(i, j)}") + (F.col("alpha") if i == j else F.lit(0.0)) for j in at] for i in at]
    return sums.select(*by, "alpha", "n", F.array(*pseudo_solved(m, [F.col(f"xy_{i}") for i in at])).alias("beta"))


def fit_models(rows: DataFrame, y: str, alphas: list[float], by: list[str], models: dict[str, list[str]] = MODELS) -> DataFrame:
    """Group columns, model, alpha, n, beta: the fits of all models from one aggregate over the rows.

    Each model takes the rows that have all of its own terms. Sums that no model shares are kept apart by model.
    """
    sums, parts = [], []
    for name, x in models.items():
        whole = F.col(y).isNotNull()
        for c in x:
            whole = whole & F.col(c).isNotNull()
        total = lambda v, w=whole: F.sum(F.when(w, v))
        at = range(len(x))
        sums += [total(F.col(x[i]) * F.col(x[j])).alias(f"{name}_xx_{i}_{j}") for i in at for j in at if i <= j]
        sums += [total(F.col(x[i]) * F.col(y)).alias(f"{name}_xy_{i}") for i in at] + [F.count_if(whole).alias(f"{name}_n")]
        m = [[F.col(f"{name}_xx_{min(i, j)}_{max(i, j)}") + (F.col("alpha") if i == j else F.lit(0.0)) for j in at] for i in at]
        beta = F.array(*pseudo_solved(m, [F.col(f"{name}_xy_{i}") for i in at]))
        parts.append(F.struct(F.lit(name).alias("model"), F.col(f"{name}_n").alias("n"), beta.alias("beta")))
    fits = rows.groupBy(*by).agg(*sums).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return fits.select(*by, "alpha", F.explode(F.array(*parts)).alias("_f")).select(*by, "_f.model", "alpha", "_f.n", "_f.beta").filter("n > 0")


def score_models(rows: DataFrame, betas: DataFrame, by: list[str], models: dict[str, list[str]] = MODELS) -> DataFrame:
    """rows once per model and alpha of their group, with model, alpha and ridge_score (NULL where a term is missing).

    The coefficients of a group are one row of a few structs, so rows meet them in one keyed join.
    """
    held = betas.groupBy(*by).agg(F.collect_list(F.struct("model", "alpha", "beta")).alias("_b"))  # models times alphas a group

    def score(b: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, x in models.items():
            out = F.when(b["model"] == name, sum((F.col(c) * b["beta"][i] for i, c in enumerate(x)), F.lit(0.0))).otherwise(out)
        return F.struct(b["model"].alias("model"), b["alpha"].alias("alpha"), out.alias("ridge_score"))

    told = rows.join(F.broadcast(held), by).withColumn("_s", F.explode(F.transform("_b", score)))
    return told.select(*rows.columns, "_s.*")


def choose_models(train: DataFrame, betas: DataFrame, y: str, by: list[str], min_assets: int, models: dict[str, list[str]] = MODELS) -> DataFrame:
    """The coefficients of each group and model with the alpha chosen as select_alpha() does: with mean_ic and hit_rate."""
    ics = coefficients(score_models(train, betas, by, models), ["ridge_score"], y, [*by, "model", "alpha", "open_time"], min_assets)
    best = _best_alpha(ics, [*by, "model"])
    return betas.join(F.broadcast(best), [*by, "model", "alpha"])  # one row a group and model


def scored(rows: DataFrame, betas: DataFrame, x: list[str], by: list[str]) -> DataFrame:
    """rows with ridge_score = x . beta of their group; NULL where a term is missing."""
    total = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(x)), F.lit(0.0))
    return rows.join(F.broadcast(betas), by).withColumn("ridge_score", total)


def select_alpha(train: DataFrame, betas: DataFrame, x: list[str], y: str, by: list[str], min_assets: int) -> DataFrame:
    """The alpha of each group with the best mean rank IC per time, then hit rate, then the smallest alpha."""
    ics = coefficients(scored(train, betas, x, by), ["ridge_score"], y, [*by, "alpha", "open_time"], min_assets)
    return _best_alpha(ics, by)


def _best_alpha(ics: DataFrame, by: list[str]) -> DataFrame:
    """Coefficients that are zero up to the order of summation are no hits."""
    means = ics.groupBy(*by, "alpha").agg(F.avg("ic").alias("mean_ic"), F.avg(F.when(F.round("ic", 9) > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
    w = Window.partitionBy(*by).orderBy(F.round("mean_ic", 12).desc_nulls_last(), F.col("hit_rate").desc_nulls_last(), "alpha")
    return means.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
