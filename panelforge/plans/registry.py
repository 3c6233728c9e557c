"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.expr import safe_div
from panelforge.operators import features as X
from panelforge.operators import ic, order, regime, reports, ridge, simulate
from panelforge.plans import sql
from panelforge.session import stored, table
from panelforge.sources import bars as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MICRO_WINDOW, WINDOWS, HORIZON = 10, (4, 8, 12), 4
LAST = WINDOWS[-1]
MOMENTUM, LABEL = f"vol_adj_momentum_{LAST}", f"forward_return_{HORIZON}"
START, END = datetime(1995, 1, 1), datetime(2001, 7, 1)
# roll_impact, amihud and the like are tiny: results are scaled before they are rounded
TINY = {"roll_impact": 1e6, "amihud": 1e6}
FRAME = f"WITH {sql.BARS}, {sql.features(MICRO_WINDOW, WINDOWS, HORIZON)}"
SCORED = f"{FRAME}, scored AS (SELECT pair, open_time, close, z_momentum AS score, {LABEL} AS ret, micro_risk, risk_tercile FROM features)"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(x: str, scale: float = 1.0, alias: str | None = None):
    return F.round(F.col(x) * scale, 6).alias(alias or x)


def s6(x: str, scale: float = 1.0, alias: str | None = None) -> str:
    value = f"round(({x}) * {scale:.1f}, 6)"
    return f"CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END AS {alias or x}"  # no negative zero


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.feature_frame(B.weekly_bars(spark, sf_dir), MICRO_WINDOW, WINDOWS, HORIZON)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).select("pair", "open_time", "close", F.col("z_momentum").alias("score"), F.col(LABEL).alias("ret"), "micro_risk", "risk_tercile")


# bars

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
bar_select = "SELECT pair, open_time, " + ", ".join(f"round({c}, 9) AS {c}" for c in BAR_COLUMNS)  # prices may end in a five at the seventh place


@query("bars_ohlcv", f"WITH {sql.BARS} {bar_select} FROM bars")
def bars_ohlcv(spark, sf_dir):
    return B.weekly_bars(spark, sf_dir).select("pair", "open_time", *[F.round(c, 9).alias(c) for c in BAR_COLUMNS])


@query("events_hourly_bars", f"WITH {sql.HOURLY} {bar_select} FROM hourly")
def events_hourly_bars(spark, sf_dir):
    return B.hourly_bars(spark, sf_dir).select("pair", "open_time", *[F.round(c, 9).alias(c) for c in BAR_COLUMNS])


@query("bars_dedupe_last", "SELECT event_type AS pair, epoch_ms(date_trunc('hour', ts)::TIMESTAMP) AS open_time, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY ALL")
def bars_dedupe_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pair"), F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("open_time"), "event_id", "value")
    return B.keep_last(e, ["pair", "open_time"], "event_id").select("pair", "open_time", "event_id", r6("value"))


@query("bars_upsert", f"WITH {sql.BARS} SELECT pair, open_time, round(CASE WHEN open_time % 2 = 0 AND pair < 'Brand#3' THEN close * 2 ELSE close END, 9) AS close FROM bars")
def bars_upsert(spark, sf_dir):
    old = B.weekly_bars(spark, sf_dir)
    new = old.filter("open_time % 2 = 0 and pair < 'Brand#3'").withColumn("close", F.col("close") * 2)
    return B.upsert(old, new).select("pair", "open_time", F.round("close", 9).alias("close"))


@query("bars_latest", f"WITH {sql.BARS} SELECT pair, open_time, round(close, 9) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY pair ORDER BY open_time DESC) <= 3")
def bars_latest(spark, sf_dir):
    return B.latest(B.weekly_bars(spark, sf_dir), 3).select("pair", "open_time", F.round("close", 9).alias("close"))


@query("coverage", f"WITH {sql.BARS} SELECT pair, min(open_time) AS first_bar, max(open_time) AS last_bar, count(*) AS bars FROM bars GROUP BY pair")
def coverage(spark, sf_dir):
    return B.coverage(B.weekly_bars(spark, sf_dir))


@query("common_history", f"WITH {sql.BARS}, c AS (SELECT pair, min(open_time) AS a, max(open_time) AS b, count(*) AS bars FROM bars GROUP BY pair) SELECT pair, bars FROM c WHERE a = (SELECT min(a) FROM c) AND b = (SELECT max(b) FROM c) AND bars = (SELECT max(bars) FROM c)")
def common_history(spark, sf_dir):
    return B.common_history(B.weekly_bars(spark, sf_dir))


@query("bar_delta", f"WITH {sql.BARS}, t AS (SELECT DISTINCT open_time FROM bars), g AS (SELECT open_time - lag(open_time) OVER (ORDER BY open_time) AS gap FROM t) SELECT coalesce(quantile_cont(gap, 0.5), 0)::DOUBLE AS delta_ms FROM g")
def bar_delta(spark, sf_dir):
    return B.bar_delta(B.weekly_bars(spark, sf_dir))


@query("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


# features: one query each over the same frame, of which Spark computes what the columns need


def _feature_query(column: str) -> None:
    scale = next((s for k, s in TINY.items() if column.startswith(k)), 1.0)

    @query(column, f"{FRAME} SELECT pair, open_time, {s6(column, scale)} FROM features")
    def one(spark, sf_dir):
        return frame(spark, sf_dir).select("pair", "open_time", r6(column, scale))


for _c in [*X.MICRO, "z_momentum", "z_low_roll_impact", "z_momentum_x_low_roll_impact", LABEL, "target_z", "micro_risk"] + [
    f"{k}_{w}" for k in ("log_return", "realized_vol", "vol_adj_momentum", "trend_persistence", "breakout_quality", "relative_strength", "residual_momentum", "momentum_low_vpin", "momentum_low_roll_impact") for w in WINDOWS
]:
    _feature_query(_c)


@query("micro_snapshot", f"{FRAME} SELECT pair, " + ", ".join(f"round(arg_max({c}, open_time) FILTER (WHERE {c} IS NOT NULL) * {TINY.get(c, 1.0):.1f}, 6) AS {c}" for c in X.MICRO) + " FROM features GROUP BY pair")
def micro_snapshot(spark, sf_dir):
    return X.micro_snapshot(frame(spark, sf_dir)).select("pair", *[r6(c, TINY.get(c, 1.0)) for c in X.MICRO])


@query("combined_risk_tercile", f"{FRAME} SELECT risk_tercile, count(*) AS n, round(avg(micro_risk), 6) AS micro_risk FROM features GROUP BY risk_tercile")
def combined_risk_tercile(spark, sf_dir):
    return frame(spark, sf_dir).groupBy("risk_tercile").agg(F.count("*").alias("n"), F.round(F.avg("micro_risk"), 6).alias("micro_risk"))


@query("topk_momentum", f"{FRAME} SELECT pair, open_time, {s6('z_momentum')}, row_number() OVER (PARTITION BY open_time ORDER BY z_momentum DESC, pair) AS place FROM features WHERE z_momentum IS NOT NULL QUALIFY place <= 3")
def topk_momentum(spark, sf_dir):
    best = reports.top_k(frame(spark, sf_dir), "z_momentum", 3)
    return best.select("pair", "open_time", r6("z_momentum"), F.col("place").cast("long").alias("place"))


# information coefficients

IC_FEATURES = ["roll_measure", "amihud", "vpin", MOMENTUM, f"residual_momentum_{LAST}", f"trend_persistence_{LAST}"]


def _ic_query(name: str, by: list[str], minimum: int, method: str) -> None:
    columns = "".join(f", {c}" for c in by)

    @query(name, f"{FRAME}, c AS ({sql.coefficients('features', IC_FEATURES, LABEL, by, minimum, method)}) SELECT feature{columns}, n, {s6('ic')} FROM c")
    def one(spark, sf_dir):
        return ic.coefficients(frame(spark, sf_dir), IC_FEATURES, LABEL, by, minimum, method).select("feature", *by, "n", r6("ic"))


_ic_query("ic_pooled_pearson", [], 3, "pearson")
_ic_query("ic_pooled_spearman", [], 3, "spearman")
_ic_query("ic_per_pair", ["pair"], 3, "spearman")
_ic_query("ic_by_time", ["open_time"], 8, "spearman")
_ic_query("ic_conditional_tercile", ["risk_tercile", "open_time"], 4, "spearman")


@query("ic_summary", f"{FRAME}, c AS ({sql.coefficients('features', IC_FEATURES, LABEL, ['open_time'], 8, 'spearman')}), c9 AS (SELECT feature, round(ic, 9) AS ic FROM c) SELECT feature, round(avg(ic), 6) AS mean_ic, round(quantile_cont(ic, 0.5), 6) AS median_ic, round(stddev_samp(ic), 6) AS std_ic, count(ic) AS periods, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM c9 GROUP BY feature")
def ic_summary(spark, sf_dir):
    out = ic.summary(ic.coefficients(frame(spark, sf_dir), IC_FEATURES, LABEL, ["open_time"], 8), ["feature"])
    return out.select("feature", r6("mean_ic"), r6("median_ic"), r6("std_ic"), "periods", r6("positive_rate"))


HORIZONS = (1, 4, 12)


@query(
    "ic_horizons",
    f"{FRAME}, h AS (SELECT *, " + ", ".join(f"lead(close, {k}) OVER (PARTITION BY pair ORDER BY open_time) / nullif(close, 0) - 1 AS fwd_{k}" for k in HORIZONS) + " FROM features), c AS ("
    + " UNION ALL ".join(f"SELECT {k} AS horizon, * FROM ({sql.coefficients('h', IC_FEATURES, f'fwd_{k}', [], 3, 'pearson')})" for k in HORIZONS) + f") SELECT horizon, feature, n, {s6('ic')} FROM c",
)
def ic_horizons(spark, sf_dir):
    base = frame(spark, sf_dir).drop(*[f"forward_return_{k}" for k in HORIZONS])
    parts = [ic.coefficients(X.forward_return(base, k), IC_FEATURES, f"forward_return_{k}", method="pearson").select(F.lit(k).alias("horizon"), "feature", "n", r6("ic")) for k in HORIZONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rank_methods", f"WITH {sql.BARS}, b AS (SELECT pair, open_time, round(volume / 50) AS v FROM bars), k AS (SELECT *, rank() OVER w AS lo, count(*) OVER (PARTITION BY open_time, v) AS ties, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY open_time ORDER BY v, pair) AS f FROM b WINDOW w AS (PARTITION BY open_time ORDER BY v)) SELECT pair, open_time, lo + (ties - 1) / 2.0 AS average, lo::DOUBLE AS min, (lo + ties - 1)::DOUBLE AS max, f::DOUBLE AS first, d::DOUBLE AS dense FROM k")
def rank_methods(spark, sf_dir):
    b = B.weekly_bars(spark, sf_dir).withColumn("v", F.round(F.col("volume") / 50))
    return b.select("pair", "open_time", *[ic.ranked("v", ["open_time"], m, ("pair",)).alias(m) for m in ic.RANKS])


@query("forward_lookup", f"{SCORED} SELECT s.pair, s.open_time, h.horizon, round(b.close / nullif(s.close, 0) - 1, 6) AS forward_return FROM scored s CROSS JOIN (SELECT unnest([1, 4])::INTEGER AS horizon) h JOIN bars b ON b.pair = s.pair AND b.open_time = s.open_time + h.horizon::BIGINT * {B.WEEK_MS}")
def forward_lookup(spark, sf_dir):
    s = scored(spark, sf_dir).select("pair", "open_time", "close")
    return ic.forward_lookup(s, B.weekly_bars(spark, sf_dir), [1, 4], B.WEEK_MS).select("pair", "open_time", "horizon", r6("forward_return"))


# folds and ridge

FOLDS = ridge.month_folds(START, END, 12, 6, 6)
ALPHAS = [0.1, 1.0, 10.0, 100.0]
_ms = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
FOLD_SQL = "folds(fold, is_start, is_end, os_start, os_end) AS (VALUES " + ", ".join(f"({f[0]}, {', '.join(str(_ms(x)) for x in f[1:])})" for f in FOLDS) + ")"
FIT_SQL = f"""{FRAME}, {FOLD_SQL}, alphas(alpha) AS (VALUES {', '.join(f'({a:.1f}::DOUBLE)' for a in ALPHAS)}),
train AS (SELECT fold, pair, open_time, z_momentum AS x, target_z AS y FROM features JOIN folds ON open_time >= is_start AND open_time < is_end WHERE z_momentum IS NOT NULL AND target_z IS NOT NULL),
fit AS (SELECT fold, alpha, count(*) AS n, sum(x * y) / (sum(x * x) + alpha) AS beta FROM train, alphas GROUP BY fold, alpha)"""


def _folds(spark):
    return ridge.fold_table(spark, FOLDS)


def _fits(spark, sf_dir, model="momentum_only"):
    x = ridge.terms(model)
    panel = stored(frame(spark, sf_dir).select("pair", "open_time", "close", *x, "target_z", LABEL), "panel")
    train = ridge.in_folds(panel, _folds(spark), "is").select("fold", "pair", "open_time", *x, "target_z")
    return panel, train, ridge.fit(train, x, "target_z", ALPHAS, ["fold"]), x


@query("folds_panel", f"WITH {sql.BARS}, {FOLD_SQL} SELECT fold, count(*) FILTER (WHERE open_time < is_end) AS is_rows, count(*) FILTER (WHERE open_time >= os_start) AS os_rows FROM bars JOIN folds ON open_time >= is_start AND open_time < os_end GROUP BY fold")
def folds_panel(spark, sf_dir):
    joined = B.weekly_bars(spark, sf_dir).join(F.broadcast(_folds(spark)), (F.col("open_time") >= F.col("is_start")) & (F.col("open_time") < F.col("os_end")))
    return joined.groupBy("fold").agg(F.count_if(F.col("open_time") < F.col("is_end")).alias("is_rows"), F.count_if(F.col("open_time") >= F.col("os_start")).alias("os_rows"))


@query("ridge_fit", f"{FIT_SQL} SELECT fold, alpha, n, {s6('beta')} FROM fit")
def ridge_fit(spark, sf_dir):
    return _fits(spark, sf_dir)[2].select("fold", "alpha", "n", F.round(F.col("beta")[0], 6).alias("beta"))


@query(
    "ridge_fit_two_terms",
    f"""{FRAME}, {FOLD_SQL}, alphas(alpha) AS (VALUES {', '.join(f'({a:.1f}::DOUBLE)' for a in ALPHAS)}),
t AS (SELECT fold, z_momentum AS a, z_low_roll_impact AS b, target_z AS y FROM features JOIN folds ON open_time >= is_start AND open_time < is_end WHERE z_momentum IS NOT NULL AND z_low_roll_impact IS NOT NULL AND target_z IS NOT NULL),
m AS (SELECT fold, alpha, sum(a * a) + alpha AS p, sum(a * b) AS q, sum(b * b) + alpha AS s, sum(a * y) AS u, sum(b * y) AS v FROM t, alphas GROUP BY fold, alpha)
SELECT fold, alpha, round((s * u - q * v) / (p * s - q * q), 6) AS beta_0, round((p * v - q * u) / (p * s - q * q), 6) AS beta_1 FROM m""",
)
def ridge_fit_two_terms(spark, sf_dir):
    return _fits(spark, sf_dir, "momentum_plus_low_roll")[2].select("fold", "alpha", *[F.round(F.col("beta")[i], 6).alias(f"beta_{i}") for i in range(2)])


@query(
    "ridge_select",
    f"""{FIT_SQL}, s AS (SELECT t.fold, alpha, open_time, x * beta AS ridge_score, y AS target_z FROM train t JOIN fit USING (fold)),
c AS ({sql.coefficients('s', ['ridge_score'], 'target_z', ['fold', 'alpha', 'open_time'], 8, 'spearman')}),
g AS (SELECT fold, alpha, avg(ic) AS mean_ic, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM c GROUP BY fold, alpha)
SELECT fold, alpha, {s6('mean_ic')}, {s6('hit_rate')} FROM g QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(mean_ic, 12) DESC NULLS LAST, hit_rate DESC NULLS LAST, alpha) = 1""",
)
def ridge_select(spark, sf_dir):
    _, train, betas, x = _fits(spark, sf_dir)
    return ridge.select_alpha(train, betas, x, "target_z", ["fold"], 8).select("fold", "alpha", r6("mean_ic"), r6("hit_rate"))


OS_SQL = f"{FIT_SQL}, os AS (SELECT f.fold, pair, open_time, close, z_momentum * beta AS ridge_score, {LABEL} AS ret FROM features JOIN folds f ON open_time >= os_start AND open_time < os_end JOIN fit ON fit.fold = f.fold AND alpha = 1.0)"


def _os_scores(spark, sf_dir):
    panel, _, betas, x = _fits(spark, sf_dir)
    return ridge.scored(ridge.in_folds(panel, _folds(spark), "os"), betas.filter("alpha = 1.0"), x, ["fold"])


TERMS = ridge.terms("momentum_low_roll_interaction")


def _model_sql(name: str) -> str:
    """Fits of one model by Cramer's rule, as fold, model, alpha, beta."""
    x = ridge.terms(name)
    k = range(len(x))
    m = lambda i, j: f"(sum({x[i]} * {x[j]})" + (" + alpha)" if i == j else ")")
    v = lambda i: f"sum({x[i]} * target_z)"

    def det(c: list[list[str]]) -> str:
        if len(c) == 1:
            return c[0][0]
        minor = lambda j: [[r[i] for i in range(len(c)) if i != j] for r in c[1:]]
        return "(" + " ".join(f"{'+-'[j % 2]} {c[0][j]} * {det(minor(j))}" for j in range(len(c))) + ")"

    whole = [[m(i, j) for j in k] for i in k]
    beta = [f"{det([[v(i) if j == at else whole[i][j] for j in k] for i in k])} / {det(whole)}" for at in k]
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*x, "target_z"])
    return f"SELECT fold, '{name}' AS model, alpha, [{', '.join(beta)}] AS beta FROM inside, alphas WHERE {known} GROUP BY fold, alpha"


_dot = "CASE model " + " ".join(f"WHEN '{n}' THEN {' + '.join(f'{c} * beta[{i + 1}]' for i, c in enumerate(ridge.terms(n)))}" for n in ridge.MODELS) + " END"
CHOICE_SQL = f"""alphas(alpha) AS (VALUES {', '.join(f'({a:.1f}::DOUBLE)' for a in ALPHAS)}),
fits AS ({' UNION ALL '.join(_model_sql(n) for n in ridge.MODELS)}),
tried AS (SELECT i.fold, model, alpha, open_time, {_dot} AS ridge_score, target_z FROM inside i JOIN fits USING (fold)),
tried_ic AS ({sql.coefficients('tried', ['ridge_score'], 'target_z', ['fold', 'model', 'alpha', 'open_time'], 8, 'spearman')}),
means AS (SELECT fold, model, alpha, avg(ic) AS mean_ic, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM tried_ic GROUP BY ALL),
chosen AS (SELECT m.*, beta FROM means m JOIN fits USING (fold, model, alpha) QUALIFY row_number() OVER (PARTITION BY fold, model ORDER BY round(mean_ic, 12) DESC NULLS LAST, hit_rate DESC NULLS LAST, alpha) = 1)"""  # over `inside`
CHOSEN_SQL = f"""{FRAME}, {FOLD_SQL}, inside AS (SELECT fold, pair, open_time, {', '.join(TERMS)}, target_z FROM features JOIN folds ON open_time >= is_start AND open_time < is_end), {CHOICE_SQL},
os AS (SELECT f.fold, model, alpha, pair, open_time, close, {_dot} AS ridge_score, {LABEL} AS ret FROM features JOIN folds f ON open_time >= os_start AND open_time < os_end JOIN chosen USING (fold))"""


def _chosen(spark, sf_dir):
    """The panel, and the coefficients of each fold and model with the alpha chosen in sample."""
    panel = stored(frame(spark, sf_dir).select("pair", "open_time", "close", *TERMS, "target_z", LABEL), "panel")
    train = ridge.in_folds(panel, _folds(spark), "is").select("fold", "pair", "open_time", *TERMS, "target_z")
    return panel, stored(ridge.choose_models(train, ridge.fit_models(train, "target_z", ALPHAS, ["fold"]), "target_z", ["fold"], 8), "chosen")


def _chosen_scores(spark, sf_dir):
    """Out-of-sample scores of all models with their chosen alphas."""
    panel, chosen = _chosen(spark, sf_dir)
    return ridge.score_models(ridge.in_folds(panel, _folds(spark), "os"), chosen, ["fold"])


@query("ridge_models", f"{CHOSEN_SQL} SELECT fold, model, alpha, {s6('mean_ic')}, {s6('hit_rate')}, round(beta[1], 6) AS first_beta, len(beta)::INTEGER AS terms FROM chosen")
def ridge_models(spark, sf_dir):
    out = _chosen(spark, sf_dir)[1]
    return out.select("fold", "model", "alpha", r6("mean_ic"), r6("hit_rate"), F.round(F.col("beta")[0], 6).alias("first_beta"), F.size("beta").alias("terms"))


@query("ridge_scores_latest", f"{CHOSEN_SQL} SELECT fold, model, alpha, pair, open_time, {s6('ridge_score')} FROM os QUALIFY open_time = max(open_time) OVER (PARTITION BY fold)")
def ridge_scores_latest(spark, sf_dir):
    s = _chosen_scores(spark, sf_dir).withColumn("_last", F.max("open_time").over(Window.partitionBy("fold")))
    return s.filter("open_time = _last").select("fold", "model", "alpha", "pair", "open_time", r6("ridge_score"))


@query("walkforward_eval", f"{CHOSEN_SQL}, c AS ({sql.coefficients('os', ['ridge_score'], 'ret', ['fold', 'model', 'alpha', 'open_time'], 8, 'spearman')}), i AS (SELECT fold, model, alpha, avg(ic) AS mean_ic, count(ic) AS periods FROM c GROUP BY ALL), b AS (SELECT * FROM os WHERE ridge_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold, model, open_time ORDER BY ridge_score DESC, pair) <= 3), t AS (SELECT fold, model, avg(ret) AS top_return FROM b GROUP BY ALL) SELECT fold, model, alpha, {s6('mean_ic')}, periods, {s6('top_return')} FROM i JOIN t USING (fold, model)")
def walkforward_eval(spark, sf_dir):
    s = stored(_chosen_scores(spark, sf_dir).select("fold", "model", "alpha", "pair", "open_time", "ridge_score", F.col(LABEL).alias("ret")), "out_of_sample")
    ics = ic.coefficients(s, ["ridge_score"], "ret", ["fold", "model", "alpha", "open_time"], 8).groupBy("fold", "model", "alpha").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("periods"))
    best = reports.top_k(s, "ridge_score", 3, ["fold", "model", "open_time"]).groupBy("fold", "model").agg(F.avg("ret").alias("top_return"))
    return ics.join(best, ["fold", "model"]).select("fold", "model", "alpha", r6("mean_ic"), "periods", r6("top_return"))


# regimes

STRESS = f"{FRAME}, m AS (SELECT open_time, quantile_cont(vpin, 0.5) AS market_value FROM features GROUP BY open_time), p AS (SELECT *, count(market_value) OVER w AS history, quantile_cont(market_value, 0.8) OVER w AS q FROM m WINDOW w AS (ORDER BY open_time ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING)), stress AS (SELECT open_time, market_value, history, CASE WHEN history >= 24 THEN q END AS threshold FROM p)"


def _stress(spark, sf_dir):
    return regime.market_stress(frame(spark, sf_dir), "vpin", 0.8, 104, 24)


@query("market_stress", f"{STRESS} SELECT open_time, {s6('market_value')}, history, {s6('threshold')}, coalesce(market_value >= threshold, false) AS is_stressed FROM stress")
def market_stress(spark, sf_dir):
    return _stress(spark, sf_dir).select("open_time", r6("market_value"), "history", r6("threshold"), "is_stressed")


@query("throttle_decision", f"{STRESS}, r AS (SELECT CASE WHEN market_value IS NULL THEN 'empty_scores' WHEN history < 24 THEN 'insufficient_history' WHEN threshold IS NULL THEN 'missing_threshold' WHEN market_value >= threshold THEN 'stressed' ELSE 'normal' END AS reason FROM stress) SELECT reason, reason = 'stressed' AS blocked, count(*) AS n FROM r GROUP BY ALL")
def throttle_decision(spark, sf_dir):
    return regime.throttle(_stress(spark, sf_dir), 24).groupBy("reason", "blocked").agg(F.count("*").alias("n"))


DECISION = f"""{SCORED}, d0 AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY open_time ORDER BY score DESC NULLS LAST, pair) END AS entry_rank,
    CASE WHEN close / lag(close) OVER (PARTITION BY pair ORDER BY open_time) - 1 > 0 THEN 1.0 ELSE 0.0 END AS up FROM scored),
d1 AS (SELECT *, max(score) OVER t - max(CASE WHEN entry_rank = 2 THEN score END) OVER t AS score_gap, quantile_cont(score, 0.5) OVER t AS median_score,
    max(CASE WHEN entry_rank = 1 THEN pair END) OVER t AS leader, avg(up) OVER t AS universe_breadth, CASE WHEN entry_rank <= 3 THEN 1 ELSE 0 END AS in3 FROM d0 WINDOW t AS (PARTITION BY open_time)),
decision AS (SELECT *, {', '.join(f'sum(in3) OVER {sql.frame(n)} AS top3_count_{n}' for n in (3, 6, 12))} FROM d1)"""


def _decision(spark, sf_dir):
    return stored(regime.decision_features(scored(spark, sf_dir), "score"), "decision")


@query("decision_features", f"{DECISION} SELECT pair, open_time, entry_rank, {s6('score_gap')}, {s6('median_score')}, leader, {s6('universe_breadth')}, top3_count_3::BIGINT AS top3_count_3, top3_count_6::BIGINT AS top3_count_6, top3_count_12::BIGINT AS top3_count_12 FROM decision")
def decision_features(spark, sf_dir):
    return _decision(spark, sf_dir).select("pair", "open_time", F.col("entry_rank").cast("long").alias("entry_rank"), r6("score_gap"), r6("median_score"), "leader", r6("universe_breadth"), *[f"top3_count_{n}" for n in (3, 6, 12)])


@query("expanding_gap_median", f"{DECISION}, g AS (SELECT open_time, max(score_gap) AS score_gap FROM decision GROUP BY open_time) SELECT open_time, {s6('score_gap')}, round(CASE WHEN count(score_gap) OVER w >= 24 THEN quantile_cont(score_gap, 0.5) OVER w END, 6) AS gap_median FROM g WINDOW w AS (ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding_gap_median(spark, sf_dir):
    return regime.expanding_gap_median(_decision(spark, sf_dir)).select("open_time", r6("score_gap"), r6("gap_median"))


ENTRIES = f"{DECISION}, entries AS (SELECT pair, open_time, score_gap, universe_breadth, top3_count_6::DOUBLE AS persistence, ret AS return_pct, 100 * ret AS pnl, entry_rank FROM decision WHERE entry_rank <= 3 AND ret IS NOT NULL AND score_gap IS NOT NULL)"
GATE = ["score_gap", "universe_breadth", "persistence"]
CENTRES = [[-0.5, -0.5, -0.5], [0.5, 0.5, 0.5], [1.0, -1.0, 0.0]]
_z = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS z{i}" for i, c in enumerate(GATE))
_far = ", ".join(f"{' + '.join(f'(z{i} - ({v})) ** 2' for i, v in enumerate(c))} AS far{k}" for k, c in enumerate(CENTRES))
GATED = f"{ENTRIES}, g0 AS (SELECT *, {_z} FROM entries), g1 AS (SELECT *, {_far} FROM g0), gated AS (SELECT *, CASE WHEN far0 <= far1 AND far0 <= far2 THEN 0 WHEN far1 <= far2 THEN 1 ELSE 2 END AS cluster_id FROM g1)"


def _entries(spark, sf_dir):
    d = _decision(spark, sf_dir).filter("entry_rank <= 3 and ret is not null and score_gap is not null")
    return d.select("pair", "open_time", "score_gap", "universe_breadth", F.col("top3_count_6").cast("double").alias("persistence"), F.col("ret").alias("return_pct"), (F.col("ret") * 100).alias("pnl"), "entry_rank")


def _gated(spark, sf_dir):
    e = _entries(spark, sf_dir)
    means, stds = regime.scaling(e, GATE)
    return e.withColumn("cluster_id", regime.nearest(GATE, means, stds, CENTRES).cast("int"))


@query("gate_score", f"{GATED} SELECT pair, open_time, cluster_id FROM gated")
def gate_score(spark, sf_dir):
    return _gated(spark, sf_dir).select("pair", "open_time", "cluster_id")


@query("cluster_summary", f"{GATED}, o AS (SELECT avg(return_pct) AS m FROM gated) SELECT cluster_id, count(*) AS entries, round(avg(return_pct), 6) AS mean_return, round(quantile_cont(return_pct, 0.5), 6) AS median_return, round(avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(pnl), 4) AS total_pnl, count(*) >= 10 AND avg(return_pct) >= 0 AND avg(return_pct) > any_value(m) AS allowed FROM gated, o GROUP BY cluster_id")
def cluster_summary(spark, sf_dir):
    out = regime.cluster_summary(_gated(spark, sf_dir), min_entries=10)
    return out.select("cluster_id", "entries", r6("mean_return"), r6("median_return"), r6("win_rate"), F.round("total_pnl", 4).alias("total_pnl"), "allowed")


_step = ", ".join(f"avg(z{i}) AS c{i}" for i in range(3))


@query("kmeans_one_step", f"{GATED} SELECT cluster_id, " + ", ".join(f"round(avg(z{i}), 6) AS {c}" for i, c in enumerate(GATE)) + " FROM gated GROUP BY cluster_id")
def kmeans_one_step(spark, sf_dir):
    e = _gated(spark, sf_dir)
    means, stds = regime.scaling(e, GATE)
    return e.groupBy("cluster_id").agg(*[F.round(F.avg((F.col(c) - m) / s), 6).alias(c) for c, m, s in zip(GATE, means, stds)])


LLOYD_STEPS = 40
_unrolled = ", ".join(
    f"""far_{n} AS (SELECT z0, z1, z2, c.c AS c, list_transform(range(0, 3), lambda k: list_sum(list_transform([z0, z1, z2], lambda z, i: (z - c.c[k + 1][i]) ** 2))) AS far FROM g0, centres_{n} c),
near_{n} AS (SELECT *, list_position(far, list_min(far)) AS k FROM far_{n}),
mean_{n} AS (SELECT k, [avg(z0), avg(z1), avg(z2)] AS m FROM near_{n} GROUP BY k),
centres_{n + 1} AS (SELECT list_transform(c.c, lambda old, k: coalesce((list_filter(n.l, lambda x: x.k = k)[1]).m, old)) AS c FROM centres_{n} c, (SELECT list(mean_{n}) AS l FROM mean_{n}) n)"""
    for n in range(LLOYD_STEPS)
)
KMEANS = f"{ENTRIES}, g0 AS MATERIALIZED (SELECT *, {_z} FROM entries), centres_0 AS (SELECT {CENTRES}::DOUBLE[][] AS c), {_unrolled}"


@query("kmeans_fixed_init", f"{KMEANS} SELECT k::INTEGER AS cluster_id, {', '.join(f'round(c[k + 1][{i + 1}], 4) AS {n}' for i, n in enumerate(GATE))} FROM centres_{LLOYD_STEPS}, range(0, 3) r(k)")
def kmeans_fixed_init(spark, sf_dir):
    e = _entries(spark, sf_dir)
    found = regime.kmeans(e, GATE, CENTRES)
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(found)], "cluster_id int, " + ", ".join(f"{c} double" for c in GATE))
    return rows.select("cluster_id", *[F.round(c, 4).alias(c) for c in GATE])


# policies

POLICY = f"{SCORED}, v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS policy, *, {x} AS policy_score FROM scored" for n, x in {"pure": "score", "gate_two_thirds": "CASE WHEN micro_risk <= 2 / 3.0 THEN score END", "low_third": "CASE WHEN micro_risk <= 1 / 3.0 THEN score END", "scaled": "score * (1 - micro_risk)"}.items()) + "), b AS (SELECT * FROM v WHERE policy_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY policy, open_time ORDER BY policy_score DESC, pair) <= 3), pr AS (SELECT policy, open_time, avg(ret) AS gross, count(*) AS selected, avg(ret) - 0.001 AS net FROM b GROUP BY policy, open_time)"


def _policies(spark, sf_dir):
    return reports.policy_returns(scored(spark, sf_dir), "score", "ret", 3, 10.0)


@query("policy_grid", f"{POLICY} SELECT policy, count(*) AS periods, round(avg(net), 6) AS mean_net, round(avg(net) / nullif(stddev_samp(net), 0), 6) AS sharpe_like, round(avg(selected), 6) AS mean_selected, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS net_hit FROM pr GROUP BY policy")
def policy_grid(spark, sf_dir):
    return _policies(spark, sf_dir).groupBy("policy").agg(
        F.count("*").alias("periods"), F.round(F.avg("net"), 6).alias("mean_net"), F.round(safe_div(F.avg("net"), F.stddev_samp("net")), 6).alias("sharpe_like"),
        F.round(F.avg("selected"), 6).alias("mean_selected"), F.round(F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)), 6).alias("net_hit"),
    )


@query("monthly_policy", f"{POLICY} SELECT policy, strftime(date_trunc('month', make_timestamp(open_time * 1000)), '%Y-%m') AS month, count(*) AS periods, round(sum(net), 6) AS net FROM pr GROUP BY ALL")
def monthly_policy(spark, sf_dir):
    return _policies(spark, sf_dir).groupBy("policy", F.date_format(F.timestamp_millis("open_time"), "yyyy-MM").alias("month")).agg(F.count("*").alias("periods"), F.round(F.sum("net"), 6).alias("net"))


@query("topk_returns", f"{SCORED}, b AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY open_time ORDER BY score DESC, pair) <= 3) SELECT open_time, round(avg(ret), 6) AS gross, count(*) AS selected FROM b GROUP BY open_time")
def topk_returns(spark, sf_dir):
    return reports.top_k(scored(spark, sf_dir), "score", 3).groupBy("open_time").agg(F.round(F.avg("ret"), 6).alias("gross"), F.count("*").alias("selected"))


_dist = "count(ret) AS n, round(avg(ret), 6) AS mean_return, round(quantile_cont(ret, 0.5), 6) AS median_return, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(quantile_cont(ret, 0.05), 6) AS q05, round(quantile_cont(ret, 0.95), 6) AS q95"


@query("conditional_topk", f"{SCORED}, b AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY open_time ORDER BY score DESC, pair) <= 3) SELECT risk_tercile, {_dist} FROM b GROUP BY risk_tercile")
def conditional_topk(spark, sf_dir):
    out = reports.return_summary(reports.top_k(scored(spark, sf_dir), "score", 3), "ret", ["risk_tercile"])
    return out.select("risk_tercile", "n", *[r6(c) for c in ("mean_return", "median_return", "hit_rate", "q05", "q95")])


SPLIT = _ms(datetime(1999, 1, 1))


@query("isos_grid", f"{POLICY} SELECT policy, CASE WHEN open_time < {SPLIT} THEN 'is' ELSE 'os' END AS sample, count(*) AS periods, round(avg(net), 6) AS mean_net FROM pr GROUP BY ALL")
def isos_grid(spark, sf_dir):
    sample = F.when(F.col("open_time") < SPLIT, "is").otherwise("os").alias("sample")
    return _policies(spark, sf_dir).groupBy("policy", sample).agg(F.count("*").alias("periods"), F.round(F.avg("net"), 6).alias("mean_net"))


@query("isos_selected_pivot", f"{POLICY}, g AS (SELECT policy, avg(net) FILTER (WHERE open_time < {SPLIT}) AS is_net, avg(net) FILTER (WHERE open_time >= {SPLIT}) AS os_net FROM pr GROUP BY policy), w AS (SELECT policy FROM g WHERE policy <> 'pure' ORDER BY is_net DESC NULLS LAST, policy LIMIT 1) SELECT policy, round(is_net, 6) AS is_net, round(os_net, 6) AS os_net FROM g WHERE policy = 'pure' OR policy IN (SELECT policy FROM w)")
def isos_selected_pivot(spark, sf_dir):
    sample = F.when(F.col("open_time") < SPLIT, "is_net").otherwise("os_net").alias("sample")
    wide = _policies(spark, sf_dir).select("policy", "net", sample).groupBy("policy").pivot("sample", ["is_net", "os_net"]).agg(F.avg("net"))
    best = wide.filter("policy <> 'pure'").orderBy(F.col("is_net").desc_nulls_last(), "policy").limit(1)
    return wide.filter("policy = 'pure'").unionByName(best).select("policy", r6("is_net"), r6("os_net"))


@query("paired_deltas", f"{POLICY} SELECT open_time, {s6('b.net - a.net', alias='delta_net')} FROM pr a JOIN pr b USING (open_time) WHERE a.policy = 'pure' AND b.policy = 'scaled'")
def paired_deltas(spark, sf_dir):
    return reports.paired_deltas(_policies(spark, sf_dir), "open_time", "policy", "pure", "scaled", ["net"]).select("open_time", r6("delta_net"))


# diagnostics


@query("rank_persistence", f"{DECISION} SELECT top3_count_6::BIGINT AS bucket, {_dist} FROM decision WHERE entry_rank <= 3 GROUP BY top3_count_6")
def rank_persistence(spark, sf_dir):
    d = _decision(spark, sf_dir).filter("entry_rank <= 3").withColumn("bucket", F.col("top3_count_6"))
    return reports.return_summary(d, "ret", ["bucket"]).select("bucket", "n", *[r6(c) for c in ("mean_return", "median_return", "hit_rate", "q05", "q95")])


@query("score_gap_buckets", f"{ENTRIES}, q AS (SELECT list_distinct(quantile_cont(score_gap, [0, 0.25, 0.5, 0.75, 1])) AS e FROM entries), k AS (SELECT greatest(len(list_filter(e, lambda v: v < score_gap)) - 1, 0) AS bucket, return_pct AS ret FROM entries, q) SELECT bucket::INTEGER AS bucket, count(*) AS n, round(avg(ret), 6) AS mean_return FROM k GROUP BY bucket")
def score_gap_buckets(spark, sf_dir):
    from panelforge.functions.expr import quantile_bucket

    e = _entries(spark, sf_dir)
    out = e.join(F.broadcast(order.edges(e, "score_gap", 4))).withColumn("bucket", quantile_bucket(F.col("score_gap"), F.col("_e")))
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("return_pct"), 6).alias("mean_return"))


_predicates = {"high_gap": "score_gap > 0.5", "broad": "universe_breadth >= 0.5", "persistent": "persistence >= 2"}


@query("shadow_filters", f"{ENTRIES}, p AS (" + " UNION ALL ".join(f"SELECT '{k}' AS predicate, coalesce({c}, false) AS kept, return_pct AS r FROM entries" for k, c in _predicates.items()) + ") SELECT predicate, kept, count(*) AS n, round(avg(r), 6) AS mean_return, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM p GROUP BY ALL")
def shadow_filters(spark, sf_dir):
    out = reports.shadow_filters(_entries(spark, sf_dir), {k: F.expr(c) for k, c in _predicates.items()}, "return_pct")
    return out.select("predicate", "kept", "n", r6("mean_return"), r6("win_rate"))


@query("asof_prior", "WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type IN (SELECT min(event_type) FROM events)), o AS (SELECT user_id, ts, event_id AS e2, value AS v2 FROM events WHERE event_type IN (SELECT max(event_type) FROM events)) SELECT e.event_id, o.e2 AS prior_e2, round(o.v2, 6) AS prior_v2 FROM e LEFT JOIN o ON o.user_id = e.user_id AND o.ts < e.ts QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY o.ts DESC NULLS LAST, o.e2 DESC) = 1")
def asof_prior(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    tagged = e.join(F.broadcast(kinds))
    left = tagged.filter("event_type = a").select("event_id", "user_id", "ts")
    right = tagged.filter("event_type = b").groupBy("user_id", "ts").agg(F.max("event_id").alias("e2"), F.max_by("value", "event_id").alias("v2"))
    return reports.prior_event(left, right, ["user_id"], "ts", "ts", ["e2", "v2"]).select("event_id", "prior_e2", F.round("prior_v2", 6).alias("prior_v2"))


@query("asof_hot_key", "WITH e AS (SELECT event_id, user_id % 3 AS g, ts FROM events WHERE event_id % 2 = 0), o AS (SELECT user_id % 3 AS g, ts, max(event_id) AS e2 FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT e.event_id, o.e2 AS prior_e2 FROM e ASOF LEFT JOIN o ON o.g = e.g AND o.ts < e.ts")
def asof_hot_key(spark, sf_dir):
    """As-of join whose keys each hold a third of the rows, dealt over blocks of time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 3).alias("g"))
    right = e.filter("event_id % 2 = 1").groupBy("g", "ts").agg(F.max("event_id").alias("e2"))
    return reports.prior_event(e.filter("event_id % 2 = 0"), right, ["g"], "ts", "ts", ["e2"], most=500).select("event_id", "prior_e2")


@query("post_exit_returns", f"{ENTRIES} SELECT e.pair, e.open_time, h.horizon, round(b.close / nullif(c.close, 0) - 1, 6) AS post_return FROM entries e JOIN bars c ON c.pair = e.pair AND c.open_time = e.open_time CROSS JOIN (SELECT unnest([1, 2])::INTEGER AS horizon) h LEFT JOIN bars b ON b.pair = e.pair AND b.open_time = e.open_time + h.horizon::BIGINT * {B.WEEK_MS}")
def post_exit_returns(spark, sf_dir):
    bars = B.weekly_bars(spark, sf_dir).select("pair", "open_time", "close")
    exits = _entries(spark, sf_dir).select("pair", "open_time").join(bars, ["pair", "open_time"])
    grid = spark.createDataFrame([(1,), (2,)], "horizon int")
    at = exits.join(F.broadcast(grid)).withColumn("_then", F.col("open_time") + F.col("horizon").cast("long") * F.lit(B.WEEK_MS))
    later = bars.select("pair", F.col("open_time").alias("_then"), F.col("close").alias("_later"))
    return at.join(later, ["pair", "_then"], "left").select("pair", "open_time", "horizon", F.round(safe_div(F.col("_later"), F.col("close")) - 1, 6).alias("post_return"))


@query("attribution", f"{ENTRIES} SELECT pair, count(*) AS closed_trades, round(sum(pnl), 4) AS pnl, round(avg(return_pct), 6) AS mean_return, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM entries GROUP BY pair")
def attribution(spark, sf_dir):
    return reports.attribution(_entries(spark, sf_dir), ["pair"]).select("pair", "closed_trades", F.round("pnl", 4).alias("pnl"), r6("mean_return"), r6("win_rate"))


@query("full_outer_positions", "WITH s AS (SELECT p_brand AS pair, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND p_brand < 'Brand#4' GROUP BY 1), w AS (SELECT p_brand AS pair, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_brand > 'Brand#2' GROUP BY 1) SELECT coalesce(s.pair, w.pair) AS pair, s.q AS state_quantity, w.q AS wallet_quantity, coalesce(w.q, 0) <= 0 AS missing_in_wallet, s.q IS NULL AS untracked FROM s FULL JOIN w ON s.pair = w.pair")
def full_outer_positions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    side = lambda where: lines.filter(where).groupBy(F.col("p_brand").alias("pair")).agg(F.sum("l_quantity").alias("quantity"))
    return reports.merged_positions(side("l_returnflag = 'A' and p_brand < 'Brand#4'"), side("l_returnflag = 'R' and p_brand > 'Brand#2'"))


@query("semi_anti_universe", f"WITH {sql.BARS}, c AS (SELECT pair, count(*) AS n FROM bars GROUP BY pair), k AS (SELECT pair FROM c WHERE n = (SELECT max(n) FROM c)) SELECT 'kept' AS side, count(*) AS n FROM bars WHERE pair IN (SELECT pair FROM k) UNION ALL SELECT 'left', count(*) FROM bars WHERE pair NOT IN (SELECT pair FROM k)")
def semi_anti_universe(spark, sf_dir):
    bars = B.weekly_bars(spark, sf_dir)
    n = bars.groupBy("pair").agg(F.count("*").alias("n"))
    keep = n.join(F.broadcast(n.agg(F.max("n").alias("_m")))).filter("n = _m").select("pair")
    count = lambda how, name: bars.join(F.broadcast(keep), "pair", how).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("left_semi", "kept").unionByName(count("left_anti", "left"))


@query("slippage_report", "WITH o AS (SELECT event_type AS pair, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, event_id % 7 <> 0 AS success, CASE WHEN value > 0 THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * ((value + 0.01 * (event_id % 5)) / value - 1) * 10000 END AS s FROM events) SELECT pair, side, count(*) AS orders, count(*) FILTER (WHERE success) AS successes, round(avg(s), 4) AS mean_slippage, round(max(s), 4) AS max_slippage FROM o GROUP BY pair, side")
def slippage_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")
    o = e.select(F.col("event_type").alias("pair"), side.alias("side"), (F.col("event_id") % 7 != 0).alias("success"), reports.adverse_bps(side, F.col("value"), F.col("value") + 0.01 * (F.col("event_id") % 5)).alias("slippage_bps"))
    return reports.slippage_report(o).select("pair", "side", "orders", "successes", F.round("mean_slippage", 4).alias("mean_slippage"), F.round("max_slippage", 4).alias("max_slippage"))


@query("stable_ids", "SELECT event_id, substr(sha1(event_type || '|' || user_id::VARCHAR || '|'), 1, 16) AS id FROM events")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reports.stable_id(F.col("event_type"), F.col("user_id"), F.lit(None)).alias("id"))


# simulation


@query("equity_metrics", f"""WITH {sql.BARS}, e AS (SELECT pair AS run, open_time, close AS equity, row_number() OVER w - 1 AS n, max(close) OVER w AS peak FROM bars WINDOW w AS (PARTITION BY pair ORDER BY open_time)),
d AS (SELECT run, equity / nullif(lag(equity) OVER (PARTITION BY run ORDER BY open_time), 0) - 1 AS r FROM e WHERE n % 4 = 0),
q AS (SELECT run, avg(r) AS m, stddev_pop(r) AS s, stddev_pop(r) FILTER (WHERE r < 0) AS l, count(*) FILTER (WHERE r < 0) AS k, count(r) AS c FROM d GROUP BY run),
t AS (SELECT run, arg_max(equity, open_time) / nullif(arg_min(equity, open_time), 0) - 1 AS total_return, max((peak - equity) / nullif(peak, 0)) AS max_drawdown, count(*) AS n FROM e GROUP BY run)
SELECT run, {s6('total_return')}, {s6('max_drawdown')}, round(CASE WHEN c >= 2 THEN m / nullif(s, 0) * sqrt(365) END, 6) AS sharpe, round(CASE WHEN k > 1 THEN m / nullif(l, 0) * sqrt(365) END, 6) AS sortino FROM t JOIN q USING (run) WHERE n >= 2""")
def equity_metrics(spark, sf_dir):
    e = B.weekly_bars(spark, sf_dir).select(F.col("pair").alias("run"), "open_time", F.col("close").alias("equity"))
    return simulate.equity_metrics(e, every=4).select("run", *[r6(c) for c in ("total_return", "max_drawdown", "sharpe", "sortino")])


POLICIES = {"base": simulate.Policy(top_k=3, take_profit=0.1, stop_loss=0.05), "no_stops": simulate.Policy(top_k=3, take_profit=None, stop_loss=None), "costly": simulate.Policy(top_k=3, take_profit=0.1, stop_loss=0.05, slippage=0.005)}


def _events(spark, sf_dir):
    scores = _os_scores(spark, sf_dir).select("fold", "pair", "open_time", "close", F.col("ridge_score").alias("score"))
    return simulate.simulate(scores, POLICIES)


@query("backtest_trades")
def backtest_trades(spark, sf_dir):
    return _events(spark, sf_dir).filter("side <> 'EQUITY'").select("run", "seq", "side", "pair", "open_time", "label", r6("quantity"), r6("price"), r6("pnl"), r6("return_pct"))


@query("backtest_summary")
def backtest_summary(spark, sf_dir):
    e = _events(spark, sf_dir)
    sells = e.filter("side = 'SELL'").groupBy("run").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.count_if(F.col("label") == "stop_loss").alias("stops"), F.count_if(F.col("label") == "take_profit").alias("takes"))
    return simulate.equity_metrics(e.filter("side = 'EQUITY'"), every=4).join(sells, "run", "left")


@query("walkforward_aggregate")
def walkforward_aggregate(spark, sf_dir):
    label = F.substring_index("run", "/", -1).alias("label")
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return _events(spark, sf_dir).filter("side = 'SELL'").groupBy(label).agg(F.countDistinct("run").alias("folds"), F.count("*").alias("trades"), F.round(F.sum("pnl"), 6).alias("pnl"), F.round(safe_div(won, lost), 6).alias("profit_factor"), F.round(F.stddev_pop("return_pct"), 6).alias("std_return"))
