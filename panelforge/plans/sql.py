"""SQL texts of the same queries, in the dialect of the comparison engine: shared steps as common table expressions."""

from __future__ import annotations

BARS = """
ticks AS (
    SELECT p_brand AS pair, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size,
        row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
    FROM lineitem JOIN part ON l_partkey = p_partkey
), bars AS (
    SELECT pair, epoch_ms(date_trunc('week', ts)::TIMESTAMP) AS open_time, arg_min(price, k) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume
    FROM ticks GROUP BY ALL
)"""

HOURLY = """
hourly AS (
    SELECT event_type AS pair, epoch_ms(date_trunc('hour', ts)::TIMESTAMP) AS open_time, arg_min(value, row(ts, event_id)) AS open,
        max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY ALL
)"""

ERF = """CASE WHEN abs(z / sqrt(2.0)) >= 6 THEN 1.0 WHEN z = 0 THEN 0.0 ELSE 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 121),
    lambda n: exp(2 * n * ln(2.0) + (2 * n + 1) * ln(abs(z) / sqrt(2.0)) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"""


def pct_rank(x: str, by: str = "open_time") -> str:
    ties = f"count({x}) OVER (PARTITION BY {by}, {x})"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + ({ties} - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def zscore(x: str, by: str = "open_time") -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY {by})) / nullif(stddev_samp({x}) OVER (PARTITION BY {by}), 0)"


def frame(n: int, last: int = 0) -> str:
    return f"(PARTITION BY pair ORDER BY open_time ROWS BETWEEN {n - 1 + last} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"


def guarded(agg: str, x: str, n: int, last: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n, last)} = {n} THEN {agg} OVER {frame(n, last)} END"


def features(w: int, windows: tuple[int, ...], h: int) -> str:
    """The feature frame over bars, step by step as `features`."""
    lag = "OVER (PARTITION BY pair ORDER BY open_time)"
    first = ", ".join(f"ln(close / nullif(lag(close, {k}) {lag}, 0)) AS log_return_{k}" for k in windows)
    second = ", ".join(
        f"""{guarded('stddev_samp(r)', 'r', k)} AS realized_vol_{k},
        CASE WHEN count(*) OVER {frame(k)} = {k} THEN 2 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) OVER {frame(k)} - 1 END AS trend_persistence_{k},
        greatest(close / nullif({guarded('max(high)', 'high', k, 1)}, 0) - 1, CASE WHEN {guarded('max(high)', 'high', k, 1)} <> 0 THEN 0.0 END) * volume / nullif({guarded('quantile_cont(volume, 0.5)', 'volume', k, 1)}, 0) AS breakout_{k}"""
        for k in windows
    )
    third = ", ".join(f"log_return_{k} / nullif(realized_vol_{k}, 0) AS vol_adj_momentum_{k}, CASE WHEN log_return_{k} IS NOT NULL AND count(*) OVER {frame(k, 1)} = {k} THEN breakout_{k} END AS breakout_quality_{k}" for k in windows)
    fourth = ", ".join(
        f"""{pct_rank(f'log_return_{k}')} AS relative_strength_{k}, log_return_{k} - avg(log_return_{k}) OVER (PARTITION BY open_time) AS residual_momentum_{k},
        vol_adj_momentum_{k} * (1 - {pct_rank('vpin')}) AS momentum_low_vpin_{k}, vol_adj_momentum_{k} * (1 - {pct_rank('roll_impact')}) AS momentum_low_roll_impact_{k}"""
        for k in windows
    )
    risks = ("roll_measure", "roll_impact", "amihud", "vpin")
    total = " + ".join(f"coalesce(k_{c}, 0)" for c in risks)
    found = " + ".join(f"(k_{c} IS NOT NULL)::INT" for c in risks)
    return f"""
f1 AS (SELECT *, close - lag(close) {lag} AS d, abs(close / nullif(lag(close) {lag}, 0) - 1) / nullif(close * volume, 0) AS a,
    close - lag(close, {w}) {lag} AS dw, ln(close / nullif(lag(close) {lag}, 0)) AS r, {first},
    lead(close, {h}) {lag} / nullif(close, 0) - 1 AS forward_return_{h} FROM bars),
f2 AS (SELECT *, lag(d) {lag} AS ld, sign(d) * volume AS sv, {second} FROM f1),
f3 AS (SELECT *, 2 * sqrt(abs({guarded('covar_samp(d, ld)', 'd * ld', w)})) AS roll_measure, {guarded('avg(a)', 'a', w)} AS amihud,
    dw / nullif({guarded('sum(sv)', 'sv', w + 1)}, 0) AS kyle_lambda, d / nullif({guarded('stddev_samp(d)', 'd', w)}, 0) AS z, {third} FROM f2),
f4 AS (SELECT *, roll_measure / nullif(close * volume, 0) AS roll_impact, CASE WHEN volume <> 0 AND z IS NOT NULL THEN {ERF} END AS imbalance FROM f3),
f5 AS (SELECT *, {guarded('avg(imbalance)', 'imbalance', w)} AS vpin FROM f4),
f6 AS (SELECT *, {fourth}, {zscore(f'vol_adj_momentum_{windows[-1]}')} AS z_momentum, {zscore('(-roll_impact)')} AS z_low_roll_impact,
    {zscore(f'forward_return_{h}')} AS target_z, {', '.join(f'{pct_rank(c)} AS k_{c}' for c in risks)} FROM f5),
f7 AS (SELECT *, {zscore('(z_momentum * z_low_roll_impact)')} AS z_momentum_x_low_roll_impact, ({total}) / nullif({found}, 0) AS k_mean FROM f6),
f8 AS (SELECT *, {pct_rank('k_mean')} AS micro_risk FROM f7),
features AS (SELECT *, CASE WHEN micro_risk <= 1 / 3.0 THEN 'low' WHEN micro_risk <= 2 / 3.0 THEN 'mid' WHEN micro_risk IS NOT NULL THEN 'high' END AS risk_tercile FROM f8)"""


def average_rank(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


PEARSON = "covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)"


def coefficients(source: str, names: list[str], label: str, by: list[str], minimum: int, method: str) -> str:
    """A SELECT of feature, by, n, ic over a table of complete pairs."""
    keys = ", ".join(["feature", *by])
    group = "".join(f", {c}" for c in by)
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature{group}, {c} AS x, {label} AS y FROM {source} WHERE {c} IS NOT NULL AND {label} IS NOT NULL" for c in names)
    if method == "spearman":
        long = f"SELECT {keys}, {average_rank('x', keys)} AS x, {average_rank('y', keys)} AS y FROM ({long})"
    return f"SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {minimum} THEN {PEARSON} END AS ic FROM ({long}) GROUP BY {keys}"
