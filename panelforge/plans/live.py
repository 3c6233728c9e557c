"""Queries of files, incremental upserts and the live pair of models, each with its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from panelforge.operators import live_models
from panelforge.plans import sql
from panelforge.plans.diagnostics import trade_log
from panelforge.plans.registry import ALPHAS, CHOICE_SQL, CHOSEN_SQL, CENTRES, END, FRAME, HORIZON, LABEL, ORACLES, START, TERMS, _dot, _ms, bar_select, BAR_COLUMNS, frame, query, r6, s6
from panelforge.session import shared_dir, stored, table
from panelforge.sources import bars as B
from panelforge.sources import jsonl
from panelforge.streaming.bars import stored_bars, upsert_batch


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("late_bars_upsert", ORACLES["bars_dedupe_last"])
def late_bars_upsert(spark, sf_dir):
    """Three batches of late rows merged into their days, the last of each key kept by sequence."""
    path, e = _folder(spark, "upserts"), table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("pair"), F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("open_time"), "event_id", "value")
    for n in range(3):
        upsert_batch(rows.filter(f"event_id % 3 = {2 - n}"), n, path, "event_id")
    return stored_bars(spark, path).select("pair", "open_time", "event_id", r6("value"))


@query("jsonl_slice", f"WITH e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events), m AS (SELECT min(stamp) AS a, max(stamp) AS b FROM e WHERE event_id % 10 = 0) SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM e, m WHERE stamp >= a AND stamp < b GROUP BY event_type")
def jsonl_slice(spark, sf_dir):
    """A half-open time slice of logs, pushed into the JSON-lines source."""
    path, e = _folder(spark, "logs"), table(spark, sf_dir, "events")
    logs = e.select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    a, b = logs.filter("event_id % 10 = 0").agg(F.min("at"), F.max("at")).first()
    B.append_jsonl(logs, path)
    jsonl.register(spark)
    read = spark.read.format(jsonl.NAME).schema("event_type string, value double, at string").option("timeColumn", "at").load(path)
    return read.filter((F.col("at") >= a) & (F.col("at") < b)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("csv_roundtrip", f"WITH {sql.BARS} {bar_select} FROM bars")
def csv_roundtrip(spark, sf_dir):
    """Bars written as two CSV files, of which the second repeats some, and read again."""
    path, bars = _folder(spark, "csv"), B.weekly_bars(spark, sf_dir)
    B.write_csv(bars.withColumn("close", F.when(F.col("open_time") % 2 == 0, F.col("close") + 1).otherwise(F.col("close"))), f"{path}/a")
    B.write_csv(bars.filter("open_time % 2 = 0"), f"{path}/b")
    return B.read_csv(spark, [f"{path}/a", f"{path}/b"]).select("pair", "open_time", *[F.round(c, 9).alias(c) for c in BAR_COLUMNS])


MODEL_COLUMNS = ["z_momentum", "z_low_roll_impact", "target_z", LABEL]


@query("model_frame_csv", f"{FRAME} SELECT pair, open_time, " + ", ".join(s6(c) for c in MODEL_COLUMNS) + " FROM features")
def model_frame_csv(spark, sf_dir):
    """The model frame as CSV and back: missing values stay missing."""
    from pyspark.sql import types as T

    path, out = _folder(spark, "frame"), frame(spark, sf_dir).select("pair", "open_time", *MODEL_COLUMNS)
    B.write_csv(out, path)
    schema = T.StructType([T.StructField("pair", T.StringType()), T.StructField("open_time", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in MODEL_COLUMNS]])
    return B.read_csv(spark, [path], schema).select("pair", "open_time", *[r6(c) for c in MODEL_COLUMNS])


@query("json_records", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","share":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '0.5' END || '}' AS record FROM events""")
def json_records(spark, sf_dir):
    """Rows as JSON objects in which infinities and missing numbers are null."""
    odd = F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 8 == 4, F.lit(float("inf"))).otherwise(F.lit(0.5))
    return B.json_records(table(spark, sf_dir, "events").select("event_id", "event_type", odd.alias("share")))


REBUILT = "momentum_plus_low_roll"


@query("rebuilt_scores", f"{CHOSEN_SQL} SELECT fold, alpha, pair, open_time, {s6('ridge_score')} FROM os WHERE model = '{REBUILT}'")
def rebuilt_scores(spark, sf_dir):
    """Out-of-sample scores of a walk-forward run, from its saved metadata."""
    path = _folder(spark, "run")
    B.save_model(spark, {"metadata": {"model": REBUILT, "is_months": 12, "os_months": 6, "step_months": 6, "ridge_alphas": ALPHAS, "start": START, "end": END}}, "run", path)
    metadata = B.load_model(spark, path, "run")["metadata"]
    out = live_models.rebuilt_scores(frame(spark, sf_dir).select("pair", "open_time", *TERMS, "target_z"), metadata)
    return out.select("fold", "alpha", "pair", "open_time", r6("ridge_score"))


AS_OF, LIVE_MODEL = datetime(1998, 6, 1), "momentum_plus_low_roll"
HISTORY = (_ms(datetime(1996, 6, 1)), _ms(AS_OF))
_live_pairs = f"SELECT pair FROM bars GROUP BY pair HAVING min(open_time) <= {HISTORY[0]} AND max(open_time) >= {HISTORY[1]}"


@query(
    "live_pair",
    f"""{FRAME}, inside AS (SELECT 0 AS fold, pair, open_time, {', '.join(TERMS)}, target_z FROM features WHERE pair IN ({_live_pairs}) AND open_time >= {_ms(datetime(1997, 6, 1))} AND open_time <= {_ms(AS_OF) - HORIZON * B.WEEK_MS}), {CHOICE_SQL}
SELECT pair, open_time, alpha, {s6(_dot, alias='ridge_score')} FROM features, chosen WHERE model = '{LIVE_MODEL}' AND pair IN ({_live_pairs}) AND open_time >= {_ms(AS_OF)} AND open_time < {_ms(AS_OF) + 4 * B.WEEK_MS}""",
)
def live_pair(spark, sf_dir):
    """Scores of the weeks after the training, by the committed and loaded pair of models."""
    panel, folder = stored(frame(spark, sf_dir).select("pair", "open_time", "close", *TERMS, "target_z"), "panel"), _folder(spark, "live")
    bars = panel.select("pair", "open_time", "close")
    pairs = [r["pair"] for r in B.coverage(bars).filter((F.col("first_bar") <= HISTORY[0]) & (F.col("last_bar") >= HISTORY[1])).select("pair").collect()]
    models = live_models.train_live(panel, pairs, AS_OF, lambda decided: trade_log(decided, bars), LIVE_MODEL, tuple(ALPHAS), ridge_months=12, regime_months=24, label_ms=HORIZON * B.WEEK_MS, clusters=3, first=CENTRES)
    live_models.save_pair(spark, folder, *models)
    ridge_model, gate = live_models.load_pair(spark, folder)
    now = panel.filter(F.col("pair").isin(pairs) & F.col("open_time").between(_ms(AS_OF), _ms(AS_OF) + 4 * B.WEEK_MS - 1))
    if not gate["gate"]["features"]:
        raise ValueError("the gate has no features")
    return live_models.scored_by(now, ridge_model["selection"]).select("pair", "open_time", F.lit(ridge_model["selection"]["alpha"]).alias("alpha"), r6("ridge_score"))
