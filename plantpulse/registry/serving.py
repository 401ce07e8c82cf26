"""Record validation, batch scoring, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.models.linear import LinearFit
from plantpulse.operators.drift import binned_counts, reference_cuts
from plantpulse.plans.scoring import score_records, service_counters, validate_records
from plantpulse.session import frozen, scratch_path
from plantpulse.registry.views import naive, rounded, table
from plantpulse.sources.bundle import ScoringBundle
from plantpulse.sources.sinks import json_rows
from plantpulse.streaming.jobs import (
    drain_append, file_stream, first_arrivals, first_per_key, quarantined_stream, resample, scored_stream, start_append,
    windowed_bins, windowed_counters, windowed_drift,
)
from plantpulse.streaming.lags import streaming_lags
from plantpulse.streaming.live import BatchCounters, DriftSink, counted

# Scoring contract of the event stream: field -> (model column, lowest, highest).
FIELDS = {"k": ("cold", 0.0, 95.0), "user_id": ("load", 0.0, 1_000_000.0)}
OBSERVED = ("value", 0.0, 200.0)
BUNDLE = ScoringBundle(
    served=LinearFit(("cold", "load"), 40.0, (0.121, 0.0617), (0.0, 0.0)),
    baseline=LinearFit(("cold", "load"), 45.0, (0.0312, 0.0153), (0.0, 0.0)),
    model_name="ridge", drivers=("cold", "load"), alert=20.0, critical=100.0,
)
_REFERENCE_END = "2024-01-15"


def _records(df):
    return df.select(
        F.col("ts").cast("timestamp").alias("Time"), "event_id", "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
        F.col("user_id").cast("double").alias("user_id"),
        # Errors carry no reading.
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


# Parts of the event table that arrive one after the other, and files of each.
_ARRIVALS, _FILES = 3, 4


def _stream(spark, sf):
    """The events in three arrivals in time order, a micro-batch each."""
    events = table(spark, sf, "events")
    path = scratch_path(spark, "arrivals")
    cuts = events.select(F.percentile_approx(
        F.unix_micros(F.col("ts").cast("timestamp")), [i / _ARRIVALS for i in range(1, _ARRIVALS)]
    )).first()[0]
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events if low is None else events.filter(stamp > low)
        part = part if high is None else part.filter(stamp <= high)
        part.repartition(_FILES).write.mode("append").parquet(path)
    return _records(file_stream(spark, path, events.schema, "*.parquet", _FILES))


def validated(spark, sf):
    accepted, rejected = validate_records(_records(table(spark, sf, "events")), FIELDS, OBSERVED)
    marked = accepted.select("event_id", F.lit("").alias("motivo")).unionByName(
        rejected.select("event_id", F.array_join("reject_reason", ",").alias("motivo"))
    )
    return marked


def _scored(spark, sf):
    accepted, _ = validate_records(_records(table(spark, sf, "events")), FIELDS, OBSERVED)
    return score_records(accepted, BUNDLE, FIELDS, "value", ["event_id", "Time"])


def score_batch(spark, sf):
    return _scored(spark, sf).drop("Time")


def scored_json(spark, sf):
    """JSON rendering of scored rows, summarised by which fields are null."""
    docs = json_rows(_scored(spark, sf).drop("Time"))
    return docs.select(
        F.get_json_object("value", "$.clase").alias("clase"),
        F.get_json_object("value", "$.anomalia").alias("anomalia"),
    ).groupBy("clase", "anomalia").agg(F.count("*").alias("n"))


def score_counters(spark, sf):
    return service_counters(_scored(spark, sf))


def stream_score(spark, sf):
    stream = scored_stream(_stream(spark, sf), BUNDLE, FIELDS, OBSERVED, ["event_id"])
    return drain_append(stream, "scored")


def stream_quarantine(spark, sf):
    rejected = quarantined_stream(_stream(spark, sf), FIELDS, OBSERVED)
    return drain_append(rejected.select("event_id", F.array_join("reject_reason", ",").alias("motivo")), "rejected")


def stream_counters(spark, sf):
    scored = scored_stream(_stream(spark, sf), BUNDLE, FIELDS, OBSERVED, ["Time"])
    done = drain_append(windowed_counters(scored, "Time"), "counters")
    return done.select(naive("inicio").alias("inicio"), "predicciones", "anomalias")


def stream_dedup(spark, sf):
    minute = _stream(spark, sf).select(F.date_trunc("minute", "Time").alias("Time"), "event_type", "event_id", "k")
    kept = first_per_key(minute, ["event_type", "Time"], "Time", "event_id", "2 hours")
    done = drain_append(kept, "dedup")
    return done.select(naive("Time").alias("Time"), "event_type", "event_id", "k")


def stream_first_arrivals(spark, sf):
    """The keys that are passed on; which of a key's rows comes first depends on the arrival."""
    minute = _stream(spark, sf).select(F.date_trunc("minute", "Time").alias("Time"), "event_type", "event_id")
    done = drain_append(first_arrivals(minute, ["event_type", "Time"], "Time"), "arrived")
    return done.select(naive("Time").alias("Time"), "event_type")


def stream_live_counters(spark, sf):
    """Sums of the counters that the batches of the scoring stream reported."""
    scored = counted(scored_stream(_stream(spark, sf), BUNDLE, FIELDS, OBSERVED, ["event_id"]))
    listener = BatchCounters()
    spark.streams.addListener(listener)
    try:
        listener.wait(start_append(scored, scratch_path(spark, "scored"), scratch_path(spark, "scored-state"), True))
    finally:
        spark.streams.removeListener(listener)
    total = listener.totals()
    return spark.createDataFrame([(total["predicciones"], total["anomalias"])], "predicciones long, anomalias long")


def stream_live_drift(spark, sf):
    """Stability of every window after the last batch, also of windows still open."""
    end = F.lit(_REFERENCE_END).cast("timestamp")
    features = ["k", "user_id"]
    reference = _records(table(spark, sf, "events")).filter(F.col("Time") < end)
    cuts = reference_cuts(reference, features)
    held = frozen(binned_counts(reference, features, cuts, F.lit(True)))
    sink = DriftSink(scratch_path(spark, "live-drift"), "Time", features, cuts, held, "7 days")
    current = _stream(spark, sf).filter(F.col("Time") >= end)
    sink.start(current, scratch_path(spark, "live-drift-state"), available_now=True).awaitTermination()
    return rounded(sink.latest(spark).withColumn("inicio", naive("inicio")))


def stream_resample(spark, sf):
    stream = _stream(spark, sf).withWatermark("Time", "1 day")
    grid = resample(stream, "Time", "1 hour", ["event_type"], [
        F.count("*").alias("n"), F.max("k").alias("k_max"),
    ])
    return drain_append(grid, "grid").select(naive("Time").alias("Time"), "event_type", "n", "k_max")


def stream_drift(spark, sf):
    end = F.lit(_REFERENCE_END).cast("timestamp")
    features = ["k", "user_id"]
    reference = _records(table(spark, sf, "events")).filter(F.col("Time") < end)
    cuts = reference_cuts(reference, features)
    held = binned_counts(reference, features, cuts, F.lit(True))
    current = _stream(spark, sf).filter(F.col("Time") >= end)
    bins = drain_append(windowed_bins(current, "Time", features, cuts, "7 days"), "bins")
    drift = windowed_drift(bins, held, cuts)
    return rounded(drift.withColumn("inicio", naive("inicio")))


def stream_lags(spark, sf):
    lagged = streaming_lags(
        _stream(spark, sf).select("event_type", "Time", "event_id", "k"),
        "event_type", "Time", "event_id", "k", [1, 2], 20.0,
    )
    return drain_append(lagged, "lags").select("event_id", "k", "k_lag_1", "k_lag_2")


_REC_SQL = """rec AS (
  SELECT ts AS "Time", event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         CAST(user_id AS DOUBLE) AS user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
ok AS (SELECT * FROM rec WHERE k BETWEEN 0 AND 95 AND user_id BETWEEN 0 AND 1000000
       AND coalesce(value BETWEEN 0 AND 200, true)),
sc AS (
  SELECT *, 40 + 0.121::DOUBLE * k + 0.0617::DOUBLE * user_id AS e, 45 + 0.0312::DOUBLE * k + 0.0153::DOUBLE * user_id AS b
  FROM ok)"""
_SCORED_SQL = f"""WITH {_REC_SQL}
SELECT event_id, round_even(e, 4) AS vacio_esperado, round_even(b, 4) AS vacio_linea_base_agua_carga,
  'ridge' AS modelo, round_even(value, 4) AS vacio_observado, round_even(value - e, 4) AS residual_modelo,
  round_even(value - b, 4) AS residual_linea_base,
  CASE WHEN value IS NULL THEN NULL WHEN value - b <= 20 THEN 'normal' WHEN value - b <= 100 THEN 'alerta'
       ELSE 'critico' END AS clase,
  value - b > 100 AS anomalia, CASE WHEN value IS NOT NULL THEN 100.0::DOUBLE END AS umbral_anomalia FROM sc"""

# Files of records are scored without the range checks of the service.
SCORED_ALL_SQL = _SCORED_SQL.replace("FROM ok)", "FROM rec)").replace("SELECT event_id, round_even", "SELECT round_even")


def _drift_sql(closed: bool = True) -> str:
    passed = """
  HAVING w + INTERVAL 7 DAY <= (SELECT max("Time") FROM rec) - INTERVAL 1 DAY""" if closed else ""
    probs = "[" + ", ".join(f"CAST({i} AS DOUBLE) / 10" for i in range(11)) + "]"
    return f"""WITH {_REC_SQL}, long AS (
  SELECT "Time", 'k' AS v, k AS x FROM rec UNION ALL SELECT "Time", 'user_id', user_id FROM rec),
cuts AS (
  SELECT v, list_sort(list_distinct(quantile_cont(x, {probs}))) AS c FROM long
  WHERE "Time" < TIMESTAMP '{_REFERENCE_END}' GROUP BY v),
placed AS (
  SELECT long.v, "Time" < TIMESTAMP '{_REFERENCE_END}' AS ref,
         time_bucket(INTERVAL 7 DAY, "Time", TIMESTAMP '1970-01-01') AS w,
         CASE WHEN x >= c[1] AND x <= c[len(c)]
              THEN least(len(list_filter(c, lambda e: e <= x)), len(c) - 1) - 1 END AS b
  FROM long JOIN cuts ON long.v = cuts.v),
wins AS (SELECT v, w, count(*) AS n FROM placed WHERE NOT ref GROUP BY 1, 2{passed}),
frame AS (SELECT wins.v, w, n, unnest(range(len(c) - 1)) AS b FROM wins JOIN cuts ON wins.v = cuts.v),
n AS (
  SELECT f.v, f.w, f.n, f.b, (SELECT count(*) FROM placed p WHERE p.ref AND p.v = f.v AND p.b = f.b) AS r,
         (SELECT count(*) FROM placed p WHERE NOT p.ref AND p.v = f.v AND p.w = f.w AND p.b = f.b) AS k
  FROM frame f),
s AS (
  SELECT *, greatest(r / sum(r) OVER g, 1e-4) AS rr, greatest(k / greatest(sum(k) OVER g, 1), 1e-4) AS kk
  FROM n WINDOW g AS (PARTITION BY v, w)),
p AS (SELECT *, rr / sum(rr) OVER g AS pr, kk / sum(kk) OVER g AS pk FROM s WINDOW g AS (PARTITION BY v, w)),
i AS (SELECT w, v, max(n) AS n, sum((pk - pr) * ln(pk / pr)) AS psi FROM p GROUP BY 1, 2),
j AS (SELECT w, v, CASE WHEN n >= 10 THEN psi END AS psi FROM i)
SELECT w AS inicio, v AS variable, round(psi, 6) AS psi, CASE WHEN psi IS NULL THEN 'sin_dato'
  WHEN psi < 0.1 THEN 'estable' WHEN psi < 0.25 THEN 'cambio_moderado' ELSE 'drift' END AS banda FROM j"""


QUERIES = {
    "validate_records": validated,
    "score_batch": score_batch,
    "scored_json": scored_json,
    "score_counters": score_counters,
    "stream_score": stream_score,
    "stream_quarantine": stream_quarantine,
    "stream_counters": stream_counters,
    "stream_dedup": stream_dedup,
    "stream_resample": stream_resample,
    "stream_drift": stream_drift,
    "stream_lags": stream_lags,
    "stream_first_arrivals": stream_first_arrivals,
    "stream_live_counters": stream_live_counters,
    "stream_live_drift": stream_live_drift,
}

SQL = {
    "validate_records": f"""WITH {_REC_SQL}
SELECT event_id, concat_ws(',', CASE WHEN NOT k BETWEEN 0 AND 95 THEN 'k' END,
  CASE WHEN NOT user_id BETWEEN 0 AND 1000000 THEN 'user_id' END,
  CASE WHEN NOT value BETWEEN 0 AND 200 THEN 'value' END) AS motivo FROM rec""",
    "score_batch": _SCORED_SQL,
    "scored_json": f"""WITH s AS ({_SCORED_SQL})
SELECT clase, CASE WHEN anomalia THEN 'true' WHEN NOT anomalia THEN 'false' END AS anomalia, count(*) AS n
FROM s GROUP BY 1, 2""",
    "score_counters": f"""WITH s AS ({_SCORED_SQL})
SELECT count(*) AS predicciones, count(*) FILTER (coalesce(anomalia, false)) AS anomalias FROM s""",
    "stream_score": _SCORED_SQL,
    "stream_counters": f"""WITH {_REC_SQL}
SELECT date_trunc('hour', "Time") AS inicio, count(*) AS predicciones,
  count(*) FILTER (coalesce(value - b > 100, false)) AS anomalias FROM sc GROUP BY 1
HAVING date_trunc('hour', "Time") + INTERVAL 1 HOUR <= (SELECT max("Time") FROM sc) - INTERVAL 2 HOUR""",
    "stream_quarantine": f"""WITH {_REC_SQL}, m AS (
  SELECT event_id, concat_ws(',', CASE WHEN NOT k BETWEEN 0 AND 95 THEN 'k' END,
    CASE WHEN NOT user_id BETWEEN 0 AND 1000000 THEN 'user_id' END,
    CASE WHEN NOT value BETWEEN 0 AND 200 THEN 'value' END) AS motivo FROM rec)
SELECT * FROM m WHERE motivo <> ''""",
    "stream_dedup": f"""WITH {_REC_SQL}, m AS (SELECT date_trunc('minute', "Time") AS "Time", event_type, event_id, k FROM rec)
SELECT "Time", event_type, min(event_id) AS event_id, arg_min(k, event_id) AS k FROM m GROUP BY 1, 2
HAVING "Time" <= (SELECT max("Time") FROM m) - INTERVAL 2 HOUR""",
    "stream_resample": f"""WITH {_REC_SQL}
SELECT date_trunc('hour', "Time") AS "Time", event_type, count(*) AS n, max(k) AS k_max FROM rec GROUP BY 1, 2
HAVING date_trunc('hour', "Time") + INTERVAL 1 HOUR <= (SELECT max("Time") FROM rec) - INTERVAL 1 DAY""",
    "stream_drift": _drift_sql(),
    "stream_live_drift": _drift_sql(closed=False),
    "stream_live_counters": f"""WITH s AS ({_SCORED_SQL})
SELECT count(*) AS predicciones, count(*) FILTER (coalesce(anomalia, false)) AS anomalias FROM s""",
    "stream_first_arrivals": f"""WITH {_REC_SQL} SELECT DISTINCT date_trunc('minute', "Time") AS "Time", event_type FROM rec""",
    "stream_lags": f"""WITH {_REC_SQL}
SELECT event_id, k,
  CASE WHEN (epoch_us("Time") - epoch_us(lag("Time", 1) OVER p)) / 60000000.0 BETWEEN 15 AND 25
    THEN lag(k, 1) OVER p END AS k_lag_1,
  CASE WHEN (epoch_us("Time") - epoch_us(lag("Time", 2) OVER p)) / 60000000.0 BETWEEN 30 AND 50
    THEN lag(k, 2) OVER p END AS k_lag_2
FROM rec WINDOW p AS (PARTITION BY event_type ORDER BY "Time", event_id)""",
}
