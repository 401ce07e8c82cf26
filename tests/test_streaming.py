import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse.models.linear import LinearFit
from plantpulse.operators.drift import binned_counts, population_stability, reference_cuts
from plantpulse.operators.windows import forecast_columns
from plantpulse.plans.scoring import score_records, service_counters, validate_records
from plantpulse.sources.bundle import ScoringBundle
from plantpulse.streaming import jobs
from plantpulse.streaming.lags import streaming_lags
from plantpulse.streaming.live import BatchCounters, DriftSink, counted

FIELDS = {"k": ("cold", 0.0, 90.0), "u": ("load", 0.0, 500.0)}
OBS = ("value", 0.0, 500.0)
FIT = LinearFit(("cold", "load"), 40.0, (0.1, 0.05), (0.0, 0.0))
BUNDLE = ScoringBundle(FIT, FIT, "ridge", ("cold", "load"), 10.0, 60.0)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events in three files, as three arrivals."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("ts").cast("timestamp").alias("Time"), "event_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), F.col("user_id").cast("double").alias("u"),
    ).persist()
    for low, high in ((0, 400), (400, 700), (700, 2000)):
        part = events.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(path)
    yield path, events
    events.unpersist()


def stream_of(spark, landed):
    path, events = landed
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_scores_equal_batch_scores(spark, landed):
    events = landed[1]
    got = jobs.drain_append(jobs.scored_stream(stream_of(spark, landed), BUNDLE, FIELDS, OBS, ["event_id"]), "t")
    want = score_records(validate_records(events, FIELDS, OBS)[0], BUNDLE, FIELDS, "value", ["event_id"])
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_window_counters(spark, landed):
    """Windows that the final watermark has passed, and no others."""
    scored = jobs.scored_stream(stream_of(spark, landed), BUNDLE, FIELDS, OBS, ["Time"])
    got = jobs.drain_append(jobs.windowed_counters(scored, "Time", "1 day"), "t")
    batch = score_records(validate_records(landed[1], FIELDS, OBS)[0], BUNDLE, FIELDS, "value", ["Time"])
    last = batch.agg(F.max("Time")).first()[0] - dt.timedelta(hours=2)
    window = F.window("Time", "1 day")
    want = service_counters(batch, [window.alias("w")]).filter(F.col("w.end") <= F.lit(last)).select(
        F.col("w.start").alias("inicio"), "predicciones", "anomalias"
    )
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def arrivals(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_not_counted(spark, tmp_path):
    t, day = dt.datetime(2024, 1, 1, 12), dt.timedelta(days=1)
    batches = [
        [(t, 60.0, False), (t, 60.0, True)], [(t + 2 * day, 60.0, True)],
        [(t + 4 * day, 60.0, False)], [(t, 60.0, True)], [(t + 2 * day, 60.0, True)],
    ]
    stream = arrivals(spark, str(tmp_path / "late"), batches, "Time timestamp, vacio_esperado double, anomalia boolean")
    got = jobs.drain_append(jobs.windowed_counters(stream, "Time", "1 day"), "t").collect()
    # The last two arrivals come behind the watermark.
    assert {(r["inicio"].day, r["predicciones"], r["anomalias"]) for r in got} == {(1, 2, 1), (3, 1, 1)}


def test_first_per_key_keeps_the_smallest_and_drops_late_rows(spark, tmp_path):
    t, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    batches = [[(t, 5, "a"), (t, 3, "b")], [(t, 4, "c"), (t + 2 * day, 9, "d")],
               [(t + 3 * day, 8, "f")], [(t, 1, "late"), (t + 9 * day, 2, "e")]]
    stream = arrivals(spark, str(tmp_path / "first"), batches, "Time timestamp, n int, v string")
    kept = jobs.first_per_key(stream, ["Time"], "Time", "n", "1 hour")
    assert {(r["n"], r["v"]) for r in jobs.drain_append(kept, "t").collect()} == {(3, "b"), (9, "d"), (8, "f")}


def test_quarantine_and_scores_share_out_the_records(spark, landed):
    kept = jobs.drain_append(jobs.scored_stream(stream_of(spark, landed), BUNDLE, FIELDS, OBS, ["event_id"]), "t")
    gone = jobs.drain_append(jobs.quarantined_stream(stream_of(spark, landed), FIELDS, OBS).select("event_id"), "t")
    assert kept.count() + gone.count() == landed[1].count()
    assert kept.select("event_id").intersect(gone).count() == 0


def test_windowed_drift_equals_batch_drift(spark, landed):
    events = landed[1]
    end = F.lit("2024-01-20").cast("timestamp")
    reference, rest = events.filter(F.col("Time") < end), events.filter(F.col("Time") >= end)
    cuts = reference_cuts(reference, ["k", "u"])
    held = binned_counts(reference, ["k", "u"], cuts, F.lit(True))
    current = stream_of(spark, landed).filter(F.col("Time") >= end)
    bins = jobs.drain_append(jobs.windowed_bins(current, "Time", ["k", "u"], cuts, "2 days"), "t")
    drift = jobs.windowed_drift(bins, held, cuts).collect()
    starts = {r["inicio"] for r in drift}
    last = rest.agg(F.max("Time")).first()[0] - dt.timedelta(days=1)
    assert starts and all(s + dt.timedelta(days=2) <= last for s in starts)
    one = min(starts)
    within = rest.filter((F.col("Time") >= F.lit(one)) & (F.col("Time") < F.lit(one + dt.timedelta(days=2))))
    got = {r["variable"]: r for r in drift if r["inicio"] == one}
    for r in population_stability(reference, within, ["k", "u"]).collect():
        assert abs(got[r["variable"]]["psi"] - r["psi"]) < 1e-12
        assert got[r["variable"]]["banda"] == r["banda"]


def test_streaming_lags_equal_batch_lags(spark, landed):
    lagged = streaming_lags(stream_of(spark, landed), "event_type", "Time", "event_id", "k", [1, 2], 200.0)
    got = jobs.drain_append(lagged, "t").select("event_id", "k_lag_1", "k_lag_2")
    want = forecast_columns(
        landed[1], "Time", "event_id", "k", [1, 2], 1, 200.0, "event_type"
    ).select("event_id", "k_lag_1", "k_lag_2")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.filter("k_lag_2 is not null").count() > 0


def test_lags_carry_on_over_pieces_and_hot_units(monkeypatch):
    """One unit with all rows, handed over in small pieces out of order: same lags, bounded output."""
    import numpy as np
    import pandas as pd

    from plantpulse.streaming import lags as module

    class State:
        rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    monkeypatch.setattr(module, "CHUNK", 100)
    processor = module.LagProcessor(["u", "t", "n", "x"], [1, 3], 1.0, 10**9)  # bucket 1 is the year 2024
    processor.kept, asked = State(), []
    processor.handle = type("Handle", (), {"registerTimer": lambda self, at: asked.append(at)})()
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    n = 5000
    rows = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=n, freq="min"), "n": range(n), "x": np.arange(n) * 1.0})
    rows["epoch_us"] = rows["t"].astype("datetime64[us]").astype("int64")
    found = []
    for part in (rows[:3000], rows[3000:]):
        mixed = part.sample(frac=1, random_state=1)
        out = list(processor.handleInputRows(("a", 1), (mixed[i:i + 70] for i in range(0, len(mixed), 70)), clock))
        assert max(map(len, out)) <= 100 and len(processor.kept.rows) == 3
        found += out
    got = pd.concat(found).sort_values("n")
    assert len(asked) == 1 and len(got) == n
    assert (got["x_lag_1"].to_numpy()[1:] == np.arange(n - 1)).all() and (got["x_lag_3"].to_numpy()[3:] == np.arange(n - 3)).all()


def test_resample_is_the_same_for_table_and_stream(spark, landed):
    measures = lambda: [F.count("*").alias("n"), F.max("value").alias("m")]
    stream = stream_of(spark, landed).withWatermark("Time", "1 hour")
    got = jobs.drain_append(jobs.resample(stream, "Time", "6 hours", ["event_type"], measures()), "t")
    last = landed[1].agg(F.max("Time")).first()[0] - dt.timedelta(hours=7)
    want = jobs.resample(landed[1], "Time", "6 hours", ["event_type"], measures()).filter(F.col("Time") <= F.lit(last))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_first_arrivals_come_out_at_once(spark, tmp_path):
    """No key waits for the watermark, and a key comes once however often it arrives."""
    t, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    batches = [[(t, 5, "a")], [(t, 4, "b"), (t + day, 9, "c")], [(t + day, 8, "d")]]
    stream = arrivals(spark, str(tmp_path / "arrivals"), batches, "Time timestamp, n int, v string")
    got = jobs.drain_append(jobs.first_arrivals(stream, ["Time"], "Time", "2 days"), "t").collect()
    assert {(r["Time"], r["v"]) for r in got} == {(t, "a"), (t + day, "c")}


def test_batches_report_their_counters(spark, landed, tmp_path):
    scored = jobs.scored_stream(stream_of(spark, landed), BUNDLE, FIELDS, OBS, ["event_id"])
    listener = BatchCounters()
    spark.streams.addListener(listener)
    try:
        query = jobs.start_append(counted(scored), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    want = service_counters(spark.read.parquet(str(tmp_path / "out"))).first().asDict()
    assert listener.totals() == want and want["anomalias"] > 0
    assert len(listener.batches) == 3


def test_a_replayed_batch_changes_no_drift(spark, landed, tmp_path):
    events = landed[1]
    end = F.lit("2024-01-20").cast("timestamp")
    reference, rest = events.filter(F.col("Time") < end), events.filter(F.col("Time") >= end)
    cuts = reference_cuts(reference, ["k", "u"])
    held = binned_counts(reference, ["k", "u"], cuts, F.lit(True))
    sink = DriftSink(str(tmp_path / "drift"), "Time", ["k", "u"], cuts, held, "4000 days")
    first, second = rest.filter("event_id % 2 = 0"), rest.filter("event_id % 2 = 1")
    sink(first, 0)
    early = {r["variable"]: r["psi"] for r in sink.latest(spark).collect()}
    sink(second, 1)
    found = sorted(map(tuple, sink.latest(spark).collect()))
    sink(second, 1)
    assert sorted(map(tuple, sink.latest(spark).collect())) == found
    whole = {r["variable"]: r["psi"] for r in population_stability(reference, rest, ["k", "u"]).collect()}
    half = {r["variable"]: r["psi"] for r in population_stability(reference, first, ["k", "u"]).collect()}
    assert {v: round(p, 12) for _, v, p, _ in found} == {v: round(p, 12) for v, p in whole.items()}
    assert {v: round(p, 12) for v, p in early.items()} == {v: round(p, 12) for v, p in half.items()} != whole
