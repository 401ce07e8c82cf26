import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from plantpulse.operators import halo, ordered, splits
from plantpulse.operators.ordered import positions, prefix_sums, quantiles, rows_at
from plantpulse.operators.regime import histogram, last_rows, quality_report, step_minutes
from plantpulse.operators.splits import (
    chronological_split, curve_sizes, expanding_folds, fold_bounds, systematic_sample,
)
from plantpulse.operators.windows import forecast_columns, forecast_features, ready_rows

T0 = pd.Timestamp("2024-01-01")


def series(spark, n=100, step="15min"):
    pdf = pd.DataFrame({"Time": pd.date_range(T0, periods=n, freq=step), "seq": range(n), "vacio": np.arange(float(n))})
    return spark.createDataFrame(pdf)


def hot_rows(spark, n=3000):
    """A third of the rows share one time."""
    rng = np.random.default_rng(3)
    minute = np.where(np.arange(n) % 3 == 0, 700, rng.integers(0, 1500, n))
    pdf = pd.DataFrame({"Time": T0 + pd.to_timedelta(minute, unit="min"), "seq": rng.permutation(n),
                        "name": [f"unidad-{i % 7}" for i in range(n)], "y": rng.normal(size=n).round(2)})
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture
def narrow(monkeypatch):
    """Force the narrowing rounds that only long tables reach."""
    monkeypatch.setattr(ordered, "ACCURACY", 50)
    monkeypatch.setattr(ordered, "SMALL", 110)


def test_split_is_ordered_and_complete(spark):
    got = chronological_split(series(spark), ["Time", "seq"], 0.70, 0.15).groupBy("particion").agg(
        F.count("*"), F.min("Time"), F.max("Time")
    ).collect()
    by = {r[0]: r for r in got}
    assert (by["train"][1], by["val"][1], by["test"][1]) == (70, 15, 15)
    assert by["train"][3] < by["val"][2] and by["val"][3] < by["test"][2]


@pytest.mark.parametrize("train,val", [(0.0, 0.2), (0.7, 0.0), (0.8, 0.2)])
def test_split_rejects_bad_fractions(spark, train, val):
    with pytest.raises(ValueError):
        chronological_split(series(spark), ["Time", "seq"], train, val)


def test_split_rejects_empty_parts(spark):
    with pytest.raises(ValueError):
        chronological_split(series(spark, 4), ["Time", "seq"], 0.1, 0.1)


def test_split_with_a_hot_timestamp(spark, narrow):
    pdf, df = hot_rows(spark)
    got = {r[0]: r[1] for r in chronological_split(df, ["Time", "seq"], 0.4, 0.1).groupBy("particion").count().collect()}
    assert got == {"train": 1200, "val": 300, "test": 1500}


def test_rows_at_any_rank_numeric_and_text_keys(spark, narrow):
    pdf, df = hot_rows(spark)
    ranks = [0, 1, 999, 1400, 2000, 2998, 2999]
    for order in (["Time", "seq"], ["y", "seq"], ["name", "seq"]):
        want = pdf.sort_values(order).reset_index(drop=True)
        for rank, key in zip(ranks, rows_at(df, order, ranks, len(pdf))):
            assert df.filter(F.col("seq") == key["seq"]).select((F.col(order[0]) == key[order[0]])).first()[0]
            assert df.filter((F.col("seq") == key["seq"])).first()["seq"] == want.loc[rank, "seq"]


def test_quantiles_match_numpy(spark, narrow):
    pdf, df = hot_rows(spark)
    got = quantiles(df, ["y"], [0.0, 0.25, 0.5, 0.95, 1.0], ["name"]).collect()
    for r in got:
        want = np.quantile(pdf.loc[pdf.name == r["name"], "y"], [0.0, 0.25, 0.5, 0.95, 1.0])
        assert np.allclose(r["q"], want, atol=1e-12)
    hot = df.withColumn("y", F.when(F.col("seq") % 3 == 0, 5.0).otherwise(F.col("y")))
    want = np.quantile(hot.toPandas()["y"], [0.1, 0.9])
    assert np.allclose(quantiles(hot, ["y"], [0.1, 0.9]).first()["q"], want)


def test_positions_and_prefix_sums(spark):
    pdf, df = hot_rows(spark)
    got = {r["seq"]: r["pos"] for r in positions(df, ["Time", "seq"]).collect()}
    want = pdf.sort_values(["Time", "seq"]).reset_index(drop=True)
    assert [got[s] for s in want.seq] == list(range(len(pdf)))
    sums = prefix_sums(df.select("seq", F.lit(2).cast("long").alias("m")), ["seq"], ["m"])
    assert sums.filter(F.col("before_m") != 2 * F.col("seq")).count() == 0


def test_systematic_sample_matches_even_spacing(spark):
    df = series(spark, 997)
    got = sorted(r["seq"] for r in systematic_sample(df, ["Time", "seq"], 100).collect())
    assert got == sorted(set(np.linspace(0, 996, 100, dtype=int).tolist()))
    assert systematic_sample(df, ["Time", "seq"], 5000).count() == 997


def test_systematic_sample_parts_rows_of_one_time(spark, monkeypatch):
    """Many ranges, a time held by half of the rows, text keys, further columns kept."""
    monkeypatch.setattr(splits, "RANGE_ROWS", 40)
    rows = [(0 if i % 2 else i, f"ké{i:05d}", i) for i in range(2003)]
    df = spark.createDataFrame(rows, "t long, name string, extra int").withColumn("t", F.timestamp_seconds("t"))
    want = sorted(((r[0], r[1]) for r in rows))
    spots = sorted(set(np.linspace(0, 2002, 50, dtype=int).tolist()))
    got = systematic_sample(df, ["t", "name"], 50)
    assert got.columns == ["t", "name", "extra"]
    assert sorted(r["name"] for r in got.collect()) == sorted(want[p][1] for p in spots)
    numbers = splits._range_number(df.select("t", "name"), ["t", "name"], 2003)
    assert df.groupBy(numbers).count().agg(F.max("count")).first()[0] < 400


def test_folds_and_curve_sizes(spark):
    assert fold_bounds(103, 3) == [(28, 53), (53, 78), (78, 103)]
    for (train, test), (start, end) in zip(expanding_folds(series(spark, 103), ["Time", "seq"]), fold_bounds(103)):
        assert (train.count(), test.count()) == (start, end - start)
        assert train.agg(F.max("Time")).first()[0] < test.agg(F.min("Time")).first()[0]
    # 20 %..100 % of the first of three folds over 41,206 rows.
    assert curve_sizes(41206) == [2060, 4121, 6181, 8242, 10303]


def gap_frame(spark):
    times = list(pd.date_range(T0, periods=120, freq="15min"))
    times = [t + pd.Timedelta(hours=6) if i > 80 else t for i, t in enumerate(times)]
    pdf = pd.DataFrame({"Time": times, "seq": range(120), "vacio": np.linspace(1.2, 1.5, 120), "temp": 60.0})
    return spark.createDataFrame(pdf)


def test_forecast_rows_stop_at_a_gap(spark):
    seen = forecast_columns(gap_frame(spark), "Time", "seq", "vacio", [1, 4], 4, 15.0)
    ready = ready_rows(seen, ["Time", "seq"], "vacio", [1, 4], ["temp"], 96)
    got = sorted(r["seq"] for r in ready.collect())
    assert got == [i for i in range(4, 116) if i not in (77, 78, 79, 80, 81, 82, 83, 84)]
    assert "vacio_futuro" not in forecast_features("vacio", [1, 4], ["temp"])


def reference_lags(df, unit):
    w = Window.partitionBy(unit).orderBy("Time", "seq")
    for k in (1, 3):
        minutes = (F.unix_micros("Time") - F.unix_micros(F.lag("Time", k).over(w))) / 6e7
        ok = F.coalesce(minutes.between(0.75 * k, 1.25 * k), F.lit(False))
        df = df.withColumn(f"w{k}", F.when(ok, F.lag("y", k).over(w)))
    ahead = (F.unix_micros(F.lead("Time", 2).over(w)) - F.unix_micros("Time")) / 6e7
    return df.withColumn("wf", F.when(ahead.between(1.5, 2.5), F.lead("y", 2).over(w)))


@pytest.mark.parametrize("dense", [False, True])
def test_halo_layouts_equal_the_global_window(spark, monkeypatch, dense):
    if dense:
        monkeypatch.setattr(halo, "BUCKET_ROWS", 10)
        monkeypatch.setattr(halo, "POSITION_BLOCK", 64)
        halo.over_position_blocks.__defaults__ = (64,)
    _, df = hot_rows(spark)
    want = reference_lags(df.select("Time", "seq", "name", "y"), "name").select("seq", "w1", "w3", "wf")
    seen = forecast_columns(
        df.select("Time", "seq", "name", "y"), "Time", "seq", "y", [1, 3], 2, 1.0, "name", bucket_s=1800.0
    )
    got = seen.select("seq", "y_lag_1", "y_lag_3", "y_futuro")
    assert got.count() == 3000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    if dense:
        halo.over_position_blocks.__defaults__ = (500_000,)


def test_steps_and_quality(spark):
    df = gap_frame(spark)
    steps = sorted(r["step_min"] for r in step_minutes(df, "Time", "seq").collect() if r["step_min"] is not None)
    assert len(steps) == 119 and steps[-1] == 375.0
    q = quality_report(df, 130, "Time", "seq", "vacio").first()
    assert (q["filas_crudas"], q["filas_limpias"], q["paso_mediano_min"], q["vacio_nulos"]) == (130, 120, 15.0, 0)


def test_histogram_and_tail(spark):
    df = series(spark, 100)
    bins = [r["n"] for r in histogram(df, "vacio", 40).orderBy("bin").collect()]
    assert sum(bins) == 100 and bins == np.histogram(np.arange(100.0), 40)[0].tolist()
    assert [r["seq"] for r in last_rows(df, ["Time", "seq"], 3).collect()] == [97, 98, 99]
    assert histogram(df.withColumn("vacio", F.lit(2.0)), "vacio", 4).agg(F.sum("n")).first()[0] == 100
