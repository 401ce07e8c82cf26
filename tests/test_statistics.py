import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import ordered, ranktest, stationarity
from plantpulse.operators.collinearity import variance_inflation
from plantpulse.operators.drift import population_stability
from plantpulse.operators.metrics import (
    balanced_weights, classification_scores, confusion_matrix, regression_scores,
)
from plantpulse.operators.ranktest import mann_whitney, spearman_matrix, two_sided_p
from plantpulse.operators.sketches import (
    daily_sketches, merged_quantiles, rank_bound, rank_errors, store_sketches, stored_sketches,
)
from plantpulse.operators.stationarity import adf, mackinnon_p, max_lag

ORDER = ["Time", "seq"]


def test_perfect_and_constant_regression(spark):
    df = spark.createDataFrame([(y, y, 2.0, "val") for y in (1.0, 2.0, 3.0)], "y double, p double, c double, particion string")
    got = {r["modelo"]: r for r in regression_scores(df, "y", {"igual": "p", "fijo": "c"}).collect()}
    assert got["igual"]["mae"] == 0 and got["igual"]["r2"] == 1
    assert got["fijo"]["r2"] == 0 and abs(got["fijo"]["mape_pct"] - 100 * (1 + 0 + 1 / 3) / 3) < 1e-9
    flat = df.withColumn("y", F.lit(5.0))
    got = {r["modelo"]: r["r2"] for r in regression_scores(flat, "y", {"igual": "y", "otro": "p"}).collect()}
    assert got == {"igual": 1.0, "otro": 0.0}


def test_macro_f1_over_label_union(spark):
    df = spark.createDataFrame([("normal", "normal", "v"), ("critico", "alerta", "v")], "t string, p string, particion string")
    r = classification_scores(df, "t", {"m": "p"}).first()
    assert (r["accuracy"], r["f1_weighted"]) == (0.5, 0.5) and abs(r["f1_macro"] - 1 / 3) < 1e-12
    m = [tuple(x) for x in confusion_matrix(df, "t", "p").orderBy("ord").collect()]
    assert m == [(0, "normal", 1, 0, 0), (1, "alerta", 0, 0, 0), (2, "critico", 0, 1, 0)]


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    got = {r["c"]: r["weight"] for r in balanced_weights(df, "c").collect()}
    assert got == {"a": 4 / 6, "b": 2.0}


def psi_of(spark, ref, cur, bins=10):
    frame = lambda v: spark.createDataFrame(pd.DataFrame({"x": np.asarray(v, dtype=float)}))
    return population_stability(frame(ref), frame(cur), ["x"], bins).first()


def brute_psi(ref, cur, bins=10):
    cuts = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    r, c = np.histogram(ref, cuts)[0], np.histogram(cur, cuts)[0]
    r, c = np.maximum(r / r.sum(), 1e-4), np.maximum(c / max(c.sum(), 1), 1e-4)
    r, c = r / r.sum(), c / c.sum()
    return float(((c - r) * np.log(c / r)).sum())


def test_psi(spark):
    x = np.random.default_rng(0).normal(size=500)
    same, moved = psi_of(spark, x, x), psi_of(spark, x, x + 3)
    assert same["psi"] < 0.01 and same["banda"] == "estable"
    assert moved["psi"] > 0.25 and moved["banda"] == "drift"
    assert abs(moved["psi"] - brute_psi(x, x + 3)) < 1e-9
    lumpy = np.round(x)
    assert abs(psi_of(spark, lumpy, x)["psi"] - brute_psi(lumpy, x)) < 1e-9
    out = psi_of(spark, x, x + 1000)
    assert abs(out["psi"] - brute_psi(x, x + 1000)) < 1e-9
    dirty = np.concatenate([x, [np.nan, np.inf]])
    assert abs(psi_of(spark, dirty, dirty)["psi"]) < 1e-12


@pytest.mark.parametrize("ref,cur", [(range(5), range(50)), ([1.0] * 50, range(50)), (range(50), range(3))])
def test_psi_needs_rows_and_cuts(spark, ref, cur):
    r = psi_of(spark, list(ref), list(cur))
    assert r["psi"] is None and r["banda"] == "sin_dato"


def test_mann_whitney_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 60).astype(float), rng.integers(3, 33, 45).astype(float)
    pdf = pd.DataFrame({"g": ["normal"] * 60 + ["critico"] * 45 + ["alerta"] * 9,
                        "x": np.concatenate([a, b, np.zeros(9)])})
    pdf["few"] = np.where(np.arange(len(pdf)) < 70, pdf.x, np.nan)
    df = spark.createDataFrame(pdf).withColumn("few", F.when(~F.isnan("few"), F.col("few")))
    got = {r["variable"]: r for r in mann_whitney(df, ["x", "few"], "g", "normal", "critico").collect()}
    u = ((a[:, None] > b) + 0.5 * (a[:, None] == b)).sum()
    t = np.unique(np.concatenate([a, b]), return_counts=True)[1]
    r = got["x"]
    assert (r["n_normal"], r["n_critico"], r["estadistico"]) == (60, 45, u)
    assert r["empates"] == (t**3 - t).sum()
    assert (r["mediana_normal"], r["mediana_critico"]) == (np.median(a), np.median(b))
    assert abs(r["p_valor"] - two_sided_p(u, 60, 45, r["empates"])) < 1e-15
    assert got["few"]["p_valor"] is None and got["few"]["n_critico"] == 10


def test_published_p_values():
    # 12,104 with 6,316 / 74 rows and 42,271: published as 8.29e-45 and 7.09e-34.
    assert abs(two_sided_p(12104.0, 6316, 74, 0.0) / 8.29e-45 - 1) < 0.01
    assert abs(two_sided_p(42271.0, 6316, 74, 0.0) / 7.09e-34 - 1) < 0.01
    assert abs(mackinnon_p(-8.5101) / 1.17e-13 - 1) < 0.01
    assert abs(mackinnon_p(-5.7522) / 5.93e-07 - 1) < 0.01
    assert mackinnon_p(3.0) == 1.0 and mackinnon_p(-20.0) == 0.0


def frame(spark, n=400):
    rng = np.random.default_rng(5)
    a = rng.normal(size=n).round(1)
    pdf = pd.DataFrame({"a": a, "b": (a + rng.normal(size=n)).round(1), "c": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf)


def test_spearman_and_vif(spark):
    pdf, df = frame(spark)
    want = pdf.corr("spearman")
    for r in spearman_matrix(df, ["a", "b", "c"]).collect():
        assert abs(r["rho"] - want.loc[r["variable_a"], r["variable_b"]]) < 1e-12
    for r in variance_inflation(df, ["a", "b", "c"]).collect():
        others = [c for c in "abc" if c != r["variable"]]
        x = np.column_stack([np.ones(len(pdf)), pdf[others]])
        y = pdf[r["variable"]].to_numpy()
        res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert abs(r["vif"] - y.var() / res.var()) < 1e-9


def brute_adf(x, lags=None):
    d = np.diff(x)

    def fit(p, top):
        t = np.arange(top + 1, len(x))
        z = np.column_stack([x[t - 1], *[d[t - 1 - k] for k in range(1, p + 1)], np.ones(len(t))])
        y = d[t - 1]
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        ssr = ((y - z @ beta) ** 2).sum()
        se = math.sqrt(ssr / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        aic = len(y) * (math.log(2 * math.pi) + math.log(ssr / len(y)) + 1) + 2 * z.shape[1]
        return beta[0] / se, aic

    top = max_lag(len(x))
    best = min(range(top + 1), key=lambda p: fit(p, top)[1])
    return fit(best, best)[0], best


def wandering(n, seed, share=0.5):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(2, n):
        x[t] = share * x[t - 1] + 0.3 * x[t - 2] + rng.normal()
    return x + 20.0


def test_adf_against_direct_regressions(spark, monkeypatch):
    """One series, and several at once: each has its own longest lag and choice."""
    sizes = {"a": 700, "b": 150, "c": 60, "d": 3, None: 90}
    series = {u: wandering(n, 11 + n, 0.5 if n > 100 else 0.1) for u, n in sizes.items()}
    rows = [(u, t, float(v)) for u, x in series.items() for t, v in enumerate(x)] + [("a", 10_000, None)]
    df = spark.createDataFrame(rows, "u string, seq long, x double").withColumn(
        "Time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 3600))
    for cells, least in ((stationarity.CELLS, 1000), (1, 90)):
        monkeypatch.setattr(stationarity, "CELLS", cells)
        monkeypatch.setattr(stationarity, "LEAST_BLOCK", least)
        found = {r["u"]: r for r in adf(df, ORDER, "x", by=["u"]).collect()}
        assert set(found) == {"a", "b", "c", None}
        for unit, r in found.items():
            want, lags = brute_adf(series[unit])
            assert r["lags"] == lags and abs(r["adf_estadistico"] - want) < 1e-7, unit
            assert r["n"] == sizes[unit] - lags - 1 and abs(r["adf_p_valor"] - mackinnon_p(want)) < 1e-7
    one = adf(df.filter("u = 'a'"), ORDER, "x").first()
    assert abs(one["adf_estadistico"] - found["a"]["adf_estadistico"]) < 1e-9 and one["n"] == found["a"]["n"]
    assert adf(df.filter("u = 'd'"), ORDER, "x").count() == 0


def test_nested_residuals_come_from_one_factor():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    x[:, 3] = 2 * x[:, 1] - x[:, 2]  # explained by those before it
    y = x @ [1.0, -1.0, 0.5, 0.0, 2.0] + rng.normal(size=200)
    z = np.column_stack([x, y])
    got = stationarity.nested_residuals(z.T @ z)
    for k in range(6):
        left = y - x[:, :k] @ np.linalg.lstsq(x[:, :k], y, rcond=None)[0] if k else y
        assert abs(got[k] - (left**2).sum()) < 1e-8


@pytest.mark.parametrize("small", [ordered.SMALL, 0])
def test_quantiles_by_window_and_by_range_partitions(spark, monkeypatch, small):
    """Both ways of ranking the bracketed values, with hot values and groups of all sizes."""
    monkeypatch.setattr(ordered, "ACCURACY", 200)
    rng = np.random.default_rng(17)
    sizes = {"a": 4000, "b": 900, "c": 1, "d": 2}
    pdf = pd.DataFrame([(g, v) for g, n in sizes.items() for v in np.round(rng.gamma(2, 3, n), 2)], columns=["g", "x"])
    pdf.loc[pdf.index[:1500], "x"] = 4.0
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = ordered.long_quantiles(spark.createDataFrame(pdf), ["g"], probs, True, small).collect()
    assert {r["g"]: r["n"] for r in got} == sizes
    for r in got:
        assert np.allclose(r["q"], np.quantile(pdf[pdf.g == r["g"]].x, probs), atol=1e-12)


def test_average_ranks_with_hot_values_and_open_cells(spark, monkeypatch):
    """A value of a third of the rows, repeated rows, both zeros, infinities; few cells and many."""
    rng = np.random.default_rng(23)
    pdf = pd.DataFrame({"a": np.round(rng.gamma(2, 3, 3000), 2), "b": rng.integers(0, 5, 3000).astype(float),
                        "c": rng.normal(size=3000)})
    pdf.loc[:999, ["a", "b", "c"]] = [4.0, 2.0, 0.0]
    pdf.loc[1000:1100, "c"] = -0.0
    pdf.loc[2990:, "c"] = [np.inf, -np.inf] * 5
    pdf["id"] = np.arange(3000)
    want = pdf[["a", "b", "c"]].rank()
    df = spark.createDataFrame(pdf).repartition(5)
    for most in (8192, 7):
        monkeypatch.setattr(ranktest, "MAX_CELLS", most)
        got = ranktest.with_average_ranks(df, ["a", "b", "c"]).orderBy("id").toPandas()
        assert len(got) == 3000
        for c in "abc":
            assert np.array_equal(got[f"rank_{c}"], want[c]), (most, c)
    assert ranktest.with_average_ranks(df.limit(0), ["a", "b", "c"]).count() == 0


def test_columns_of_few_values_are_ranked_without_a_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    plan = ranktest.with_average_ranks(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_sketches_by_day_merge_within_their_bound(spark, tmp_path):
    rng = np.random.default_rng(29)
    size = 64
    pdf = pd.DataFrame({"u": rng.choice(["a", "b", "c"], 30_000, p=[0.7, 0.29, 0.01]), "x": np.round(rng.gamma(2, 3, 30_000), 1)})
    pdf["Time"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 24, len(pdf)), unit="h")
    pdf.loc[:9999, "x"] = 4.0
    df = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([("a", None), ("a", math.nan), ("b", math.inf), ("d", None)], "u string, x double")
    df = df.unionByName(odd.withColumn("Time", F.lit(pd.Timestamp("2024-02-01"))))
    probs, place = [0.0, 0.5, 0.95, 1.0], str(tmp_path / "store")
    sketches = daily_sketches(df, "x", "Time", ["u"], size)
    store_sketches(sketches.filter("day < '2024-01-12'"), place)
    for _ in range(2):  # the second arrival comes twice and overlaps the first
        store_sketches(sketches.filter("day >= '2024-01-11'"), place)
    found = merged_quantiles(stored_sketches(spark, place), probs, ["u"], size)
    rows = {r["u"]: r for r in found.collect()}
    assert {u: r["n"] for u, r in rows.items()} == pdf.u.value_counts().to_dict()
    assert rows["a"]["days"] == 20
    for u, g in pdf.groupby("u"):
        for p, q in zip(probs, rows[u]["q"]):
            error = max(0.0, p - (g.x <= q).mean(), (g.x < q).mean() - p)
            assert error <= rank_bound(size), (u, p)
    worst = rank_errors(df, "x", found, probs, ["u"]).agg(F.max("error"), F.count("*")).first()
    assert worst[0] <= rank_bound(size) and worst[1] == 12
    nothing = merged_quantiles(stored_sketches(spark, place).limit(0), [0.5]).first()
    assert (nothing["n"], nothing["q"]) == (0, None)


def test_small_sketches_are_exact(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"), F.lit(pd.Timestamp("2024-01-01")).alias("Time"))
    q = merged_quantiles(daily_sketches(df, "x", "Time"), [0.25, 0.75]).first()["q"]
    assert q == [249.0, 749.0]
