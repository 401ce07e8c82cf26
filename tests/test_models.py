import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantpulse.config import CLASSES, StudyConfig
from plantpulse.models.catalog import assemble, label_index, label_name
from plantpulse.models.linear import fit_linear, fit_two_driver_by
from plantpulse.models.samme import fit_samme
from plantpulse.operators.clusters import best_of, cluster_sums, lloyd, operating_clusters, silhouettes, spread_starts, standardised
from plantpulse.operators.leaderboard import metric_pivot, promotion_gate, winner
from plantpulse.operators.splits import chronological_split
from plantpulse.plans.regression import grid_search, learning_curves, run_regression

CFG = StudyConfig(name="t", target="y", drivers=("a", "b", "c"), baseline=("a", "b"), baseline_name="lineal",
                  cold="a", load="b", profile=("y",),
                  trees={"random_forest": {"numTrees": 5}, "gbm": {"maxIter": 5}, "gbt_hist": {"maxIter": 5},
                         "gbt_grid": {"maxIter": 3}})


def data(spark, n=600, noise=0.1):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)) * [2, 5, 1] + [60, 150, 0], columns=list("abc"))
    pdf["y"] = 1.2 + 0.02 * pdf.a + 0.001 * pdf.b + noise * rng.normal(size=n)
    pdf["Time"] = pd.date_range("2024-01-01", periods=n, freq="15min")
    pdf["seq"] = range(n)
    return pdf, spark.createDataFrame(pdf)


def cached(spark):
    return {int(n) for n in spark.sparkContext._jsc.getPersistentRDDs().keySet()}


def test_least_squares_recovers_noise_free_slopes(spark):
    _, df = data(spark, 40, 0.0)
    fit = fit_linear(df, "y", ["a", "b"])
    assert np.allclose([fit.intercept, *fit.coefs], [1.2, 0.02, 0.001], atol=1e-9)
    scored = df.select(F.max(F.abs(F.col("y") - fit.predicted()))).first()[0]
    assert scored < 1e-9
    by = fit_two_driver_by(df.withColumn("u", F.lit("x")), "y", ["a", "b"], ["u"]).first()
    assert abs(by["coef_a"] - 0.02) < 1e-9 and abs(by["intercept"] - 1.2) < 1e-7


def test_ridge_equals_closed_form(spark):
    pdf, df = data(spark)
    fit = fit_linear(df, "y", list("abc"), alpha=1.0)
    x = pdf[list("abc")]
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (pdf.y - pdf.y.mean()))
    assert np.allclose(fit.per_sd, beta, atol=1e-10)
    assert fit.importance()[0][0] == "a"
    flat = fit_linear(df.withColumn("c", F.lit(1.0)), "y", list("abc"), alpha=1.0)
    assert flat.coefs[2] == 0.0


def test_regression_run_gate_and_refit(spark):
    _, df = data(spark)
    split = chronological_split(df, CFG.keys, 0.7, 0.15)
    before = cached(spark)
    with run_regression(split, CFG) as result:
        check_regression(result)
        assert cached(spark) > before
    assert cached(spark) == before


def check_regression(result):
    rows = {(r["modelo"], r["particion"]): r for r in result.table.collect()}
    assert len(rows) == 2 * 8
    assert rows[("ridge", "test")]["mae"] < rows[("mediana_entrenamiento", "test")]["mae"] * 1.05
    assert result.gate["modelo_flexible"] in ("ridge", "arbol", "random_forest", "gbm", "gbt_hist", "gbt_grid")
    assert set(result.deployed_test) >= {"mae", "rmse", "r2", "mape_pct"}
    assert result.importance and len(result.grid["cells"]) == 4
    assert winner(result.table, "val", "mae").first()["modelo"] == result.winner
    pivot = metric_pivot(result.table, "mae").collect()
    assert [r["val"] for r in pivot] == sorted(r["val"] for r in pivot)


def test_gate_keeps_the_baseline_when_the_median_wins(spark):
    t = spark.createDataFrame([("mediana_entrenamiento", "val", 0.1), ("ridge", "val", 0.1), ("gbm", "val", 0.2)],
                              "modelo string, particion string, mae double")
    g = promotion_gate(t, ["ridge", "gbm"], "lineal").first()
    assert (g["modelo_flexible"], g["flexible_supera_mediana"], g["modelo_servido"]) == ("ridge", False, "lineal")


def test_learning_curves_share_the_prefix(spark):
    _, df = data(spark, 400)
    rows = learning_curves(df, CFG).collect()
    assert len(rows) == 15 and sorted({r["muestras"] for r in rows}) == [20, 40, 60, 80, 100]
    deep = {r["muestras"]: r for r in rows if r["modelo"] == "arbol_profundo"}
    assert all(r["mae_train"] <= r["mae_val"] for r in deep.values())


def test_samme_learns_three_classes(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.uniform(-1, 1, size=(600, 2)), columns=list("ab"))
    pdf["clase"] = np.select([pdf.a + pdf.b < -0.4, pdf.a + pdf.b < 0.5], CLASSES[:2], CLASSES[2])
    df = assemble(spark.createDataFrame(pdf), ["a", "b"]).withColumn("label", label_index(F.col("clase")))
    df = df.withColumn("weight", F.lit(1.0))
    def accuracy(rounds):
        model = fit_samme(df, 3, rounds=rounds)
        called = label_name(F.col("prediction"))
        return model.transform(df).agg(F.avg((called == F.col("clase")).cast("double"))).first()[0]
    assert accuracy(12) > max(accuracy(1), 0.9)


def brute_silhouette(x, labels):
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = gap[i][mine].sum() / (mine.sum() - 1)
        b = min(gap[i][labels == k].mean() for k in set(labels) if k != own)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_clusters_and_silhouette(spark):
    rng = np.random.default_rng(6)
    centre = np.repeat([[0, 0], [8, 0], [0, 9]], [90, 60, 30], axis=0)
    pdf = pd.DataFrame(centre + rng.normal(size=(180, 2)), columns=list("ab"))
    pdf["y"] = pdf.a * 2
    pdf["Time"] = pd.date_range("2024-01-01", periods=180, freq="h")
    pdf["seq"] = range(180)
    df = spark.createDataFrame(pdf)
    curve, k, rows, profile = operating_clusters(df, ["Time", "seq"], ["a", "b"], "y", ks=range(2, 5), restarts=2)
    assert k == 3
    got = {r["cluster"]: r for r in profile.collect()}
    assert [got[i]["n"] for i in range(3)] == [90, 60, 30]
    labels = rows.orderBy("seq").toPandas()
    for i in range(3):
        assert abs(got[i]["a"] - labels[labels.cluster == i].a.median()) < 1e-12
    z = standardised(df, ["a", "b"]).join(rows.select("seq", "cluster"), "seq")
    x = pdf[["a", "b"]]
    want = brute_silhouette(((x - x.mean()) / x.std(ddof=0)).to_numpy(), labels.cluster.to_numpy())
    assert abs(silhouettes(z, ["cluster"])["cluster"] - want) < 1e-9
    assert abs(dict(curve)[3] - want) < 1e-9


def test_all_starts_move_together_and_costs_are_those_of_the_centres(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 1, size=(80, 2)) for m in ([0, 0], [6, 0], [0, 7])])
    df = standardised(spark.createDataFrame(pd.DataFrame(x, columns=list("ab"))), ["a", "b"])
    z = np.array([r["_z"] for r in df.select("_z").collect()])
    starts = spread_starts(z, [2, 3], 4, 1)
    assert len(starts) == 8 and all(len(np.unique(c.points, axis=0)) == c.k for c in starts)
    alone = lloyd(df, [type(c)(c.k, c.start, c.points.copy()) for c in starts[5:6]])[0]
    fits = lloyd(df, starts)
    assert np.allclose(alone.points, fits[5].points) and all(c.settled for c in fits)
    for c in fits:
        gap = ((z[:, None] - c.points[None]) ** 2).sum(-1)
        assert abs(c.cost - gap.min(axis=1).sum()) < 1e-8
        own = gap.argmin(axis=1)
        assert all(np.allclose(z[own == k].mean(axis=0), c.points[k], atol=1e-2) for k in range(c.k))
    best = best_of(fits)
    assert best[3].cost < best[2].cost and best[3].cost == min(c.cost for c in fits if c.k == 3)
    far = [type(starts[0])(2, 0, np.array([z[0], [99.0, 99.0]]))]
    assert lloyd(df, far, rounds=3)[0].points[1].tolist() == [99.0, 99.0]
    text = cluster_sums(df, fits)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
