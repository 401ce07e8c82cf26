"""Fitted models: trees, boosting, classifiers, forecasts, curves, clusters."""

from __future__ import annotations

import numpy as np
from plantpulse.models.boosting import Rules, root_cells
from plantpulse.models.catalog import assemble, importance, regressors
from plantpulse.operators.clusters import Centres, lloyd, operating_clusters, standardised
from plantpulse.plans.classification import run_classification
from plantpulse.plans.forecast import run_forecast
from plantpulse.plans.regression import grid_search, learning_curves, run_regression
from plantpulse.registry.views import (
    HOURLY, RD_SQL, READINGS, hourly, labelled_readings, readings, rounded, split_readings, split_sql,
)
from plantpulse.session import spread


def regression_models(spark, sf):
    # The grid model has its own query, boosting_grid.
    with run_regression(split_readings(spark, sf), READINGS, with_grid=False) as result:
        return rounded(result.table)


def variable_importance(spark, sf):
    drivers = list(READINGS.drivers)
    train = spread(assemble(split_readings(spark, sf).filter("particion = 'train'"), drivers))
    forest = regressors("value", READINGS.seed, key=READINGS.keys)["random_forest"].fit(train)
    train.unpersist()
    return spark.createDataFrame(importance(forest, drivers), "variable string, importancia double")


def boosting_grid(spark, sf):
    train = spread(
        assemble(split_readings(spark, sf).filter("particion = 'train'"), list(READINGS.drivers))
    )
    _, cells = grid_search(train, READINGS)
    train.unpersist()
    return spark.createDataFrame(
        [(c["maxDepth"], c["stepSize"], c["mae_cv"]) for c in cells],
        "maxDepth int, stepSize double, mae_cv double",
    )


def curves(spark, sf):
    return rounded(learning_curves(split_readings(spark, sf).filter("particion = 'train'"), READINGS))


def degradation_models(spark, sf):
    with run_classification(labelled_readings(spark, sf), READINGS) as result:
        return rounded(result.table)


def forecast_models(spark, sf):
    with run_forecast(hourly(spark, sf), HOURLY) as result:
        return rounded(result.table)


def _clusters(spark, sf):
    train = split_readings(spark, sf).filter("particion = 'train'")
    return operating_clusters(train, READINGS.keys, list(READINGS.drivers), "value")


def kmeans_profile(spark, sf):
    return rounded(_clusters(spark, sf)[3])


def silhouette_by_k(spark, sf):
    return spark.createDataFrame(_clusters(spark, sf)[0], "k int, silhouette double")


def boosting_cells(spark, sf):
    """What the first split of a boosted tree is chosen from: sums per variable and bin."""
    train = assemble(split_readings(spark, sf).filter("particion = 'train'"), ["cold", "hora"])
    return rounded(root_cells(train, "value", READINGS.keys, Rules(1)), 4)


_STARTS, _ROUNDS = (2, 3, 4), 3


def kmeans_rounds(spark, sf):
    """Costs and centres of three starts after three rounds, all moved by one aggregate a round.

    The start of k centres is the first k rows.
    """
    scaled = spread(standardised(readings(spark, sf), ["cold", "hora"]))
    first = [r["_z"] for r in scaled.orderBy("Time", "seq").limit(max(_STARTS)).select("_z").collect()]
    fits = lloyd(scaled, [Centres(k, 0, np.array(first[:k], dtype=float)) for k in _STARTS], _ROUNDS, 0.0)
    scaled.unpersist()
    rows = [(c.k, n, c.cost, *map(float, p)) for c in fits for n, p in enumerate(c.points)]
    return rounded(spark.createDataFrame(rows, "k int, cluster int, costo double, cold double, hora double"))


def _kmeans_sql() -> str:
    text = [f"""WITH {RD_SQL}, m AS (SELECT avg(cold) AS ma, stddev_pop(cold) AS sa, avg(hora) AS mb, stddev_pop(hora) AS sb FROM rd),
z AS (SELECT "Time", seq, (cold - ma) / sa AS a, (hora - mb) / sb AS b FROM rd, m),
f AS (SELECT *, row_number() OVER (ORDER BY "Time", seq) - 1 AS cluster FROM z ORDER BY "Time", seq LIMIT {max(_STARTS)}),
ks AS (SELECT unnest({list(_STARTS)}) AS k),
c0 AS (SELECT k, cluster, a, b FROM ks JOIN f ON cluster < k)"""]
    for n in range(_ROUNDS + 1):
        text.append(f"""n{n} AS (SELECT k, seq, min(struct_pack(d := pow(z.a - c.a, 2) + pow(z.b - c.b, 2), cluster := cluster)) AS t,
  any_value(z.a) AS a, any_value(z.b) AS b FROM z, c{n} c GROUP BY k, seq)""")
        if n < _ROUNDS:
            text.append(f"""c{n + 1} AS (SELECT c.k, c.cluster, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{n} c LEFT JOIN (
  SELECT k, t.cluster AS cluster, avg(a) AS a, avg(b) AS b FROM n{n} GROUP BY 1, 2) m ON m.k = c.k AND m.cluster = c.cluster)""")
    text.append(f"""e AS (SELECT k, sum(t.d) AS cost FROM n{_ROUNDS} GROUP BY k)
SELECT CAST(c.k AS INTEGER) AS k, CAST(cluster AS INTEGER) AS cluster, round(cost, 6) AS costo, round(a, 6) AS cold, round(b, 6) AS hora
FROM c{_ROUNDS} c JOIN e ON e.k = c.k""")
    return ",\n".join(text)


QUERIES = {
    "boosting_cells": boosting_cells,
    "kmeans_rounds": kmeans_rounds,
    "regression_models": regression_models,
    "variable_importance": variable_importance,
    "boosting_grid": boosting_grid,
    "learning_curves": curves,
    "degradation_models": degradation_models,
    "forecast_models": forecast_models,
    "kmeans_profile": kmeans_profile,
    "silhouette_by_k": silhouette_by_k,
}

SQL: dict[str, str] = {
    # Gradients are whole numbers of a power of two: 30 bits for up to 2^32 rows.
    "boosting_cells": f"""WITH {RD_SQL}, {split_sql('rd', '"Time", seq')},
t AS (SELECT * FROM sp WHERE particion = 'train'),
m AS (SELECT avg(value) AS base, pow(2, 30 - ceil(log2(4 * greatest(max(value) - min(value), 1)))) AS sc FROM t),
x AS (SELECT 0 AS feature, cold AS v, value FROM t UNION ALL SELECT 1, hora, value FROM t),
b AS (SELECT *, dense_rank() OVER (PARTITION BY feature ORDER BY v) - 1 AS bin FROM x)
SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(sum(round((base - value) * sc)) / any_value(sc), 4) AS g,
  CAST(count(*) AS DOUBLE) AS h, count(*) AS n FROM b, m GROUP BY feature, bin""",
    "kmeans_rounds": _kmeans_sql(),
}
