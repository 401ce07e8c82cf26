"""Regression and classification scores, thresholds, classes, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.config import CLASSES, DUMMY_MODEL, MEDIAN_MODEL
from plantpulse.models.linear import fit_linear, fit_two_driver_by
from plantpulse.operators.leaderboard import (
    leaderboard, metric_pivot, metric_row, promotion_gate, winner,
)
from plantpulse.operators.metrics import (
    balanced_weights, class_counts, classification_scores, confusion_matrix, regression_scores,
)
from plantpulse.operators.ordered import column_quantiles
from plantpulse.operators.splits import chronological_split
from plantpulse.plans.classification import assign_degradation, majority_class
from plantpulse.plans.regression import residual_limits
from plantpulse.session import frozen, written
from plantpulse.registry.views import (
    LABELLED_SQL, PLANT, PLANT_SQL, RD_SQL, READINGS, TRAIN, VAL, labelled_readings, ols_sql, plant,
    readings, rounded, rounded_scores, scores_sql, split_readings, split_sql, table,
)

_BASE = READINGS.baseline_name


def baseline_alerts(spark, sf):
    """When is the plant worse than its physical reference? Rows per part and class."""
    # The hourly grid is far smaller than the events and is read several times.
    hours = written(plant(spark, sf), "plant")
    grid = chronological_split(hours, ["Time", "seq"], TRAIN, VAL)
    fit = fit_linear(grid.filter("particion = 'train'"), "y", ["cold", "load"])
    alert, critical = residual_limits(grid, PLANT, fit)
    graded = assign_degradation(grid, "y", fit.predicted(), alert, critical)
    return graded.groupBy("particion", "clase").agg(
        F.count("*").alias("n"), F.round(F.max("residual_base"), 6).alias("peor")
    )


def degradation_classes(spark, sf):
    df = labelled_readings(spark, sf)
    return rounded(df.select("seq", "particion", "vacio_base", "residual_base", "clase"))


def residual_thresholds(spark, sf):
    df = split_readings(spark, sf)
    fit = fit_linear(df.filter("particion = 'train'"), "value", ["cold", "load"])
    alert, critical = residual_limits(df, READINGS, fit)
    return rounded(spark.createDataFrame([(alert, critical)], "alerta double, critico double"))


def counts_by_class(spark, sf):
    train = labelled_readings(spark, sf).filter("particion = 'train'")
    return class_counts(train, "clase")


def weights(spark, sf):
    train = labelled_readings(spark, sf).filter("particion = 'train'")
    weighted = balanced_weights(train, "clase")
    return rounded(weighted.groupBy("clase").agg(F.count("*").alias("n"), F.max("weight").alias("weight")))


def _expected(spark, sf):
    df = split_readings(spark, sf)
    train = df.filter("particion = 'train'")
    median = column_quantiles(train, "value", [0.5])[0]
    ols = fit_linear(train, "value", ["cold", "load"])
    ridge = fit_linear(train, "value", ["cold", "load"], alpha=1.0)
    return df.withColumns({
        "p_med": F.lit(median), "p_ols": ols.predicted(), "p_ridge": ridge.predicted()
    }).filter("particion <> 'train'")


_PREDICTIONS = {MEDIAN_MODEL: "p_med", _BASE: "p_ols", "ridge": "p_ridge"}


def _scores(spark, sf, names=None):
    chosen = {n: c for n, c in _PREDICTIONS.items() if names is None or n in names}
    return frozen(regression_scores(_expected(spark, sf), "value", chosen))


def median_scores(spark, sf):
    return rounded(_scores(spark, sf, [MEDIAN_MODEL]))


def ols_scores(spark, sf):
    return rounded(_scores(spark, sf, [_BASE]))


def ridge_scores(spark, sf):
    return rounded(_scores(spark, sf, ["ridge"]))


def ols_coefs(spark, sf):
    train = split_readings(spark, sf).filter("particion = 'train'")
    return rounded(fit_linear(train, "value", ["cold", "load"]).as_table(spark))


def ridge_coefs(spark, sf):
    train = split_readings(spark, sf).filter("particion = 'train'")
    return rounded(fit_linear(train, "value", ["cold", "load"], alpha=1.0).as_table(spark))


def ols_by_unit(spark, sf):
    return rounded(fit_two_driver_by(readings(spark, sf), "value", ["cold", "load"], ["unit"]))


def _graded_documents(spark, sf):
    """Truth from the labels, a prediction from the length of the text."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    truth = (
        F.when(F.col("toxic") == 1, CLASSES[2]).when(F.col("quality") == 1, CLASSES[0]).otherwise(CLASSES[1])
    )
    guess = (
        F.when(F.col("n_chars") < 500, CLASSES[1]).when(F.col("n_chars") > 5000, CLASSES[2])
        .otherwise(CLASSES[0])
    )
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", truth.alias("truth"), guess.alias("guess"), F.lit("todo").alias("particion")
    )


def confusion(spark, sf):
    return confusion_matrix(_graded_documents(spark, sf), "truth", "guess")


def document_scores(spark, sf):
    return rounded(classification_scores(_graded_documents(spark, sf), "truth", {"longitud": "guess"}))


def dummy_scores(spark, sf):
    df = labelled_readings(spark, sf)
    top = majority_class(df.filter("particion = 'train'"), "clase")
    held = df.filter("particion <> 'train'").withColumn("p", F.lit(top))
    return rounded(classification_scores(held, "clase", {DUMMY_MODEL: "p"}))


def board(spark, sf):
    return rounded(leaderboard(_scores(spark, sf), "val", "mae"))


def best_model(spark, sf):
    return rounded(winner(_scores(spark, sf), "val", "mae"))


def one_metric_row(spark, sf):
    return rounded(metric_row(_scores(spark, sf), _BASE, "test"))


def gate(spark, sf):
    return rounded(promotion_gate(_scores(spark, sf), ["ridge"], _BASE))


def pivoted(spark, sf):
    return rounded(metric_pivot(_scores(spark, sf), "mae"))


_MEDIAN_SQL = "(SELECT quantile_cont(value, 0.5) FROM sp WHERE particion = 'train')"
_RIDGE_SQL = """rg AS (
  SELECT *, (m * vbb / (sb * sb) + 1) AS gbb, (m * vaa / (sa * sa) + 1) AS gaa, m * vab / (sa * sb) AS gab,
         m * vay / sa AS ra, m * vby / sb AS rb
  FROM (SELECT *, sqrt(vaa) AS sa, sqrt(vbb) AS sb FROM mom)),
rc AS (SELECT *, (gbb * ra - gab * rb) / (gaa * gbb - gab * gab) AS za,
       (gaa * rb - gab * ra) / (gaa * gbb - gab * gab) AS zb FROM rg)"""
_SCORED_SQL = f"""{LABELLED_SQL}, {_RIDGE_SQL},
sc AS (SELECT cl.*, {_MEDIAN_SQL} AS p_med, base AS p_ols,
       rc.my + za / sa * (cold - rc.ma) + zb / sb * (load - rc.mb) AS p_ridge FROM cl, rc),
tb AS ({scores_sql("value", {MEDIAN_MODEL: "p_med", _BASE: "p_ols", "ridge": "p_ridge"}, "sc", "particion <> 'train'")})
"""


def _one(name: str) -> str:
    return _SCORED_SQL + rounded_scores(f"SELECT * FROM tb WHERE modelo = '{name}'")


def _coef_table(za: str, zb: str, sa: str, sb: str, source: str) -> str:
    return f"""SELECT 'intercept' AS variable, round(my - {za} / {sa} * ma - {zb} / {sb} * mb, 6) AS coef,
  CAST(NULL AS DOUBLE) AS por_sd FROM {source}
UNION ALL SELECT 'cold', round({za} / {sa}, 6), round({za}, 6) FROM {source}
UNION ALL SELECT 'load', round({zb} / {sb}, 6), round({zb}, 6) FROM {source}"""


def _f1_sql(counted: str) -> str:
    """Scores per (modelo, particion) from rows (modelo, particion, truth, pred)."""
    return f"""x AS ({counted}),
lab AS (SELECT modelo, particion, truth AS label FROM x UNION SELECT modelo, particion, pred FROM x),
per AS (
  SELECT lab.modelo, lab.particion, label, count(*) FILTER (truth = label AND pred = label) AS tp,
         count(*) FILTER (truth = label) AS sup, count(*) FILTER (pred = label) AS called
  FROM lab JOIN x ON x.modelo = lab.modelo AND x.particion = lab.particion GROUP BY 1, 2, 3)
SELECT modelo, particion, round(sum(tp) / sum(sup), 6) AS accuracy,
  round(avg(2.0::DOUBLE * tp / (sup + called)), 6) AS f1_macro,
  round(sum(2.0::DOUBLE * tp / (sup + called) * sup) / sum(sup), 6) AS f1_weighted
FROM per GROUP BY 1, 2"""


_DOCS_SQL = """gd AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'critico' WHEN quality = 1 THEN 'normal' ELSE 'alerta' END AS truth,
         CASE WHEN n_chars < 500 THEN 'alerta' WHEN n_chars > 5000 THEN 'critico' ELSE 'normal' END AS pred
  FROM labels JOIN documents USING (doc_id))"""

QUERIES = {
    "baseline_alerts": baseline_alerts,
    "degradation_classes": degradation_classes,
    "residual_thresholds": residual_thresholds,
    "class_counts": counts_by_class,
    "balanced_weights": weights,
    "median_scores": median_scores,
    "ols_scores": ols_scores,
    "ridge_scores": ridge_scores,
    "ols_coefs": ols_coefs,
    "ridge_coefs": ridge_coefs,
    "ols_by_unit": ols_by_unit,
    "confusion_matrix": confusion,
    "classification_scores": document_scores,
    "dummy_classifier_scores": dummy_scores,
    "leaderboard": board,
    "winner": best_model,
    "metric_row": one_metric_row,
    "promotion_gate": gate,
    "metric_pivot": pivoted,
}

SQL = {
    "baseline_alerts": f"""WITH {PLANT_SQL}, {split_sql('plant', '"Time"')}, {ols_sql('y')}
SELECT particion, clase, count(*) AS n, round(max(res), 6) AS peor FROM cl GROUP BY 1, 2""",
    "degradation_classes": f"""{LABELLED_SQL}
SELECT seq, particion, round(base, 6) AS vacio_base, round(res, 6) AS residual_base, clase FROM cl""",
    "residual_thresholds": f"""{LABELLED_SQL}
SELECT round(qa, 6) AS alerta, round(qc, 6) AS critico FROM th""",
    "class_counts": f"{LABELLED_SQL} SELECT clase, count(*) AS n FROM cl WHERE particion = 'train' GROUP BY 1",
    "balanced_weights": f"""{LABELLED_SQL}, c AS (SELECT clase, count(*) AS n FROM cl WHERE particion = 'train' GROUP BY 1)
SELECT clase, n, round((SELECT CAST(sum(n) AS DOUBLE) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
    "median_scores": _one(MEDIAN_MODEL),
    "ols_scores": _one(_BASE),
    "ridge_scores": _one("ridge"),
    "ols_coefs": f"{LABELLED_SQL}, oc AS (SELECT *, sqrt(vaa) AS sa, sqrt(vbb) AS sb, ca * sqrt(vaa) AS za, cb * sqrt(vbb) AS zb FROM co)\n"
    + _coef_table("za", "zb", "sa", "sb", "oc"),
    "ridge_coefs": f"{LABELLED_SQL}, {_RIDGE_SQL}\n" + _coef_table("za", "zb", "sa", "sb", "rc"),
    "ols_by_unit": f"""WITH {RD_SQL}, s AS (
  SELECT unit, count(*) AS n, avg(value) AS my, avg(cold) AS ma, avg(load) AS mb, var_pop(cold) AS vaa,
         var_pop(load) AS vbb, covar_pop(cold, load) AS vab, covar_pop(cold, value) AS vay,
         covar_pop(load, value) AS vby FROM rd GROUP BY unit),
c AS (SELECT *, (vbb * vay - vab * vby) / (vaa * vbb - vab * vab) AS ca,
       (vaa * vby - vab * vay) / (vaa * vbb - vab * vab) AS cb FROM s)
SELECT unit, n, round(my - ca * ma - cb * mb, 6) AS intercept, round(ca, 6) AS coef_cold,
       round(cb, 6) AS coef_load FROM c""",
    "confusion_matrix": f"""WITH {_DOCS_SQL}, o(ord, truth) AS (VALUES (0, 'normal'), (1, 'alerta'), (2, 'critico'))
SELECT ord, o.truth, count(*) FILTER (pred = 'normal') AS normal, count(*) FILTER (pred = 'alerta') AS alerta,
       count(*) FILTER (pred = 'critico') AS critico
FROM o LEFT JOIN gd ON gd.truth = o.truth GROUP BY 1, 2""",
    "classification_scores": f"WITH {_DOCS_SQL}, "
    + _f1_sql("SELECT 'longitud' AS modelo, 'todo' AS particion, truth, pred FROM gd"),
    "dummy_classifier_scores": f"""{LABELLED_SQL}, top AS (
  SELECT clase FROM cl WHERE particion = 'train' GROUP BY 1 ORDER BY count(*) DESC, clase LIMIT 1),
""" + _f1_sql(f"""SELECT '{DUMMY_MODEL}' AS modelo, particion, cl.clase AS truth, top.clase AS pred
  FROM cl, top WHERE particion <> 'train'"""),
    "leaderboard": _SCORED_SQL + rounded_scores("SELECT * FROM tb WHERE particion = 'val'"),
    "winner": _SCORED_SQL + """SELECT modelo, round(mae, 6) AS mae FROM tb WHERE particion = 'val'
ORDER BY tb.mae, modelo LIMIT 1""",
    "metric_row": _SCORED_SQL + rounded_scores(f"SELECT * FROM tb WHERE particion = 'test' AND modelo = '{_BASE}'"),
    "promotion_gate": _SCORED_SQL + f""", g AS (
  SELECT 'ridge' AS f, max(mae) FILTER (modelo = 'ridge') AS mf, max(mae) FILTER (modelo = '{MEDIAN_MODEL}') AS mm
  FROM tb WHERE particion = 'val')
SELECT f AS modelo_flexible, round(mf, 6) AS mae_flexible, round(mm, 6) AS mae_mediana,
  mf < mm AS flexible_supera_mediana, CASE WHEN mf < mm THEN f ELSE '{_BASE}' END AS modelo_servido FROM g""",
    "metric_pivot": _SCORED_SQL + """SELECT modelo, round(max(mae) FILTER (particion = 'val'), 6) AS val,
  round(max(mae) FILTER (particion = 'test'), 6) AS test FROM tb GROUP BY 1""",
}
