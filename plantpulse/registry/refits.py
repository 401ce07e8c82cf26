"""What a study does around its fits: facts on loading, curves, refits, choices, figure rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plantpulse.config import COMPASS_POINTS, DUMMY_MODEL, RATED_MW
from plantpulse.models.catalog import FEATURES, assemble, importance
from plantpulse.models.linear import fit_linear
from plantpulse.operators.clusters import cluster_profile, nearest_centre, standardised
from plantpulse.operators.leaderboard import winner
from plantpulse.operators.metrics import classification_scores
from plantpulse.plans.classification import majority_class
from plantpulse.plans.regression import learning_curves, refitted
from plantpulse.plans.study import observed_predicted
from plantpulse.registry.scores import _RIDGE_SQL, _f1_sql
from plantpulse.registry.views import (
    LABELLED_SQL, RD_SQL, READINGS, labelled_readings, naive, readings, rounded, rounded_scores, scores_sql,
    split_readings, split_sql,
)
from plantpulse.session import frozen, scratch_path
from plantpulse.sources.air_cooled import load_air_cooled
from plantpulse.sources.historian import clean_table
from plantpulse.sources.sinks import write_csv

# Two drivers: their ridge has a closed form that SQL can state.
_PAIR = READINGS.with_(drivers=("cold", "load"))


def _stamp(column: str):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def timeless_rows(spark, sf):
    """Readings whose time is missing or no time at all are dropped, the others kept once a time."""
    rows = readings(spark, sf)
    when = F.when(F.col("seq") % 11 == 3, "sin dato").when(F.col("seq") % 7 != 2, _stamp("Time"))
    clean = clean_table(rows.select(when.alias(" Time "), "seq", "value"), "Time", "seq")
    return clean.select(naive("Time").alias("Time"), "seq", "value")


def load_facts(spark, sf):
    """Rows of a CSV extract and the valid ones among them, counted on one scan."""
    events = readings(spark, sf)
    gone = F.col("seq") % 13 == 5
    path = scratch_path(spark, "air")
    write_csv(events.select(
        F.when(F.col("seq") % 17 != 4, _stamp("Time")).alias("Time"), F.col("value").alias("TV_BP_Pout"),
        (F.col("cold") / 10).alias("CF"), F.col("cold").alias("T_ambient"), F.col("load").alias("Wind_speed"),
        F.when(gone, "---").otherwise(COMPASS_POINTS[0]).alias("Wind_dir"),
        F.when(F.col("seq") % 19 != 6, F.col("load")).alias("BP_Flow"), F.col("cold").alias("TV_BP_Tout"),
    ), path)
    _, facts = load_air_cooled(spark, path)
    return spark.createDataFrame(
        [tuple(facts.values())], "filas_archivo long, filas_validas long, potencia_nominal_mw double"
    )


def feature_matrix(spark, sf):
    """The feature vector of every reading, in the order of the drivers."""
    drivers = list(READINGS.drivers)
    x = vector_to_array(FEATURES)
    return assemble(readings(spark, sf), drivers).select("seq", *[x[i].alias(f"x{i}") for i in range(len(drivers))])


def median_profile(spark, sf):
    """Exact medians and sizes of clusters about the first three readings.

    One variable has many values, so that no reading is as near to two centres.
    """
    scaled = standardised(readings(spark, sf), ["value", "hora"])
    first = [r["_z"] for r in scaled.orderBy("Time", "seq").limit(3).select("_z").collect()]
    labelled = scaled.withColumn("cluster", nearest_centre(np.array(first, dtype=float)))
    return rounded(cluster_profile(labelled, ["cold", "hora", "value"]))


def ridge_curves(spark, sf):
    train = split_readings(spark, sf).filter("particion = 'train'")
    return rounded(learning_curves(train, _PAIR, with_trees=False))


def refit_scores(spark, sf):
    """Ridge fitted on train and validation together, scored on test."""
    return rounded(refitted(split_readings(spark, sf), _PAIR, "ridge", {})[1])


def linear_importance(spark, sf):
    train = split_readings(spark, sf).filter("particion = 'train'")
    ranked = importance(fit_linear(train, "value", ["cold", "load"], alpha=1.0), ["cold", "load"])
    rows = [(i + 1, name, share) for i, (name, share) in enumerate(ranked)]
    return rounded(spark.createDataFrame(rows, "orden int, variable string, importancia double"))


def observed_rows(spark, sf):
    held = labelled_readings(spark, sf).filter("particion = 'test'")
    rows = observed_predicted(held, READINGS, "vacio_base")
    return rounded(rows.withColumn("Time", naive("Time")))


def class_winners(spark, sf):
    """Best classifier of the validation part by macro F1, with the majority class and without."""
    df = labelled_readings(spark, sf)
    top = majority_class(df.filter("particion = 'train'"), "clase")
    held = df.filter("particion <> 'train'").withColumns({
        "p0": F.lit(top), "p1": F.when(F.col("cold") > 5, "critico").otherwise("normal"),
        "p2": F.when(F.col("hora") < 6, "alerta").otherwise("normal"),
    })
    scored = frozen(classification_scores(held, "clase", {DUMMY_MODEL: "p0", "frio": "p1", "madrugada": "p2"}))
    chosen = [
        winner(scored, "val", "f1_macro", lowest=False, without=names).withColumn("criterio", F.lit(what))
        for what, names in (("todos", None), ("aprendidos", [DUMMY_MODEL]))
    ]
    return rounded(chosen[0].unionByName(chosen[1]))


QUERIES = {
    "timeless_rows": timeless_rows,
    "load_facts": load_facts,
    "feature_matrix": feature_matrix,
    "cluster_medians": median_profile,
    "ridge_curves": ridge_curves,
    "refit_scores": refit_scores,
    "linear_importance": linear_importance,
    "observed_predicted": observed_rows,
    "class_winners": class_winners,
}


def _moments_sql(name: str, source: str, by: str = "") -> str:
    return f"""{name} AS (SELECT {by} avg(value) AS my, avg(cold) AS ma, avg(load) AS mb, var_pop(cold) AS vaa, var_pop(load) AS vbb,
  covar_pop(cold, load) AS vab, covar_pop(cold, value) AS vay, covar_pop(load, value) AS vby, count(*) AS m
  FROM {source} {"GROUP BY " + by.rstrip(", ") if by else ""})"""


_SPLIT = f"WITH {RD_SQL}, {split_sql('rd', '"Time", seq')}"
_RIDGE_AT = "my + za / sa * (cold - ma) + zb / sb * (load - mb)"

SQL = {
    "timeless_rows": f"""WITH {RD_SQL}
SELECT "Time", min(seq) AS seq, arg_min(value, seq) AS value FROM rd WHERE seq % 11 <> 3 AND seq % 7 <> 2 GROUP BY 1""",
    "load_facts": f"""WITH {RD_SQL}
SELECT count(*) AS filas_archivo, count(*) FILTER (seq % 13 <> 5 AND seq % 17 <> 4 AND seq % 19 <> 6) AS filas_validas,
  CAST({float(RATED_MW)} AS DOUBLE) AS potencia_nominal_mw FROM rd""",
    "feature_matrix": f"WITH {RD_SQL} SELECT seq, cold AS x0, load AS x1, hora AS x2 FROM rd",
    "cluster_medians": f"""WITH {RD_SQL},
m AS (SELECT avg(value) AS ma, stddev_pop(value) AS sa, avg(hora) AS mb, stddev_pop(hora) AS sb FROM rd),
z AS (SELECT rd.*, (value - ma) / sa AS a, (hora - mb) / sb AS b FROM rd, m),
c AS (SELECT row_number() OVER (ORDER BY "Time", seq) - 1 AS cluster, a, b FROM z ORDER BY "Time", seq LIMIT 3),
n AS (SELECT z.seq, any_value(cold) AS cold, any_value(hora) AS hora, any_value(value) AS value,
  min(struct_pack(d := pow(z.a - c.a, 2) + pow(z.b - c.b, 2), cluster := c.cluster)) AS t FROM z, c GROUP BY z.seq)
SELECT CAST(t.cluster AS INTEGER) AS cluster, round(median(cold), 6) AS cold, round(median(hora), 6) AS hora,
  round(median(value), 6) AS value, count(*) AS n FROM n GROUP BY 1""",
    "ridge_curves": f"""{_SPLIT},
tr AS (SELECT *, row_number() OVER (ORDER BY "Time", seq) - 1 AS j, count(*) OVER () AS t FROM sp WHERE particion = 'train'),
f AS (SELECT any_value(t) // 4 AS block, any_value(t) - 3 * (any_value(t) // 4) AS head FROM tr),
k AS (SELECT CAST(floor(head * (CAST(0.2 AS DOUBLE) + i * (CAST(0.8 AS DOUBLE) / 4))) AS BIGINT) AS k FROM f, range(5) AS r(i)),
hd AS (SELECT * FROM k JOIN tr ON j < k), {_moments_sql("mom", "hd", "k, ")}, {_RIDGE_SQL},
e AS (SELECT k, CASE WHEN j < k THEN -1 WHEN j >= head THEN (j - head) // block END AS b, abs(value - ({_RIDGE_AT})) AS e
  FROM tr, f, rc),
g AS (SELECT k, b, avg(e) AS mae FROM e WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT 'ridge' AS modelo, k AS muestras, round(max(mae) FILTER (b < 0), 6) AS mae_train,
  round(avg(mae) FILTER (b >= 0), 6) AS mae_val FROM g GROUP BY k""",
    "refit_scores": f"""{_SPLIT}, bo AS (SELECT * FROM sp WHERE particion <> 'test'), {_moments_sql("mom", "bo")}, {_RIDGE_SQL},
sc AS (SELECT sp.*, {_RIDGE_AT} AS p FROM sp, rc WHERE particion = 'test')
""" + rounded_scores(scores_sql("value", {"ridge": "p"}, "sc")),
    "linear_importance": f"""{LABELLED_SQL}, {_RIDGE_SQL},
v AS (SELECT 'cold' AS variable, abs(za) AS i FROM rc UNION ALL SELECT 'load', abs(zb) FROM rc)
SELECT CAST(row_number() OVER (ORDER BY i DESC) AS INTEGER) AS orden, variable, round(i, 6) AS importancia FROM v""",
    "observed_predicted": f"""{LABELLED_SQL} SELECT "Time", seq, round(value, 6) AS observado, round(base, 6) AS predicho,
  round(res, 6) AS residual FROM cl WHERE particion = 'test'""",
    "class_winners": f"""{LABELLED_SQL},
top AS (SELECT clase FROM cl WHERE particion = 'train' GROUP BY 1 ORDER BY count(*) DESC, clase LIMIT 1),
sc AS (WITH """ + _f1_sql(f"""SELECT '{DUMMY_MODEL}' AS modelo, particion, cl.clase AS truth, top.clase AS pred
  FROM cl, top WHERE particion = 'val'
  UNION ALL SELECT 'frio', particion, clase, CASE WHEN cold > 5 THEN 'critico' ELSE 'normal' END FROM cl WHERE particion = 'val'
  UNION ALL SELECT 'madrugada', particion, clase, CASE WHEN hora < 6 THEN 'alerta' ELSE 'normal' END FROM cl WHERE particion = 'val'""")
    + f""")
SELECT 'todos' AS criterio, * FROM (SELECT modelo, f1_macro FROM sc ORDER BY f1_macro DESC, modelo LIMIT 1)
UNION ALL SELECT 'aprendidos', * FROM (
  SELECT modelo, f1_macro FROM sc WHERE modelo <> '{DUMMY_MODEL}' ORDER BY f1_macro DESC, modelo LIMIT 1)""",
}
