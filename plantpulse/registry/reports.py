"""Side-by-side comparison of two studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.config import BAR_TO_MBAR, INHG_TO_MBAR, MEDIAN_MODEL, PERSISTENCE
from plantpulse.models.linear import fit_linear
from plantpulse.operators.metrics import regression_scores
from plantpulse.operators.ordered import column_quantiles
from plantpulse.operators.regime import level_stats
from plantpulse.operators.splits import chronological_split
from plantpulse.plans.forecast import naive_predictions, ready_table
from plantpulse.plans.study import compare, study_metrics, with_relative
from plantpulse.registry.series import NAIVE_READY_SQL
from plantpulse.registry.views import (
    HOURLY, TRAIN, VAL, grid_of, ols_sql, readings, rounded, scores_sql, split_sql,
)
from plantpulse.session import frozen, written

_LINE = "lineal_frio_y_carga"
_UNITS = {"view": INHG_TO_MBAR, "click": BAR_TO_MBAR}


def _unit_metrics(spark, df, ready, to_mbar):
    split = chronological_split(df, ["Time", "seq"], TRAIN, VAL)
    train = split.filter("particion = 'train'")
    median = column_quantiles(train, "value", [0.5])[0]
    line = fit_linear(train, "value", ["cold", "load"])
    test = split.filter("particion = 'test'").withColumns({"pm": F.lit(median), "pl": line.predicted()})
    regression = frozen(regression_scores(test, "value", {MEDIAN_MODEL: "pm", _LINE: "pl"}))
    ahead = chronological_split(ready, ["Time", "unit"], TRAIN, VAL).filter("particion = 'test'")
    forecast = frozen(regression_scores(ahead, "y_futuro", naive_predictions(ready, HOURLY)))
    sizes = [
        ("filas", float(df.count())), ("pronostico_filas", float(ready.count())),
        ("horizonte_min", float(HOURLY.horizon * HOURLY.step_minutes)),
        ("mejor_mae_pronostico", forecast.agg(F.min("mae")).first()[0]),
    ]
    metrics = study_metrics(frozen(level_stats(df, "value")), regression, forecast, _LINE, to_mbar)
    return with_relative(metrics.unionByName(spark.createDataFrame(sizes, "metrica string, valor double")))


def comparison(spark, sf):
    """Two event types as the two studies; both share one parsed and one ready table."""
    both = written(
        readings(spark, sf).filter(F.col("unit").isin(list(_UNITS))).select(
            "unit", "Time", "seq", "value", "cold", "load"), "readings", ["unit"],
    )
    ready = written(ready_table(grid_of(both), HOURLY), "ready", ["unit"])
    tables = [
        _unit_metrics(spark, both.filter(F.col("unit") == u), ready.filter(F.col("unit") == u), to_mbar)
        for u, to_mbar in _UNITS.items()
    ]
    return rounded(compare(*tables))


def _metrics_sql(unit: str, to_mbar: float) -> str:
    pairs = {MEDIAN_MODEL: "pm", _LINE: "base"}
    naive = {PERSISTENCE: "y_ahora", "persistencia_diaria": "y_lag_24"}
    return f"""(WITH rd1 AS (SELECT * FROM rd WHERE unit = '{unit}'), {split_sql('rd1', '"Time", seq')}, {ols_sql()},
x AS (SELECT cl.*, (SELECT quantile_cont(value, 0.5) FROM sp WHERE particion = 'train') AS pm FROM cl),
tb AS ({scores_sql("value", pairs, "x", "particion = 'test'")}),
re AS (SELECT * FROM ready WHERE unit = '{unit}'), {split_sql('re', '"Time", unit', 'sf')},
fc AS ({scores_sql("y_futuro", naive, "sf", "particion = 'test'")}),
lv AS (SELECT median(value) AS med, quantile_cont(value, 0.95) AS p95, CAST(count(*) AS DOUBLE) AS n FROM rd1),
f AS (SELECT max(mae) FILTER (modelo = '{PERSISTENCE}') AS mp, min(mae) AS mf,
        (SELECT CAST(count(*) AS DOUBLE) FROM re) AS nf FROM fc),
t AS (SELECT max(mae) FILTER (modelo = '{MEDIAN_MODEL}') AS mm, max(mae) FILTER (modelo = '{_LINE}') AS ml,
        max(mape_pct) FILTER (modelo = '{_LINE}') AS pl, max(r2) FILTER (modelo = '{_LINE}') AS rl,
        min(mae) AS best FROM tb)
SELECT unnest(['mediana', 'mediana_mbar', 'p95', 'mejor_mae', 'mae_mediana', 'mae_linea', 'mape_pct_linea', 'r2_linea',
   'mae_persistencia', 'mae_linea_relativo', 'mae_persistencia_relativo', 'filas', 'pronostico_filas', 'horizonte_min',
   'mejor_mae_pronostico']) AS metrica,
  unnest([med, med * CAST({to_mbar} AS DOUBLE), p95, best, mm, ml, pl, rl, mp, ml / med, mp / med, n, nf, 240.0, mf])
    AS valor FROM t, lv, f)"""


QUERIES = {"comparison": comparison}

SQL = {
    "comparison": f"""WITH {NAIVE_READY_SQL}
SELECT coalesce(a.metrica, b.metrica) AS metrica, round(a.valor, 6) AS superficie, round(b.valor, 6) AS aerocondensador,
  round(b.valor / a.valor, 6) AS razon
FROM {_metrics_sql('view', INHG_TO_MBAR)} a FULL JOIN {_metrics_sql('click', BAR_TO_MBAR)} b ON a.metrica = b.metrica""",
}
