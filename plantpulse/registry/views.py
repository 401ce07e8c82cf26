"""Historian-like views of the supplied tables, in Spark and in SQL.

``readings``: one row per event; ``hourly``: events on an hourly grid per event type;
``plant``: the same without the type.  Sums are rounded to the two decimals they
have, so both engines divide identical numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.config import StudyConfig
from plantpulse.models.linear import LinearFit, fit_linear
from plantpulse.operators.splits import chronological_split
from plantpulse.plans.classification import assign_degradation
from plantpulse.plans.regression import residual_limits

TRAIN, VAL = 0.7, 0.15

READINGS = StudyConfig(
    name="readings", target="value", drivers=("cold", "load", "hora"), baseline=("cold", "load"),
    baseline_name="lineal_frio_y_carga", cold="cold", load="load", contrasts=("cold", "load"),
    profile=("value", "cold", "load"), unit=None, lags=(1, 2), horizon=1, step_minutes=4.3,
    daily_lag=2, preview_rows=200,
)
HOURLY = StudyConfig(
    name="hourly", target="y", drivers=("cold", "load"), baseline=("cold", "load"),
    baseline_name="lineal_frio_y_carga", cold="cold", load="load", unit="unit", seq="unit",
    lags=(1, 2, 4, 8, 24), horizon=4, step_minutes=60.0, daily_lag=24, preview_rows=200,
)
PLANT = StudyConfig(
    name="plant", target="y", drivers=("cold", "load"), baseline=("cold", "load"),
    baseline_name="lineal_frio_y_carga", cold="cold", load="load", seq="seq",
    lags=(1, 2, 4, 8, 24), horizon=4, step_minutes=60.0, daily_lag=24, preview_rows=200,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # Times are compared and truncated in UTC, whatever zone the caller's session has.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def naive(c: str):
    """Zone-less timestamp for results."""
    return F.col(c).cast("timestamp_ntz")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("Time"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("unit"),
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("cold"),
        F.col("user_id").cast("double").alias("load"),
        F.hour("ts").cast("double").alias("hora"),
    )


def _grid() -> list:
    return [
        (F.round(F.sum("value"), 2) / F.count("*")).alias("y"),
        F.count("*").cast("double").alias("load"),
        (F.sum("cold") / F.count("*")).alias("cold"),
    ]


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return grid_of(readings(spark, sf))


def grid_of(rd: DataFrame) -> DataFrame:
    return rd.groupBy("unit", F.date_trunc("hour", "Time").alias("Time")).agg(*_grid())


def plant(spark: SparkSession, sf: str) -> DataFrame:
    rd = readings(spark, sf)
    grid = rd.groupBy(F.date_trunc("hour", "Time").alias("Time")).agg(*_grid())
    return grid.withColumn("seq", F.lit(0))


def split_readings(spark: SparkSession, sf: str) -> DataFrame:
    return chronological_split(readings(spark, sf), READINGS.keys, TRAIN, VAL)


def labelled_readings(spark: SparkSession, sf: str) -> DataFrame:
    df = split_readings(spark, sf)
    fit: LinearFit = fit_linear(df.filter("particion = 'train'"), "value", ["cold", "load"])
    alert, critical = residual_limits(df, READINGS, fit)
    return assign_degradation(df, "value", fit.predicted(), alert, critical)


RD_SQL = """rd AS (
  SELECT ts AS "Time", event_id AS seq, event_type AS unit, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS cold,
         CAST(user_id AS DOUBLE) AS load, CAST(hour(ts) AS DOUBLE) AS hora
  FROM events)"""

HOURLY_SQL = RD_SQL + """, hourly AS (
  SELECT unit, date_trunc('hour', "Time") AS "Time", round(sum(value), 2) / count(*) AS y,
         CAST(count(*) AS DOUBLE) AS load, sum(cold) / count(*) AS cold
  FROM rd GROUP BY 1, 2)"""

PLANT_SQL = RD_SQL + """, plant AS (
  SELECT date_trunc('hour', "Time") AS "Time", 0 AS seq, round(sum(value), 2) / count(*) AS y,
         CAST(count(*) AS DOUBLE) AS load, sum(cold) / count(*) AS cold
  FROM rd GROUP BY 1)"""


def split_sql(source: str, order: str, name: str = "sp") -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                 WHEN i < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
                 ELSE 'test' END AS particion
  FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM {source}))"""


def ols_sql(y: str = "value", source: str = "sp") -> str:
    """Two-driver least squares on the train part, prediction column base."""
    return f"""mom AS (
  SELECT avg({y}) AS my, avg(cold) AS ma, avg(load) AS mb, var_pop(cold) AS vaa, var_pop(load) AS vbb,
         covar_pop(cold, load) AS vab, covar_pop(cold, {y}) AS vay, covar_pop(load, {y}) AS vby,
         count(*) AS m
  FROM {source} WHERE particion = 'train'),
co AS (
  SELECT *, (vbb * vay - vab * vby) / (vaa * vbb - vab * vab) AS ca,
         (vaa * vby - vab * vay) / (vaa * vbb - vab * vab) AS cb FROM mom),
pr AS (SELECT s.*, my + ca * (cold - ma) + cb * (load - mb) AS base FROM {source} s, co),
th AS (
  SELECT quantile_cont({y} - base, 0.75) AS qa, quantile_cont({y} - base, 0.95) AS qc
  FROM pr WHERE particion = 'train'),
cl AS (
  SELECT pr.*, {y} - base AS res, qa, qc,
         CASE WHEN {y} - base <= qa THEN 'normal' WHEN {y} - base <= qc THEN 'alerta'
              ELSE 'critico' END AS clase
  FROM pr, th)"""


LABELLED_SQL = f"WITH {RD_SQL}, {split_sql('rd', '\"Time\", seq')}, {ols_sql()}"


def scores_sql(y: str, pairs: dict[str, str], source: str, where: str = "true") -> str:
    """SELECT of the four regression scores per (modelo, particion)."""
    parts = [
        f"""SELECT '{name}' AS modelo, particion, avg(abs({y} - {p})) AS mae,
       sqrt(avg(({y} - {p}) * ({y} - {p}))) AS rmse,
       1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y})) AS r2,
       avg(abs({y} - {p}) / greatest(abs({y}), 1e-6)) * 100 AS mape_pct
  FROM {source} WHERE {where} GROUP BY particion"""
        for name, p in pairs.items()
    ]
    return "\n  UNION ALL ".join(parts)


def rounded_scores(inner: str) -> str:
    return f"""SELECT modelo, particion, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
       round(r2, 6) AS r2, round(mape_pct, 6) AS mape_pct FROM ({inner})"""
