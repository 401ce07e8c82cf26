"""Choices made on the long metric table (model, split, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantpulse.config import MEDIAN_MODEL, MODEL, SPLIT


def leaderboard(table: DataFrame, split: str, metric: str, ascending: bool = True) -> DataFrame:
    column = F.col(metric)
    return table.filter(F.col(SPLIT) == split).orderBy(
        column.asc() if ascending else column.desc(), MODEL
    )


def winner(
    table: DataFrame, split: str, metric: str, lowest: bool = True, among: list[str] | None = None,
    without: list[str] | None = None,
) -> DataFrame:
    """One row: best model of a part by a metric, ties to the first name."""
    rows = table.filter(F.col(SPLIT) == split)
    if among is not None:
        rows = rows.filter(F.col(MODEL).isin(among))
    if without:
        rows = rows.filter(~F.col(MODEL).isin(without))
    rank = F.struct(F.col(metric) if lowest else -F.col(metric), F.col(MODEL))
    return rows.agg(
        F.min_by(MODEL, rank).alias(MODEL), F.min_by(metric, rank).alias(metric)
    )


def metric_row(table: DataFrame, model: str, split: str) -> DataFrame:
    return table.filter((F.col(MODEL) == model) & (F.col(SPLIT) == split))


def promotion_gate(table: DataFrame, flexible: list[str], baseline: str) -> DataFrame:
    """Serve the best flexible model only if it beats the train median on validation."""
    val = table.filter(F.col(SPLIT) == "val")
    flexible_row = F.col(MODEL).isin(flexible)
    best = val.agg(
        F.min_by(F.when(flexible_row, F.col(MODEL)), F.when(flexible_row, F.struct("mae", MODEL))).alias("modelo_flexible"),
        F.min(F.when(flexible_row, F.col("mae"))).alias("mae_flexible"),
        F.max(F.when(F.col(MODEL) == MEDIAN_MODEL, F.col("mae"))).alias("mae_mediana"),
    )
    beats = F.coalesce(F.col("mae_flexible") < F.col("mae_mediana"), F.lit(False))
    return best.withColumn("flexible_supera_mediana", beats).withColumn(
        "modelo_servido", F.when(beats, F.col("modelo_flexible")).otherwise(baseline)
    )


def metric_pivot(table: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """Models by parts for one metric, ordered by validation."""
    wide = table.groupBy(MODEL).pivot(SPLIT, ["val", "test"]).agg(F.first(metric))
    return wide.orderBy(F.col("val").asc() if ascending else F.col("val").desc(), MODEL)
