"""Pairwise moments, correlation, and variance inflation from one aggregate pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population covariance) of a few columns; null rows are skipped.

    Only columns x columns scalars leave the executors.
    """
    whole = df.select([F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = whole.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    means = np.array([row[f"m{i}"] for i in range(len(columns))], dtype=float)
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else np.nan
    return row["n"], means, cov


def pearson_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    _, _, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(sd, sd)


# Share of a driver's variance that the others leave; below it the driver is redundant.
LEAST_SHARE = 1e-10


def variance_inflation(df: DataFrame, drivers: list[str]) -> DataFrame:
    """(variable, vif): diagonal of the inverse correlation matrix of the drivers.

    A driver of which the others leave less than LEAST_SHARE has infinite inflation.
    """
    corr = pearson_matrix(df, drivers)
    try:
        vif = np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        vif = np.full(len(drivers), np.inf)
    vif = np.where((vif <= 0) | (vif > 1 / LEAST_SHARE), np.inf, vif)
    rows = [(c, float(v)) for c, v in zip(drivers, vif)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")
