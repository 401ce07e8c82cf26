"""Linear models solved from one pass of pairwise moments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.operators.collinearity import moments


@dataclass(frozen=True)
class LinearFit:
    """Raw-scale coefficients plus the effect of one standard deviation of each driver."""

    drivers: tuple[str, ...]
    intercept: float
    coefs: tuple[float, ...]
    per_sd: tuple[float, ...]

    def predicted(self) -> Column:
        """The prediction as a column expression, evaluated inside generated code."""
        terms = [F.col(d) * F.lit(c) for d, c in zip(self.drivers, self.coefs)]
        return reduce(add, terms, F.lit(self.intercept))

    def importance(self) -> list[tuple[str, float]]:
        ranked = zip(self.drivers, (abs(c) for c in self.per_sd))
        return sorted(ranked, key=lambda item: -item[1])

    def as_table(self, spark) -> DataFrame:
        rows = [("intercept", self.intercept, None)] + [
            (d, c, s) for d, c, s in zip(self.drivers, self.coefs, self.per_sd)
        ]
        return spark.createDataFrame(rows, "variable string, coef double, por_sd double")


def fit_linear(df: DataFrame, target: str, drivers: list[str], alpha: float = 0.0) -> LinearFit:
    """Least squares on standardised drivers; ``alpha`` adds a ridge penalty.

    Standardising divides by the population deviation, so the normal equations are
    n * correlation + alpha on the diagonal.  A constant driver gets no weight.
    """
    n, means, cov = moments(df, [*drivers, target])
    p = len(drivers)
    sd = np.sqrt(np.diag(cov)[:p])
    scale = np.where(sd > 0, sd, 1.0)
    gram = n * cov[:p, :p] / np.outer(scale, scale) + alpha * np.eye(p)
    rhs = n * cov[:p, p] / scale
    per_sd = np.linalg.solve(gram, rhs) if alpha else np.linalg.lstsq(gram, rhs, rcond=None)[0]
    coefs = np.where(sd > 0, per_sd / scale, 0.0)
    intercept = means[p] - float(np.dot(coefs, means[:p]))
    return LinearFit(
        tuple(drivers), float(intercept), tuple(map(float, coefs)), tuple(map(float, per_sd))
    )


def fit_two_driver_by(
    df: DataFrame, target: str, drivers: list[str], by: list[str]
) -> DataFrame:
    """Closed-form least squares of two drivers for every unit in one aggregation."""
    y, (a, b) = target, drivers
    whole = df.dropna(subset=[y, a, b])
    s = whole.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_pop(a).alias("vaa"), F.var_pop(b).alias("vbb"),
        F.covar_pop(a, b).alias("vab"), F.covar_pop(a, y).alias("vay"), F.covar_pop(b, y).alias("vby"),
    )
    det = F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab")
    ca = F.try_divide(F.col("vbb") * F.col("vay") - F.col("vab") * F.col("vby"), det)
    cb = F.try_divide(F.col("vaa") * F.col("vby") - F.col("vab") * F.col("vay"), det)
    return s.select(*by, "n", "my", "ma", "mb", ca.alias(f"coef_{a}"), cb.alias(f"coef_{b}")).select(
        *by,
        "n",
        (F.col("my") - F.col(f"coef_{a}") * F.col("ma") - F.col(f"coef_{b}") * F.col("mb")).alias("intercept"),
        f"coef_{a}",
        f"coef_{b}",
    )
