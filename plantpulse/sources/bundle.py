"""Scoring bundle: served model, linear baseline, thresholds and driver order."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.models.catalog import assemble
from plantpulse.models.histogram import TreeModel
from plantpulse.models.linear import LinearFit
from plantpulse.sources.historian import last_modified

_KINDS = {
    m.__name__: m
    for m in (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel)
}


@dataclass
class ScoringBundle:
    served: object
    baseline: LinearFit
    model_name: str
    drivers: tuple[str, ...]
    alert: float
    critical: float

    def expected(self, df: DataFrame, name: str) -> DataFrame:
        """Add the served model's prediction; driver order is the bundle's own."""
        if isinstance(self.served, LinearFit):
            return df.withColumn(name, self.served.predicted())
        kept = df.columns
        scored = self.served.transform(assemble(df, list(self.drivers)))
        return scored.select(*kept, F.col("prediction").alias(name))


def _linear_json(fit: LinearFit) -> str:
    return json.dumps([fit.drivers, fit.intercept, fit.coefs, fit.per_sd])


def _linear_from(text: str) -> LinearFit:
    drivers, intercept, coefs, per_sd = json.loads(text)
    return LinearFit(tuple(drivers), intercept, tuple(coefs), tuple(per_sd))


def save_bundle(spark: SparkSession, bundle: ScoringBundle, path: str) -> None:
    """Thresholds, linear fits and binned trees as one Parquet row, other trees in MLlib's format."""
    text = {LinearFit: _linear_json, TreeModel: TreeModel.to_json}.get(type(bundle.served))
    row = (
        bundle.model_name,
        type(bundle.served).__name__,
        text(bundle.served) if text else None,
        _linear_json(bundle.baseline),
        list(bundle.drivers),
        float(bundle.alert),
        float(bundle.critical),
    )
    schema = (
        "model_name string, kind string, served string, baseline string, drivers array<string>, "
        "alert double, critical double"
    )
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if not text:
        bundle.served.write().overwrite().save(f"{path}/model")


def load_bundle(spark: SparkSession, path: str) -> ScoringBundle:
    if last_modified(spark, f"{path}/meta") is None:
        raise FileNotFoundError(f"no scoring bundle at {path}; run a study first")
    row = spark.read.parquet(f"{path}/meta").first()
    served: LinearFit | TreeModel | Model
    if row["kind"] == "LinearFit":
        served = _linear_from(row["served"])
    elif row["kind"] == "TreeModel":
        served = TreeModel.from_json(row["served"])
    else:
        served = _KINDS[row["kind"]].load(f"{path}/model")
    return ScoringBundle(
        served, _linear_from(row["baseline"]), row["model_name"], tuple(row["drivers"]),
        row["alert"], row["critical"],
    )
