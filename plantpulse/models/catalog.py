"""Tree, boosting and weighted classification estimators with the study's settings."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.config import CLASSES
from plantpulse.models.boosting import HistogramRegressor, SoftmaxClassifier
from plantpulse.models.forest import BalancedForest, MeanForest
from plantpulse.models.histogram import FEATURES

LABEL = "label"
WEIGHT = "weight"
BINS = 256


def assemble(df: DataFrame, drivers: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(drivers), outputCol=FEATURES, handleInvalid="error").transform(df)


def label_index(c: Column) -> Column:
    """Position of the class in the fixed severity order."""
    found = F.array_position(F.array(*[F.lit(x) for x in CLASSES]), c)
    return F.when(found > 0, (found - 1).cast("double"))


def label_name(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CLASSES]), c.cast("int") + 1)


def regressors(target: str, seed: int, overrides: dict | None = None, key: list[str] | None = None) -> dict:
    """Tree (depth 6), forest (120 x 12), boosting (120 x 3) and second-order boosting (160 x 4).

    ``key`` names the columns that tell rows apart; draws of rows start from their hash.
    """
    common = dict(featuresCol=FEATURES, labelCol=target, seed=seed, maxBins=BINS)
    built = {
        "arbol": DecisionTreeRegressor(maxDepth=6, minInstancesPerNode=20, **common),
        "random_forest": MeanForest(
            target, list(key or []), numTrees=120, maxDepth=12, minInstancesPerNode=8, seed=seed, bins=BINS
        ),
        "gbm": GBTRegressor(maxIter=120, maxDepth=3, stepSize=0.08, **common),
        "gbt_hist": HistogramRegressor(target, list(key or []), maxIter=160, maxDepth=4, stepSize=0.08, seed=seed),
    }
    return _overridden(built, overrides)


def forecasters(target: str, seed: int, overrides: dict | None = None) -> dict:
    common = dict(featuresCol=FEATURES, labelCol=target, seed=seed, maxBins=BINS)
    built = {
        "random_forest_lags": RandomForestRegressor(
            numTrees=80, maxDepth=12, minInstancesPerNode=8, featureSubsetStrategy="all", **common
        ),
        "gbt_ventanas": GBTRegressor(maxIter=80, maxDepth=4, stepSize=0.1, **common),
    }
    return _overridden(built, overrides)


def classifiers(seed: int, overrides: dict | None = None, key: list[str] | None = None) -> dict:
    """Weighted tree, forest balanced in every bootstrap, and softmax boosting in two settings."""
    common = dict(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, seed=seed, maxBins=BINS)
    own = dict(classes=len(CLASSES), key=list(key or []), seed=seed)
    built = {
        "arbol": DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=20, **common),
        "random_forest": BalancedForest(LABEL, numTrees=120, maxDepth=12, minInstancesPerNode=8, **own),
        "gbm": SoftmaxClassifier(LABEL, WEIGHT, maxIter=100, maxDepth=3, stepSize=0.08, newton=False, **own),
        "gbt_hist": SoftmaxClassifier(LABEL, WEIGHT, maxIter=140, maxDepth=4, stepSize=0.08, **own),
    }
    return _overridden(built, overrides)


def _overridden(built: dict, overrides: dict | None) -> dict:
    for name, params in (overrides or {}).items():
        if name in built:
            built[name].setParams(**params)
    return built


def fit_all(estimators: dict, train: DataFrame, parallelism: int = 4) -> dict:
    """Fit independent estimators from a small driver pool; each fit is a Spark job chain."""
    names = list(estimators)
    with ThreadPool(max(1, min(parallelism, len(names)))) as pool:
        job = inheritable_thread_target(train.sparkSession)(lambda n: estimators[n].fit(train))
        return dict(zip(names, pool.map(job, names)))


def with_predictions(df: DataFrame, models: dict[str, Model], prefix: str = "p_") -> DataFrame:
    """One prediction column per model; helper columns of the models are dropped."""
    for name, model in models.items():
        kept = df.columns
        scored = model.transform(df)
        df = scored.select(*[F.col(f"`{c}`") for c in kept], F.col("prediction").alias(prefix + name))
    return df


def importance(model, drivers: list[str]) -> list[tuple[str, float]]:
    """Variables by decreasing importance (absolute standardised effect for linear fits)."""
    if hasattr(model, "importance"):
        return model.importance()
    if not hasattr(model, "featureImportances"):
        return []
    return sorted(zip(drivers, map(float, model.featureImportances.toArray())), key=lambda v: -v[1])
