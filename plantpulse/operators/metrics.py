"""Regression and classification scores as single aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.config import CLASSES, MODEL, SPLIT

REGRESSION_METRICS = ["mae", "rmse", "r2", "mape_pct"]
CLASS_METRICS = ["accuracy", "f1_macro", "f1_weighted"]


def _regression_struct(y: Column, p: Column) -> Column:
    error = y - p
    spread = F.var_pop(y) * F.count(y)
    lost = F.sum(error * error)
    # A constant truth has no spread to explain: 1 when met exactly, else 0.
    r2 = F.when(spread > 0, 1 - lost / spread).when(lost == 0, 1.0).otherwise(0.0)
    return F.struct(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        r2.cast("double").alias("r2"),
        (F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(1e-6))) * 100).alias("mape_pct"),
    )


def regression_scores(
    df: DataFrame, truth: str, predictions: dict[str, str], by: list[str] = [SPLIT]
) -> DataFrame:
    """One row per (model, group): every model is scored in the same pass.

    ``predictions`` maps a model name to its prediction column; the input stays wide,
    so rows are not multiplied by the number of models.
    """
    y = F.col(truth)
    wide = df.groupBy(*by).agg(
        *[_regression_struct(y, F.col(c)).alias(f"m{i}") for i, c in enumerate(predictions.values())]
    )
    scored = F.array(
        *[
            F.struct(F.lit(name).alias(MODEL), F.col(f"m{i}").alias("m"))
            for i, name in enumerate(predictions)
        ]
    )
    return wide.select(*by, F.explode(scored).alias("s")).select(
        F.col(f"s.{MODEL}"), *by, *[F.col(f"s.m.{m}") for m in REGRESSION_METRICS]
    )


def outcome_counts(
    df: DataFrame, truth: str, predictions: dict[str, str], by: list[str] = [SPLIT]
) -> DataFrame:
    """(model, by..., truth, predicted, n): classes squared rows per model and group.

    Joint outcomes of all models are counted first, so the expansion to one row per
    model touches label combinations, not records.
    """
    called = [f"_p{i}" for i in range(len(predictions))]
    joint = (
        df.groupBy(
            *by,
            F.col(truth).alias("truth"),
            *[F.col(p).alias(c) for p, c in zip(predictions.values(), called)],
        )
        .agg(F.count("*").alias("n"))
    )
    entries = [
        F.struct(F.lit(name).alias(MODEL), F.col(c).alias("predicted"))
        for name, c in zip(predictions, called)
    ]
    return (
        joint.select(*by, "truth", "n", F.inline(F.array(*entries)))
        .groupBy(MODEL, *by, "truth", "predicted")
        .agg(F.sum("n").alias("n"))
    )


def classification_scores(
    df: DataFrame, truth: str, predictions: dict[str, str], by: list[str] = [SPLIT]
) -> DataFrame:
    """Accuracy, macro and weighted F1 over the labels seen as truth or prediction."""
    key = [MODEL, *by]
    same = F.col("truth") == F.col("predicted")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
    )
    per_label = (
        outcome_counts(df, truth, predictions, by)
        .select(*key, F.when(same, F.col("n")).otherwise(0).alias("hit"), F.inline(sides))
        .groupBy(*key, "label")
        .agg(
            (F.sum("hit") / 2).alias("tp"),
            F.sum("support").alias("support"),
            F.sum("called").alias("called"),
        )
        .withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.col("called")))
    )
    rows = F.sum("support")
    return per_label.groupBy(*key).agg(
        (F.sum("tp") / rows).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / rows).alias("f1_weighted"),
    )


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, labels: list[str] = CLASSES
) -> DataFrame:
    """Truth by prediction counts in fixed label order, zero filled."""
    spark = df.sparkSession
    frame = spark.createDataFrame(list(enumerate(labels)), "ord int, truth string")
    counts = (
        df.filter(F.col(truth).isin(labels))
        .groupBy(F.col(truth).alias("truth"))
        .pivot(predicted, labels)
        .count()
    )
    return (
        frame.join(F.broadcast(counts), "truth", "left")
        .na.fill(0, labels)
        .select("ord", "truth", *[F.col(c).cast("long").alias(c) for c in labels])
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add n / (K * n_class), from one aggregate with a row per class."""
    counts = {r[label]: r["n"] for r in class_counts(df, label).collect()}
    total, kinds = sum(counts.values()), len(counts)
    pairs = [(F.col(label) == F.lit(c), total / (kinds * n)) for c, n in sorted(counts.items())]
    weight = reduce(lambda acc, pair: F.when(pair[0], pair[1]).otherwise(acc), pairs, F.lit(None))
    return df.withColumn(name, weight.cast("double"))
