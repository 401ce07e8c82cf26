"""Degradation classes from the baseline residual, and models that predict them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.config import CLASSES, DUMMY_MODEL, SPLIT, StudyConfig
from plantpulse.functions.numbers import degradation_class
from plantpulse.models.catalog import (
    LABEL, WEIGHT, assemble, classifiers, fit_all, label_index, label_name, with_predictions,
)
from plantpulse.models.samme import fit_samme
from plantpulse.operators.leaderboard import winner
from plantpulse.operators.metrics import (
    balanced_weights, class_counts, classification_scores, confusion_matrix,
)
from plantpulse.session import Cached, frozen, spread


def assign_degradation(
    df: DataFrame, target: str, expected: Column, alert: float, critical: float
) -> DataFrame:
    """Add vacio_base, residual_base and clase."""
    return (
        df.withColumn("vacio_base", expected)
        .withColumn("residual_base", F.col(target) - F.col("vacio_base"))
        .withColumn("clase", degradation_class(F.col("residual_base"), F.lit(alert), F.lit(critical)))
    )


def majority_class(df: DataFrame, label: str) -> str:
    """Most frequent class, the alphabetically first on a tie."""
    counts = class_counts(df, label)
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label)))).first()[0]


@dataclass
class ClassificationResult(Cached):
    """Scores and the matrix of the model shown; ``scored`` reads the cached rows."""

    table: DataFrame
    winner: str
    matrix_model: str
    matrix: DataFrame
    train_counts: DataFrame
    scored: DataFrame
    cached: DataFrame


def run_classification(
    labelled: DataFrame, cfg: StudyConfig, samme_rounds: int = 40, parallelism: int = 4
) -> ClassificationResult:
    """``labelled`` carries the split and ``clase`` columns."""
    drivers = list(cfg.drivers)
    rows = spread(assemble(
        labelled.select(*cfg.keys, SPLIT, "clase", *drivers).withColumn(LABEL, label_index(F.col("clase"))), drivers
    ))
    train = balanced_weights(rows.filter(F.col(SPLIT) == "train"), "clase", WEIGHT)
    estimators = classifiers(cfg.seed, cfg.trees, cfg.keys)

    class Boosted:
        def fit(self, data):
            return fit_samme(data, len(CLASSES), rounds=samme_rounds, seed=cfg.seed)

    fitted = fit_all({**estimators, "adaboost": Boosted()}, train, parallelism)
    held = rows.filter(F.col(SPLIT).isin("val", "test"))
    scored = with_predictions(held, fitted).withColumns(
        {f"c_{n}": label_name(F.col(f"p_{n}")) for n in fitted}
    ).withColumn(f"c_{DUMMY_MODEL}", F.lit(majority_class(train, "clase")))
    names = [DUMMY_MODEL, *fitted]
    table = frozen(classification_scores(scored, "clase", {n: f"c_{n}" for n in names}, [SPLIT]))
    best = winner(table, "val", "f1_macro", lowest=False).first()[0]
    learned = winner(table, "val", "f1_macro", lowest=False, without=[DUMMY_MODEL]).first()[0]
    shown = learned if best == DUMMY_MODEL else best
    matrix = confusion_matrix(scored.filter(F.col(SPLIT) == "test"), "clase", f"c_{shown}")
    return ClassificationResult(table, best, shown, matrix, class_counts(train, "clase"), scored, rows)
