"""Expected-value models: fit on train, score val and test, choose, refit, gate."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from plantpulse.config import MEDIAN_MODEL, SPLIT, StudyConfig
from plantpulse.models.boosting import HistogramRegressor, grid_errors
from plantpulse.models.catalog import (
    BINS, FEATURES, assemble, fit_all, importance, regressors, with_predictions,
)
from plantpulse.models.linear import LinearFit, fit_linear
from plantpulse.operators.leaderboard import promotion_gate, winner
from plantpulse.operators.metrics import regression_scores
from plantpulse.operators.ordered import column_quantiles
from plantpulse.operators.sketches import daily_sketches, merged_quantiles
from plantpulse.operators.splits import curve_sizes, fold_bounds, row_prefixes
from plantpulse.session import Cached, frozen, spread

GRID = {"maxDepth": [3, 6], "stepSize": [0.05, 0.1]}
GRID_ROUNDS = 120


@dataclass
class RegressionResult(Cached):
    """Scores, models and the choice among them; ``scored`` reads the cached rows."""

    table: DataFrame
    winner: str
    gate: dict
    baseline: LinearFit
    models: dict
    deployed: object
    deployed_test: dict
    importance: list
    median: float
    grid: dict | None
    scored: DataFrame
    cached: DataFrame


def _part(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(F.col(SPLIT).isin(*names))


def residual_limits(df: DataFrame, cfg: StudyConfig, baseline: LinearFit) -> tuple[float, float]:
    """Alert and critical limits: exact quantiles of the train residual."""
    residual = _part(df, "train").select((F.col(cfg.target) - baseline.predicted()).alias("r"))
    alert, critical = column_quantiles(residual, "r", [cfg.alert_quantile, cfg.critical_quantile])
    return alert, critical


def residual_sketches(df: DataFrame, cfg: StudyConfig, baseline: LinearFit, by: list[str] | None = None) -> DataFrame:
    """A day's residuals as one sketch a group, to be stored as the days arrive."""
    return daily_sketches(df, F.col(cfg.target) - baseline.predicted(), cfg.time, by)


def sketched_limits(sketches: DataFrame, cfg: StudyConfig) -> tuple[float, float]:
    """Alert and critical limits from stored sketches, each within ``rank_bound`` of its rank.

    The opt-in to ``residual_limits`` for limits that follow a growing table: the rows are
    not read again.
    """
    return tuple(merged_quantiles(sketches, [cfg.alert_quantile, cfg.critical_quantile]).first()["q"])


def grid_search(
    train: DataFrame, cfg: StudyConfig, folds: int = 3, rounds: int = GRID_ROUNDS, grid: dict = GRID
) -> tuple[HistogramRegressor, list[dict]]:
    """Mean fold MAE of every setting over expanding folds, and the best setting's estimator.

    Rows are numbered by the block of folds they are in, and all cells grow together.
    """
    total = train.count()
    starts = [a for a, _ in fold_bounds(total, folds)]
    first = row_prefixes(train, cfg.keys, starts, total)
    block = F.lit(folds)
    for f in reversed(range(folds)):
        block = F.when(first[starts[f]], f).otherwise(block)
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    rows = grid_errors(train, cfg.target, cfg.keys, block, settings, folds, rounds, cfg.seed)
    best = min(rows, key=lambda r: r["mae_cv"])
    chosen = {k: best[k] for k in grid}
    return HistogramRegressor(cfg.target, cfg.keys, maxIter=rounds, seed=cfg.seed, **chosen), rows


def run_regression(
    df: DataFrame, cfg: StudyConfig, with_grid: bool = True, parallelism: int = 4
) -> RegressionResult:
    """Score every model on the labelled table in one aggregate, then refit the chosen one."""
    target, drivers = cfg.target, list(cfg.drivers)
    rows = spread(assemble(
        df.select(*cfg.keys, SPLIT, target, *dict.fromkeys([*drivers, *cfg.baseline])), drivers
    ))
    train = _part(rows, "train")
    median = column_quantiles(train, target, [0.5])[0]
    baseline = fit_linear(train, target, list(cfg.baseline))
    ridge = fit_linear(train, target, drivers, alpha=1.0)
    trees = regressors(target, cfg.seed, cfg.trees, cfg.keys)
    grid = None
    if with_grid:
        trees["gbt_grid"], grid = grid_search(
            train, cfg, rounds=cfg.trees.get("gbt_grid", {}).get("maxIter", GRID_ROUNDS)
        )
    fitted = fit_all(trees, train, parallelism)
    held = _part(rows, "val", "test").withColumns({
        f"p_{MEDIAN_MODEL}": F.lit(median),
        f"p_{cfg.baseline_name}": baseline.predicted(),
        "p_ridge": ridge.predicted(),
    })
    scored = with_predictions(held, fitted)
    names = [MEDIAN_MODEL, cfg.baseline_name, "ridge", *fitted]
    table = frozen(regression_scores(scored, target, {n: f"p_{n}" for n in names}, [SPLIT]))
    flexible = ["ridge", *fitted]
    gate = promotion_gate(table, flexible, cfg.baseline_name).first().asDict()
    chosen = gate["modelo_flexible"]
    deployed, final = refitted(rows, cfg, chosen, trees)
    deployed_test = final.first().asDict()
    models = {cfg.baseline_name: baseline, "ridge": ridge, **fitted}
    return RegressionResult(
        table, winner(table, "val", "mae").first()[0], gate, baseline, models, deployed, deployed_test,
        importance(models[chosen], drivers), median, {"cells": grid} if grid else None, scored, rows,
    )


def refitted(rows: DataFrame, cfg: StudyConfig, chosen: str, trees: dict) -> tuple[object, DataFrame]:
    """The chosen model fitted on train and validation together, and its scores on test."""
    both, test = _part(rows, "train", "val"), _part(rows, "test")
    if chosen == "ridge":
        model = fit_linear(both, cfg.target, list(cfg.drivers), alpha=1.0)
        final = test.withColumn("p", model.predicted())
    else:
        model = trees[chosen].fit(both)
        final = with_predictions(test, {"p": model}, "")
    return model, regression_scores(final, cfg.target, {chosen: "p"}, [SPLIT])


def learning_curves(
    train: DataFrame, cfg: StudyConfig, folds: int = 3, parallelism: int = 4, with_trees: bool = True
) -> DataFrame:
    """(modelo, muestras, mae_train, mae_val): mean over folds, prefixes of the first fold."""
    target, drivers = cfg.target, list(cfg.drivers)
    columns = [*cfg.keys, target, *drivers]
    rows = spread(assemble(train.select(*columns), drivers))
    total = rows.count()
    bounds = fold_bounds(total, folds)
    sizes = curve_sizes(total, folds)
    first = row_prefixes(rows, cfg.keys, [*sizes, *[b for pair in bounds for b in pair]], total)
    common = dict(featuresCol=FEATURES, labelCol=target, seed=cfg.seed, maxBins=BINS)
    trees = {
        "arbol_poco_profundo": DecisionTreeRegressor(maxDepth=3, **common),
        "arbol_profundo": DecisionTreeRegressor(maxDepth=12, **common),
    } if with_trees else {}

    class Cell:
        def __init__(self, size):
            self.size = size

        def fit(self, _):
            # All folds share the prefix, so each model is fitted once per size and
            # scored on the three test blocks together.
            head = rows.filter(first[self.size])
            ridge = fit_linear(head, target, drivers, alpha=1.0)
            models = {n: t.fit(head) for n, t in trees.items()}
            scored = with_predictions(rows.withColumn("p_ridge", ridge.predicted()), models)
            block = F.when(first[self.size], -1)
            for f, (a, b) in enumerate(bounds):
                block = block.when(first[b] & ~first[a], f)
            maes = (
                scored.withColumn("b", block).filter(F.col("b").isNotNull()).groupBy("b")
                .agg(*[F.avg(F.abs(F.col(target) - F.col(f"p_{n}"))).alias(n) for n in ["ridge", *trees]])
                .collect()  # one row per fold
            )
            by = {r["b"]: r for r in maes}
            return [
                (n, self.size, by[-1][n], sum(by[f][n] for f in range(folds)) / folds)
                for n in ["ridge", *trees]
            ]

    results = fit_all({s: Cell(s) for s in sizes}, train, parallelism)
    rows.unpersist()
    return train.sparkSession.createDataFrame(
        [r for s in sizes for r in results[s]],
        "modelo string, muestras long, mae_train double, mae_val double",
    )
