"""One-horizon-ahead forecasts: persistence, lagged ridge, forest and boosting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plantpulse.config import DAILY_PERSISTENCE, PERSISTENCE, SPLIT, StudyConfig
from plantpulse.models.catalog import assemble, fit_all, forecasters, with_predictions
from plantpulse.models.linear import fit_linear
from plantpulse.operators.leaderboard import winner
from plantpulse.operators.metrics import regression_scores
from plantpulse.operators.regime import last_rows
from plantpulse.operators.splits import chronological_split
from plantpulse.operators.stationarity import adf
from plantpulse.operators.windows import (
    forecast_columns, forecast_features, future_column, lag_column, now_column, ready_rows,
)
from plantpulse.session import Cached, frozen, spread, written


@dataclass
class ForecastResult(Cached):
    """Scores, the best model's last predictions and the unit root; reads the cached rows."""

    table: DataFrame
    winner: str
    rows: int
    horizon_minutes: float
    adf: dict
    preview: DataFrame
    cached: DataFrame


def ready_table(operating: DataFrame, cfg: StudyConfig) -> DataFrame:
    lags = list(cfg.lags)
    keys = list(dict.fromkeys([*cfg.keys, *([cfg.unit] if cfg.unit else [])]))
    seen = forecast_columns(
        operating.select(*keys, cfg.target, *cfg.drivers), cfg.time, cfg.seq, cfg.target, lags, cfg.horizon,
        cfg.step_minutes, cfg.unit,
    )
    return ready_rows(seen, keys, cfg.target, lags, list(cfg.drivers), cfg.daily_lag)


def naive_predictions(ready: DataFrame, cfg: StudyConfig) -> dict[str, str]:
    """Persistence, and the same time yesterday when that lag exists."""
    found = {PERSISTENCE: now_column(cfg.target)}
    daily = lag_column(cfg.target, cfg.daily_lag)
    if daily in ready.columns:
        found[DAILY_PERSISTENCE] = daily
    return found


def run_forecast(operating: DataFrame, cfg: StudyConfig, parallelism: int = 4) -> ForecastResult:
    """Own chronological split on the ready rows; every model scored in one aggregate."""
    ready = written(ready_table(operating, cfg), "ready")
    split = chronological_split(ready, cfg.keys, cfg.train_fraction, cfg.val_fraction)
    features = forecast_features(cfg.target, list(cfg.lags), list(cfg.drivers))
    target = future_column(cfg.target)
    rows = spread(assemble(split, features))
    train = rows.filter(F.col(SPLIT) == "train")
    ridge = fit_linear(train, target, features, alpha=1.0)
    fitted = fit_all(forecasters(target, cfg.seed, cfg.trees), train, parallelism)
    held = rows.filter(F.col(SPLIT).isin("val", "test")).withColumn("p_ridge_lags", ridge.predicted())
    scored = with_predictions(held, fitted)
    columns = {**naive_predictions(ready, cfg), "ridge_lags": "p_ridge_lags"}
    columns.update({n: f"p_{n}" for n in fitted})
    table = frozen(regression_scores(scored, target, columns, [SPLIT]))
    best = winner(table, "val", "mae").first()[0]
    test = scored.filter(F.col(SPLIT) == "test")
    preview = last_rows(
        test.select(*cfg.keys, target, F.col(columns[best]).alias("prediccion")),
        cfg.keys, cfg.preview_rows,
    )
    # Neighbours in time of different machines are no series: every unit has its own.
    tested = [r.asDict() for r in adf(train, cfg.keys, now_column(cfg.target), by=[cfg.unit] if cfg.unit else []).collect()]
    unit_root = tested[0] if len(tested) == 1 else {"adf_estadistico": None, "adf_p_valor": None}
    unit_root["por_unidad"] = tested if cfg.unit else []
    return ForecastResult(
        table, best, ready.count(), cfg.horizon * cfg.step_minutes, unit_root, preview, rows
    )
