"""Clock-validated lags and forecast horizon for gappy series."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.functions.tags import minutes_between
from plantpulse.operators.halo import neighbours

TOLERANCE = 0.25


def lag_column(target: str, k: int) -> str:
    return f"{target}_lag_{k}"


def future_column(target: str) -> str:
    return f"{target}_futuro"


def now_column(target: str) -> str:
    return f"{target}_ahora"


def _on_schedule(minutes: Column, steps: int, step_minutes: float) -> Column:
    due = steps * step_minutes
    hit = minutes.between(due * (1 - TOLERANCE), due * (1 + TOLERANCE))
    return F.coalesce(hit, F.lit(False))


def forecast_columns(
    df: DataFrame, time: str, seq: str, target: str, lags: list[int], horizon: int,
    step_minutes: float, unit: str | None = None, bucket_s: float | None = None,
) -> DataFrame:
    """Add the k-th previous values, the value ``horizon`` rows ahead and their clock checks.

    A lag counts only if the clock moved back k steps within 25 %.  Values whose check
    fails are NULL: across a gap the previous row is not an earlier reading.
    """
    wanted = {}
    for k in lags:
        wanted[lag_column(target, k)] = lambda w, k=k: F.lag(target, k).over(w)
        wanted[f"_t_lag_{k}"] = lambda w, k=k: F.lag(time, k).over(w)
    wanted[future_column(target)] = lambda w: F.lead(target, horizon).over(w)
    wanted["_t_lead"] = lambda w: F.lead(time, horizon).over(w)
    seen = neighbours(
        df, time, seq, unit, wanted, max(lags, default=0), horizon, step_minutes, TOLERANCE, bucket_s
    )
    now = F.col(time)
    checks, values = {}, {}
    for k in lags:
        ok = _on_schedule(minutes_between(now, F.col(f"_t_lag_{k}")), k, step_minutes)
        checks[f"ok_lag_{k}"] = ok
        values[lag_column(target, k)] = F.when(F.col(f"ok_lag_{k}"), F.col(lag_column(target, k)))
    checks["ok_futuro"] = _on_schedule(
        minutes_between(F.col("_t_lead"), now), horizon, step_minutes
    )
    values[future_column(target)] = F.when(F.col("ok_futuro"), F.col(future_column(target)))
    values[now_column(target)] = F.col(target)
    spent = [c for c in wanted if c.startswith("_t_")]
    return seen.withColumns(checks).drop(*spent).withColumns(values)


def forecast_features(target: str, lags: list[int], drivers: list[str]) -> list[str]:
    return [*drivers, *[lag_column(target, k) for k in lags]]


def ready_rows(
    df: DataFrame, keys: list[str], target: str, lags: list[int], drivers: list[str],
    daily_lag: int | None = None,
) -> DataFrame:
    """Rows whose every lag and horizon passed the clock check, model columns only."""
    flags = [F.col(f"ok_lag_{k}") for k in lags] + [F.col("ok_futuro")]
    keep = [*keys, future_column(target), now_column(target), *forecast_features(target, lags, drivers)]
    daily = lag_column(target, daily_lag) if daily_lag else None
    if daily and daily in df.columns and daily not in keep:
        keep.append(daily)
    ready = reduce(and_, flags) & F.col(future_column(target)).isNotNull()
    return df.filter(ready).select(*keep)
