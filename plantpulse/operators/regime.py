"""In-service regime, hot-cold contrast, data quality and grouped levels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.config import SPLIT, StudyConfig
from plantpulse.functions.tags import minutes_between
from plantpulse.operators.halo import over_position_blocks
from plantpulse.operators.ordered import medians, quantiles


def operating_rows(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Unit in service, target inside its band (inclusive), every driver present."""
    rules = [F.col(c).isNotNull() for c in cfg.drivers]
    if cfg.min_load is not None:
        rules.append(F.col(cfg.load) >= cfg.min_load)
    if cfg.target_range is not None:
        rules.append(F.col(cfg.target).between(*cfg.target_range))
    return df.filter(reduce(and_, rules))


def terminal_difference(df: DataFrame, hot: str | None, cold: str) -> Column:
    if hot not in df.columns or cold not in df.columns:
        return F.lit(None).cast("double")
    return F.col(hot) - F.col(cold)


def step_minutes(df: DataFrame, time: str, seq: str, unit: str | None = None) -> DataFrame:
    """Minutes since the previous row (null on the first row of a series)."""
    columns = {"_before": lambda w: F.lag(time).over(w)}
    seen = over_position_blocks(df, time, seq, unit, columns, back=1, ahead=0)
    return seen.withColumn("step_min", minutes_between(F.col(time), F.col("_before"))).drop("_before")


def quality_report(
    df: DataFrame, raw_rows: int, time: str, seq: str, target: str
) -> DataFrame:
    """One row: sizes, period, median step in minutes, missing targets."""
    steps = medians(step_minutes(df.select(time, seq), time, seq), ["step_min"])
    facts = df.agg(
        F.lit(raw_rows).cast("long").alias("filas_crudas"),
        F.count("*").alias("filas_limpias"),
        F.min(time).alias("inicio"),
        F.max(time).alias("fin"),
        F.count_if(F.col(target).isNull()).alias("vacio_nulos"),
    )
    median = steps.first()["step_min"]  # one scalar
    return facts.withColumn("paso_mediano_min", F.lit(median).cast("double"))


def split_profile(df: DataFrame, time: str, columns: list[str], by: str = SPLIT) -> DataFrame:
    """Period and exact medians of each part."""
    period = df.groupBy(by).agg(
        F.count("*").alias("n"), F.min(time).alias("inicio"), F.max(time).alias("fin")
    )
    return period.join(F.broadcast(medians(df, columns, [by], few_groups=True)), by)


def level_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, p95, min and max of a column, per group."""
    by = list(by or [])
    q = quantiles(df, [column], [0.5, 0.95], by)
    q = q.select(*by, F.col("q")[0].alias("mediana"), F.col("q")[1].alias("p95"))
    basic = df.groupBy(*by).agg(
        F.avg(column).alias("media"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    if not by:
        spot = q.first()
        return basic.select(
            "media",
            F.lit(spot["mediana"]).alias("mediana"),
            F.lit(spot["p95"]).alias("p95"),
            "min",
            "max",
        )
    return basic.join(q, by).select(*by, "media", "mediana", "p95", "min", "max")


def median_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """Median of a value per category, missing categories dropped, ascending."""
    known = df.filter(F.col(category).isNotNull())
    return medians(known, [value], [category]).orderBy(value, category)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram between the extremes, the maximum in the last bin."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        low = high = 0.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    x = F.col(column)
    index = F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("desde"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hasta"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def shared_limits(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Joint extremes of observed and predicted values."""
    return df.agg(
        F.least(F.min(observed), F.min(predicted)).alias("lo"),
        F.greatest(F.max(observed), F.max(predicted)).alias("hi"),
    )


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The latest ``n`` rows in ascending order: a distributed top-k, then a small sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
