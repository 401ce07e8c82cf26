"""Quantiles from stored, mergeable sketches: one a day and group, merged when asked.

An exact threshold reads every row again.  Here a day's rows are read once, when the day
arrives; a threshold over any span of days merges that span's sketches, a few kilobytes
each, and its rank is off by at most ``rank_bound`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.session import broadcast_if_small

# Values a sketch keeps at its lowest level: up to so many rows it is exact.
SIZE = 4096


def rank_bound(size: int = SIZE) -> float:
    """Largest error of a quantile's rank, as a share of the rows.

    The sketch states 2.296 / size^0.9723 for 99 of 100 cases; twice that is some five
    standard errors.  Merging does not widen it.
    """
    return 2 * 2.296 / size**0.9723


def daily_sketches(
    df: DataFrame, value: Column | str, time: str, by: list[str] | None = None, size: int = SIZE
) -> DataFrame:
    """(day, by..., n, sketch): missing, NaN and infinite values are left out.

    One partial aggregate in the scan's tasks; only sketches are shuffled, so a day or a
    group with a third of all rows is one small buffer a task.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    kept = df.select(F.to_date(time).alias("day"), *(by or []), x.alias("_x")).filter(
        F.col("day").isNotNull() & F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf"))
    )
    return kept.groupBy("day", *(by or [])).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("_x", size).alias("sketch")
    )


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Write days into the store; a day that is written again replaces what it had.

    Other days are not touched, so an arrival costs its own days and a repeated arrival
    changes nothing.
    """
    spread = sketches.repartition("day")
    spread.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; a condition on ``day`` reads only those folders."""
    return spark.read.parquet(path)


def merged_quantiles(
    sketches: DataFrame, probs: list[float], by: list[str] | None = None, size: int = SIZE
) -> DataFrame:
    """(by..., days, n, q array) over all days of each group, smallest stored value at each rank.

    Without rows there is no group; without ``by`` that is one row with a null array.
    """
    merged = sketches.groupBy(*(by or [])).agg(
        F.countDistinct("day").alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.kll_merge_agg_double("sketch", size).alias("_s"),
    )
    picks = F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))) for p in probs])
    return merged.select(*(by or []), "days", "n", F.when(F.col("n") > 0, picks).alias("q"))


def rank_errors(
    df: DataFrame, value: Column | str, quantiles: DataFrame, probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """(by..., prob, error): how far each quantile's true rank is from the one asked for.

    Counted exactly in one pass over the rows; 0 where the wanted rank falls on a row that
    holds the value.
    """
    by = list(by or [])
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, x.alias("_x")).filter(
        F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    side = quantiles.select(*[F.col(c).alias(f"_by_{c}") for c in by], "q")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = rows.join(broadcast_if_small(side) if by else F.broadcast(side), same)
    spots = range(len(probs))
    counted = met.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("_x") < F.col("q")[i]).alias(f"below{i}") for i in spots],
        *[F.count_if(F.col("_x") <= F.col("q")[i]).alias(f"upto{i}") for i in spots],
    )
    found = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.greatest(
                F.lit(0.0), F.lit(float(p)) - F.col(f"upto{i}") / F.col("n"), F.col(f"below{i}") / F.col("n") - F.lit(float(p))
            ).alias("error"),
        )
        for i, p in enumerate(probs)
    ]
    return counted.select(*by, F.inline(F.array(*found)))
