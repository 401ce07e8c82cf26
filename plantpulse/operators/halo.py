"""Row lags and leads over one long series without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.functions.tags import epoch_micros
from plantpulse.operators.ordered import positions

# A time bucket denser than this goes to the position layout instead.
BUCKET_ROWS = 2_000_000
# Rows per bucket of the position layout.
POSITION_BLOCK = 500_000


def over_time_buckets(
    df: DataFrame, time: str, seq: str, unit: str | None, columns: dict, back_s: float,
    ahead_s: float, bucket_s: float,
) -> DataFrame:
    """Evaluate window expressions per (unit, time bucket), with a halo of neighbours.

    ``columns`` maps a name to a function of the window.  A row is copied to every
    bucket whose rows may look at it; results are kept in the row's own bucket.  They
    are exact for any neighbour within ``back_s`` / ``ahead_s`` seconds.
    """
    second = epoch_micros(F.col(time)) / 1_000_000.0
    first = F.floor((second - ahead_s) / bucket_s)
    last = F.floor((second + back_s) / bucket_s)
    keys = [unit] if unit else []
    window = Window.partitionBy(*keys, "_bucket").orderBy(time, seq)
    spread = df.withColumn("_home", F.floor(second / bucket_s)).withColumn(
        "_bucket", F.explode(F.sequence(first, last))
    )
    seen = spread.withColumns({name: make(window) for name, make in columns.items()})
    return seen.filter("_bucket = _home").drop("_bucket", "_home")


def over_position_blocks(
    df: DataFrame, time: str, seq: str, unit: str | None, columns: dict, back: int, ahead: int,
    block: int = POSITION_BLOCK,
) -> DataFrame:
    """The same evaluation over blocks of consecutive rows, whatever their times.

    Every block holds exactly ``block`` rows plus ``back`` + ``ahead`` copies, so one
    timestamp holding a large share of the rows cannot fill a task.
    """
    keys = [unit] if unit else []
    ranked = positions(df, [*keys, time, seq], "_pos")
    first = F.floor((F.col("_pos") - ahead) / block)
    last = F.floor((F.col("_pos") + back) / block)
    window = Window.partitionBy(*keys, "_bucket").orderBy("_pos")
    spread = ranked.withColumn("_home", F.floor(F.col("_pos") / block)).withColumn(
        "_bucket", F.explode(F.sequence(first, last))
    )
    seen = spread.withColumns({name: make(window) for name, make in columns.items()})
    return seen.filter("_bucket = _home").drop("_bucket", "_home", "_pos")


def densest_bucket(df: DataFrame, time: str, unit: str | None, bucket_s: float) -> int:
    """Most rows any (unit, bucket) holds; counted with map-side combine."""
    bucket = F.floor(epoch_micros(F.col(time)) / (bucket_s * 1_000_000.0))
    keys = [F.col(unit)] if unit else []
    return df.groupBy(*keys, bucket.alias("_b")).count().agg(F.max("count")).first()[0] or 0


def neighbours(
    df: DataFrame, time: str, seq: str, unit: str | None, columns: dict, back: int, ahead: int,
    step_minutes: float, tolerance: float, bucket_s: float | None = None,
) -> DataFrame:
    """Pick the layout: time buckets when they stay small, row blocks otherwise."""
    reach = step_minutes * 60.0 * (1 + tolerance)
    back_s, ahead_s = back * reach, ahead * reach
    bucket_s = bucket_s or max(86_400.0, 8 * (back_s + ahead_s))
    if densest_bucket(df, time, unit, bucket_s) <= BUCKET_ROWS:
        return over_time_buckets(df, time, seq, unit, columns, back_s, ahead_s, bucket_s)
    return over_position_blocks(df, time, seq, unit, columns, back, ahead)
