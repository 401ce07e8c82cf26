"""Exact ranks, order statistics and prefix sums over tables of any length.

An unpartitioned window sends the whole table to one task.  These helpers reach the
same answers with range partitions, or by narrowing the key range around the wanted
rank until few rows are left.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plantpulse.functions.tags import epoch_micros
from plantpulse.session import BROADCAST_ROWS, checkpointed, written

# Relative rank error asked of the approximate sketches is 1 / ACCURACY; brackets are
# twice that wide on both sides, so they always contain the exact value.
ACCURACY = 20_000
# Below this many candidate rows the wanted row is found by one top-k; it must stay
# above 2 * ACCURACY, where a bracket is at least a few rows wide.
SMALL = 200_000
_OFFSET_BITS = 33


def positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of every row in the total order of ``order``.

    One range shuffle; the checkpoint pins the partition boundaries so that the
    per-partition counts and the rows they offset come from the same layout.
    """
    slot = "_slot"
    laid_out = checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(slot, F.monotonically_increasing_id())
    )
    part = F.shiftright(slot, _OFFSET_BITS)
    within = F.col(slot).bitwiseAND((1 << _OFFSET_BITS) - 1)
    counts = laid_out.groupBy(part.alias("_part")).count().collect()  # one row per partition
    starts = part_starts({r["_part"]: r["count"] for r in counts})
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        laid_out.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_start") + within).cast("long"))
        .drop("_part", "_start", slot)
    )


def part_starts(size_by_part: dict) -> list[tuple]:
    """(part, rows in the parts before it) from the rows of each part."""
    parts = sorted(size_by_part)
    ends = list(accumulate(size_by_part[p] for p in parts))
    return [(p, e - size_by_part[p]) for p, e in zip(parts, ends)]


def prefix_sums(df: DataFrame, order: list[str], measures: list[str]) -> DataFrame:
    """Add ``before_<m>``: the sum of each measure over all rows ahead in ``order``.

    The order must be total (rows distinct on it).  Range partitions carry running
    sums, and one offset row per partition links them.
    """
    laid_out = checkpointed(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    totals = sorted(
        laid_out.groupBy("_part").agg(*[F.sum(m).alias(m) for m in measures]).collect(),
        key=lambda r: r["_part"],
    )
    rows, run = [], [0] * len(measures)
    for total in totals:
        rows.append((total["_part"], *run))
        run = [a + total[m] for a, m in zip(run, measures)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType())]
        + [T.StructField(f"_start_{m}", kinds[m]) for m in measures]
    )
    offsets = df.sparkSession.createDataFrame(rows, schema)
    ahead = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = laid_out
    for m in measures:
        running = running.withColumn(f"before_{m}", F.coalesce(F.sum(m).over(ahead), F.lit(0)))
    joined = running.join(F.broadcast(offsets), "_part")
    for m in measures:
        joined = joined.withColumn(
            f"before_{m}", (F.col(f"before_{m}") + F.col(f"_start_{m}")).cast(kinds[m])
        )
    return joined.drop("_part", *[f"_start_{m}" for m in measures])


# Bytes of a text key turned into a number at a time: exact as a double.
_HEAD = 6


def _as_number(df: DataFrame, name: str, skip: int = 0) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_micros(F.col(name))
    if isinstance(kind, T.StringType):
        # A few bytes from position ``skip`` on, as a number in the order of the text.
        head = F.substring(F.hex(F.encode(F.col(name), "UTF-8")), 2 * skip + 1, 2 * _HEAD)
        return F.conv(F.rpad(head, 2 * _HEAD, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def rows_at(df: DataFrame, order: list[str], ranks: list[int], total: int) -> list[dict]:
    """Key literals of the rows at the given 0-based positions of the total order.

    Only a few scalars per rank reach the driver.  Each round keeps the rows whose
    first key lies in a bracket around the rank; a single hot key value hands over to
    the next key.  The rows left for each rank are picked in one last job.
    """
    base = df.select(*order)
    left = [_narrowed(base, order, rank, total) for rank in ranks]
    picks = [
        rows.orderBy(*order).offset(rank).limit(1)
        .select(F.lit(i).alias("_i"), *[portable(base, k).alias(k) for k in order])
        for i, (rows, rank) in enumerate(left)
    ]
    found = {r["_i"]: r for r in reduce(DataFrame.unionAll, picks).collect()}
    return [
        {k: literal(base.schema[k].dataType, found[i][k]) for k in order} for i in range(len(ranks))
    ]


def _narrowed(df: DataFrame, order: list[str], rank: int, total: int) -> tuple[DataFrame, int]:
    """(few rows, rank among them) holding the row at ``rank``."""
    base, keys, skip, margin = df, list(order), 0, 2.0 / ACCURACY
    while total > SMALL and keys:
        name = keys[0]
        key = _as_number(base, name, skip)
        share = (rank + 0.5) / total
        marks = [max(share - margin, 0.0), min(share + margin, 1.0)]
        low, high = df.agg(F.percentile_approx(key, marks, ACCURACY).alias("b")).first()["b"]
        below, inside, at_low = df.agg(
            F.count_if(key < low), F.count_if(key.between(low, high)), F.count_if(key == low)
        ).first()
        if not below <= rank < below + inside:
            margin *= 8  # a wider bracket; one over all ranks holds any rank
            continue
        margin = 2.0 / ACCURACY
        if rank < below + at_low and (low == high or inside == total):
            df, rank, total = df.filter(key == low), rank - below, at_low
            lowest, highest = df.agg(F.min(name), F.max(name)).first()
            if lowest == highest:
                keys, skip = keys[1:], 0  # one value left: the next key decides
            elif isinstance(base.schema[name].dataType, T.StringType):
                skip = _shared_bytes(lowest, highest)  # texts in between begin the same
            else:
                break  # integers that share a double: few enough to sort
        elif inside == total:
            df, rank, total = df.filter(key > low), rank - at_low, total - at_low
        else:
            df, rank, total = df.filter(key.between(low, high)), rank - below, inside
    return df, rank if keys else 0  # without keys left, every row carries the same tuple


def _shared_bytes(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def portable(df: DataFrame, name: str) -> Column:
    """Times travel to the driver as microseconds, free of any time zone."""
    timed = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return epoch_micros(F.col(name)) if timed else F.col(name)


def literal(kind: T.DataType, value) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_micros(F.lit(value)).cast(kind)
    return F.lit(value).cast(kind)


def not_before(order: list[str], key: dict) -> Column:
    """Row key >= ``key`` in lexicographic order, as plain comparisons."""
    result = F.lit(True)
    for name in reversed(order):
        result = (F.col(name) > key[name]) | ((F.col(name) == key[name]) & result)
    return (F.col(order[0]) >= key[order[0]]) & result


def before(order: list[str], key: dict) -> Column:
    """Row key < ``key`` in lexicographic order, as comparisons a scan can use."""
    result = F.lit(False)
    for name in reversed(order):
        result = (F.col(name) < key[name]) | ((F.col(name) == key[name]) & result)
    return (F.col(order[0]) <= key[order[0]]) & result


def quantiles(
    df: DataFrame, values: list[str], probs: list[float], by: list[str] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles: (by..., variable, n, q array).

    ``few_groups`` states that the grouping columns have a fixed small domain (split,
    class, cluster); otherwise the number of groups is counted before a broadcast.
    """
    by = list(by or [])
    wide = df.select(*by, *[F.col(v).cast("double").alias(v) for v in values])
    long = wide.unpivot(by, values, "variable", "x")
    return long_quantiles(long, [*by, "variable"], probs, few_groups or not by)


def long_quantiles(
    long: DataFrame, key: list[str], probs: list[float], few_groups: bool = False, small: int = SMALL
) -> DataFrame:
    """Quantiles of column ``x`` per key.

    An approximate sketch brackets every wanted rank; rows outside the brackets are
    only counted, rows inside are counted per distinct value: a 4/ACCURACY share of a
    group for each probability.  Where that share of the largest group is at most
    ``small`` rows, a window per group ranks them; beyond, range partitions do, so that
    no task gets a share of the table.
    """
    long = long.filter(F.col("x").isNotNull())
    margin = 2.0 / ACCURACY
    levels = sorted(set(probs))
    marks = [m for p in levels for m in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = written(long.groupBy(*key).agg(
        F.count("*").alias("n"), F.percentile_approx("x", marks, ACCURACY).alias("b")
    ).select(*key, "n", *[F.col("b")[i].alias(f"m{i}") for i in range(len(marks))]), "sketch")
    groups, largest = sketch.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    side = F.broadcast(sketch) if few_groups or groups <= BROADCAST_ROWS else sketch
    x = F.col("x")
    # In short groups a bracket can be narrower than one row: count every value there.
    inside = F.col("n") <= 2 * ACCURACY
    floor = F.when(F.lit(False), x)
    for i in reversed(range(len(levels))):
        inside = inside | x.between(F.col(f"m{2 * i}"), F.col(f"m{2 * i + 1}"))
        floor = floor.when(F.col(f"m{2 * i + 1}") < x, F.col(f"m{2 * i + 1}"))
    floor = floor.otherwise(F.lit(float("-inf")))
    counted = (
        long.join(side, key)
        .select(*key, "n", F.when(inside, x).otherwise(floor).alias("x"), (~inside).alias("gap"))
        .groupBy(*key, "x", "gap")
        .agg(F.first("n").alias("n"), F.count("*").alias("c"))
    )
    bracketed = 4 * len(levels) * largest // ACCURACY + len(levels) + 1
    if min(largest, max(2 * ACCURACY, bracketed)) <= small:
        upto = Window.partitionBy(*key).orderBy("x", "gap").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("end", F.sum("c").over(upto))
    else:
        run = prefix_sums(counted, [*key, "x", "gap"], ["c"])
        base = run.groupBy(*key).agg(F.min("before_c").alias("base"))
        first = F.broadcast(base) if few_groups or groups <= BROADCAST_ROWS else base
        ranked = run.join(first, key).withColumn("end", F.col("before_c") - F.col("base") + F.col("c"))
    start = F.col("end") - F.col("c")
    spots = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(s) for s in spots for f in (F.floor, F.ceil)]))
    hit = F.exists(ranks, lambda r: (r >= start) & (r < F.col("end")))
    exact = F.when(F.col("gap"), F.raise_error(F.lit("rank fell outside its bracket"))).otherwise(x)
    # At most two rows per probability are left to gather.
    found = ranked.filter(hit).groupBy(*key).agg(
        F.first("n").alias("n"),
        F.collect_list(F.struct(start.alias("start"), "end", exact.alias("x"))).alias("hits"),
    )

    def at(rank: Column) -> Column:
        return F.filter("hits", lambda h: (rank >= h["start"]) & (rank < h["end"]))[0]["x"]

    def lerp(spot: Column) -> Column:
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        return low + (high - low) * (spot - F.floor(spot))

    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return found.select(
        *key, "n", F.transform(wanted, lambda p: lerp((F.col("n") - 1) * p)).alias("q")
    )


def medians(
    df: DataFrame, values: list[str], by: list[str] | None = None, few_groups: bool = False
) -> DataFrame:
    """One row per group with the exact median of every listed column."""
    by = list(by or [])
    long = quantiles(df, values, [0.5], by, few_groups)
    picks = [F.max(F.when(F.col("variable") == v, F.col("q")[0])).alias(v) for v in values]
    return long.groupBy(*by).agg(*picks) if by else long.agg(*picks)


def column_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float]:
    """Exact quantiles of one column as driver scalars (thresholds, cut points)."""
    found = quantiles(df, [column], probs).first()
    return list(found["q"]) if found else [None] * len(probs)
