"""Chronological splits, expanding folds and evenly spaced samples by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.config import SPLIT, SPLITS
from plantpulse.operators.ordered import before, literal, not_before, part_starts, portable, rows_at


def split_conditions(
    df: DataFrame, order: list[str], train: float, val: float
) -> dict[str, Column]:
    """Condition of each part: comparisons with the two cut keys, which a scan can use."""
    if train <= 0 or val <= 0 or train + val >= 1:
        raise ValueError("train and val fractions must be positive and leave a test part")
    total = df.count()
    first_val, first_test = int(total * train), int(total * (train + val))
    if min(first_val, first_test - first_val, total - first_test) <= 0:
        raise ValueError("a part of the split is empty")
    val_key, test_key = rows_at(df, order, [first_val, first_test], total)
    conditions = (
        before(order, val_key),
        not_before(order, val_key) & before(order, test_key),
        not_before(order, test_key),
    )
    return dict(zip(SPLITS, conditions))


def chronological_split(
    df: DataFrame, order: list[str], train: float, val: float, name: str = SPLIT
) -> DataFrame:
    """Label rows train / val / test by position in time.

    The cut keys are found first and become literals, so the table itself is never
    sorted or shuffled.
    """
    part = split_conditions(df, order, train, val)
    return df.withColumn(
        name,
        F.when(part[SPLITS[0]], SPLITS[0]).when(part[SPLITS[1]], SPLITS[1]).otherwise(SPLITS[2]),
    )


def fold_bounds(total: int, folds: int = 3) -> list[tuple[int, int]]:
    """(train rows, end of test block) of each expanding-window fold."""
    block = total // (folds + 1)
    return [(total - (folds - f) * block, total - (folds - f - 1) * block) for f in range(folds)]


def row_prefixes(df: DataFrame, order: list[str], sizes: list[int], total: int) -> dict[int, Column]:
    """Condition "among the first k rows" for each k, as comparisons with the k-th key.

    Only the keys at those positions are looked up; the table is not moved.
    """
    inner = sorted({k for k in sizes if 0 < k < total})
    keys = rows_at(df, order, inner, total) if inner else []
    ahead = {k: before(order, key) for k, key in zip(inner, keys)}
    return {k: ahead.get(k, F.lit(k >= total)) for k in sizes}


def expanding_folds(df: DataFrame, order: list[str], folds: int = 3) -> list[tuple]:
    """(train, test) pairs: each test block follows everything it is trained on."""
    total = df.count()
    bounds = fold_bounds(total, folds)
    first = row_prefixes(df, order, [b for pair in bounds for b in pair], total)
    return [(df.filter(first[a]), df.filter(first[b] & ~first[a])) for a, b in bounds]


def curve_sizes(total: int, folds: int = 3, steps: int = 5) -> list[int]:
    """Prefix lengths 20 %..100 % of the first fold, shared by all folds."""
    first = fold_bounds(total, folds)[0][0]
    shares = [0.2 + i * (1.0 - 0.2) / (steps - 1) for i in range(steps)]
    return [int(first * s) for s in shares]


# Rows of the key order that one task ranks, and how many such ranges there are at most.
RANGE_ROWS, MAX_RANGES = 50_000, 1024
# Sampled keys a range, from which its ends are taken.
_DRAWS, _DIE = 64, 1 << 30


def _range_number(keys: DataFrame, order: list[str], total: int) -> Column:
    """Number of the key range a row is in, as a binary tree of comparisons with literal keys.

    The ends are evenly spaced rows of a drawn sample of keys, at most _DRAWS x MAX_RANGES or
    so; a poor draw makes uneven ranges, never a wrong order.  Keys are whole tuples, so rows
    that share a first key still part.
    """
    ranges = min(MAX_RANGES, -(-total // RANGE_ROWS))
    chance = min(1.0, _DRAWS * ranges / total)
    drawn = keys.filter(F.pmod(F.xxhash64(*order), F.lit(_DIE)) < int(chance * _DIE))
    rows = drawn.orderBy(*order).select(*[portable(keys, k).alias(k) for k in order]).collect()
    step = max(1, len(rows) // ranges)
    ends = [{k: literal(keys.schema[k].dataType, r[k]) for k in order} for r in rows[step::step]]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(before(order, ends[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(ends))


def systematic_sample(df: DataFrame, order: list[str], size: int = 6000) -> DataFrame:
    """At most ``size`` rows evenly spaced by position, first and last included.

    ``order`` is a total order without nulls.  Key ranges are counted first; each row's
    position is then its place in its range plus the rows of the ranges before, and the
    wanted ones are picked in the same pass.  Only keys are shuffled, once, and nothing is
    written; further columns are fetched by the few chosen keys.
    """
    total = df.count()
    if size >= total:
        return df
    if size == 1:
        return df.orderBy(*order).limit(1)
    keys = df.select(*order)
    placed = keys.withColumn("_range", _range_number(keys, order, total))
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}  # a row a range
    starts = df.sparkSession.createDataFrame(part_starts(counts), "_range int, _start long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = placed.join(F.broadcast(starts), "_range").withColumn("_pos", F.col("_start") + within - 1)
    # Position p is chosen when some i has floor(i * (total-1) / (size-1)) = p; the last i is
    # the last row, whatever the product rounds to.
    step = F.lit((total - 1) / (size - 1))
    nearest = F.ceil(F.col("_pos") / step)
    candidates = [nearest - 1, nearest, nearest + 1]
    chosen = F.lit(False)
    for i in candidates:
        chosen = chosen | (
            (i >= 0) & (i < size - 1) & (F.floor(i * step) == F.col("_pos"))
        )
    last = F.col("_pos") == total - 1
    picked = ranked.filter(chosen | last).select(*order)  # ``size`` rows
    if set(df.columns) == set(order):
        return picked.select(*df.columns)
    return df.join(F.broadcast(picked), order, "left_semi")
