"""Rank statistics: two-sample Mann-Whitney and Spearman correlation, ties averaged."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.operators.collinearity import pearson_matrix
from plantpulse.operators.ordered import long_quantiles, prefix_sums

MIN_GROUP = 20


def two_sided_p(u: float, n1: int, n2: int, ties: float) -> float | None:
    """Normal approximation with tie and continuity correction."""
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return None
    z = (abs(u - n1 * n2 / 2.0) - 0.5) / math.sqrt(variance)
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def mann_whitney(
    df: DataFrame, columns: list[str], group: str, first: str, second: str
) -> DataFrame:
    """One row per column: sizes, medians, U of the first group, tie term and p-value.

    Rows are counted per distinct value before anything is ordered, so a value held
    by a large share of the rows is a single row of the ranking.
    """
    long = (
        df.filter(F.col(group).isin(first, second))
        .select(
            (F.col(group) == first).alias("_first"),
            *[F.col(c).cast("double").alias(c) for c in columns],
        )
        .unpivot("_first", columns, "variable", "x")
        .filter(F.col("x").isNotNull())
    )
    values = long.groupBy("variable", "x").agg(
        F.count_if(F.col("_first")).alias("c1"), F.count("*").alias("t")
    )
    ranked = prefix_sums(values, ["variable", "x"], ["t"])
    # Ranks restart for each variable: subtract what lies ahead of its first value.
    c1, t = F.col("c1").cast("double"), F.col("t").cast("double")
    summed = ranked.groupBy("variable").agg(
        F.min("before_t").alias("ahead"),
        F.sum("c1").alias("n1"),
        F.sum("t").alias("n"),
        F.sum(c1 * (F.col("before_t") + (t + 1) / 2)).alias("ranks"),
        F.sum(t * t * t - t).alias("ties"),
    )
    middle = long_quantiles(long, ["variable", "_first"], [0.5], few_groups=True)
    middle = middle.groupBy("variable").agg(
        F.max(F.when(F.col("_first"), F.col("q")[0])).alias("med1"),
        F.max(F.when(~F.col("_first"), F.col("q")[0])).alias("med2"),
    )
    rows = []
    for r in summed.join(F.broadcast(middle), "variable").collect():  # one row per column
        n1, n2 = r["n1"], r["n"] - r["n1"]
        row = [r["variable"], n1, n2]
        if min(n1, n2) < MIN_GROUP:
            rows.append((*row, None, None, None, None, None))
            continue
        u = r["ranks"] - float(r["ahead"]) * n1 - n1 * (n1 + 1) / 2.0
        p = two_sided_p(u, n1, n2, r["ties"])
        rows.append((*row, r["med1"], r["med2"], u, r["ties"], p))
    return df.sparkSession.createDataFrame(rows, TEST_SCHEMA)


TEST_SCHEMA = (
    "variable string, n_normal long, n_critico long, mediana_normal double, "
    "mediana_critico double, estadistico double, empates double, p_valor double"
)


# Rows a cell of the value range should hold, and how many cells a column has at most.
CELL_ROWS, MAX_CELLS = 100_000, 8192
# Rows of one value need no order, so they spread over this many places of a shuffle.
SPREAD = 1024


def _cell_edges(df: DataFrame, columns: list[str], total: int) -> dict[str, list[float]]:
    """Edges of value cells per column: about equal shares, a frequent value in one of its own.

    A quantile and the next double after it are both edges, so the cell between them holds
    that single value.  How well the sketch cuts decides the balance only, not the ranks.
    """
    cells = min(MAX_CELLS, max(256, total // CELL_ROWS))
    marks = [i / cells for i in range(cells + 1)]
    found = df.agg(*[F.percentile_approx(c, marks, 4 * cells).alias(c) for c in columns]).first()
    edges = {}
    for c in columns:
        cuts = {x for x in found[c] if math.isfinite(x)}
        inner = cuts | {math.nextafter(x, math.inf) for x in cuts}
        edges[c] = [-math.inf, *sorted(x for x in inner if math.isfinite(x)), math.inf]
    return edges


def with_average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``rank_<c>`` of every column: its 1-based rank, tied values sharing their mean.

    Columns are doubles without missing values.  Cells of each column are found by binary
    search over literal edges and counted in one pass.  In a cell of one value the counts are
    the rank, so a value held by a third of the rows is not ordered at all; the other cells
    are ranked in partitions of their own, from the rows of the cells below them.  A column
    of few distinct values is never shuffled, and rows are never joined with a rank a value.
    """
    spark, total = df.sparkSession, df.count()
    if not total:
        return df.select("*", *[F.lit(None).cast("double").alias(f"rank_{c}") for c in columns])
    # Adding zero makes one value of the two zeros.
    clean = df.withColumns({c: F.col(c) + F.lit(0.0) for c in columns})
    edges = _cell_edges(clean, columns, total)
    celled = Bucketizer(
        inputCols=columns, outputCols=[f"_cell_{c}" for c in columns], splitsArray=[edges[c] for c in columns]
    ).transform(clean)
    entries = F.array(*[
        F.struct(F.lit(i).alias("v"), F.col(f"_cell_{c}").alias("cell"), F.col(c).alias("x"))
        for i, c in enumerate(columns)
    ])
    # At most two cells an edge of each column.
    counted = (
        celled.select(F.inline(entries)).groupBy("v", "cell")
        .agg(F.count("*").alias("n"), (F.min("x") == F.max("x")).alias("single")).collect()
    )
    ranked = celled.withColumn("_salt", F.monotonically_increasing_id() % SPREAD)
    for i, c in enumerate(columns):
        rows, ahead = [], 0
        for r in sorted((r for r in counted if r["v"] == i), key=lambda r: r["cell"]):
            rows.append((r["cell"], float(ahead), float(r["n"]), r["single"]))
            ahead += r["n"]
        cell = f"_cell_{c}"
        places = spark.createDataFrame(rows, f"{cell} double, _ahead double, _n double, _single boolean")
        ranked = ranked.join(F.broadcast(places), cell)
        rank = F.col("_ahead") + (F.col("_n") + 1) / 2
        if not all(single for *_, single in rows):
            apart = F.when(F.col("_single"), F.col("_salt")).otherwise(-1)
            within = Window.partitionBy(cell, apart).orderBy(c)
            tied = F.count("*").over(within.rangeBetween(Window.currentRow, Window.currentRow))
            rank = F.when(F.col("_single"), rank).otherwise(
                F.col("_ahead") + F.rank().over(within) + (tied - 1) / 2
            )
        ranked = ranked.withColumn(f"rank_{c}", rank).drop("_ahead", "_n", "_single", cell)
    return ranked.drop("_salt")


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable_a, variable_b, rho): Pearson correlation of average ranks."""
    whole = df.select([F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ranked = with_average_ranks(whole, columns)
    rho = pearson_matrix(ranked, [f"rank_{c}" for c in columns])
    rows = [
        (a, b, None if np.isnan(rho[i, j]) else float(rho[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "variable_a string, variable_b string, rho double"
    )
