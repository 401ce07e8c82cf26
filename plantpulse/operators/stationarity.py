"""Augmented Dickey-Fuller test of every unit from partial Gram matrices.

A unit's series is cut into blocks of consecutive rows; each block adds up one small matrix
of the regressors of the longest lag, and a unit's matrices are summed.  The regressions of
all shorter lags are nested in that matrix: one triangular factor gives all their residuals.
The few rows that shorter lags see in addition are a unit's first ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.operators.ordered import positions
from plantpulse.session import broadcast_if_small

# Numbers in a block's matrix of regressors: the more lags, the fewer rows.
CELLS = 4_000_000
LEAST_BLOCK = 1_000

# MacKinnon (1994) response surface, constant, one series.
TAU_MIN, TAU_MAX, TAU_STAR = -18.83, 2.74, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(statistic: float) -> float:
    if statistic > TAU_MAX:
        return 1.0
    if statistic < TAU_MIN:
        return 0.0
    coefs = SMALL_P if statistic <= TAU_STAR else LARGE_P
    z = sum(c * statistic**i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def max_lag(n: int) -> int:
    """Schwert (1989) rule, limited by the length of the series."""
    return min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25))


def _max_lag(n: Column) -> Column:
    """``max_lag`` as a column."""
    return F.least(
        F.floor(n / 2) - 2, F.ceil(F.lit(12.0) * F.pow(n / F.lit(100.0), F.lit(0.25)))
    ).cast("int")


def _regressors(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows [1, level, newest lagged difference, ..., oldest, difference] of a run of values."""
    runs = np.lib.stride_tricks.sliding_window_view(x, lags + 2)
    steps = np.diff(runs, axis=1)[:, ::-1]
    return np.column_stack([np.ones(len(runs)), runs[:, -2], steps[:, 1:], steps[:, :1]])


def _partial_grams(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by..., i, j, s): sums of z z', per unit.

    Blocks hold rows of one unit plus the rows before them that a lag can reach, so no group
    outgrows a task; each yields one small matrix.
    """
    reach = F.col("_top") + 1
    size = F.greatest(F.lit(LEAST_BLOCK), F.floor(F.lit(CELLS) / (F.col("_top") + 3)))
    last = F.least(F.col("_pos") + reach, F.col("_n") - 1)
    spread = ranked.select(
        *by, "_pos", "x", "_top", F.explode(F.sequence(F.floor(F.col("_pos") / size), F.floor(last / size))).alias("_block")
    )
    kinds = dict(ranked.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["i int", "j int", "s double"])

    def partial(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_pos")
        top, x = int(block["_top"].iloc[0]), block["x"].to_numpy(dtype=float)
        i, j = np.triu_indices(top + 3)
        total = np.zeros(len(i))
        if len(x) > top + 1:
            z = _regressors(x, top)
            total = (z.T @ z)[i, j]
        cells = pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": total})
        for n, c in enumerate(by):
            cells.insert(n, c, [block[c].iloc[0]] * len(cells))
        return cells

    cells = spread.groupBy(*by, "_block").applyInPandas(partial, schema)
    return cells.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def nested_residuals(gram: np.ndarray) -> np.ndarray:
    """Sums of squared residuals of the last variable on the first k, k = 0, 1, ..., from one factor.

    A regressor that those before it explain adds nothing.
    """
    k = len(gram) - 1
    factor, left = np.zeros((k, k)), gram[:k, :k].copy()
    share, y = np.zeros(k), gram[:k, k].copy()
    for i in range(k):
        if left[i, i] <= 1e-12 * gram[i, i]:
            continue
        root = math.sqrt(left[i, i])
        factor[i:, i] = left[i:, i] / root
        share[i] = y[i] / root
        left[i:, i:] -= np.outer(factor[i:, i], factor[i:, i])
        y[i:] -= factor[i:, i] * share[i]
    return gram[k, k] - np.append(0.0, np.cumsum(share**2))


def choose_and_test(gram: np.ndarray, first: np.ndarray, fixed: bool) -> tuple[float | None, int, int]:
    """(statistic, lags, rows) from the matrix of the longest lag and the series' first values."""
    top = len(gram) - 3
    rows = int(round(gram[0, 0]))
    chosen = top
    if not fixed:
        left = nested_residuals(gram)[2:]
        aic = [
            rows * (math.log(2 * math.pi) + math.log(ssr / rows) + 1) + 2 * (2 + p) if ssr > 0 else math.inf
            for p, ssr in enumerate(left)
        ]
        chosen = int(np.argmin(aic))
    use = [*range(2 + chosen), top + 2]
    gram = gram[np.ix_(use, use)]
    if chosen < top:  # the longer sample that fewer lags leave
        more = _regressors(first, chosen)[:top - chosen]
        gram = gram + more.T @ more
        rows += len(more)
    k = 2 + chosen
    inverse = np.linalg.pinv(gram[:k, :k], hermitian=True)
    beta = inverse @ gram[:k, k]
    ssr = float(gram[k, k] - beta @ gram[:k, k])
    if rows <= k or ssr <= 0 or inverse[1, 1] <= 0:
        return None, chosen, rows
    return float(beta[1] / math.sqrt(ssr / (rows - k) * inverse[1, 1])), chosen, rows


def adf(
    df: DataFrame, order: list[str], column: str, lags: int | None = None, by: list[str] | None = None,
    top: int | None = None,
) -> DataFrame:
    """(by..., adf_estadistico, adf_p_valor, lags, n): constant term, lag length by AIC.

    One row for every unit of ``by``, whose rows are used in their order as they stand.
    ``lags`` fixes the length; ``top`` bounds the choice instead of Schwert's rule.  A series
    too short for its lags, or without residual, has a null statistic; null values are left
    out before anything else, and without ``by`` the whole table is one series.
    """
    by = list(by or [])
    # A unit may also be part of the order: within the unit it tells no rows apart.
    order = [c for c in order if c not in by]
    series = df.filter(F.col(column).isNotNull()).select(*by, *order, F.col(column).cast("double").alias("x"))
    ranked = positions(series, [*by, *order], "_at")
    n = F.count("*")
    wanted = F.lit(lags if lags is not None else top).cast("int")
    longest = F.least(_max_lag(n), wanted) if lags is None else wanted
    # A shift of the level changes only the constant, and keeps the sums accurate.
    facts = ranked.groupBy(*by).agg(
        n.alias("_n"), F.avg("x").alias("_mean"), F.min("_at").alias("_start"), longest.alias("_top")
    ).select(F.struct(*by, F.lit(0)).alias("_unit"), "_n", "_mean", "_start", "_top")
    facts = broadcast_if_small(facts)
    met = ranked.withColumn("_unit", F.struct(*by, F.lit(0))).join(facts, "_unit").select(
        *by, (F.col("_at") - F.col("_start")).alias("_pos"), (F.col("x") - F.col("_mean")).alias("x"), "_n", "_top"
    ).filter("_top >= 0 AND _n > _top + 1")
    kinds = dict(met.dtypes)
    grams = _partial_grams(met, by)
    first = met.filter("_pos <= _top").select(*by, F.lit(-1).alias("i"), F.col("_pos").cast("int").alias("j"), F.col("x").alias("s"))
    schema = ", ".join(
        [f"`{c}` {kinds[c]}" for c in by] + ["adf_estadistico double", "adf_p_valor double", "lags int", "n long"]
    )
    fixed = lags is not None

    def test(cells: pd.DataFrame) -> pd.DataFrame:
        sums, values = cells[cells["i"] >= 0], cells[cells["i"] < 0].sort_values("j")
        gram = np.zeros((sums["j"].max() + 1,) * 2)
        gram[sums["i"], sums["j"]] = gram[sums["j"], sums["i"]] = sums["s"]
        statistic, chosen, rows = choose_and_test(gram, values["s"].to_numpy(dtype=float), fixed)
        out = pd.DataFrame({
            "adf_estadistico": pd.Series([statistic], dtype="float64"),
            "adf_p_valor": pd.Series([None if statistic is None else mackinnon_p(statistic)], dtype="float64"),
            "lags": [chosen], "n": [rows],
        })
        for k, c in enumerate(by):
            out.insert(k, c, [cells[c].iloc[0]])
        return out

    # A unit's cells are its lags squared, whatever the length of its series.
    both = grams.unionByName(first)
    tested = both.groupBy(*by).applyInPandas(test, schema)
    return tested.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("adf_estadistico", "adf_p_valor")})
