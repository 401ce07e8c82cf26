"""Population stability between a reference and a current sample, all features at once."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.functions.numbers import psi_band
from plantpulse.functions.tags import finite
from plantpulse.operators.ordered import quantiles
from plantpulse.session import frozen

FLOOR = 1e-4


def _reading(name: str) -> Column:
    """Finite double; adding zero turns -0.0 into 0.0, which the bin search tells apart."""
    return (finite(F.col(name).cast("double")) + F.lit(0.0)).alias(name)


def reference_cuts(reference: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(variable, n_ref, cuts): distinct linear quantiles, one row per feature."""
    clean = reference.select([_reading(f) for f in features])
    probs = [i / bins for i in range(bins + 1)]
    cuts = quantiles(clean, features, probs).select(
        "variable", F.col("n").alias("n_ref"), F.array_sort(F.array_distinct("q")).alias("cuts")
    )
    return frozen(cuts, max(len(features), 1))


def with_bins(df: DataFrame, features: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """Replace each feature by its 0-based bin: left closed, last one closed on both sides.

    Outside the cuts is -1 and a missing value stays NULL.  The bin is found by the
    JVM's binary search over the literal cuts.
    """
    known = [f for f in features if len(edges.get(f, [])) >= 2]
    if known:
        df = Bucketizer(
            inputCols=known,
            outputCols=[f"_b_{f}" for f in known],
            splitsArray=[[-math.inf, *[c + 0.0 for c in edges[f]], math.inf] for f in known],
            handleInvalid="keep",
        ).transform(df)
    bins = {f: F.lit(-1) for f in features}
    for f in known:
        x, last = F.col(f), len(edges[f]) - 2
        inside = x.between(F.lit(edges[f][0]), F.lit(edges[f][-1]))
        bins[f] = F.when(inside, F.least(F.col(f"_b_{f}").cast("int") - 1, F.lit(last))).otherwise(-1)
    others = [c for c in df.columns if c not in features and not c.startswith("_b_")]
    return df.select(*others, *[F.when(F.col(f).isNotNull(), b).alias(f) for f, b in bins.items()])


def binned_counts(
    df: DataFrame, features: list[str], cuts: DataFrame, side: Column, by: list[str] | None = None
) -> DataFrame:
    """(by..., variable, bin, ref, cur): rows per bin; ``side`` is true for reference rows.

    ``cuts`` has one short row per feature and becomes literals.
    """
    by = list(by or [])
    edges = {r["variable"]: list(r["cuts"]) for r in cuts.collect()}
    values = df.select(
        *by, side.alias("_ref"), *[_reading(f) for f in features]
    )
    long = with_bins(values, features, edges).unpivot([*by, "_ref"], features, "variable", "bin")
    return (
        long.filter(F.col("bin").isNotNull())
        .groupBy(*by, "variable", F.when(F.col("bin") >= 0, F.col("bin")).alias("bin"))
        .agg(F.count_if(F.col("_ref")).alias("ref"), F.count_if(~F.col("_ref")).alias("cur"))
    )


def psi_from_counts(
    counts: DataFrame, cuts: DataFrame, bins: int = 10, by: list[str] | None = None
) -> DataFrame:
    """Stability index from binned counts; too few rows or cuts give NULL.

    Shares are clipped below and renormalised, so an empty bin stays finite.  The
    windows run over at most one row per bin.
    """
    key = [*(by or []), "variable"]
    groups = (
        counts.groupBy(*key)
        .agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
        .join(F.broadcast(cuts.select("variable", (F.size("cuts") - 1).alias("bins"))), "variable")
    )
    usable = F.least("n_ref", "n_cur") >= bins
    frame = groups.filter(usable & (F.col("bins") >= 2)).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")
    )
    over = Window.partitionBy(*key)
    cells = frame.join(counts, [*key, "bin"], "left").na.fill(0, ["ref", "cur"])
    for side in ("ref", "cur"):
        total = F.greatest(F.sum(side).over(over), F.lit(1))
        cells = cells.withColumn(side, F.greatest(F.col(side) / total, F.lit(FLOOR)))
    for side in ("ref", "cur"):
        cells = cells.withColumn(side, F.col(side) / F.sum(side).over(over))
    ref, cur = F.col("ref"), F.col("cur")
    index = cells.groupBy(*key).agg(F.sum((cur - ref) * F.log(cur / ref)).alias("psi"))
    return groups.select(*key).join(index, key, "left").withColumn("banda", psi_band(F.col("psi")))


def population_stability(
    reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10
) -> DataFrame:
    """(variable, psi, banda) for every feature, without a loop over features."""
    cuts = reference_cuts(reference, features, bins)
    both = reference.select(*features, F.lit(True).alias("_side")).unionByName(
        current.select(*features, F.lit(False).alias("_side"))
    )
    # At most the bins and the two places outside them, a variable.
    counts = frozen(binned_counts(both, features, cuts, F.col("_side")), len(features) * (bins + 2) + 1)
    return psi_from_counts(counts, cuts, bins)
