"""Operating regimes: k-means on standardised drivers, k chosen by Euclidean silhouette."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.operators.collinearity import moments
from plantpulse.operators.ordered import medians
from plantpulse.operators.splits import systematic_sample
from plantpulse.session import frozen, spread

SAMPLE_ROWS = 6000
CHUNK = 100
# Rounds at most, and the distance that all centres of a start together still move when settled.
ROUNDS, TOLERANCE = 300, 1e-2


def standardised(df: DataFrame, drivers: list[str]) -> DataFrame:
    """Add ``_z``, the array of (x - mean) / population deviation."""
    _, means, cov = moments(df, drivers)
    sd = np.sqrt(np.diag(cov))
    scaled = [
        (F.col(d) - F.lit(float(m))) / F.lit(float(s) if s > 0 else 1.0)
        for d, m, s in zip(drivers, means, sd)
    ]
    return df.withColumn("_z", F.array(*scaled))


@dataclass
class Centres:
    """One start of k-means: its centres, and the cost of the rows around them."""

    k: int
    start: int
    points: np.ndarray
    cost: float = float("inf")
    settled: bool = False


def spread_starts(points: np.ndarray, ks: list[int], restarts: int, seed: int) -> list[Centres]:
    """Starts drawn from a bounded sample: each centre far from those before (Arthur and
    Vassilvitskii 2007)."""
    starts = []
    for k in ks:
        for r in range(restarts):
            rng = np.random.default_rng([seed, k, r])
            picked = [int(rng.integers(len(points)))]
            gap = ((points - points[picked[0]]) ** 2).sum(axis=1)
            while len(picked) < k:
                total = gap.sum()
                share = gap / total if total > 0 else np.full(len(points), 1 / len(points))
                picked.append(int(rng.choice(len(points), p=share)))
                gap = np.minimum(gap, ((points - points[picked[-1]]) ** 2).sum(axis=1))
            starts.append(Centres(k, r, points[picked].astype(float)))
    return starts


def cluster_sums(df: DataFrame, starts: list[Centres]) -> DataFrame:
    """(fit, cluster, n, cost, s0, s1, ...): sums of the rows nearest to each centre of every fit.

    Each task adds its own rows up for all fits; what is shuffled is a row a centre and task.
    """
    width = starts[0].points.shape[1]
    names = ["n", "cost", *[f"s{j}" for j in range(width)]]
    points = [c.points for c in starts]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(p), 2 + width)) for p in points]
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for p, total in zip(points, sums):
                gap = ((z[:, None, :] - p[None]) ** 2).sum(axis=2)
                own = gap.argmin(axis=1)
                total[:, 0] += np.bincount(own, minlength=len(p))
                total[:, 1] += np.bincount(own, gap[np.arange(len(z)), own], len(p))
                for j in range(width):
                    total[:, 2 + j] += np.bincount(own, z[:, j], len(p))
        fit = np.repeat(np.arange(len(points)), [len(p) for p in points]).astype(np.int32)
        cluster = np.concatenate([np.arange(len(p)) for p in points]).astype(np.int32)
        table = np.concatenate(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fit), pa.array(cluster), *[pa.array(table[:, j]) for j in range(2 + width)]],
            names=["fit", "cluster", *names],
        )

    schema = "fit int, cluster int, " + ", ".join(f"{n} double" for n in names)
    partial = df.select("_z").mapInArrow(add_up, schema)
    return partial.groupBy("fit", "cluster").agg(*[F.sum(n).alias(n) for n in names])


def lloyd(df: DataFrame, starts: list[Centres], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[Centres]:
    """Move the centres of all starts together, one aggregate a round, until none moves on.

    A centre without rows stays.  Costs are those of the final centres.  Only a row a centre
    reaches the driver.
    """
    for step in range(rounds + 1):
        moving = [c for c in starts if not c.settled]
        if not moving:
            break
        found = {(r["fit"], r["cluster"]): r for r in cluster_sums(df, moving).collect()}
        for i, c in enumerate(moving):
            rows = [found.get((i, j)) for j in range(c.k)]
            c.cost = sum(r["cost"] for r in rows if r)
            moved = np.array([
                [r[f"s{j}"] / r["n"] for j in range(c.points.shape[1])] if r and r["n"] else c.points[n]
                for n, r in enumerate(rows)
            ])
            c.settled = step == rounds or ((moved - c.points) ** 2).sum() <= tolerance**2
            if not c.settled:
                c.points = moved
    return starts


def best_of(fits: list[Centres]) -> dict[int, Centres]:
    """Per k the start of lowest cost, the first of equals."""
    return {k: min((c for c in fits if c.k == k), key=lambda c: (c.cost, c.start)) for k in {c.k for c in fits}}


def nearest_centre(points: np.ndarray) -> Column:
    """Number of the nearest centre (the lowest on a tie), in generated code."""
    gaps = F.array(*[
        reduce(lambda x, y: x + y, [(F.col("_z")[j] - F.lit(float(v))) ** 2 for j, v in enumerate(p)]) for p in points
    ])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def cluster_profile(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, exact median of every column, n): a row a cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    return medians(labelled, columns, ["cluster"], few_groups=True).join(F.broadcast(sizes), "cluster")


def silhouettes(sample: DataFrame, labels: list[str]) -> dict[str, float]:
    """Mean Euclidean silhouette of each labelling of a sample of bounded size.

    The sample (at most SAMPLE_ROWS rows by construction) is broadcast; each task
    compares its own rows with it and emits one number per row and labelling.
    """
    held = sample.select("_z", *labels).toPandas()
    if len(held) > SAMPLE_ROWS:
        raise ValueError("silhouettes need a bounded sample")
    points = np.array(held["_z"].tolist(), dtype=float)
    marks = {c: held[c].to_numpy(dtype=int) for c in labels}
    shared = sample.sparkSession.sparkContext.broadcast((points, marks))

    def per_row(batches):
        points, marks = shared.value
        members = {c: np.eye(m.max() + 1)[m] for c, m in marks.items()}
        for batch in batches:
            z = np.array(batch["_z"].tolist(), dtype=float)
            out = {}
            for start in range(0, len(z), CHUNK):
                part = z[start:start + CHUNK]
                gap = np.sqrt(((part[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
                for c, onehot in members.items():
                    own = batch[c].to_numpy(dtype=int)[start:start + CHUNK]
                    size = onehot.sum(axis=0)
                    total = gap @ onehot
                    rows = np.arange(len(part))
                    alone = size[own] <= 1
                    inner = total[rows, own] / np.maximum(size[own] - 1, 1)
                    mean = np.where(size > 0, total / np.maximum(size, 1), np.inf)
                    mean[rows, own] = np.inf
                    outer = mean.min(axis=1)
                    width = np.maximum(inner, outer)
                    score = np.where(alone | (width == 0), 0.0, (outer - inner) / np.where(width > 0, width, 1.0))
                    out.setdefault(c, []).append(score)
            yield pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    schema = ", ".join(f"{c} double" for c in labels)
    means = sample.select("_z", *labels).mapInPandas(per_row, schema).agg(
        *[F.avg(c).alias(c) for c in labels]
    ).first()
    shared.destroy()
    return {c: float(means[c]) for c in labels}


def operating_clusters(
    df: DataFrame, order: list[str], drivers: list[str], target: str, ks=range(2, 7),
    restarts: int = 10, seed: int = 42,
) -> tuple[list[tuple[int, float]], int, DataFrame, DataFrame]:
    """(silhouette per k, chosen k, labelled rows, median profile per cluster).

    k is chosen on an evenly spaced sample; the chosen k is then fitted on all rows.  Every
    start begins at rows of the sample, and all starts move together.  Clusters are numbered
    by decreasing size, so labels do not depend on the start.
    """
    scaled = standardised(df, drivers)
    sample = systematic_sample(scaled, order, SAMPLE_ROWS).persist()
    points = np.array([r["_z"] for r in sample.select(*order, "_z").orderBy(*order).collect()], dtype=float)
    fits = best_of(lloyd(sample, spread_starts(points, list(ks), restarts, seed)))
    labelled = sample.select("*", *[nearest_centre(fits[k].points).alias(f"k{k}") for k in ks])
    scores = silhouettes(labelled, [f"k{k}" for k in ks])
    curve = [(k, scores[f"k{k}"]) for k in ks]
    chosen = max(curve, key=lambda item: item[1])[0]
    sample.unpersist()
    rows = spread(scaled)
    final = best_of(lloyd(rows, spread_starts(points, [chosen], restarts, seed)))[chosen]
    assigned = rows.withColumn(f"k{chosen}", nearest_centre(final.points))
    sizes = assigned.groupBy(f"k{chosen}").count().collect()  # one row per cluster
    ranked = sorted(sizes, key=lambda r: (-r["count"], r[0]))
    number = reduce(
        lambda acc, item: F.when(F.col(f"k{chosen}") == item[1][0], item[0]).otherwise(acc),
        enumerate(ranked), F.lit(None),
    )
    labelled = assigned.withColumn("cluster", number.cast("int")).drop("_z", f"k{chosen}")
    profile = frozen(cluster_profile(labelled, [*drivers, target]))
    rows.unpersist()
    return curve, chosen, labelled, profile
