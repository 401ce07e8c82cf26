"""Second-order boosting on binned rows (Chen and Guestrin 2016), one short job a level.

A round adds a tree for every head: one for a value, one a class on a shared softmax, or one
for each cell of a grid search, whose cells all grow in the same passes over the rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.models.histogram import (
    FEATURES, MOST_ROWS, PACKED_ROWS, Held, Settable, Tree, TreeModel, best_cut, bin_edges, counted, fixed_point_bits,
    joined, listed, matrix, node_sums, packed, settled, training_rows, uniform,
)

# Rounds whose trees are added to the kept margins at once.
KEEP_EVERY = 4
SUMS = ["g", "h", "n"]


@dataclass
class Head:
    """One sequence of trees: its depth and rate, and the rows it learns from.

    Rows carry a block number; a head learns from those up to ``last_block``.
    """

    depth: int
    rate: float
    last_block: int = 0


@dataclass
class Rules:
    """What all heads share."""

    rounds: int
    penalty: float = 1.0
    least_weight: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 256
    seed: int = 42
    softmax: bool = False
    curvature: float = 1.0
    step: float = 1.0


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss of every row and head, times the row's weight."""
    if not rules.softmax:
        return (margins - y[:, None]) * weight[:, None], np.broadcast_to(weight[:, None], margins.shape)
    grown = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = grown / grown.sum(axis=1, keepdims=True)
    truth = np.zeros_like(p)
    truth[np.arange(len(y)), y.astype(np.int64)] = 1.0
    return (p - truth) * weight[:, None], np.maximum(rules.curvature * p * (1 - p), 1e-16) * weight[:, None]


def _add_trees(bins: np.ndarray, margins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.values(bins)[:, 0]
    return margins


def _moved(base: np.ndarray, pending: list[list[Tree]]):
    """A block with its margins after the pending trees."""
    def run(block: dict) -> dict:
        margins = block.get("margins")
        margins = np.tile(base, (len(block["bins"]), 1)) if margins is None else margins
        return block | {"margins": _add_trees(block["bins"], margins, pending)}

    return run


def _round(rules: Rules, scale: float, base: np.ndarray, pending: list[list[Tree]], blocks: list[int], columns: list[int]):
    """The sums of one round in fixed point: gradients a head, curvatures, and rows up to each of ``blocks``.

    ``columns`` tells which of the blocks a head learns from.
    """
    def run(block: dict) -> dict:
        margins = _moved(base, pending)(block)["margins"]
        n = np.where(block["block"][:, None] <= np.array(blocks), block["n"][:, None], 0)
        g, h = gradients(margins, block["y"], block["weight"], rules)
        g, h = (np.rint(of * scale).astype(np.int32) for of in (g, h if rules.softmax else h[:, :1]))
        # The curvature of a value is the same for all heads.
        return {"bins": block["bins"], "n": n, "g": g * n[:, columns], "h": h * (n[:, columns] if rules.softmax else n)}

    return run


def _drawn_round(
    rules: Rules, scale: float, base: np.ndarray, pending: list[list[Tree]], at: int, low: float, columns: list[int]
):
    """The same sums from cells, where each round draws rows.

    Rows of a cell have one margin: a round counts its drawn rows and adds up their targets,
    and the gradients follow for all heads without going back to the rows.
    """
    def run(block: dict) -> dict:
        margins, weight = _moved(base, pending)(block)["margins"], block["weight"]
        drawn, shape = uniform(block["draw"], at) < rules.row_share, (len(weight), block["blocks"])
        place = block["place"][drawn]
        n = np.bincount(place, minlength=shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
        target = np.bincount(place, block["target"][drawn], shape[0] * shape[1]).astype(np.int64).reshape(shape).cumsum(axis=1)
        own = np.rint((margins - low) * weight[:, None] * scale).astype(np.int64)
        h = n * np.rint(weight * scale).astype(np.int64)[:, None]
        return {"bins": block["bins"], "n": n, "g": own * n[:, columns] - target[:, columns], "h": h}

    return run


def _level(heads: list[Head], rules: Rules, growing: list[Tree], level: int, columns: list[int], features: list[int], width: int):
    """Partial sums of one level: gradients, curvatures (fixed point) and rows of every cell."""
    first = nodes = 1 << level

    def run(blocks: Iterator[dict]) -> Iterator[tuple]:
        total: dict[int, np.ndarray] = {}
        for block in blocks:
            bins = block["bins"]
            for k in _active(heads, level):
                node, n = growing[k].nodes(bins, level), block["n"][:, columns[k]]
                # Nodes that stayed leaves on the way down are above this level.
                use = np.flatnonzero((node >= first) & (n > 0))
                values = [block["g"][:, k], block["h"][:, k if rules.softmax else columns[k]], n]
                found = node_sums(bins[use], node[use], first, nodes, features, width, [v[use] for v in values])
                total[k] = total[k] + found if k in total else found
        for k, sums in total.items():
            for i in np.flatnonzero(sums[-1, :, 0].any(axis=1)):
                yield (k, int(i) + first), sums[:, i]

    return run


def _active(heads: list[Head], level: int) -> list[int]:
    return [k for k, head in enumerate(heads) if level < head.depth]


def newton_gain(rules: Rules, scale: float):
    """Gain of a split in the loss's own unit; sides below the least weight have none."""
    def score(side):
        return (side("g") / scale) ** 2 / (side("h") / scale + (rules.penalty + 1e-12))

    def gain(left, right, total):
        least = rules.least_weight * scale
        value = score(left) + score(right) - score(total)
        return np.where((left("h") >= least) & (right("h") >= least), value, -np.inf)

    return gain


def _leaf(g: float, h: float, rate: float, rules: Rules, scale: float) -> float:
    return -rules.step * rate * (g / scale) / (h / scale + rules.penalty + 1e-12)


@dataclass
class Boosted:
    """Trees of all rounds and heads, and the rows with their final margins."""

    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]]
    gains: np.ndarray
    rows: Held


def _exact_bits(rows: int) -> int:
    """Bits of the fixed point: sums of all rows are also exact as doubles."""
    return max(1, min(fixed_point_bits(rows), 54 - math.ceil(math.log2(max(2, rows)))))


def boost(
    df: DataFrame, y: Column, heads: list[Head], rules: Rules, key: list[str], weight: Column | None = None,
    block: Column | None = None,
) -> Boosted:
    """Grow ``rules.rounds`` trees a head on the rows of ``df`` (features, target, key).

    The caller gives ``rows`` back.  A round of depth d is d short jobs, whatever the number
    of heads.  Without draws, rows of the same bins, target and weight have the same
    derivatives in all rounds: they are counted out once.  With draws of a value's rows, each
    round counts them out into the cells of equal bins, and only these go through the levels.
    """
    edges = bin_edges(df, rules.bins)
    weight, block = F.lit(1.0) if weight is None else weight, F.lit(0) if block is None else block
    columns = {"y": y.cast("double"), "weight": weight.cast("double"), "block": block.cast("int")}
    held = training_rows(df, edges, columns, key, rules.seed, "boosting")
    blocks = sorted({head.last_block for head in heads})

    def exact(c: Column, b: int) -> Column:
        # Decimal sums are the same in any order.
        return F.sum(F.when(F.col("block") <= b, c.cast("decimal(38,12)"))).cast("double")

    facts = held.rows.agg(
        F.count("*").alias("n"), F.max("weight").alias("w"), F.min("y").alias("low"), F.max("y").alias("high"),
        *[(exact(F.col("y") * F.col("weight"), b) / exact(F.col("weight"), b)).alias(f"b{b}") for b in blocks],
    ).first()
    if rules.softmax:
        base, reach = np.zeros(len(heads)), max(2.0, rules.curvature) * facts["w"]
    else:
        base = np.array([facts[f"b{head.last_block}"] for head in heads], dtype=float)
        reach = 4 * max(facts["high"] - facts["low"], 1.0) * facts["w"]
    # A power of two, so scaling loses nothing.
    scale = 2.0 ** (_exact_bits(facts["n"]) - math.ceil(math.log2(reach)))
    columns = [blocks.index(head.last_block) for head in heads]
    if rules.row_share < 1:
        kept = _cells(held.rows, facts["n"], blocks, facts["low"], scale)
    else:
        kept = packed(counted(held.rows.drop("draw")), facts["n"])
    most = max(head.depth for head in heads)
    span = max((len(e) for e in edges), default=0) + 1
    done, pending, before, gains = [], [], None, np.zeros(len(edges))
    for at in range(rules.rounds):
        growing = [Tree.empty(head.depth) for head in heads]
        features = _drawn_features(len(edges), rules, at)
        choose = _choice(features, rules, scale)
        if len(pending) >= KEEP_EVERY:
            before, kept = kept, kept.map(_moved(base, pending)).persist(StorageLevel.MEMORY_AND_DISK)
            pending = []
        sums = (
            _drawn_round(rules, scale, base, pending, at, facts["low"], columns) if rules.row_share < 1
            else _round(rules, scale, base, pending, blocks, columns)
        )
        now = kept.map(sums).persist(StorageLevel.MEMORY_AND_DISK)
        for level in range(most):
            add_up = _level(heads, rules, growing, level, columns, features, span)
            found = settled(now, add_up, choose, len(SUMS) * len(features) * span, len(_active(heads, level)) << level)
            split = [
                _grow(growing[k], heads[k], node, *chosen, rules, scale, gains)
                for (k, node), chosen in sorted(found, key=lambda f: f[0])
            ]
            if not any(split):
                break
        done.append(growing)
        pending.append(growing)
        now.unpersist()
        if before:  # the kept margins were made in this round's first pass
            before.unpersist()
            before = None
    kept.unpersist()
    held.rows.unpersist()
    held.rows = _scored(held.rows, facts["n"], base, done)  # computed only where it is read
    return Boosted(edges, base, done, gains, held)


def _by_bins(rows: DataFrame, count: int) -> DataFrame:
    """Rows of equal bins side by side, in parts of even size: a crowded cell is cut by its rows' draws."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-count // PACKED_ROWS)), count // MOST_ROWS)
    if parts == 1:
        return rows.coalesce(1).sortWithinPartitions("bins", "weight")
    return rows.repartitionByRange(parts, "bins", "weight", "draw").sortWithinPartitions("bins", "weight")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal neighbours that each row is in."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        unlike = c[1:] != c[:-1]
        new[1:] |= unlike.any(axis=1) if unlike.ndim > 1 else unlike
    return np.cumsum(new)


def _cells(rows: DataFrame, count: int, blocks: list[int], low: float, scale: float) -> RDD:
    """Blocks of cells (equal bins and weight) with the draws, targets and places of their rows.

    A row's place is its cell and the first of ``blocks`` that has it; rows that no head learns
    from are left out.  Targets are whole numbers above the lowest one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            bins = matrix(batch.column("bins"), np.int16)
            draw, y, weight, block = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("draw", "y", "weight", "block")
            )
            of = np.searchsorted(blocks, block)
            use = of < len(blocks)
            bins, draw, y, weight, of = (c[use] for c in (bins, draw, y, weight, of))
            if not len(y):
                continue
            cell = _runs(bins, weight)
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            found = {
                "bins": bins[first], "weight": weight[first], "blocks": len(blocks), "draw": draw,
                "place": (cell * len(blocks) + of).astype(np.int32), "target": np.rint((y - low) * weight * scale),
            }
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["block"])

    packed_rows = _by_bins(rows, count).mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    return packed_rows.persist(StorageLevel.MEMORY_AND_DISK)


def _scored(rows: DataFrame, count: int, base: np.ndarray, rounds: list[list[Tree]]) -> DataFrame:
    """The rows with the margins of all trees, one a head; rows of equal bins go through the trees once."""
    names, kinds = rows.columns, ", ".join(f"{n} {kind}" for n, kind in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = matrix(batch.column("bins"), np.int16)
            if not len(bins):
                continue
            cell = _runs(bins)
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            margins = _add_trees(bins[first], np.tile(base, (len(first), 1)), rounds)[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, listed(margins, pa.float64())], names=[*names, "margins"])

    return _by_bins(rows, count).mapInArrow(run, f"{kinds}, margins array<double>")


def _choice(features: list[int], rules: Rules, scale: float):
    gain = newton_gain(rules, scale)
    return lambda sums: best_cut(sums, features, gain, SUMS, "n")


def _drawn_features(n: int, rules: Rules, at: int) -> list[int]:
    take = max(1, int(n * rules.column_share))
    if take == n:
        return list(range(n))
    return sorted(np.random.default_rng([rules.seed, at]).choice(n, take, replace=False).tolist())


def _grow(tree: Tree, head: Head, node: int, sums, best, rules: Rules, scale: float, gains: np.ndarray) -> bool:
    """Settle a node: its value, and its split with the values of both sides."""
    g, h, _ = sums.tolist()
    tree.value[node] = _leaf(g, h, head.rate, rules, scale)
    if best is None:
        return False
    feature, cut, gain, left = best
    left_g, left_h, _ = left.tolist()
    tree.feature[node], tree.cut[node] = feature, cut
    gains[feature] += gain
    tree.value[2 * node] = _leaf(left_g, left_h, head.rate, rules, scale)
    tree.value[2 * node + 1] = _leaf(g - left_g, h - left_h, head.rate, rules, scale)
    return True


def root_cells(df: DataFrame, target: str, key: list[str], rules: Rules) -> DataFrame:
    """(feature, bin, g, h, n): what the first split of a boosted value is chosen from."""
    edges = bin_edges(df, rules.bins)
    held = training_rows(
        df, edges, {"y": F.col(target).cast("double"), "weight": F.lit(1.0), "block": F.lit(0)}, key, rules.seed, "cells"
    )
    n, mean, low, high = held.rows.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y")).first()
    scale = 2.0 ** (_exact_bits(n) - math.ceil(math.log2(4 * max(high - low, 1.0))))
    kept = packed(counted(held.rows.drop("draw")), n)
    span = max(map(len, edges)) + 1
    add_up = _level([Head(1, 1.0)], rules, [Tree.empty(1)], 0, [0], list(range(len(edges))), span)
    now = kept.map(_round(rules, scale, np.array([mean]), [], [0], [0]))
    ((_, sums),) = settled(now, add_up, lambda s: s, len(SUMS) * len(edges) * span, 1)
    kept.unpersist()
    held.drop()
    found = [
        (int(f), int(b), float(sums[0, f, b]) / scale, float(sums[1, f, b]) / scale, int(sums[2, f, b]))
        for f, b in np.argwhere(sums[-1])  # variables times bins
    ]
    return df.sparkSession.createDataFrame(found, "feature int, bin int, g double, h double, n long")


@dataclass
class HistogramRegressor(Settable):
    """Squared error on binned rows, with draws of rows and of each tree's variables."""

    target: str
    key: list[str] = field(default_factory=list)
    maxIter: int = 160
    maxDepth: int = 4
    stepSize: float = 0.08
    subsamplingRate: float = 0.85
    columnRate: float = 0.85
    seed: int = 42

    def rules(self) -> Rules:
        return Rules(self.maxIter, row_share=self.subsamplingRate, column_share=self.columnRate, seed=self.seed)

    def fit(self, df: DataFrame) -> TreeModel:
        found = boost(
            df, F.col(self.target), [Head(self.maxDepth, self.stepSize)], self.rules(), self.key or [FEATURES, self.target]
        )
        found.rows.drop()
        return TreeModel(found.edges, found.base, found.rounds, found.gains)


@dataclass
class SoftmaxClassifier(Settable):
    """K trees a round on one softmax, so the classes' scores compete.

    ``newton`` is the regularised second-order form; without it leaves are those of gradient
    boosting on the multinomial deviance: no penalty, and (K - 1) / K of the step.
    """

    label: str
    weight: str
    classes: int
    key: list[str] = field(default_factory=list)
    maxIter: int = 140
    maxDepth: int = 4
    stepSize: float = 0.08
    newton: bool = True
    seed: int = 42

    def rules(self) -> Rules:
        if self.newton:
            return Rules(self.maxIter, softmax=True, curvature=2.0, seed=self.seed)
        return Rules(
            self.maxIter, penalty=0.0, least_weight=0.0, softmax=True, step=(self.classes - 1) / self.classes, seed=self.seed
        )

    def fit(self, df: DataFrame) -> TreeModel:
        heads = [Head(self.maxDepth, self.stepSize) for _ in range(self.classes)]
        found = boost(
            df, F.col(self.label), heads, self.rules(), self.key or [FEATURES, self.label], F.col(self.weight)
        )
        found.rows.drop()
        return TreeModel(found.edges, found.base, found.rounds, found.gains, classes=True)


def grid_errors(
    df: DataFrame, target: str, key: list[str], block: Column, settings: list[dict], folds: int, rounds: int, seed: int
) -> list[dict]:
    """Mean absolute error of every setting on the fold after each of its blocks, and their mean.

    All settings and folds grow together: one aggregate a level for the whole grid.  Bins are
    those of all rows.
    """
    heads = [Head(s["maxDepth"], s["stepSize"], f) for s in settings for f in range(folds)]
    rules = Rules(rounds, row_share=0.85, column_share=0.85, seed=seed)
    found = boost(df, F.col(target), heads, rules, key, block=block)
    errors = found.rows.rows.agg(*[
        F.avg(F.when(F.col("block") == head.last_block + 1, F.abs(F.col("y") - F.col("margins")[k]))).alias(f"e{k}")
        for k, head in enumerate(heads)
    ]).first()
    found.rows.drop()
    return [
        {**s, "mae_cv": sum(errors[f"e{i * folds + f}"] for f in range(folds)) / folds} for i, s in enumerate(settings)
    ]
