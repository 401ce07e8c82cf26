"""Multiclass adaptive boosting of shallow weighted trees (SAMME, Zhu et al. 2009).

A row's weight only depends on its bins, its class and its first weight, so equal rows are
counted out once.  A round is one short job a level: the error comes from the sums of the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from plantpulse.models.catalog import BINS, FEATURES, LABEL, WEIGHT
from plantpulse.models.histogram import (
    Tree, TreeModel, best_cut, bin_edges, counted, node_sums, packed, settled, training_rows,
)

# Rounds whose factors are multiplied into the kept weights at once.
KEEP_EVERY = 8


def fit_samme(
    train: DataFrame, classes: int, rounds: int = 40, rate: float = 0.8, depth: int = 2, seed: int = 42
) -> TreeModel:
    """Each round fits a weighted Gini tree, then raises the weight of the rows it missed.

    The model is the weighted vote of the trees; the lowest class wins a tie.
    """
    edges = bin_edges(train, BINS)
    columns = {"y": F.col(LABEL).cast("int"), "weight": F.col(WEIGHT).cast("double")}
    held = training_rows(train, edges, columns, [FEATURES, LABEL], seed, "samme")
    # Decimal sums are the same in any order.
    rows, mass = held.rows.agg(F.count("*"), F.sum(F.col("weight").cast("decimal(38,12)")).cast("double")).first()
    # Weights have a mean of one, so the whole numbers of all rows add up to less than 2^53.
    scale = 2.0 ** max(1, min(30, 52 - math.ceil(math.log2(max(2, rows)))))
    share = F.col("weight") * F.lit(rows / mass)
    kept = packed(counted(held.rows.drop("draw")).withColumn("weight", share), rows)
    names = [f"c{k}" for k in range(classes)]
    features, span = list(range(len(edges))), max((len(e) for e in edges), default=0) + 1
    size = (classes + 1) * len(features) * span

    def choose(sums: np.ndarray):
        return best_cut(sums, features, _purity(names, scale), [*names, "n"], "n")

    done: list[Tree] = []
    pending: list[tuple[Tree, float, float]] = []
    gains = np.zeros(len(edges))
    for _ in range(rounds):
        tree, leaves = Tree.empty(depth, classes), {}
        now = kept.map(_reweighted(pending)).persist(StorageLevel.MEMORY_AND_DISK)
        for level in range(depth):
            found = settled(now, _level(tree, level, classes, span, scale), choose, size, 1 << level)
            for (_, node), (sums, best) in sorted(found, key=lambda f: f[0]):
                leaves[node] = sums[:-1]
                if best is not None:
                    feature, cut, gain, left = best
                    tree.feature[node], tree.cut[node] = feature, cut
                    gains[feature] += gain
                    del leaves[node]
                    leaves[2 * node], leaves[2 * node + 1] = left[:-1], (sums - left)[:-1]
            if not any(best is not None for _, (_, best) in found):
                break
        total = sum(float(of.sum()) for of in leaves.values())
        lost = sum(float(of.sum() - of.max()) for of in leaves.values())
        error = lost / total
        if error >= 1 - 1 / classes:
            now.unpersist()
            break
        alpha = rate * (math.log((1 - error) / error) + math.log(classes - 1)) if error > 0 else 1.0
        for node, of in leaves.items():
            tree.value[node, int(of.argmax())] = alpha
        done.append(tree)
        if error <= 0:
            now.unpersist()
            break
        # Rescaled to a mean of one, so weights stay in range over many rounds.
        grown = total - lost + lost * math.exp(alpha)
        step = (tree, math.exp(alpha), total / grown)
        pending.append(step)
        if len(pending) > KEEP_EVERY:  # this round's blocks have the factors of all before it
            kept.unpersist()
            kept, pending = now, [step]
        else:
            now.unpersist()
    kept.unpersist()
    held.drop()
    return TreeModel(edges, np.zeros(classes), [[tree] for tree in done], gains, classes=True)


def _reweighted(pending: list[tuple[Tree, float, float]]):
    """A block after the pending rounds: rows that a tree missed weigh more."""
    def run(block: dict) -> dict:
        weight = block["weight"]
        for tree, more, factor in pending:
            missed = tree.values(block["bins"]).argmax(axis=1) != block["y"]
            weight = weight * np.where(missed, more, 1.0) * factor
        return block | {"weight": weight}

    return run


def _level(tree: Tree, level: int, classes: int, width: int, scale: float):
    """Partial sums of one level: the weight of every class (fixed point), and rows, of every cell."""
    first = nodes = 1 << level

    def run(blocks: Iterator[dict]) -> Iterator[tuple]:
        total = 0
        for block in blocks:
            node = tree.nodes(block["bins"], level)
            use = node >= first
            bins, y, counts = block["bins"][use], block["y"][use], block["n"][use].astype(np.float64)
            weight = np.rint(block["weight"][use] * scale) * counts
            values = [*(np.where(y == k, weight, 0.0) for k in range(classes)), counts]
            total = total + node_sums(bins, node[use], first, nodes, list(range(bins.shape[1])), width, values)
        if not isinstance(total, int):
            for i in np.flatnonzero(total[-1, :, 0].any(axis=1)):
                yield (0, int(i) + first), total[:, i]

    return run


def _purity(names: list[str], scale: float):
    """Fall of the Gini impurity times the node's weight."""
    def of(side):
        mass = [side(c) / scale for c in names]
        return sum(m**2 for m in mass) / np.maximum(sum(mass), 1e-300)

    return lambda left, right, total: of(left) + of(right) - of(total)
