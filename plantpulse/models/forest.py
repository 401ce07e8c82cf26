"""Random forests on binned rows: of classes, weighted in each tree's own bootstrap, and of a value.

A row's count in a tree is a Poisson draw from the hash of its key, so the bootstrap is the
same wherever the row lies.  All trees of a group grow one level at a time in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.models.histogram import (
    CODES, FEATURES, Held, Settable, Tree, TreeModel, best_splits, bin_edges, joined, listed, matrix, node_rows,
    partial_cells, training_rows, uniform,
)

BINS = 128
# Trees that grow together: bounds the cells of one pass.
GROUP = 40
# Cumulated chances of 0, 1, 2, ... draws of a Poisson variable of mean one.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


def bootstrap(draw: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap."""
    return np.searchsorted(POISSON, uniform(draw, tree), side="right")


def node_features(seed: int, tree: int, nodes: np.ndarray, width: int, take: int) -> np.ndarray:
    """The variables that each node may split on, a row a node."""
    if take == width:
        return np.tile(np.arange(width), (len(nodes), 1))
    draw = (np.uint64(seed) << np.uint64(40)) ^ (nodes.astype(np.uint64) << np.uint64(16)) ^ np.uint64(tree)
    chance = np.stack([uniform(draw, f) for f in range(width)], axis=1)
    return np.sort(np.argsort(chance, axis=1, kind="stable")[:, :take], axis=1)


@dataclass
class BalancedForest(Settable):
    """Gini trees on Poisson bootstraps; in each tree a class weighs rows / (classes * its rows)."""

    label: str
    classes: int
    key: list[str] = field(default_factory=list)
    numTrees: int = 120
    maxDepth: int = 12
    minInstancesPerNode: int = 8
    seed: int = 42

    def fit(self, df: DataFrame) -> TreeModel:
        edges = bin_edges(df, BINS)
        held = training_rows(
            df, edges, {"y": F.col(self.label).cast("int")}, self.key or [FEATURES, self.label], self.seed, "forest"
        )
        gains = np.zeros(len(edges))
        trees: list[Tree] = []
        for first in range(0, self.numTrees, GROUP):
            trees += self._group(held, list(range(first, min(first + GROUP, self.numTrees))), edges, gains)
        held.drop()
        for tree in trees:
            tree.value /= self.numTrees
        return TreeModel(edges, np.zeros(self.classes), [[t] for t in trees], gains, classes=True)

    def _weights(self, rows: DataFrame, numbers: list[int]) -> dict[int, np.ndarray]:
        """Class weights of each tree, from the counts of its bootstrap."""
        classes = self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(numbers), classes), np.int64)
            for batch in batches:
                y, draw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "draw"))
                for i, number in enumerate(numbers):
                    total[i] += np.bincount(y, bootstrap(draw, number), classes).astype(np.int64)
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(numbers)[i].astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[i, k])],
                names=["tree", "k", "n"],
            )

        counts = {t: np.zeros(classes) for t in numbers}
        found = rows.mapInArrow(run, "tree int, k int, n long").groupBy("tree", "k").agg(F.sum("n").alias("n"))
        for r in found.collect():  # trees times classes
            counts[r["tree"]][r["k"]] = r["n"]
        return {
            t: np.where(n > 0, n.sum() / (np.count_nonzero(n) * np.maximum(n, 1)), 0.0) for t, n in counts.items()
        }

    def _group(self, held: Held, numbers: list[int], edges: list[np.ndarray], gains: np.ndarray) -> list[Tree]:
        width, take = len(edges), max(1, int(len(edges) ** 0.5))
        weights = self._weights(held.rows, numbers)
        grown = {t: Tree.empty(self.maxDepth, self.classes) for t in numbers}
        open_nodes = {t: np.array([1]) for t in numbers}
        names = [f"c{k}" for k in range(self.classes)]
        sums = [*names, "n"]
        constants = {f"w{k}": {t: weights[t][k] for t in numbers} for k in range(self.classes)}
        for level in range(self.maxDepth):
            asked = {
                t: (nodes, node_features(self.seed, t, nodes, width, take)) for t, nodes in open_nodes.items() if len(nodes)
            }
            if not asked:
                break
            add_up = _level({t: grown[t] for t in asked}, asked, level, self.classes, BINS)
            found = best_splits(
                partial_cells(held, add_up, sums), sums, _gini(names, list(constants)), "n", self.minInstancesPerNode,
                constants,
            )
            open_nodes = {t: [] for t in numbers}
            for r in found:
                open_nodes[r["tree"]] += self._settle(grown[r["tree"]], r, weights[r["tree"]], names, gains)
            open_nodes = {t: np.array(sorted(nodes)) for t, nodes in open_nodes.items()}
        return [grown[t] for t in numbers]

    def _settle(self, tree: Tree, row, weight: np.ndarray, names: list[str], gains: np.ndarray) -> list[int]:
        """Split a node if that gains anything; the sides that may be split in turn."""
        total = np.array([row[c] for c in names])
        tree.value[row["node"]] = _shares(total, weight)
        best = row["best"]
        if best is None:
            return []
        node = row["node"]
        tree.feature[node], tree.cut[node] = best["feature"], best["bin"]
        gains[best["feature"]] += best["gain"]
        left = np.array([best[f"l_{c}"] for c in names])
        further = []
        for child, counts, n in ((2 * node, left, best["l_n"]), (2 * node + 1, total - left, row["n"] - best["l_n"])):
            tree.value[child] = _shares(counts, weight)
            if np.count_nonzero(counts) > 1 and n >= 2 * self.minInstancesPerNode:
                further.append(child)
        return further


def _shares(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    mass = counts * weight
    return mass / mass.sum()


def _gini(names: list[str], constants: list[str]):
    """Fall of the Gini impurity times the node's weight."""
    def purity(side):
        mass = [side(c) * side(w) for c, w in zip(names, constants)]
        return sum(m**2 for m in mass) / np.maximum(sum(mass), 1e-300)

    return lambda left, right, total: purity(left) + purity(right) - purity(total)


def _level(trees: dict[int, Tree], asked: dict, level: int, classes: int, bins: int):
    """Bootstrap counts per class, and rows, of every cell of the open nodes of a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_of = matrix(batch.column("bins"), np.int16)
            y, draw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "draw"))
            for number, tree in trees.items():
                nodes, features = asked[number]
                count = bootstrap(draw, number)
                at = tree.nodes(bin_of, level)
                slot = np.searchsorted(nodes, at)
                slot[slot == len(nodes)] = 0
                use = np.flatnonzero((count > 0) & (nodes[slot] == at))
                if not len(use):
                    continue
                chosen, width = features[slot[use]], bin_of.shape[1]
                place = (slot[use, None] * width + chosen) * bins + bin_of[use[:, None], chosen]
                place, inverse = np.unique(place, return_inverse=True)
                inverse, each = inverse.reshape(-1), chosen.shape[1]
                found = {
                    f"c{k}": np.bincount(inverse, np.repeat(count[use] * (y[use] == k), each), len(place)).astype(np.int64)
                    for k in range(classes)
                }
                found["n"] = np.bincount(inverse, minlength=len(place))
                code = place // bins % width * CODES + place % bins
                yield node_rows(number, nodes[place // (bins * width)], code, found)

    return run


@dataclass
class MeanForest(Settable):
    """Variance trees on Poisson bootstraps, every variable allowed at every node.

    A tree sees of a row only its bins.  So rows of the same bins are counted out once for all
    trees of a group (draws and their summed target, per tree), and levels run over these
    cells: with few variables they are bounded by the bins, whatever the number of rows.
    """

    target: str
    key: list[str] = field(default_factory=list)
    numTrees: int = 120
    maxDepth: int = 12
    minInstancesPerNode: int = 8
    seed: int = 42
    bins: int = 256

    def fit(self, df: DataFrame) -> TreeModel:
        edges = bin_edges(df, self.bins)
        held = training_rows(
            df, edges, {"y": F.col(self.target).cast("double")}, self.key or [FEATURES, self.target], self.seed, "forest"
        )
        # Decimal sums are the same in any order.
        exact = F.sum(F.col("y").cast("decimal(38,12)")).cast("double") / F.count("*")
        n, base, low, high = held.rows.agg(F.count("*"), exact, F.min("y"), F.max("y")).first()
        # Whole numbers of a power of two, of which all draws add up to less than 2^52.
        bits = max(1, min(30, 50 - math.ceil(math.log2(max(2, n)))))
        scale = 2.0 ** (bits - math.ceil(math.log2(max(high - low, 1e-300))))
        if not held.few:  # rows of the same bins together, a crowded cell over several ranges
            parts = held.rows.rdd.getNumPartitions()
            held = held.replaced(held.rows.repartitionByRange(parts, "bins", "draw"), "forest")
        gains, trees = np.zeros(len(edges)), []
        for first in range(0, self.numTrees, GROUP):
            numbers = list(range(first, min(first + GROUP, self.numTrees)))
            cells = Held(counted_out(held.rows, numbers, base, scale, [len(e) + 1 for e in edges]), "cells")
            trees += self._group(cells, numbers, gains, base, scale)
            cells.drop()
        held.drop()
        for tree in trees:
            tree.value /= self.numTrees
        return TreeModel(edges, np.zeros(1), [[t] for t in trees], gains)

    def _group(self, cells: Held, numbers: list[int], gains: np.ndarray, base: float, scale: float) -> list[Tree]:
        grown = {t: Tree.empty(self.maxDepth) for t in numbers}
        own = {t: np.zeros(len(gains)) for t in numbers}
        open_nodes = {t: np.array([1]) for t in numbers}
        for level in range(self.maxDepth):
            asked = {t: nodes for t, nodes in open_nodes.items() if len(nodes)}
            if not asked:
                break
            add_up = _value_level({t: grown[t] for t in asked}, asked, numbers, level, self.bins)
            found = best_splits(
                partial_cells(cells, add_up, ["s", "n"]), ["s", "n"], _variance(scale), "n", self.minInstancesPerNode
            )
            further: dict[int, list[int]] = {t: [] for t in numbers}
            for r in found:
                further[r["tree"]] += self._settle(grown[r["tree"]], r, own[r["tree"]], base, scale)
            open_nodes = {t: np.array(sorted(nodes)) for t, nodes in further.items()}
        for of_tree in own.values():  # every tree has the same say in the importances
            if of_tree.sum() > 0:
                gains += of_tree / of_tree.sum()
        return [grown[t] for t in numbers]

    def _settle(self, tree: Tree, row, gains: np.ndarray, base: float, scale: float) -> list[int]:
        node, best = row["node"], row["best"]
        tree.value[node] = base + row["s"] / scale / row["n"]
        if best is None:
            return []
        tree.feature[node], tree.cut[node] = best["feature"], best["bin"]
        gains[best["feature"]] += best["gain"]
        sides = (2 * node, best["l_s"], best["l_n"]), (2 * node + 1, row["s"] - best["l_s"], row["n"] - best["l_n"])
        for child, s, n in sides:
            tree.value[child] = base + s / scale / n
        return [child for child, _, n in sides if n >= 2 * self.minInstancesPerNode]


def _variance(scale: float):
    """Fall of the variance times the node's rows."""
    def score(side):
        return (side("s") / scale) ** 2 / np.maximum(side("n"), 1)

    return lambda left, right, total: score(left) + score(right) - score(total)


def counted_out(rows: DataFrame, numbers: list[int], base: float, scale: float, sizes: list[int]) -> DataFrame:
    """(bins, n, s): per tree, how often a bootstrap draws rows of these bins, and their targets' sum.

    A task adds up its own rows; cells that several tasks hold need not be brought together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in joined(batches):
            bins = matrix(batch.column("bins"), np.int16)
            y, draw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "draw"))
            # Draws are made a tree at a time, and added up per cell at once.
            cell, first = _same_bins(bins, sizes)
            whole = np.rint((y - base) * scale)
            n, s = (np.zeros((len(first), len(numbers)), np.int64) for _ in range(2))
            for i, number in enumerate(numbers):
                count = bootstrap(draw, number)
                n[:, i] = np.bincount(cell, count, len(first))
                s[:, i] = np.bincount(cell, count * whole, len(first))
            found = [bins[first], n, s]
            held = found if held is None else _merged(held, found, sizes)
        if held is not None:
            bins, n, s = held
            for at in range(0, len(bins), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [listed(bins[part], pa.int16()), listed(n[part], pa.int64()), listed(s[part], pa.int64())],
                    names=["bins", "n", "s"],
                )

    return rows.mapInArrow(run, "bins array<smallint>, n array<long>, s array<long>")


def _same_bins(bins: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's cell, and a row of every cell."""
    cell, first = np.zeros(len(bins), np.int64), np.zeros(1, np.int64)
    for j, size in enumerate(sizes):
        _, first, cell = np.unique(cell * size + bins[:, j], return_index=True, return_inverse=True)
    return cell, first


def _merged(one: list[np.ndarray], other: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    bins, n, s = (np.concatenate(pair) for pair in zip(one, other))
    cell, first = _same_bins(bins, sizes)
    order = np.argsort(cell, kind="stable")
    start = np.searchsorted(cell[order], np.arange(len(first)))
    return [bins[first], np.add.reduceat(n[order], start), np.add.reduceat(s[order], start)]


def _value_level(trees: dict[int, Tree], asked: dict[int, np.ndarray], numbers: list[int], level: int, bins: int):
    """Draws and summed targets of every cell of the open nodes of a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_of = matrix(batch.column("bins"), np.int16)
            count, total = (matrix(batch.column(c), np.int64) for c in ("n", "s"))
            width = bin_of.shape[1]
            for number, tree in trees.items():
                i, nodes = numbers.index(number), asked[number]
                at = tree.nodes(bin_of, level)
                slot = np.searchsorted(nodes, at)
                slot[slot == len(nodes)] = 0
                use = np.flatnonzero((count[:, i] > 0) & (nodes[slot] == at))
                if not len(use):
                    continue
                place = ((slot[use, None] * width + np.arange(width)) * bins + bin_of[use]).ravel()
                place, inverse = np.unique(place, return_inverse=True)
                found = {
                    name: np.bincount(inverse, np.repeat(of[use, i], width), len(place)).astype(np.int64)
                    for name, of in (("s", total), ("n", count))
                }
                yield node_rows(number, nodes[place // (bins * width)], place // bins % width * CODES + place % bins, found)

    return run
