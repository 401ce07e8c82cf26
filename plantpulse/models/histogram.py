"""Trees grown on binned rows, many at a time: the engine of boosting and of the balanced forest.

Rows are binned once and dealt out to the cores.  For every level of all trees that grow
together, tasks add up their own rows per (tree, node, variable, bin); Spark brings the sums
of a node together in one shuffle, and a task runs along the bins of its nodes and picks
each one's best split.  The driver only gets one row a node, so what it holds is as large as
the model.

Sums are whole numbers (gradients in fixed point, bootstrap counts), and random draws are
made from a hash of the row's key.  So a fit does not depend on how rows are partitioned.
"""

from __future__ import annotations

import json
import math
import operator
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.session import drop_paths, scratch_path

FEATURES = "features"
# Sketch accuracy of the cut points where a variable has more values than bins.
ACCURACY = 10_000
# Smallest gain for which a node is split.
LEAST_GAIN = 1e-9
# Up to so many training rows are one partition: a level is then one task and no shuffle.
# More are dealt out in parts of at least so many, as long as there are cores for them.
FEW_ROWS = 8_192
# Rows of a part at most, or so.
MOST_ROWS = 1_000_000
# Rows that a task adds up at once, and nodes whose bins it runs along at once.
ADDED_ROWS, NODES_AT_ONCE = 200_000, 256
# Rows that a part of packed rows has at least, as long as there are cores for more parts.
PACKED_ROWS = 32_768
# Sums of a level that the driver adds up itself; more are added up by node in a shuffle.
DIRECT_BYTES = 32 << 20
# Cells are numbered variable * CODES + bin.
CODES = 1 << 15


@dataclass
class Tree:
    """A binary tree in heap order (root 1); ``feature`` -1 marks a leaf or an absent node."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int, outputs: int = 1) -> "Tree":
        n = 1 << (depth + 1)
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros((n, outputs)))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Where each row stands after at most ``depth`` steps."""
        at, place = np.ones(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1]
        flat, inner, own = np.ascontiguousarray(bins).ravel(), self.feature >= 0, np.arange(len(self.feature))
        # A leaf is its own left side, and no bin is above its cut.
        feature, left = np.where(inner, self.feature, 0).astype(np.int64), np.where(inner, 2 * own, own)
        cut = np.where(inner, self.cut, np.iinfo(np.int16).max).astype(np.int16)
        for _ in range(depth):
            value = flat.take(place + feature.take(at))
            at = left.take(at) + (value > cut.take(at))
        return at

    @property
    def depth(self) -> int:
        return len(self.feature).bit_length() - 2

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.depth)]


def feature_array() -> Column:
    return vector_to_array(F.col(FEATURES))


def feature_count(df: DataFrame) -> int:
    first = df.select(F.size(feature_array())).first()
    if first is None:
        raise ValueError("no rows to learn from")
    return first[0]


def bin_edges(df: DataFrame, bins: int) -> list[np.ndarray]:
    """Per variable the ascending cut points; a row's bin is the number of them below its value.

    All distinct values where there are at most ``bins``, else approximate quantiles.  One
    aggregate; a null or NaN value has bin zero.
    """
    x, width = feature_array(), feature_count(df)
    probs = [(i + 1) / bins for i in range(bins - 1)]
    values = df.select(*[x[j].alias(f"x{j}") for j in range(width)])
    values = values.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in values.columns])
    row = values.agg(
        *[F.approx_count_distinct(c, 0.02).alias(f"n_{c}") for c in values.columns],
        *[F.percentile_approx(c, probs, ACCURACY).alias(f"q_{c}") for c in values.columns],
    ).first()
    few = [c for c in values.columns if row[f"n_{c}"] <= 2 * bins]
    whole = {}
    for c in few:  # one short job for each variable of few values
        found = [r[0] for r in values.select(c).distinct().filter(F.col(c).isNotNull()).limit(bins + 1).collect()]
        if len(found) <= bins:
            whole[c] = np.sort(np.array(found, dtype=float))[:-1]
    return [
        whole[c] if c in whole else np.unique(np.array(row[f"q_{c}"] or [], dtype=float)) for c in values.columns
    ]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int16)
    for j, cuts in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j], side="left"))
    return out


def row_draw(key: list[str], seed: int) -> Column:
    """A 64-bit number per row that all draws of the row start from."""
    return F.xxhash64(F.lit(seed), *[feature_array() if c == FEATURES else F.col(c) for c in key])


def uniform(draw: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in [0, 1) of one stream, by the finaliser of a splittable generator."""
    z = draw.view(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def matrix(column: pa.ListArray, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), kind)
    )


class Held:
    """A table of training rows in the shared folder, kept in memory as well while it is used."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, label)
        df.write.parquet(self.path)
        rows = self.spark.read.schema(df.schema).parquet(self.path)
        self.few = rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS
        self.rows = (rows.coalesce(1) if self.few else rows).persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self) -> None:
        self.rows.unpersist()
        drop_paths(self.spark, [self.path])

    def replaced(self, df: DataFrame, label: str) -> "Held":
        """The table that follows this one; this one is given back once it is written."""
        following = Held(df, label)
        self.drop()
        return following


def training_rows(
    df: DataFrame, edges: list[np.ndarray], columns: dict[str, Column], key: list[str], seed: int, label: str
) -> Held:
    """Binned rows with the given columns and their draw, written once.

    They are dealt out evenly: a small file is one partition of the scan, and would keep all
    levels on one core.
    """
    source = df.select(
        feature_array().alias("x"), row_draw(key, seed).alias("draw"),
        *[c.alias(n) for n, c in columns.items()],
    )
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.count()
    source = source.repartition(max(1, min(cores, -(-rows // max(1, FEW_ROWS))), rows // MOST_ROWS))
    rest = ", ".join(f"{n} {kind}" for n, kind in source.dtypes[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(matrix(batch.column(0), np.float64), edges)
            yield pa.RecordBatch.from_arrays(
                [listed(bins, pa.int16()), *batch.columns[1:]], names=["bins", *batch.schema.names[1:]]
            )

    return Held(source.mapInArrow(run, f"bins array<smallint>, {rest}"), label)


def partial_cells(held: Held, add_up: Callable, sums: list[str]) -> DataFrame:
    """(tree, node, cells, sums...) as the tasks add them up, a node's rows together.

    ``add_up`` turns record batches into the batches of ``node_rows``; a row has a node's
    non-empty cells, and several may be of one node.
    """
    schema = "tree int, node int, cells binary, " + ", ".join(f"{s} binary" for s in sums)
    partial = held.rows.mapInArrow(lambda batches: add_up(joined(batches)), schema)
    partial = partial.coalesce(1) if held.few else partial.repartition("tree", "node")
    return partial.sortWithinPartitions("tree", "node")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, so that fewer partial sums leave a task."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= ADDED_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def node_rows(tree: int, node: np.ndarray, code: np.ndarray, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A batch with one row a node, from one tree's cells in the order of their nodes."""
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    ends = np.append(first, len(node))

    def packed(values: np.ndarray) -> pa.Array:
        offsets = (ends * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    columns = [pa.array(np.full(len(first), tree, np.int32)), pa.array(node[first].astype(np.int32))]
    columns += [packed(np.ascontiguousarray(code, np.int32))]
    columns += [packed(np.ascontiguousarray(s, np.int64)) for s in sums.values()]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "node", "cells", *sums])


def best_splits(
    partial: DataFrame, sums: list[str], gain: Callable, count: str, least_rows: int,
    constants: dict[str, dict[int, float]] | None = None,
) -> list:
    """One row a node: totals of the sums, and the split of largest gain with its left sums.

    ``gain(left, right, total)`` gets, for each side, a function from a sum's name, or that of
    a tree's constant, to its values.  Of equal gains the lowest variable and bin win; without
    a split, best is null.  The rows are partitioned by (tree, node) already, so a task adds up
    whole nodes, some at a time, and runs along their bins.
    """
    constants = constants or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in the order of their nodes.
        waiting: dict[tuple[int, int], list] = {}
        for batch in batches:
            tree, node = (batch.column(c).to_pylist() for c in ("tree", "node"))
            columns = [batch.column(c).to_pylist() for c in ("cells", *sums)]
            for key, *cells in zip(zip(tree, node), *columns):
                if key not in waiting and len(waiting) >= NODES_AT_ONCE:
                    yield _best(waiting, sums, gain, count, least_rows, constants)
                    waiting = {}
                waiting.setdefault(key, []).append(cells)
        if waiting:
            yield _best(waiting, sums, gain, count, least_rows, constants)

    schema = "tree int, node int, " + ", ".join(f"{s} long" for s in sums) + ", best struct<feature int, bin int, gain double, "
    schema += ", ".join(f"l_{s}: long" for s in sums) + ">"
    return partial.mapInArrow(run, schema).collect()


def _best(
    nodes: dict[tuple[int, int], list], sums: list[str], gain: Callable, count: str, least_rows: int,
    constants: dict[str, dict[int, float]],
) -> pa.RecordBatch:
    """The rows of ``best_splits`` for some nodes, from the packed cells of each."""
    codes = [[np.frombuffer(part[0], np.int32) for part in parts] for parts in nodes.values()]
    used = np.unique(np.concatenate([c for parts in codes for c in parts]))
    total = np.zeros((len(sums), len(nodes), len(used)), np.int64)
    for i, (parts, of_part) in enumerate(zip(nodes.values(), codes)):
        for part, code in zip(parts, of_part):
            place = np.searchsorted(used, code)
            for s in range(len(sums)):
                total[s, i, place] += np.frombuffer(part[s + 1], np.int64)
    variable = used // CODES
    start = np.flatnonzero(np.append(True, variable[1:] != variable[:-1]))
    which = np.searchsorted(start, np.arange(len(used)), side="right") - 1
    along = np.cumsum(total, axis=2)
    before = along[:, :, start] - total[:, :, start]
    left = along - before[:, :, which]
    whole = np.add.reduceat(total, start, axis=2)[:, :, which]
    at = sums.index(count)
    trees = [tree for tree, _ in nodes]
    fixed = {name: np.array([values[t] for t in trees])[:, None] for name, values in constants.items()}

    def side(values: np.ndarray) -> Callable:
        return lambda name: fixed[name] if name in fixed else values[sums.index(name)]

    # An empty cell is no cut of its own: the one before it leaves the same sides.
    allowed = (total[at] > 0) & (left[at] >= least_rows) & (whole[at] - left[at] >= least_rows)
    value = np.where(allowed, gain(side(left), side(whole - left), side(whole)), -np.inf)
    value = np.where(value > LEAST_GAIN, value, -np.inf)
    best, row = value.argmax(axis=1), np.arange(len(nodes))  # the first of equal gains
    none = np.isneginf(value[row, best])
    fields = [pa.array((used[best] // CODES).astype(np.int32)), pa.array((used[best] % CODES).astype(np.int32)), pa.array(value[row, best])]
    fields += [pa.array(left[s, row, best]) for s in range(len(sums))]
    names = ["feature", "bin", "gain", *[f"l_{s}" for s in sums]]
    chosen = pa.StructArray.from_arrays(fields, names=names, mask=pa.array(none))
    columns = [pa.array(np.array(trees, np.int32)), pa.array(np.array([n for _, n in nodes], np.int32))]
    columns += [pa.array(whole[s].max(axis=1)) for s in range(len(sums))]
    return pa.RecordBatch.from_arrays([*columns, chosen], names=["tree", "node", *sums, "best"])


def counted(rows: DataFrame) -> DataFrame:
    """One row for all that are equal, and their number ``n``: what no draw tells apart learns the same."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def packed(rows: DataFrame, count: int) -> RDD:
    """Rows as arrays by column, kept in memory: a pass over them is one short job of few objects.

    ``count`` is how many rows there are, or more.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-count // PACKED_ROWS)), count // MOST_ROWS)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            block = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names if c != "bins"}
            block["bins"] = matrix(batch.column("bins"), np.int16)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    blocks = rows.repartition(parts).mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def settled(blocks: RDD, add_up: Callable, choose: Callable, sums: int, nodes: int) -> list[tuple]:
    """((tree, node), choice) of every node that has rows, from one pass.

    ``add_up`` turns a part's blocks into pairs of (tree, node) and an array of ``sums`` whole
    numbers; ``choose`` gets a node's array.  The driver adds up the parts of at most
    ``DIRECT_BYTES``; where they may be more, a shuffle brings a node's arrays together.
    """
    parts = blocks.getNumPartitions()
    partial = blocks.mapPartitions(add_up)
    if parts * nodes * sums * 8 > DIRECT_BYTES:
        return partial.reduceByKey(operator.add, parts).mapValues(choose).collect()
    total: dict[tuple[int, int], np.ndarray] = {}
    for key, part in partial.collect():
        total[key] = total[key] + part if key in total else part
    return [(key, choose(part)) for key, part in total.items()]


def node_sums(
    bins: np.ndarray, node: np.ndarray, first: int, nodes: int, features: list[int], width: int, values: list[np.ndarray]
) -> np.ndarray:
    """Whole numbers added up by (value, node, variable, bin); nodes count from ``first``."""
    total = np.zeros((len(values), nodes, len(features), width), np.int64)
    where = (node - first) * width
    for j, f in enumerate(features):
        place = where + bins[:, f]
        for s, w in enumerate(values):
            total[s, :, j] = np.bincount(place, w, nodes * width).astype(np.int64).reshape(nodes, width)
    return total


def best_cut(total: np.ndarray, features: list[int], gain: Callable, names: list[str], count: str):
    """A node's sums, and (variable, bin, gain, left sums) of its best split, or None.

    ``total`` is (sum, variable, bin).  Of equal gains the lowest variable and bin win.
    """
    at, left = names.index(count), np.cumsum(total, axis=2)
    whole = left[:, :, -1:]

    def side(values: np.ndarray) -> Callable:
        return lambda name: values[names.index(name)]

    # An empty cell is no cut of its own: the one before it leaves the same sides.
    allowed = (total[at] > 0) & (left[at] >= 1) & (whole[at] - left[at] >= 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(allowed, gain(side(left), side(whole - left), side(whole)), -np.inf)
    value = np.where(value > LEAST_GAIN, value, -np.inf)
    j, b = divmod(int(value.argmax()), value.shape[1])  # the first of equal gains
    if np.isneginf(value[j, b]):
        return whole[:, 0, 0], None
    return whole[:, 0, 0], (features[j], b, float(value[j, b]), left[:, j, b])


@dataclass
class TreeModel:
    """Sums of trees per output over raw variables; one output predicts, several are classes.

    ``rounds`` holds, per round, one tree for each output or a single one for all of them.
    """

    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]]
    gains: np.ndarray
    classes: bool = False

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.tile(self.base, (len(x), 1))
        for trees in self.rounds:
            if len(trees) == 1:
                out += trees[0].values(bins)
            else:
                for k, tree in enumerate(trees):
                    out[:, k] += tree.values(bins)[:, 0]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        found = self.margins(x)
        return found.argmax(axis=1).astype(np.float64) if self.classes else found[:, 0]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: the value, or the class of the largest sum (the lowest on a tie)."""
        model = self

        @F.pandas_udf("double")
        def prediction(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return df.withColumn("prediction", prediction(feature_array()))

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the variables in the gain of all splits."""
        total = self.gains.sum()
        return Vectors.dense(self.gains / total if total else self.gains)

    def to_json(self) -> str:
        trees = [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees] for trees in self.rounds]
        return json.dumps([[e.tolist() for e in self.edges], self.base.tolist(), trees, self.gains.tolist(), self.classes])

    @staticmethod
    def from_json(text: str) -> "TreeModel":
        edges, base, rounds, gains, classes = json.loads(text)
        return TreeModel(
            [np.array(e, dtype=float) for e in edges], np.array(base),
            [[Tree(np.array(f, np.int16), np.array(c, np.int16), np.array(v)) for f, c, v in trees] for trees in rounds],
            np.array(gains), classes,
        )


class Settable:
    """Estimators whose fields can be set by name, like the library's other ones."""

    def setParams(self, **params):
        for name, value in params.items():
            if name not in self.__dataclass_fields__:
                raise ValueError(f"no parameter {name}")
            setattr(self, name, value)
        return self


def fixed_point_bits(rows: int) -> int:
    """Bits of a fixed-point number of which ``rows`` add up to less than 2^62."""
    return max(1, min(30, 62 - math.ceil(math.log2(max(2, rows)))))
