"""Product codes of vectors, their codebooks trained by k-means with LAESA pivots.

Vectors are whole numbers, cut into equal parts; every part position has its own codebook.
LAESA (linear approximating and eliminating search) keeps a few fixed pivots per part
position.  The distance of every part to every pivot is computed once and written with the
vectors.  A round only computes the distances between pivots and its few entries; by the
triangle inequality the largest difference |d(part, pivot) - d(pivot, entry)| bounds
d(part, entry) from below.  Entries are tried in the order of that bound with exact integer
distances, until the bound passes the best distance found.

Spark holds the vectors and adds the sums of a round; a codebook has ``entries`` rows a part,
whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plantpulse.llm.common import Scratch, attach_groups, free_name
from plantpulse.llm.vectors import LIMIT, listed, whole_matrix, whole_vectors

PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
# Parts whose bounds are held at once, and candidates evaluated before the bound is read again.
ROWS, STEP = 512, 16
# What a bound in float32 may be off: three roundings of the largest distance, and one of a root.
SLACK, ROOT_SLACK = 4 * 2.0**-24, 1e-4
# Sums of squares below this are exact in float64.
EXACT = 1 << 53


def compress(
    rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> DataFrame:
    """The usable rows of ``rows`` and a struct ``coded`` of code, error, label_error and codebooks.

    Usable vectors and their whole-number form are those of ``vectors.whole_vectors``.  Each
    part position's codebook starts as that part of the ``entries`` rows with the smallest
    keys (null keys last, equal keys by their vectors); a smaller table has that many entries.
    Every round assigns each part to its nearest entry (squared Euclidean distance, ties to
    the lower index) and replaces entries by the floored means of their parts; unused entries
    stay.  ``code`` names the final nearest entries, two hex digits each in part order;
    ``error`` is the sum of the squared distances, ``label_error`` the errors' sum over rows
    of an equal label (nulls together), ``codebooks`` the final entries as decimal integers
    by part, entry and position, joined by commas.

    Repeated rows and keys are coded each.  An empty table gives an empty one.  A vector
    length that ``parts`` does not divide is refused.  Where a column is named ``coded``, the
    struct's name is lengthened by underscores.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    scratch = Scratch(rows.sparkSession, "pivot-codes")
    out, whole, near = (free_name(rows, c) for c in ("coded", "whole_parts", "pivot_distances"))
    shape = "struct<code: string, error: bigint, label_error: bigint, codebooks: string>"
    kept = whole_vectors(rows, vector, whole)
    start = kept.orderBy(F.col(key).asc_nulls_last(), whole).select(whole).limit(entries).collect()
    if not start:
        return rows.filter(F.lit(False)).withColumn(out, F.lit(None).cast(shape))
    book = np.array([r[0] for r in start], np.int64)
    if book.shape[1] % parts:
        raise ValueError(f"{parts} equal parts of {book.shape[1]} components")
    if book.size and np.abs(book).max() > LIMIT:
        raise ValueError(f"a scaled component beyond {LIMIT}: exact sums need smaller vectors")
    book = book.reshape(len(book), parts, -1).transpose(1, 0, 2)
    fixed = np.stack([chosen_pivots(b, pivots) for b in book])

    held = scratch.write(_with_pivot_distances(kept, whole, near, fixed), "parts")
    for _ in range(rounds):
        book = _moved(held, whole, near, fixed, book)
    final = scratch.write(_assigned(held, whole, near, fixed, book, out), "codes")

    group = free_name(final, "label_key")
    keyed = final.withColumn(group, F.when(F.col(label).isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), F.col(label).cast("string"))
    ))
    added, size = free_name(keyed, "label_sum"), free_name(keyed, "label_rows")
    sums = scratch.write(keyed.groupBy(group).agg(
        F.sum(f"{out}.error").alias(added), F.count("*").alias(size)
    ), "labels")
    total = final.count()
    # Rows of hot labels are spread by a number of their own; keys may be null or repeat.
    spread = free_name(keyed, "row_number")
    met = attach_groups(
        keyed.withColumn(spread, F.monotonically_increasing_id()), sums, group, size, total, spread
    )
    text = ",".join(map(str, book.ravel().tolist()))
    coded = F.struct(
        F.col(f"{out}.code").alias("code"), F.col(f"{out}.error").alias("error"),
        F.col(added).alias("label_error"), F.lit(text).alias("codebooks"),
    )
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], coded.alias(out))


def codebooks_digest(codebooks) -> str:
    return hashlib.sha256(codebooks.encode()).hexdigest()


def chosen_pivots(points: np.ndarray, wanted: int) -> np.ndarray:
    """Rows far from one another: each next one has the largest sum of distances to those before."""
    picked, far = [0], np.zeros(len(points))
    while len(picked) < min(wanted, len(points)):
        far = far + distances(points, points[picked[-1:]])[:, 0]
        left = far.copy()
        left[picked] = -1.0
        picked.append(int(left.argmax()))
    return points[picked]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two whole-number matrices."""
    out = np.empty((len(a), len(b)))
    for at in range(0, len(a), ROWS):
        gap = a[at:at + ROWS, None, :] - b[None, :, :]
        out[at:at + ROWS] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap).astype(np.float64))
    return out


def nearest(parts: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray):
    """Index and squared distance of each part's nearest entry, and how many were evaluated."""
    from_pivots = distances(pivots, entries)
    slack = ROOT_SLACK + SLACK * max(from_pivots.max(initial=0), to_pivots.max(initial=0))
    from_pivots = from_pivots.astype(np.float32)
    reach = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach**2 * parts.shape[1] < EXACT:
        parts, entries = parts.astype(np.float64), entries.astype(np.float64)
    index = np.zeros(len(parts), np.int64)
    error = np.zeros(len(parts), np.int64)
    tried = 0
    for at in range(0, len(parts), ROWS):
        rows, near = parts[at:at + ROWS], to_pivots[at:at + ROWS].astype(np.float32)
        bound = np.zeros((len(rows), len(entries)), np.float32)
        for p in range(len(pivots)):
            np.maximum(bound, np.abs(near[:, p, None] - from_pivots[p]), out=bound)
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, axis=1)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        found = np.full(len(rows), len(entries), np.int64)
        live = np.arange(len(rows))
        for first in range(0, len(entries), STEP):
            # An entry whose bound equals the best distance may tie with a lower index.
            live = live[bound[live, first] <= np.sqrt(best[live]) + slack]
            if not len(live):
                break
            picked = order[live, first:first + STEP]
            gap = rows[live, None, :] - entries[picked]
            exact = np.einsum("ijk,ijk->ij", gap, gap).astype(np.int64)
            tried += exact.size
            low = exact.min(axis=1)
            who = np.where(exact == low[:, None], picked, len(entries)).min(axis=1)
            better = (low < best[live]) | ((low == best[live]) & (who < found[live]))
            best[live[better]], found[live[better]] = low[better], who[better]
        index[at:at + ROWS], error[at:at + ROWS] = found, best
    return index, error, tried


def _with_pivot_distances(kept: DataFrame, whole: str, near: str, fixed: np.ndarray) -> DataFrame:
    schema = T.StructType([*kept.schema.fields, T.StructField(near, T.ArrayType(T.DoubleType()))])
    place = kept.columns.index(whole)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = _cut(batch.column(place), len(fixed))
            far = np.concatenate([distances(cut[:, p], fixed[p]) for p in range(len(fixed))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, listed(far, pa.float64())], names=[*batch.schema.names, near]
            )

    return kept.mapInArrow(measure, schema)


def _cut(column: pa.ListArray, parts: int) -> np.ndarray:
    matrix = whole_matrix(column)
    return matrix.reshape(len(matrix), parts, -1)


def _searched(batch: pa.RecordBatch, whole: int, near: int, fixed: np.ndarray, book: np.ndarray):
    """Every part of a batch, with the index and squared distance of its nearest entry."""
    cut = _cut(batch.column(whole), len(book))
    far = batch.column(near).flatten().to_numpy(zero_copy_only=False).reshape(len(cut), len(book), -1)
    for p in range(len(book)):
        index, error, _ = nearest(cut[:, p], far[:, p], fixed[p], book[p])
        yield cut[:, p], index, error


def _moved(held: DataFrame, whole: str, near: str, fixed: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The codebooks after one round; tasks add up their own rows before anything is shuffled."""
    parts, entries, width = book.shape
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
        T.StructField("n", T.LongType()), *[T.StructField(f"s{k}", T.LongType()) for k in range(width)],
    ])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for p, (rows, index, _) in enumerate(_searched(batch, 0, 1, fixed, book)):
                np.add.at(sums[p], index, rows)
                counts[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    added = held.select(whole, near).mapInArrow(add_up, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]
    )
    book = book.copy()
    for r in added.collect():
        book[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return book


def _assigned(
    held: DataFrame, whole: str, near: str, fixed: np.ndarray, book: np.ndarray, out: str
) -> DataFrame:
    names = [c for c in held.columns if c not in (whole, near)]
    given = held.select(*[F.col(f"`{c}`") for c in names], whole, near)
    coded = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    schema = T.StructType([*[given.schema[c] for c in names], T.StructField(out, coded)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_searched(batch, len(names), len(names) + 1, fixed, book))
            index = np.stack([f[1] for f in found], axis=1).astype(np.uint8)
            error = sum(f[2] for f in found)
            struct = pa.StructArray.from_arrays(
                [pa.array([row.tobytes().hex() for row in index], pa.string()), pa.array(error, pa.int64())],
                names=["code", "error"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], struct], names=schema.names)

    return given.mapInArrow(assign, schema)
