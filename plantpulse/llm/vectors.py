"""Embeddings as whole numbers: which vectors are usable, and their scaled components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Scaled components beyond this are refused: sums of their squares would leave 64 bits.
LIMIT = 1 << 24
SCALE = 1024


def whole_vectors(rows: DataFrame, vector: str = "embedding", out: str = "whole") -> DataFrame:
    """Rows with ``out``, the vector's components as floor(1024 * x), an array of longs.

    Rows whose vector is null, or holds a null or non-finite component, are left out.  All
    vectors must be of one length; where lengths differ, the most frequent one is kept (of
    equally frequent ones the longest) and the others are left out like broken ones.  A
    component beyond 2^24 after scaling fails the job in ``whole_matrix``.
    """
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    kept = rows.filter(F.col(vector).isNotNull() & finite)
    lengths = kept.groupBy(F.size(vector).alias("length")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if first is None:
        return kept.withColumn(out, F.lit(None).cast("array<bigint>"))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return kept.filter(F.size(vector) == first["length"]).withColumn(out, scaled)


def whole_matrix(column: pa.ListArray) -> np.ndarray:
    """A batch's vectors as a matrix of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if flat.size and max(int(flat.max()), -int(flat.min())) > LIMIT:
        raise ValueError(f"a scaled component beyond {LIMIT}: exact sums need smaller vectors")
    return flat.reshape(len(column), -1)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind)
    )
