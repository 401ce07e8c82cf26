"""Session helpers: shared scratch space that is given back, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when it was counted below this many rows, or when its
# row count is fixed by construction (one row per variable, split or class).
BROADCAST_ROWS = 200_000

# Paths handed out inside the open scopes, innermost last.
_SCOPES: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is named, a folder in the session's warehouse: on a cluster one of the two
    must be on storage that every executor reaches.  No machine's own temporary folder is
    ever used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    root = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; deleted when the scope it was made in ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside once nothing reads them any more.

    For code that returns plain values: a table that is still to be read must not outlive
    its scope.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        drop_paths(spark, _SCOPES.pop())


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


class Cached:
    """A result that keeps a cached table: given back by ``release`` or at the end of a ``with``."""

    cached: DataFrame

    def release(self) -> None:
        self.cached.unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *failure) -> None:
        self.release()


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise a table as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: written once, it survives executor loss and can be deleted."""
    return written(df, "step")


def frozen(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A result table of a few rows, computed once and kept as literal rows.

    For tables with a row per model, variable or bin; a larger one is refused.
    """
    held = df.limit(rows + 1).collect()
    if len(held) > rows:
        raise ValueError(f"more than {rows} rows: not a small result table")
    return df.sparkSession.createDataFrame(held, df.schema)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cached copy for iterative fits.

    It keeps the partitions that the scan makes of the table's bytes: a small table is few
    tasks a round, and independent fits share the cores.  Row subsampling depends on the
    partitions, so name their number where a fit must be the same on another cluster.
    """
    held = (df.repartition(partitions) if partitions else df).persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; larger sides keep the shuffle join.

    The side is written once, so counting it does not compute it twice.
    """
    df = written(df, "side")
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
