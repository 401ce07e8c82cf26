"""What the operators share: scratch tables, ASCII case folding, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.session import scratch_path

# White space of the line and word contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
# Keys holding more than one row in HOT_SHARE are hot; there are fewer than HOT_SHARE of
# them whatever the size of the table, so their group rows may be broadcast.
HOT_SHARE = 1000


# Bytes of a record batch that Python code unpacks at once; one longer row is a batch alone.
BATCH_BYTES = 4 << 20


class Scratch:
    """Parquet tables of one run in the folder every executor can reach.

    A lost executor costs the tasks it was running: what is written here is read again
    from the shared folder, not recomputed.  Inside a ``session.scratch_scope`` the folder
    goes with the scope.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(
        self, df: DataFrame, name: str, partition_by: str | None = None, append: bool = False
    ) -> DataFrame:
        """Write a table and read it back; the partition column comes last."""
        writer = df.write.mode("append" if append else "errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            place = jvm.org.apache.hadoop.fs.Path(self.path(name))
            place.getFileSystem(conf).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def attach_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, row_id: str
) -> DataFrame:
    """Left-join one group row per key to many rows of which any key may hold a third.

    Groups with more than ``total / HOT_SHARE`` rows, fewer than HOT_SHARE of them, are
    broadcast.  Rows so served enter the shuffle join under a key of their own, which
    spreads them over all partitions; the others meet their group there.
    """
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * HOT_SHARE > total).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot")
    )
    rest = groups.filter(F.col(size) * HOT_SHARE <= total).select(
        F.struct(F.col(key).alias("k"), F.lit(None).cast("long").alias("r")).alias("_cold_key"),
        F.struct(*values).alias("_cold"),
    )
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    own = F.struct(
        F.when(F.col("_hot").isNull(), F.col(key)).alias("k"),
        F.when(F.col("_hot").isNotNull(), F.col(row_id)).alias("r"),
    )
    both = met.withColumn("_own_key", own).join(rest, F.col("_own_key").eqNullSafe(F.col("_cold_key")), "left")
    return both.select(
        *rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values]
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES, so long texts do not add up."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * min(1.0, BATCH_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
