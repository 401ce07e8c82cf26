"""Structured Streaming jobs: score, count, de-duplicate, watch drift, resample, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.operators.drift import binned_counts, psi_from_counts
from plantpulse.plans.scoring import score_records, service_counters, validate_records
from plantpulse.session import scratch_path
from plantpulse.sources.bundle import ScoringBundle


def file_stream(
    spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def resample(df: DataFrame, time: str, step: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """Tumbling grid: one row per key and step, for tables and for streams alike."""
    slot = F.window(F.col(time), step)
    grid = df.groupBy(*keys, slot.alias("_w")).agg(*measures)
    return grid.select(F.col("_w.start").alias("Time"), *[c for c in grid.columns if c != "_w"])


def scored_stream(
    records: DataFrame, bundle: ScoringBundle, fields: dict, observed: tuple, keep: list[str]
) -> DataFrame:
    """Valid records through the batch scoring transform, row by row."""
    accepted, _ = validate_records(records, fields, observed)
    return score_records(accepted, bundle, fields, observed[0], keep)


def quarantined_stream(records: DataFrame, fields: dict, observed: tuple) -> DataFrame:
    """The records that ``scored_stream`` leaves out, with their ``reject_reason``."""
    _, rejected = validate_records(records, fields, observed)
    return rejected


def windowed_counters(
    scored: DataFrame, time: str, width: str = "1 hour", delay: str = "2 hours"
) -> DataFrame:
    """Predictions and anomalies per event-time window; rows behind the watermark are dropped."""
    by_window = service_counters(
        scored.withWatermark(time, delay), [F.window(F.col(time), width).alias("_w")]
    )
    return by_window.select(F.col("_w.start").alias("inicio"), "predicciones", "anomalias")


def first_per_key(
    stream: DataFrame, keys: list[str], time: str, order: str, delay: str = "2 hours"
) -> DataFrame:
    """The row with the smallest ``order`` per key; ``time`` is one of the keys.

    A key is final, and its state dropped, once the watermark has passed its time.
    """
    rest = [c for c in stream.columns if c not in keys]
    first = stream.withWatermark(time, delay).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    )
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str = "2 hours") -> DataFrame:
    """The first row of each key to arrive, passed on at once.

    A key is forgotten when the watermark is ``delay`` past its time; of rows that arrive in
    one batch any may be the first.  ``first_per_key`` waits and picks by an order instead.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_bins(
    stream: DataFrame, time: str, features: list[str], cuts: DataFrame, width: str = "1 day",
    delay: str = "1 day",
) -> DataFrame:
    """Rows per window, feature and frozen reference bin."""
    current = stream.withWatermark(time, delay)
    values = current.select(F.window(F.col(time), width).alias("_w"), *features)
    return binned_counts(values, features, cuts, F.lit(False), ["_w"])


def windowed_drift(
    window_bins: DataFrame, reference_bins: DataFrame, cuts: DataFrame, bins: int = 10
) -> DataFrame:
    """(inicio, variable, psi, banda): each window of counts against the reference counts.

    Both sides hold one row per bin, so this is small whatever the stream carried.
    """
    windows = window_bins.select("_w", "variable", "bin", "cur")
    frame = windows.select("_w", "variable").distinct()
    reference = frame.join(F.broadcast(reference_bins.select("variable", "bin", "ref")), "variable")
    both = windows.withColumn("ref", F.lit(0).cast("long")).unionByName(
        reference.withColumn("cur", F.lit(0).cast("long"))
    )
    counts = both.groupBy("_w", "variable", "bin").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    scored = psi_from_counts(counts, cuts, bins, ["_w"])
    return scored.select(F.col("_w.start").alias("inicio"), "variable", "psi", "banda")


def drain_append(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available, into Parquet files, and read them back.

    Aggregates come out when the watermark passes them; what it has not passed stays in the
    state and is not in the result.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = start_append(stream, out, scratch_path(spark, f"{label}-state"), available_now=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_append(stream: DataFrame, out: str, state: str, available_now: bool = False) -> StreamingQuery:
    """Start a stream into Parquet files; its state is kept outside the heap, in RocksDB.

    A store that the session names itself is left as it is.
    """
    conf = stream.sparkSession.conf
    if "RocksDB" not in (conf.get(STORE, None) or ""):
        conf.set(STORE, ROCKS)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)
