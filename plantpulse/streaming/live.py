"""What a running stream reports as it goes: counters of each batch, drift after each batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from plantpulse.operators.drift import binned_counts
from plantpulse.streaming.jobs import windowed_drift

COUNTERS = "contadores"


def counted(scored: DataFrame, name: str = COUNTERS) -> DataFrame:
    """The same rows, counted on their way: predictions, and anomalies (unknown is none)."""
    return scored.observe(
        name, F.count(F.lit(1)).alias("predicciones"),
        F.count_if(F.coalesce(F.col("anomalia"), F.lit(False))).alias("anomalias"),
    )


class BatchCounters(StreamingQueryListener):
    """Counters of every micro-batch of the queries that carry the observation, as they end.

    A batch that is run again reports under its own number, so it counts once.
    """

    def __init__(self, name: str = COUNTERS):
        self.name = name
        self.batches: dict[tuple[str, int], dict] = {}
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            with self._change:
                self.batches[str(event.progress.id), event.progress.batchId] = seen.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.id))
            self._change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the end of the query has been reported: its batches come before that."""
        query.awaitTermination()
        with self._change:
            if not self._change.wait_for(lambda: str(query.id) in self._ended, seconds):
                raise TimeoutError("the end of the query was not reported")

    def totals(self) -> dict:
        with self._change:
            rows = list(self.batches.values())
        return {c: sum(r[c] for r in rows) for c in ("predicciones", "anomalias")}


class DriftSink:
    """``foreachBatch`` sink: stability of every window seen so far, after every batch.

    Each batch's rows are counted per window, variable and frozen reference bin, and written
    under the batch's number; the index is then computed from all counts up to that batch.
    Both replace what an earlier attempt of the batch wrote, so running it again changes
    nothing.  What is kept is a row a window, bin and batch.
    """

    def __init__(
        self, out: str, time: str, features: list[str], cuts: DataFrame, reference: DataFrame, width: str = "1 day",
        bins: int = 10,
    ):
        self.out, self.time, self.features = out.rstrip("/"), time, features
        self.cuts, self.reference, self.width, self.bins = cuts, reference, width, bins

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        windows = batch.select(F.window(F.col(self.time), self.width).alias("_w"), *self.features)
        counts = binned_counts(windows, self.features, self.cuts, F.lit(False), ["_w"])
        counts.select("_w", "variable", "bin", "cur").write.mode("overwrite").parquet(f"{self.out}/counts/batch={number}")
        seen = spark.read.option("basePath", f"{self.out}/counts").parquet(f"{self.out}/counts")
        total = seen.filter(F.col("batch") <= number).groupBy("_w", "variable", "bin").agg(F.sum("cur").alias("cur"))
        drift = windowed_drift(total, self.reference, self.cuts, self.bins)
        drift.write.mode("overwrite").parquet(f"{self.out}/psi/batch={number}")

    def start(self, stream: DataFrame, state: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", state)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def latest(self, spark: SparkSession) -> DataFrame:
        """(inicio, variable, psi, banda) after the last batch that is written."""
        every = spark.read.option("basePath", f"{self.out}/psi").parquet(f"{self.out}/psi")
        last = every.agg(F.max("batch")).first()[0]
        return every.filter(F.col("batch") == last).drop("batch")
