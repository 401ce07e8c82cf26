"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models over the same hash buckets are counted, one from target texts and
one from all texts.  A text's importance is the log ratio of its chances under the two; its
key adds Gumbel noise, and taking the largest keys draws texts without replacement with
chances in proportion to their importance.

Two passes over the texts, neither of which shuffles them: each task sends one count a
bucket, and scoring needs one broadcast array of the buckets' log ratios.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import Scratch, small_batches

BUCKETS = 1 << 15
SMOOTHING = 1.0
# Most target texts the target model is counted from, whatever the number of labels.
TARGET_ROWS = 50_000
SEED = 42
# Rows the driver may fetch to settle the last key, and bins of a narrowing step.
FEW, BINS = 10_000, 4096


def ngrams(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, lower-cased."""
    found = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))
    pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:]
    both = np.concatenate([h, pairs ^ np.uint64(0x5BD1E995)])
    both *= np.uint64(0x9E3779B97F4A7C15)
    return ((both >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), dtype=np.int64)
        for batch in small_batches(batches):
            for body, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
                some = np.bincount(ngrams(body, buckets), minlength=buckets)
                counts[0] += some
                if target:
                    counts[1] += some
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "target"]
        )

    return run


def log_ratios(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target chance over raw chance per bucket, from (text, target) rows."""
    counted = docs.select("text", "target").mapInArrow(_counter(buckets), "bucket long, raw long, target long")
    counts = np.full((2, buckets), smoothing)
    # At most one row a bucket, whatever the corpus.
    for row in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        counts[:, row[0]] += row[1:]
    chance = counts / counts.sum(axis=1, keepdims=True)
    return np.log(chance[1]) - np.log(chance[0])


def importance(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, log_ratio, gumbel_key) per row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in small_batches(batches):
            sums = [float(held[ngrams(body, len(held))].sum()) for body in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sums, pa.float64())], ["doc_id", "log_ratio"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, log_ratio double"
    )
    chance = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    return scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(chance)))


def kth_largest(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a finite column; None when there are fewer rows.

    Narrows an interval by counts of BINS bins until FEW rows are left in it.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        inside = df.filter((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        ).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["low"], row["high"]
        if row["n"] <= FEW and low < high:
            rest = df.filter((F.col(key) >= low) & (F.col(key) <= high)).select(key).collect()
            return sorted((r[0] for r in rest), reverse=True)[k - above - 1]
    return low


def resample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", share: float | None = None, buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS, seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, log_ratio, gumbel_key, kept.

    Target texts are those labelled 1.  ``share`` of all rows is kept, by default the share
    of 1 among the labels; rows whose key equals the last kept one's are all kept.  Null and
    empty texts have ratio 0.  Rows repeating an id draw the same noise, as do null ids.
    Null labels are ignored; without a target every text is as likely under both models and
    without labels all rows are kept.  Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    marks = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("mark"))
    good, marked = marks.agg(F.count(F.when(F.col("mark") == 1, 1)), F.count("*")).first()
    if share is None:
        share = good / marked if marked else 1.0
    target = marks.filter("mark = 1").select(F.col("doc_id").alias("_target"))
    if good > target_rows:
        drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "_target"), F.lit(good)) < target_rows
        target = target.filter(drawn)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # About target_rows ids at most: the side is bounded by that parameter.
    flagged = source.join(F.broadcast(target), F.col("doc_id") == F.col("_target"), "left")
    ratios = log_ratios(flagged.withColumn("target", F.col("_target").isNotNull()), buckets)
    if not good:
        ratios = np.zeros_like(ratios)
    scored = scratch.write(importance(source, ratios, seed), "scored")
    last = kth_largest(scored, "gumbel_key", round(share * scored.count()))
    kept = F.lit(False) if last is None else F.col("gumbel_key") >= F.lit(last)
    return scored.withColumn("kept", kept)
