"""Line de-duplication over levelled sorted runs of line keys; DataFrame functions only.

Documents come in batches of ascending ids.  A batch's distinct line keys are merge-anti-
joined with every run: keys found there were held by an earlier document, the rest become
a new run at level 0.  When a level holds ``fanout`` runs they are merged into one run of
the next level, so with b batches a key is rewritten log(b) times and a batch reads at most
``fanout`` runs a level.  Runs are bucketed and sorted by key: the joins shuffle the
batch's keys once and no run at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.llm.common import BLANKS, Scratch, ascii_lower, attach_groups, free_name

MIN_KEY = 10
BATCHES = 4
FANOUT = 2


class LineRuns:
    """Runs of 16-byte line keys: bucketed tables whose files lie in the shared scratch folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.scratch = Scratch(spark, "line-runs")
        self.made: set[str] = set()
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def table(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        spread = df.repartition(self.buckets, "key")
        self.made.add(name)
        writer = spread.write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)
        self.made.discard(name)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose key is in no run."""
        for run in [name for level in self.levels for name in level]:
            keys = keys.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
        return keys

    def add(self, run: str) -> None:
        """Take a table of new keys as a run of level 0 and merge the levels that are full."""
        level = 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0]).select("key")
            for name in full[1:]:
                merged = merged.unionAll(self.spark.table(name).select("key"))
            run = self.table(merged)
            for name in full:
                self.drop(name)
            level += 1

    def clear(self) -> None:
        """Drop every table that was made, also after a failure."""
        for name in list(self.made):
            self.drop(name)
        self.scratch.drop("")
        self.levels = []


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "lines",
    batches: int = BATCHES, fanout: int = FANOUT, min_key: int = MIN_KEY,
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_lines, n_dropped, kept (the remaining text).

    A text is split at newlines; null and empty texts are one empty line.  A line's key is
    the line without blanks at its ends and with A-Z lower-cased.  Keys of at least
    ``min_key`` code points held by two ids (whole numbers) lose all lines except those of the smallest id.
    Rows sharing an id count as one holder, whether or not their texts differ.  Rows with a
    null id neither lose lines nor make others lose any.  All other columns are kept as they
    are; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    drops = _drops(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                   scratch, batches, fanout, min_key)
    lines, drop = free_name(docs, "_lines"), free_name(docs, "_drop")
    drops = drops.select(F.struct(*drops.columns).alias(drop))
    keys = [F.col(doc_id) == F.col(f"{drop}.doc_id"), F.xxhash64(text) == F.col(f"{drop}.text_key")]
    joined = docs.join(drops, keys, "left").withColumn(
        lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    )
    dropped = F.coalesce(F.col(f"{drop}.at"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    report = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
    return joined.select(*[docs[c] for c in docs.columns], report.alias(out))


def _drops(docs: DataFrame, scratch: Scratch, batches: int, fanout: int, min_key: int) -> DataFrame:
    """(doc_id, text_key, at): the places of the lines that go, one row per text that loses any."""
    spark = docs.sparkSession
    held = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    cuts = held.select(
        F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)], 10_000)
    ).first()[0] or []
    batch = sum([(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0))
    key = ascii_lower(F.trim(F.col("line"), F.lit(BLANKS)))
    lines = (
        held.select("doc_id", F.xxhash64("text").alias("text_key"), batch.alias("batch"),
                    F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .withColumn("line", key).filter(F.char_length("line") >= min_key)
        .select("doc_id", "text_key", "at", F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("key"),
                F.monotonically_increasing_id().alias("row"), "batch")
    )
    lines = scratch.write(lines, "lines", "batch")
    runs = LineRuns(spark, fanout)
    marked = None
    try:
        for b in range(batches):
            part = lines.filter(F.col("batch") == b).drop("batch")
            keys = runs.table(part.groupBy("key").agg(
                F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
            ))
            new = runs.table(runs.unseen(spark.table(keys)))
            repeated = spark.table(new).filter("last > first").select("key", "n", "first")
            seen = spark.table(keys).join(spark.table(new).select("key").hint("merge"), "key", "left_anti")
            rules = scratch.write(
                repeated.unionAll(seen.select("key", "n", F.lit(None).cast("long"))), f"rules-{b}"
            )
            ruled = attach_groups(part, rules, "key", "n", part.count(), "row")
            gone = ruled.filter("n is not null and (first is null or doc_id > first)")
            marked = scratch.write(gone.select("doc_id", "text_key", "at"), "gone", append=True)
            runs.drop(keys)
            runs.add(new)
            scratch.drop(f"rules-{b}")
    finally:
        runs.clear()
    scratch.drop("lines")
    return marked.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("at"))
