"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A seed is the hash of four words of a window; a fixed mask says which ones, so the words at
its other positions may differ.  With the two masks every passage of six to twenty-four
words keeps a seed when any fifth of its words is replaced (counted out), one of five words
when it is whole.  Seeds of the documents meet those of the benchmark in a join; around each
meeting the two texts are laid over each other and all words that agree are counted.

The documents' side is one scan: words are hashed once per text, seeds are made inside
generated code and probe the broadcast benchmark without being written anywhere.  A
benchmark with more than ``small`` seeds is not broadcast: then (document, place, seed)
rows are shuffled, and only candidate pairs fetch the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import Scratch, free_name
from plantpulse.session import broadcast_if_small

MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
SHORTEST = min(mask[-1] for mask in MASKS) + 1
SIMILARITY = 0.8
SMALL = 200_000
# Overlaps are summed over alignments that differ by at most this many inserted words.
DRIFT = 32


def words(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, tokens: str) -> DataFrame:
    """``df`` with a row per (at, seed): every window of every mask that fits."""
    n, spans = len(MASKS), [mask[-1] + 1 for mask in MASKS]
    slots = F.sequence(F.lit(0), F.size(tokens) * n - 1)
    rows = df.filter(F.size(tokens) >= min(spans)).select("*", F.explode(slots).alias("slot"))
    at, number = F.expr(f"slot div {n}").cast("int"), F.col("slot") % n
    seed = reduce(
        lambda so_far, m: so_far.when(number == m, F.xxhash64(
            F.lit(m), *[F.get(tokens, at + o) for o in MASKS[m]]
        )), range(1, n), F.when(number == 0, F.xxhash64(F.lit(0), *[F.get(tokens, at + o) for o in MASKS[0]])),
    )
    fits = reduce(
        lambda so_far, m: so_far | ((number == m) & (at + spans[m] <= F.size(tokens))), range(n), F.lit(False)
    )
    return rows.filter(fits).withColumns({"at": at, "seed": seed}).drop("slot")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
    small: int = SMALL,
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_words, similarity): items that a document contains.

    ``similarity`` is the least share of an item's words that agree in place with the
    document near a shared seed.  Items of fewer than five words, and null, empty or wordless
    texts on either side, match nothing.  Repeated items are reported each by its id, and
    rows sharing an id give one row with the best match.  Null ids are values like any
    other.  Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "seeds")
    # Items without a seed match nothing; the others have at least as many seeds as there
    # are items, and a seed for every word but four.
    items = scratch.write(benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
        words(F.col(item_text)).alias("item_words"),
    ).filter(F.size("item_words") >= SHORTEST), "items")
    seeds = scratch.write(
        _seeds(items, "item_words").select("item", F.col("at").alias("item_at"), "seed"), "seeds"
    )
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), words(F.col(text)).alias("doc_words")
    )
    at = (F.col("at") - F.col("item_at")).alias("shift")
    if seeds.limit(small + 1).count() <= small:
        # No more items than seeds, nor more words than seeds and four an item: both are small.
        found = _seeds(source, "doc_words").join(F.broadcast(seeds), "seed").select(
            "doc_id", "text_key", "item", at, "doc_words"
        ).join(F.broadcast(items), "item")
    else:
        places = _seeds(source, "doc_words").select("doc_id", "text_key", "at", "seed")
        met = places.join(seeds, "seed").select("doc_id", "text_key", "item", at).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
        whole = source.dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed(
            {"doc_id": "own_id", "text_key": "own_key"}
        )
        found = met.join(whole, same).join(items, "item")
    agree = F.filter(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda k: F.get("item_words", k) == F.get("doc_words", k + F.col("shift")),
    )
    laid = found.select(
        "doc_id", "text_key", "item", "item_id", F.size("item_words").cast("long").alias("n_words"), "shift",
        agree.alias("places"),
    ).distinct()
    region = F.explode(F.array(
        F.floor(F.col("shift") / (2 * DRIFT)) * 2, F.floor((F.col("shift") + DRIFT) / (2 * DRIFT)) * 2 + 1
    ))
    key = ["doc_id", "text_key", "item", "item_id", "n_words", "region"]
    counted = (
        laid.withColumn("region", region).select(*key, F.explode("places").alias("place")).distinct()
        .groupBy(*key).agg(F.count("*").alias("n_matched"))
    )
    return (
        counted.filter(F.col("n_matched") >= F.lit(similarity) * F.col("n_words"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("n_matched") / F.col("n_words")).alias("s"), "n_matched", "n_words")).alias("b"))
        .select("doc_id", "item_id", "b.n_matched", "b.n_words", F.col("b.s").alias("similarity"))
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id has no overlap, all columns kept."""
    leak = free_name(docs, "_leak")
    leaks = overlaps(docs, benchmark, doc_id, **options).select(F.col("doc_id").alias(leak)).distinct()
    # Few leaks: the texts stay where they are.  More than the limit: a shuffle join.
    leaks = broadcast_if_small(leaks)
    return docs.join(leaks, F.col(doc_id).eqNullSafe(F.col(leak)), "left_anti")
