"""Exact de-duplication in two passes over a Bloom filter; DataFrame functions only.

Pass one sets two cells per text digest, shuffles a count of each cell, for every row of the
table, and keeps the cells that were set twice.  Pass two
looks every digest up: a row whose two cells are not both set twice is alone and passes
straight through; only the others are shuffled, as thin (row, id, digest) rows, and grouped
by their full digest, so a false positive costs a shuffled row and never a wrong answer.

The filter must fit a broadcast.  It has at most ``max_cells`` cells; beyond the rows that
fill it at ``cells_per_row``, the digest space is cut into slices (a partition column of the
digest table, written without a shuffle) and each slice has its own filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import Scratch, ascii_lower, attach_groups

CELLS_PER_ROW = 16
# 2**28 cells are at most 2**22 filter words of 16 bytes: under 64 MB to broadcast.
MAX_CELLS = 2**28


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    cells_per_row: int = CELLS_PER_ROW, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One decision per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty and equals
    the empty text.  Of equal texts the row with the largest id stays; null ids come below
    every other.  Rows repeating both id and text are one group, of which exactly one row is
    kept.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    total = docs.count()
    slices = max(1, -(-total * cells_per_row // max_cells))
    cells = 64
    while cells < min(max_cells, total * cells_per_row):
        cells *= 2
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    digests = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    ).withColumn("slice", F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(slices)))
    digests = scratch.write(digests, "digests", "slice")
    for s in range(slices):
        part = _cells(digests.filter(F.col("slice") == s).drop("slice"), cells)
        words = scratch.write(_repeated_words(part), f"filter-{s}")
        marked = _look_up(part, words)
        alone = marked.filter("not maybe").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), "digest",
        )
        maybe = scratch.write(marked.filter("maybe").select("row", "doc_id", "digest"), f"maybe-{s}")
        scratch.write(alone, "decisions", append=True)
        result = scratch.write(_grouped(scratch, maybe, s), "decisions", append=True)
        scratch.drop(f"filter-{s}", f"maybe-{s}", f"groups-{s}")
    scratch.drop("digests")
    return result.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def _cells(part: DataFrame, cells: int) -> DataFrame:
    h = F.xxhash64("digest")
    return part.withColumns({
        "cell_a": h.bitwiseAND(F.lit(cells - 1)),
        "cell_b": F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(cells - 1)),
    })


def _repeated_words(part: DataFrame) -> DataFrame:
    """Filter words of 64 cells, a bit for each cell that was set at least twice."""
    set_twice = (
        part.select(F.explode(F.array("cell_a", "cell_b")).alias("cell"))
        .groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    )
    return set_twice.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    )


def _look_up(part: DataFrame, words: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        named = words.select(F.col("word").alias(f"word_{side}"), F.col("bits").alias(f"bits_{side}"))
        part = part.join(
            F.broadcast(named), F.shiftright(f"cell_{side}", 6) == F.col(f"word_{side}"), "left"
        )
    seen = [
        F.coalesce(F.expr(f"bit_get(bits_{s}, cast(cell_{s} & 63 as int))").cast("int"), F.lit(0))
        for s in ("a", "b")
    ]
    return part.withColumn("maybe", (seen[0] + seen[1]) == 2)


def _grouped(scratch: Scratch, maybe: DataFrame, s: int) -> DataFrame:
    groups = maybe.groupBy("digest").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("doc_id", (-F.col("row")).alias("order"))).alias("best"),
    )
    groups = scratch.write(groups, f"groups-{s}")
    joined = attach_groups(maybe, groups, "digest", "group_size", maybe.count(), "row")
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("best.order") == -F.col("row")).alias("kept"), "digest",
    )
