"""Best-fit packing by minimum bin slack on the histogram of piece lengths.

Lengths are bounded by the sequence length, so all documents of any corpus are described by
at most 4096 counts.  On those counts the driver repeats: take the longest length left, find
by a bitset subset-sum over the available lengths the fullest combination beside it, and
remove that combination as often as the counts allow.  The result is a table of filling
patterns whose size depends on the sequence length only.  Pieces are numbered within their
length by a count per task, and each finds its sequence and offset in the patterns.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.llm.common import Scratch, small_batches
from plantpulse.llm.tokens import word_bpe_path, word_ids

SEQUENCE = 4096
END_ID = 1


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths with the largest sum up to ``room``.

    Bit s of the set after some lengths tells that they can sum to s; a length with count c
    is added in doubling bundles.  Stops as soon as the room can be filled exactly.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, bundle = min(counts[length], room // length), 1
        while left > 0:
            take = min(bundle, left)
            grown = (reach | (reach << (take * length))) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many sequences are filled so); empties the histogram."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    patterns = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = [longest, *fullest(lengths, counts, capacity - longest)]
        counts[longest] += 1
        need = Counter(chosen)
        times = min(counts[length] // n for length, n in need.items())
        for length, n in need.items():
            counts[length] -= n * times
        lengths = [length for length in lengths if counts[length]]
        patterns.append((chosen, times))
    return patterns


def placements(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces per sequence, first sequence, first offset)."""
    used, sequence, rows = Counter(), 0, {}
    for chosen, times in patterns:
        offset = 0
        for length, n in sorted(Counter(chosen).items(), reverse=True):
            rows.setdefault(length, []).append((used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return {length: np.array(found, dtype=np.int64) for length, found in rows.items()}


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    capacity: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; null texts are empty and so one token long.
    Documents longer than ``capacity`` are cut into pieces of that length, the last one
    shorter.  ``keep_ids`` adds the ids of the piece (little-endian unsigned 32-bit bytes).
    Rows that share an id, or have none, are packed each by itself.  Pieces of one length
    are interchangeable, so ties are settled by the order of the tasks.  An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = tokenizer or word_bpe_path()
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    if keep_ids:
        schema += ", ids binary"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.write(
        source.mapInArrow(_cutter(path, capacity, end_id, keep_ids), schema), "pieces"
    )
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.write(
        counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts"
    )
    # At most ``capacity`` rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(pickle.dumps(placements(minimum_bin_slack(histogram, capacity))))
    # A row a task and length: it grows with the table, so it is never broadcast.
    bases = counts.select("task", "length", "base").hint("merge")
    ranked = pieces.join(bases, ["task", "length"]).withColumn(
        "rank", F.col("base") + F.col("nth")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_placer(places), schema)


def _cutter(path: str, capacity: int, end_id: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, nth = TaskContext.get().partitionId(), word_ids(path), Counter()
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in small_batches(batches):
            of, piece, start, length, crc, order, parts = ([] for _ in range(7))
            for row, body in enumerate(batch.column("text").to_pylist()):
                ids = encoder.encode(body or "") + end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    n = len(part) // 4
                    of.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    order.append(nth[n])
                    nth[n] += 1
                    if keep_ids:
                        parts.append(part)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(of, pa.int32())),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "task": pa.array([task] * len(of), pa.int32()), "nth": pa.array(order, pa.int64()),
                **({"ids": pa.array(parts, pa.binary())} if keep_ids else {}),
            })

    return cut


def _placer(places):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids.cache_clear()  # this worker may have cut pieces before
        table = pickle.loads(places.value)
        firsts = {length: found[:, 0].tolist() for length, found in table.items()}
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                first, n, seq, off = table[length][bisect_right(firsts[length], rank) - 1].tolist()
                copy, slot = divmod(rank - first, n)
                sequence.append(seq + copy)
                offset.append(off + slot * length)
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column(
                "offset", pa.array(offset, pa.int64())
            )

    return place
