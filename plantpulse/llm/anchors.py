"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is cut into blocks; two fingerprints within ``radius`` differing bits
differ by at most ``radius // blocks`` bits in some block.  The anchors of a block are the
words of a covering code: a Hamming code on its first 2**r - 1 bits and every word on the
rest, so each block lies within one bit of an anchor.  A fingerprint is at home at its
nearest anchor and is replicated to every anchor within the covering radius plus the
block's threshold.  If x and y are linked, y is replicated to x's home, where they meet.

Only distinct fingerprints are replicated, so copies cost nothing, and an anchor passes on
a forest of its links, at most one link a row, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import Scratch, attach_groups, free_name, small_batches
from plantpulse.llm.components import connected_components
from plantpulse.session import BROADCAST_ROWS

SHINGLE = 4
RADIUS = 4
SEED = 42
# Three blocks give 17-bit anchors and about 43 replicas of a fingerprint, two blocks 27-bit
# anchors and about 340: fewer meetings for more rows, which pays beyond this many.
MANY = 2**30
# Rows of an anchor beyond which it is dealt over several tasks.
CROWD = 20_000
# Cells of the comparison matrix made at once.
CELLS = 1 << 21


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles as rows of eight bytes, some at a time."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    if len(found) <= words:
        yield np.frombuffer(xxhash.xxh64_digest(joined, SEED), dtype=np.uint8).reshape(1, 8)
        return
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    digest = xxhash.xxh64_digest
    n = len(found) - words + 1
    ends = ends[words - 1:].tolist()
    for at in range(0, n, 4096):
        some = b"".join([
            digest(joined[s:e], SEED) for s, e in zip(starts[at:at + 4096], ends[at:at + 4096])
        ])
        yield np.frombuffer(some, dtype=np.uint8).reshape(-1, 8)


def _majority(hashes: Iterable[np.ndarray]) -> bytes:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for some in hashes:
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return np.packbits(2 * ones > n).tobytes()


def simhash(text: str | None, words: int = SHINGLE) -> bytes:
    """Fingerprint, most significant byte first."""
    return _majority(_hashes(text, words))


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE
) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long of the same bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = b"".join(simhash(body, words) for body in batch.column("text").to_pylist())
            fp = np.frombuffer(raw, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"]
            )

    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    )
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, text_key long, fp long")


class Block:
    """Anchors of the bits [low, low + size) of a fingerprint."""

    def __init__(self, low: int, size: int, threshold: int):
        self.low, self.mask = np.uint64(low), np.uint64((1 << size) - 1)
        checks = (size + 1).bit_length() - 1
        self.coded = (1 << checks) - 1
        reach = (1 if checks > 1 else 0) + threshold
        by_syndrome: dict[int, list[int]] = {s: [] for s in range(1 << checks)}
        for weight in range(reach + 1):
            for bits in combinations(range(size), weight):
                syndrome = 0
                for bit in bits:
                    syndrome ^= bit + 1 if bit < self.coded else 0
                by_syndrome[syndrome].append(sum(1 << bit for bit in bits))
        # The first pattern of a syndrome is the lightest: it leads to the nearest anchor.
        self.patterns = {s: np.array(found, dtype=np.uint64) for s, found in by_syndrome.items()}

    def anchors(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(anchor, fingerprint, whether it is at home there), a chunk at a time."""
        words = (fp >> self.low) & self.mask
        syndrome = np.zeros(len(fp), dtype=np.int64)
        for bit in range(self.coded):
            syndrome ^= np.where((words >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
        for s, patterns in self.patterns.items():
            here = syndrome == s
            own, bits = fp[here], words[here]
            for i, pattern in enumerate(patterns):
                yield bits ^ pattern, own, i == 0


def blocks_of(blocks: int, radius: int) -> list[Block]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [Block(a, b - a, radius // blocks) for a, b in zip(cuts, cuts[1:])]


def _replicas(blocks: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = blocks_of(blocks, radius)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for number, code in enumerate(codes):
                for anchor, own, home in code.anchors(fp):
                    key = (anchor << np.uint64(2)) | np.uint64(number)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(own.view(np.int64)),
                         pa.array(np.full(len(own), not home))],
                        ["anchor", "fp", "guest"],
                    )

    return run


def _join_forest(a: np.ndarray, b: np.ndarray, out: list) -> None:
    """Append the links that join two trees; values are fingerprints."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            out.append((x, y))


def _meet_large(homes: np.ndarray, rows: np.ndarray, radius: int, out: list) -> None:
    """One link per row to a home, and links between homes it joins, block by block."""
    label = np.arange(len(homes))
    step = max(1, CELLS // len(homes))
    for at in range(0, len(rows), step):
        some = rows[at:at + step]
        far = np.bitwise_count(some[:, None] ^ homes[None, :])
        near = (far <= radius) & (far > 0)
        for i in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(near[i])
            first = found[0]
            out.append((int(some[i]), int(homes[first])))
            for other in found[label[found] != label[first]]:
                if label[other] != label[first]:
                    label[label == label[other]] = label[first]
                    out.append((int(homes[first]), int(homes[other])))


def _meetings(radius: int):
    def links(fp: np.ndarray, guest: np.ndarray, starts: np.ndarray, out: list) -> None:
        ends = np.append(starts[1:], len(fp))
        homes = np.add.reduceat((~guest).astype(np.int64), starts)
        pairs = homes * (ends - starts)
        small = np.flatnonzero((pairs > 0) & (ends - starts > 1) & (pairs <= CELLS // 8))
        for large in np.flatnonzero(pairs > CELLS // 8):
            s, e = starts[large], ends[large]
            _meet_large(fp[s:s + homes[large]], fp[s:e], radius, out)
        if not len(small):
            return
        cut = np.flatnonzero(np.diff(np.cumsum(pairs[small]) // CELLS)) + 1
        for some in np.split(small, cut):
            n, h, size = pairs[some], homes[some], (ends - starts)[some]
            base = np.repeat(starts[some], n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(size, n)
            x, y = fp[base + nth // width], fp[base + nth % width]
            far = np.bitwise_count(x ^ y)
            near = (far <= radius) & (far > 0)
            _join_forest(x[near], y[near], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "chunk", "fp", "guest")]
            if kept is not None:
                now = [np.concatenate(both) for both in zip(kept, now)]
            new = (np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)
            starts = np.append(0, np.flatnonzero(new) + 1)
            done, out = starts[-1], []
            if done:
                links(now[2][:done].view(np.uint64), now[3][:done], starts[:-1], out)
            kept = [column[done:] for column in now]
            yield _links_batch(out)
        if kept is not None and len(kept[0]):
            out = []
            links(kept[2].copy().view(np.uint64), kept[3], np.array([0]), out)
            yield _links_batch(out)

    return run


def _links_batch(out: list) -> pa.RecordBatch:
    pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))],
        ["a", "b"],
    )


def _dealt(rows: DataFrame, scratch: Scratch, crowd: int) -> DataFrame:
    """Replicas by anchor and task, homes first; crowded anchors are dealt over a grid of tasks.

    An anchor with more than ``crowd`` homes or guests has its homes cut into one set of
    chunks and all its rows into another: every task compares one chunk of each, and every
    home meets every row once.
    """
    sizes = rows.groupBy("anchor").agg(
        F.count_if(~F.col("guest")).alias("homes"), F.count("*").alias("all")
    ).filter((F.col("homes") > 0) & (F.col("all") > crowd))
    crowds = scratch.write(sizes.select(
        F.col("anchor").alias("at"), F.ceil(F.col("homes") / crowd).cast("int").alias("down"),
        F.ceil(F.col("all") / crowd).cast("int").alias("across"),
    ), "crowds")
    # Fewer anchors than a crowd-th of the replicas: a list that grows, so it is counted.
    side = F.broadcast(crowds) if crowds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else crowds
    met = rows.join(side, F.col("anchor") == F.col("at"), "left")
    place = F.xxhash64("fp")
    whole = met.filter("down IS NULL").select(
        "anchor", F.lit(0).alias("chunk"), "fp", "guest"
    )
    grid = met.filter("down IS NOT NULL").withColumns({
        "row": F.pmod(place, F.col("down")).cast("int"),
        "column": F.pmod(F.shiftright(place, 20), F.col("across")).cast("int"),
    })
    as_home = grid.filter("NOT guest").select(
        "anchor", "row", "across", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("column"), "fp",
        F.lit(False).alias("guest"),
    )
    as_guest = grid.select(
        "anchor", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("row"), "across", "column", "fp",
        F.lit(True).alias("guest"),
    )
    chunk = (F.col("row") * F.col("across") + F.col("column")).cast("int").alias("chunk")
    dealt = whole.unionAll(as_home.unionAll(as_guest).select("anchor", chunk, "fp", "guest"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "anchor", "chunk").sortWithinPartitions("anchor", "chunk", "guest")


def fingerprint_links(
    distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, blocks: int | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``radius`` do."""
    blocks = blocks or (3 if distinct.count() <= MANY else 2)
    rows = distinct.select("fp").mapInArrow(
        _replicas(blocks, radius), "anchor long, fp long, guest boolean"
    )
    rows = scratch.write(rows, "replicas")
    return _dealt(rows, scratch, crowd).mapInArrow(_meetings(radius), "a long, b long")


def _components(
    docs: DataFrame, scratch: Scratch, doc_id: str, text: str, radius: int, blocks: int | None, words: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fp, row), and (fp, n, root, size, component_id) per fingerprint."""
    rows = scratch.write(
        fingerprints(docs, doc_id, text, words).withColumn("row", F.monotonically_increasing_id()), "rows"
    )
    distinct = scratch.write(
        rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "distinct"
    )
    links = scratch.write(fingerprint_links(distinct, scratch, radius, blocks), "links")
    roots = scratch.write(connected_components(links, scratch), "roots")
    node = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = scratch.write(
        node.groupBy("root").agg(F.sum("n").alias("size"), F.min("low").alias("component_id")), "lowest"
    )
    groups = attach_groups(
        node.select("fp", "n", "root"), lowest, "root", "size", rows.count(), "fp"
    ).select("fp", "n", "root", "component_id")
    groups = scratch.write(groups, "groups")
    scratch.drop("replicas", "crowds", "links", "roots", "lowest", "distinct")
    return rows, groups


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
    blocks: int | None = None, words: int = SHINGLE,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a text of fewer words than
    a shingle is one shingle; null, empty and blank texts have fingerprint zero and are
    linked like any other; very long texts are hashed whole.  component_id is the smallest id
    reachable over links of at most ``radius`` differing bits; a component whose ids are all
    null has a null one.  Rows repeating an id are nodes of their own.  An empty table gives
    no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, groups = _components(docs, scratch, doc_id, text, radius, blocks, words)
    return attach_groups(rows, groups, "fp", "n", rows.count(), "row").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
    blocks: int | None = None, words: int = SHINGLE,
) -> DataFrame:
    """One row of ``docs`` per component of ``near_duplicates``, the one with the smallest id.

    All columns are kept, whatever their names.  Null, empty and blank texts are one
    component, of which one row stays.  Null ids come after all others; of rows that share
    the smallest id the one with the smaller text hash stays, and of rows that repeat both,
    one.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, groups = _components(docs, scratch, doc_id, text, radius, blocks, words)
    placed = attach_groups(rows, groups, "fp", "n", rows.count(), "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    own, best = free_name(docs, "_own"), free_name(docs, "_best")
    stays = placed.groupBy("root").agg(F.min(order).alias("best")).select(
        F.struct(F.col("best.doc_id").alias("doc_id"), F.col("best.text_key").alias("text_key")).alias(best)
    )
    keyed = docs.withColumn(own, F.struct(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key")
    ))
    return keyed.join(stays, F.col(own) == F.col(best), "left_semi").dropDuplicates([own]).drop(own)
