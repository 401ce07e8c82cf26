"""Removal of repeated substrings by longest previous factors over anchored segments.

A window is any ``length`` bytes of a text; it goes when the same bytes also start elsewhere.
No machine can hold one suffix array of the corpus, so windows are first brought together:

1. The anchor of a window is its gram of ``gram`` bytes with the least hash, the leftmost of
   equals.  It depends on the window's bytes alone, so equal windows have equal anchors at
   the same place.  Consecutive windows with one anchor are a segment: its bytes reach from
   the first window's start to the last one's end.  Every window is in one segment.
2. Segments are grouped by their anchor's hash, as rows of a hash and a digest.  Equal
   segments settle each other by their count alone.  Where one anchor has different
   segments, one copy of each fetches its bytes.
3. The segments of an anchor are laid end to end and their suffixes sorted as far as
   ``length`` bytes, ties by place.  Longest previous factors follow from the previous and
   next smaller places in that order: a window has an earlier match exactly when its left
   neighbour agrees with it for ``length`` bytes, and a later one when its right does.

An anchor with more than ``crowd`` different segments is not sorted in one task.  Its
segments are cut into chunks of windows that settle each other like segments, and where
chunks agree in part their windows are hashed one by one and counted in an aggregation,
which no key can overload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import Scratch, attach_groups, small_batches

LENGTH = 200
GRAM = 48
CROWD = 200
# Bytes whose grams are hashed at once, and bytes of segments sorted at once.
PIECE = 1 << 19
SORTED = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 24


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Hashes of all grams of a buffer: a polynomial in a random byte table, modulo 2**64."""

    def __init__(self, gram: int, longest: int):
        self.gram = gram
        self.table = np.random.default_rng(42).integers(0, 2**64, 256, dtype=np.uint64)
        self.up = _powers(longest, _BASE)
        self.down = _powers(longest, pow(_BASE, -1, 2**64))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[raw] * self.up[:n], out=total[1:])
        h = (total[self.gram:] - total[:n - self.gram + 1]) * self.down[:n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def segments(raw: np.ndarray, ends: np.ndarray, grams: Grams, length: int):
    """(first window, last window, anchor) and the anchor hash of the segments of texts laid end to end."""
    if len(raw) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64)
    h = grams(raw)
    mark = np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_least((h & ~mark) | np.arange(len(h), dtype=np.uint64), length - grams.gram + 1)
    anchor = (least & mark).astype(np.int64)
    place = np.arange(len(anchor))
    text = np.searchsorted(ends, place, side="right")
    whole = place + length <= ends[text]
    anchor = np.where(whole, anchor, -1 - text)
    new = np.append(True, (np.diff(anchor) != 0) | (np.diff(text) != 0))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    real = whole[first]
    first, last = first[real], last[real]
    return first, last, anchor[first], h[anchor[first]]


def _find_segments(length: int, gram: int):
    """Rows of (h, digest, doc_id, text_key, start, more, lead, n): ``more`` windows after the
    first, the anchor ``lead`` bytes after the start.

    Segments that a text repeats are one row with their count and first place; their other
    places follow as rows with digest null, which are known to be repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(gram, PIECE + 2 * length)
        digest = xxhash.xxh3_64_intdigest
        for batch in small_batches(batches):
            owner, start, more, lead, hashes, digests, counts = ([] for _ in range(7))
            seen: dict[tuple[int, int, int], int] = {}

            def settle(raw: bytes, of: list[int], base: list[int], ends: list[int]) -> None:
                first, last, anchor, h = segments(np.frombuffer(raw, np.uint8), np.array(ends), grams, length)
                text = np.searchsorted(np.array(ends), first, side="right").tolist()
                begins = [0, *ends[:-1]]
                for s, e, a, key, t in zip(first.tolist(), last.tolist(), anchor.tolist(), h.tolist(), text):
                    same = digest(raw[s:e + length])
                    at = s - begins[t] + base[t]
                    known = seen.setdefault((of[t], key, same), len(owner))
                    repeat = known != len(owner)
                    if repeat:
                        counts[known] += 1
                    owner.append(of[t])
                    start.append(at)
                    more.append(e - s)
                    lead.append(a - s)
                    hashes.append(key)
                    digests.append(None if repeat else same)
                    counts.append(0 if repeat else 1)

            raw, of, base, ends, size = [], [], [], [], 0
            for row, body in enumerate(batch.column("text").to_pylist()):
                data = (body or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                # A long text comes in pieces that share all but one byte of a window.
                for at in range(0, len(data) - length + 1, PIECE):
                    piece = data[at:at + PIECE + length - 1]
                    if size + len(piece) > PIECE + length - 1 and raw:
                        settle(b"".join(raw), of, base, ends)
                        raw, of, base, ends, size = [], [], [], [], 0
                    size += len(piece)
                    raw.append(piece)
                    of.append(row)
                    base.append(at)
                    ends.append(size)
            if raw:
                settle(b"".join(raw), of, base, ends)
            picked = pa.array(owner, pa.int32())
            signed = np.array([d or 0 for d in digests], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                "digest": pa.array(signed, mask=np.array([d is None for d in digests], dtype=bool)),
                "doc_id": batch.column("doc_id").take(picked),
                "text_key": batch.column("text_key").take(picked),
                "start": pa.array(start, pa.int64()), "more": pa.array(more, pa.int32()),
                "lead": pa.array(lead, pa.int32()), "n": pa.array(counts, pa.int32()),
            })

    return run


def truncated_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix among the suffixes cut at ``length`` bytes; equal when they agree.

    Doubles the compared prefix from eight bytes on; the last step overlaps to end at
    ``length``.  Bytes past the end count as zero.
    """
    n = len(raw)
    padded = np.append(raw, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    known = min(8, length)
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(known):
        packed = (packed << np.uint64(8)) | padded[i:i + n]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    while known < length:
        step = min(known, length - known)
        later = np.zeros(n, dtype=np.int64)
        later[:n - step] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 1) + later, return_inverse=True)[1].astype(np.int64)
        known += step
    return rank


def factors(raw: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window (given by its place, in order) has an earlier and a later match."""
    rank = truncated_ranks(raw, length)[windows]
    order = np.argsort(rank, kind="stable")
    agrees = np.diff(rank[order]) == 0
    earlier, later = np.zeros(len(windows), dtype=bool), np.zeros(len(windows), dtype=bool)
    earlier[order[1:]] = agrees
    later[order[:-1]] = agrees
    return earlier, later


def _runs(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    yield from zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())


def _sort_segments(length: int, later_too: bool):
    """Matched stretches of segments that come sorted by anchor hash and place."""
    def stretches(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        places, bodies = table.column("start").to_pylist(), table.column("bytes").to_pylist()
        names = zip(*(table.column(c).to_pylist() for c in ("h", "doc_id", "text_key", "start")))
        # A text whose row is repeated was fetched more than once.
        seen, rows = None, []
        for i, name in enumerate(names):
            if name != seen:
                rows.append(i)
            seen = name
        sizes = np.array([len(bodies[i]) for i in rows])
        begins = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join([bodies[i] for i in rows]), dtype=np.uint8)
        windows = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes)])
        # Windows of different anchors differ, so all anchors can share one array.
        earlier, later = factors(raw, windows, length)
        hit = earlier | later if later_too else earlier
        row, start, stop, at = [], [], [], 0
        for i, size in zip(rows, (sizes - length + 1).tolist()):
            for first, last in _runs(hit[at:at + size]):
                row.append(i)
                start.append(places[i] + first)
                stop.append(places[i] + last + length)
            at += size
        picked = table.select(["doc_id", "text_key"]).take(pa.array(row, pa.int64()))
        for name, values in (("start", start), ("stop", stop)):
            picked = picked.append_column(name, pa.array(values, pa.int64()))
        return picked.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < SORTED:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("h").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from stretches(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from stretches(pa.Table.from_batches(held))

    return run


def _cut_chunks(length: int, step: int):
    """Windows of a segment in chunks by their distance from the anchor.

    ``core`` is the digest of the bytes that every window of a whole chunk has, so chunks
    with equal windows have equal cores; ``same`` is the digest of the chunk's own bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in small_batches(batches):
            row, core, same, start, more = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bytes", "start", "lead"))
            for i, (body, begin, lead) in enumerate(zip(*columns)):
                last = len(body) - length
                at = 0
                while at <= last:
                    chunk = (lead - at) // step
                    to = min(last, lead - chunk * step)
                    # The whole chunk's windows start from lead - step * (chunk + 1) + 1 on.
                    low, high = lead - chunk * step, lead - step * (chunk + 1) + 1 + length
                    row.append(i)
                    core.append(digest(body[low:high], chunk))
                    same.append(digest(body[at:to + length], chunk))
                    start.append(begin + at)
                    more.append(to - at)
                    at = to + 1
            picked = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "h": batch.column("h").take(picked), "core": _signed(core), "same": _signed(same),
                "doc_id": batch.column("doc_id").take(picked), "text_key": batch.column("text_key").take(picked),
                "start": pa.array(start, pa.int64()), "segment": batch.column("start").take(picked),
                "more": pa.array(more, pa.int32()),
            })

    return run


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def _hash_windows(length: int):
    """A row per window of the wanted chunks of a segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in small_batches(batches):
            row, place, found = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bytes", "start", "wanted"))
            for i, (body, begin, wanted) in enumerate(zip(*columns)):
                for one in wanted:
                    first = one["start"]
                    for p in range(first, first + one["more"] + 1):
                        row.append(i)
                        place.append(p)
                        found.append(digest(body[p - begin:p - begin + length]))
            picked = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "h": batch.column("h").take(picked), "window": _signed(found),
                "doc_id": batch.column("doc_id").take(picked), "text_key": batch.column("text_key").take(picked),
                "start": pa.array(place, pa.int64()), "segment": batch.column("start").take(picked),
            })

    return run


def _fetch(length: int):
    """Bytes of the wanted segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            row, found, bodies = [], [], []
            for i, (body, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                data = (body or "").encode("utf-8", "surrogatepass")
                for one in wanted:
                    row.append(i)
                    found.append(one)
                    bodies.append(data[one["start"]:one["start"] + one["more"] + length])
            picked = pa.array(row, pa.int32())
            column = lambda name, kind: pa.array([one[name] for one in found], kind)
            yield pa.RecordBatch.from_pydict({
                "h": column("h", pa.int64()), "crowded": column("crowded", pa.bool_()),
                "lead": column("lead", pa.int32()), "doc_id": batch.column("doc_id").take(picked),
                "text_key": batch.column("text_key").take(picked), "start": column("start", pa.int64()),
                "bytes": pa.array(bodies, pa.binary()),
            })

    return run


_PLACE = ["doc_id", "text_key", "start"]


def _settle(
    rows: DataFrame, kinds: DataFrame, keys: list[str], keep_first: bool, total: int
) -> DataFrame:
    """The rows that a row with equal ``keys`` matches; with ``keep_first`` an earlier one.

    ``kinds`` has the keys, ``size`` and ``first`` (the smallest place) of every group.
    """
    groups = kinds.filter("size > 1").select(F.struct(*keys).alias("_kind"), "size", F.col("first").alias("_first"))
    marked = rows.withColumns({"_kind": F.struct(*keys), "_spread": F.xxhash64(*_PLACE)})
    met = attach_groups(marked, groups, "_kind", "size", total, "_spread").filter("size is not null")
    return met.filter(F.struct(*_PLACE) > F.col("_first")) if keep_first else met


def _of_own(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Join a list column ``wanted`` by keys that may be null."""
    named = wanted.select(F.struct(*keys).alias("_own"), "wanted")
    return df.withColumn("_mine", F.struct(*keys)).join(named, F.col("_mine") == F.col("_own")).drop("_mine", "_own")


def repeated_stretches(
    docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False,
    crowd: int = CROWD,
) -> DataFrame:
    """(doc_id, text_key, start, stop) of stretches to remove, overlapping ones included.

    ``docs`` has doc_id, text_key and text.  The first of equal windows is the one with the
    smallest (doc_id, text_key, place).
    """
    where = f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, start long"
    rows = scratch.write(docs.mapInArrow(
        _find_segments(length, gram), f"h long, digest long, {where}, more int, lead int, n int"
    ), "segments")
    # A segment's repeats inside its text are known to match; the first stands for them.
    once = rows.filter("digest is not null")
    kinds = scratch.write(
        once.groupBy("h", "digest").agg(
            F.sum("n").alias("size"), F.min(F.struct(*_PLACE)).alias("first"),
            F.max(F.struct("more", "lead")).alias("shape"),
        ), "kinds",
    )
    stop = (F.col("start") + F.col("more") + length).alias("stop")
    within = rows.filter("digest is null").select(*_PLACE, stop)
    equal = _settle(once, kinds, ["h", "digest"], keep_first, rows.count()).select(*_PLACE, stop)
    # Where an anchor has several kinds of segments, one of each kind is looked at.
    anchors = scratch.write(
        kinds.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "anchors"
    )
    varied = attach_groups(
        kinds.select("h", "digest", "first", "shape"), anchors, "h", "size", kinds.count(), "digest"
    ).filter("size is not null")
    wanted = varied.select("first.*", "shape.*", "h", (F.col("size") > crowd).alias("crowded")).groupBy(
        "doc_id", "text_key"
    ).agg(F.collect_list(F.struct("h", "start", "more", "lead", "crowded")).alias("wanted"))
    fetched = scratch.write(_of_own(docs, wanted, ["doc_id", "text_key"]).mapInArrow(
        _fetch(length), f"h long, crowded boolean, lead int, {where}, bytes binary"
    ), "fetched", "crowded")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = fetched.filter("not crowded").drop("crowded")
    many = fetched.filter("crowded").drop("crowded")
    ordered = few.repartition(parts, "h").sortWithinPartitions("h", *_PLACE)
    looked = ordered.mapInArrow(_sort_segments(length, not keep_first), f"{where}, stop long")
    crowds = _crowded_stretches(many, scratch, where, length, keep_first)
    return within.unionAll(equal).unionAll(looked).unionAll(crowds)


def _crowded_stretches(
    segments_: DataFrame, scratch: Scratch, where: str, length: int, keep_first: bool
) -> DataFrame:
    """Matched stretches among the segments of anchors that have too many to sort together.

    Chunks of windows settle each other as whole segments do; only windows of chunks that
    share a core with a different chunk are hashed one by one.
    """
    step = max(1, length // 8)
    chunks = scratch.write(segments_.mapInArrow(
        _cut_chunks(length, step), f"h long, core long, same long, {where}, segment long, more int"
    ).distinct(), "chunks")
    kinds = scratch.write(chunks.groupBy("h", "core", "same").agg(
        F.count("*").alias("size"), F.min(F.struct(*_PLACE)).alias("first"),
        F.min(F.struct(*_PLACE, "segment", "more")).alias("one"),
    ), "chunk-kinds")
    stop = (F.col("start") + F.col("more") + length).alias("stop")
    equal = _settle(chunks, kinds, ["h", "core", "same"], keep_first, chunks.count()).select(*_PLACE, stop)
    cores = scratch.write(
        kinds.groupBy("h", "core").agg(F.count("*").alias("size")).filter("size > 1")
        .select(F.struct("h", "core").alias("_core"), "size"), "cores",
    )
    varied = attach_groups(
        kinds.select(F.struct("h", "core").alias("_core"), "same", "one"), cores, "_core", "size",
        kinds.count(), "same",
    ).filter("size is not null").select("_core.h", "one.*")
    wanted = varied.groupBy("h", "doc_id", "text_key", "segment").agg(
        F.collect_list(F.struct("start", "more")).alias("wanted")
    ).withColumnRenamed("segment", "start")
    windows = scratch.write(_of_own(segments_, wanted, ["h", *_PLACE]).mapInArrow(
        _hash_windows(length), f"h long, window long, {where}, segment long"
    ).distinct(), "windows")
    found = scratch.write(windows.groupBy("h", "window").agg(
        F.count("*").alias("size"), F.min(F.struct(*_PLACE)).alias("first")
    ), "window-kinds")
    hit = _settle(windows, found, ["h", "window"], keep_first, windows.count())
    # A segment has fewer windows than its anchor's gram leaves room for: short lists.
    places = hit.groupBy("doc_id", "text_key", "segment").agg(F.sort_array(F.collect_list("start")).alias("p"))
    first = F.expr("filter(p, (x, i) -> i = 0 or p[i - 1] < x - 1)")
    last = F.expr("filter(p, (x, i) -> i = size(p) - 1 or p[i + 1] > x + 1)")
    runs = places.select("doc_id", "text_key", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("r"))
    single = runs.select("doc_id", "text_key", F.col("r.a").alias("start"), (F.col("r.b") + length).alias("stop"))
    return equal.unionAll(single)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    keep_first: bool = False, crowd: int = CROWD, out: str = "repeats",
) -> DataFrame:
    """One row per document: doc_id and a struct ``out`` of n_bytes, n_removed, n_spans, kept.

    A byte goes when it is covered by a string of ``length`` bytes that also starts anywhere
    else, in this text or another; with ``keep_first`` the first such string stays.  Strings
    are judged on the input.  ``kept`` are the bytes left, in order.  Null texts are empty;
    texts shorter than ``length`` lose nothing.  Rows repeating an id with another text are
    documents of their own; rows repeating both are copies of each other, and with
    ``keep_first`` stay or go together.  Null ids sort first.  An empty table gives no rows;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "factors")
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    )
    found = scratch.write(repeated_stretches(source, scratch, length, gram, keep_first, crowd), "stretches")
    scratch.drop("segments", "kinds", "anchors", "fetched")
    scratch.drop("chunks", "chunk-kinds", "cores", "windows", "window-kinds")
    spans = found.groupBy("doc_id", "text_key").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    ).select(F.struct("doc_id", "text_key").alias("own"), "starts", "stops")
    joined = source.join(spans, F.struct("doc_id", "text_key") == F.col("own"), "left").select(
        "doc_id", "text", "starts", "stops"
    )
    kind = dict(source.dtypes)["doc_id"]
    cut = joined.mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return cut.select("doc_id", F.struct("n_bytes", "n_removed", "n_spans", "kept").alias(out))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = []
        for body, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "stops"))):
            data, left, spans, at = (body or "").encode("utf-8", "surrogatepass"), [], 0, 0
            end = -1
            for a, b in sorted(zip(starts or (), stops or ())):
                if a > end:
                    left.append(data[max(at, 0):a])
                    spans += 1
                    end = b
                else:
                    end = max(end, b)
                at = end
            left.append(data[at:])
            kept = b"".join(left)
            rows.append((len(data), len(data) - len(kept), spans, kept))
        sizes, removed, spans, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )
