"""URL rules as a sorted digest array: memory-mapped keys, binary search, strings confirmed.

A rule is a host with a path prefix and a verdict.  Two arrays are built: of the rules'
hosts (each with the lengths of its rules' paths) and of whole rules.  Each holds 64-bit
xxhash keys in ascending order, the offsets of the stored strings and the strings.  They are
one file in the shared folder, which Spark hands to every executor; tasks map it, so the
workers of a machine share its pages, and look a batch up by vectorised binary search.  A key
that is found counts only when the stored string is equal too.

A URL's host is looked up with each of its parent domains; for the hosts found, the path's
beginnings of the lengths that the host's rules have are looked up in turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.llm.common import Scratch, ascii_lower, free_name

SEED = 42
# A list of more rules, or of more bytes of rule strings, is joined instead of mapped.
ARRAY_ROWS = 4_000_000
ARRAY_BYTES = 256 << 20
CHUNK = 4 << 20
RULES = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", array_rows: int = ARRAY_ROWS,
    array_bytes: int = ARRAY_BYTES,
) -> DataFrame:
    """The rows of ``pages`` and a struct ``judged`` of host, path, rule and verdict.

    ``rules`` has host, path and verdict.  A rule fits its host and all subdomains when the
    URL's path starts with the rule's; of several that fit, the one with the longest string
    host + path wins, of equally long ones the one with the longer host.  Where none fits,
    the rule is null and the verdict ``otherwise``: a list of verdicts says nothing of what
    it does not hold.

    A null URL, or one without ``://``, has an empty host and path, which no rule fits.  Rule
    hosts are lower-cased; rules with a null or empty host or a null verdict are left out, a
    null path is an empty one, and of rules with equal host and path the smallest verdict
    holds.  Repeated rows are judged each; very long URLs are read whole; an empty table
    gives no rows, and an empty list ``otherwise``.  Where a column of ``pages`` is named
    ``judged``, the struct's name is lengthened by underscores.
    """
    out = free_name(pages, "judged")
    listed = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host <> '' AND verdict IS NOT NULL")
    listed = listed.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    size = listed.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("verdict")), F.lit(0)).alias("b"),
    ).first()
    parts = {"host": url_host(F.col(url)), "path": url_path(F.col(url))}
    if size["n"] <= array_rows and size["b"] <= array_bytes:
        return _mapped(pages, listed, parts, out, otherwise)
    return _joined(pages, listed, parts, out, otherwise)


def _mapped(pages: DataFrame, rules: DataFrame, parts: dict, out: str, otherwise: str) -> DataFrame:
    name = _publish(pages.sparkSession, _packed(rules.toArrow()))
    given = pages.select(*[F.col(f"`{c}`") for c in pages.columns], F.struct(
        *[c.alias(k) for k, c in parts.items()], F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"),
    ).alias(out))
    schema = given.schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = DigestArrays(SparkFiles.get(name))
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            host, path = held.field("host"), held.field("path")
            rule, verdict = arrays.judge(host.to_pylist(), path.to_pylist(), otherwise)
            judged = pa.StructArray.from_arrays(
                [host, path, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["host", "path", "rule", "verdict"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], judged], names=batch.schema.names)

    return given.mapInArrow(judge, schema)


def _joined(pages: DataFrame, rules: DataFrame, parts: dict, out: str, otherwise: str) -> DataFrame:
    """The same rows by shuffles: every (parent domain, path start) that a rule could have."""
    scratch = Scratch(pages.sparkSession, "url-rules")
    row = free_name(pages, "row_key")
    at = scratch.write(pages.select(
        *[F.col(f"`{c}`") for c in pages.columns], F.struct(*[c.alias(k) for k, c in parts.items()]).alias(out),
        F.monotonically_increasing_id().alias(row),
    ), "urls")
    urls = at.select(F.col(f"{out}.host").alias("host"), F.col(f"{out}.path").alias("path")).distinct()
    # A host longer than every rule's is cut to what can be a parent, its first label dropped.
    longest = rules.agg(F.coalesce(F.max(F.char_length("host")), F.lit(0)).alias("n")).first()["n"]
    long = F.char_length("host") > longest
    labels = F.split(F.when(long, F.substring("host", -longest - 1, longest + 1)).otherwise(F.col("host")), "\\.")
    parents = urls.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.when(~long | (k > 1), F.array_join(F.slice(labels, k, F.size(labels)), "."))
    )).alias("parent"))
    lengths = rules.select(F.col("host").alias("parent"), F.char_length("path").alias("length")).distinct()
    starts = parents.join(lengths, "parent").filter(F.char_length("path") >= F.col("length")).withColumn(
        "start", F.substring("path", F.lit(1), F.col("length"))
    )
    met = starts.join(
        rules.select(F.col("host").alias("parent"), F.col("path").alias("start"), "verdict"), ["parent", "start"]
    )
    rank = F.struct(F.char_length(F.concat("parent", "start")), F.char_length("parent"))
    best = met.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("parent", "start").alias("rule"), "verdict"), rank).alias("best")
    )
    best = scratch.write(best.select(F.struct("host", "path").alias("_key"), "best"), "best")
    both = at.join(best, F.col(out) == F.col("_key"), "left")
    judged = F.struct(
        F.col(f"{out}.host").alias("host"), F.col(f"{out}.path").alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
    return both.select(*[F.col(f"`{c}`") for c in pages.columns], judged.alias(out))


def _publish(spark: SparkSession, blob: bytes) -> str:
    """Write the arrays to the shared folder and have Spark hand them to every executor."""
    scratch, name = Scratch(spark, "url-arrays"), f"urls-{uuid.uuid4().hex}.arrays"
    place = spark._jvm.org.apache.hadoop.fs.Path(scratch.path(name))
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    for at in range(0, len(blob), CHUNK):
        stream.write(blob[at:at + CHUNK])
    stream.close()
    spark.sparkContext.addFile(scratch.path(name))
    return name


def _key(host: str, path: str) -> bytes:
    return host.encode() + b"\xff" + path.encode()


def digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings))


def _packed(rules: pa.Table) -> bytes:
    """Both arrays as one file: counts, then keys, offsets and strings of hosts and of rules.

    A stored string is followed by what it stands for: a host by the lengths of its rules'
    paths, a rule (host and path around a byte that no UTF-8 text holds) by its verdict.
    """
    rows = rules.to_pylist()
    lengths: dict[str, set[int]] = {}
    for r in rows:
        lengths.setdefault(r["host"], set()).add(len(r["path"]))
    hosts = {h.encode(): ",".join(map(str, sorted(found))).encode() for h, found in lengths.items()}
    whole = {
        _key(r["host"], r["path"]): r["verdict"].encode() for r in rows
    }
    blocks = []
    for entries in (hosts, whole):
        keys, extras = list(entries), list(entries.values())
        found = digests(keys)
        order = np.argsort(found, kind="stable")
        strings = [s for i in order for s in (keys[i], extras[i])]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)]).astype(np.int64)
        text = b"".join(strings)
        blocks.append((found[order].tobytes(), offsets.tobytes(), text + b"\0" * (-len(text) % 8)))
    longest = max(map(len, lengths), default=0)
    head = np.array([longest, len(hosts), len(blocks[0][2]), len(whole), len(blocks[1][2])], np.int64).tobytes()
    return head + b"".join(part for block in blocks for part in block)


class SortedDigests:
    """Ascending 64-bit keys over a mapped file, with the strings that confirm a find."""

    def __init__(self, mapped: np.ndarray, at: int, rows: int, text: int):
        self.keys = mapped[at:at + 8 * rows].view(np.uint64)
        at += 8 * rows
        self.offsets = mapped[at:at + 8 * (2 * rows + 1)].view(np.int64)
        at += 8 * (2 * rows + 1)
        self.text = mapped[at:at + text]
        self.end = at + text

    def _string(self, n: int) -> bytes:
        return self.text[self.offsets[n]:self.offsets[n + 1]].tobytes()

    def find(self, strings: list[bytes]) -> list[bytes | None]:
        """What is stored with each string, None for a string that is not in the array."""
        found: list[bytes | None] = [None] * len(strings)
        wanted = digests(strings)
        low = np.searchsorted(self.keys, wanted, "left")
        high = np.searchsorted(self.keys, wanted, "right")
        for i in np.flatnonzero(low < high):
            for place in range(low[i], high[i]):
                if self._string(2 * place) == strings[i]:
                    found[i] = self._string(2 * place + 1)
        return found


class DigestArrays:
    """The host and the rule array of one published file."""

    def __init__(self, path: str):
        mapped = np.memmap(path, np.uint8, "r")
        self.longest, hosts, host_text, rules, rule_text = mapped[:40].view(np.int64).tolist()
        self.hosts = SortedDigests(mapped, 40, hosts, host_text)
        self.rules = SortedDigests(mapped, self.hosts.end, rules, rule_text)

    def _parents(self, host: str) -> list[str]:
        """The host and its parent domains, as far as a rule's host is as long."""
        first = max(0, len(host) - self.longest - 1)
        found = [host[k + 1:] for k in range(first, len(host)) if host[k] == "."]
        return [host] * (len(host) <= self.longest) + found

    def judge(self, hosts: list[str], paths: list[str], otherwise: str) -> tuple[list, list]:
        """Rule (or None) and verdict of every (host, path)."""
        parents = {h: self._parents(h) for h in set(hosts)}
        names = sorted({p for found in parents.values() for p in found})
        known = {
            n: [int(x) for x in extra.split(b",")]
            for n, extra in zip(names, self.hosts.find([n.encode() for n in names])) if extra is not None
        }
        # Candidates from the longest rule down; only hosts that have rules ask for paths.
        asked: dict[tuple[str, str], None] = {}
        wanted: list[list[tuple[str, str]]] = []
        for host, path in zip(hosts, paths):
            mine = [
                (p, path[:length]) for p in parents[host] if p in known for length in known[p] if length <= len(path)
            ]
            mine.sort(key=lambda c: (-len(c[0]) - len(c[1]), -len(c[0])))
            wanted.append(mine)
            asked.update(dict.fromkeys(mine))
        keys = list(asked)
        verdicts = dict(zip(keys, self.rules.find([_key(h, p) for h, p in keys])))
        rule, verdict = [], []
        for mine in wanted:
            best = next((c for c in mine if verdicts[c] is not None), None)
            rule.append(best and best[0] + best[1])
            verdict.append(verdicts[best].decode() if best else otherwise)
        return rule, verdict
