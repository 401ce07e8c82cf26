"""WARC records as rows: writing and reading archives, and their Merkle fixity audit.

An archive file is a sequence of records; a record's place is its byte offset.  Its tree has
the records' hashes as leaves, then nodes over ordered offset ranges, each level's range
``fanout`` times the one below, and one root a file.  A node's hash covers its children's
places and hashes in order, so equal nodes have equal subtrees.

The audit compares the roots of two replicas, then descends: at every level only the
children of nodes that differ are compared, so intact archives cost one row each and damage
costs its path from the root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plantpulse.llm.common import Scratch

VERSION = "WARC/1.0"
END = "\r\n\r\n"
LEAF_RANGE = 1 << 16
FANOUT = 16
LEVELS = 3


def record_text(url: Column, payload: Column, date: Column, kind: str = "resource") -> Column:
    """A whole record without the two line ends that follow it."""
    body = F.coalesce(payload, F.lit(""))
    identity = F.sha2(F.concat_ws("\n", url, body), 256)
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:sha256:"), identity,
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(END),
    )
    return F.concat(head, body)


def record_leaves(records: DataFrame, order: str) -> DataFrame:
    """(file, offset, hash) of (file, ``order``, record) rows: archives in the making.

    Records are hashed where they are; only hashes and lengths move, into ranges of records
    that one task can place, however many an archive has.  Records of one archive are in the
    order of ``order``; ties share an archive in an order that is fixed once.  A null file
    name is an archive of its own, a null record an empty one; no rows give no rows.
    """
    thin = records.select(
        "file", F.col(order).alias("at"), (F.octet_length(F.coalesce("record", F.lit(""))) + len(END)).cast("long").alias("size"),
        leaf_hash("record").alias("hash"),
    )
    placed = _running(_ranges(thin, Scratch(records.sparkSession, "leaves"), ["file", "at", "hash"]), F.sum, "size", "offset")
    return placed.select("file", F.coalesce("offset", F.lit(0).cast("long")).alias("offset"), "hash")


def _ranges(rows: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """The rows in ranges of ``order``, written once: ``part`` numbers them, ``nth`` the rows in order."""
    laid_out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.write(laid_out.withColumns({
        "part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "ranges")


def _running(rows: DataFrame, total: Callable, value: str, name: str, itself: bool = False) -> DataFrame:
    """Add ``name``: sum or maximum of ``value`` over the rows of a file before this one.

    Every range runs on its own; what lies in the ranges before comes from a row a range and
    file.  With ``itself`` the row counts too; where nothing counts the result is null.
    """
    within = Window.partitionBy("part", "file").orderBy("nth").rowsBetween(
        Window.unboundedPreceding, 0 if itself else -1)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("part", "file").agg(total(value).alias("_all")).select(
        F.col("part").alias("_part"), F.col("file").alias("_file"), total("_all").over(before).alias("_carried"))
    joined = rows.withColumn("_here", total(value).over(within)).join(
        carried, (F.col("part") == F.col("_part")) & F.col("file").eqNullSafe(F.col("_file")), "left")
    here, ahead = F.col("_here"), F.col("_carried")
    both = F.coalesce(here + ahead, here, ahead) if total is F.sum else F.greatest(here, ahead)
    return joined.withColumn(name, both).drop("_here", "_part", "_file", "_carried")


def leaf_hash(record: str) -> Column:
    """Hash of a record's bytes; a null record is an empty one."""
    return F.sha2(F.coalesce(F.col(record), F.lit("")).cast("binary"), 256)


def write_archive(records: DataFrame, path: str) -> None:
    """Write (file, offset, record) as archives, one folder a file, records in order.

    A null record is written as an empty one; no rows write an empty folder.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select("file", "offset", F.coalesce("record", F.lit("")).alias("value")).repartition(parts, "file")
    (rows.sortWithinPartitions("file", "offset").select("file", "value")
     .write.partitionBy("file").option("lineSep", END).text(path))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record) of archives written by any tool, payloads as they are.

    Files are split at the version line, so a large archive is read by many tasks.  A piece
    that is shorter than its Content-Length (the payload holds a version line itself) takes
    the following pieces in until it is whole.  Places are found on thin rows, without
    payloads and in ranges, so no task gets a whole archive; payloads are joined back by
    piece, and meet each other only where a record has several.  Empty files give no rows.
    """
    scratch = Scratch(spark, "archive")
    text = spark.read.option("lineSep", f"{VERSION}\r\n").text(path)
    body = F.col("value").cast("binary")
    head = F.substring_index(F.decode(body, "ISO-8859-1"), END, 1)
    said = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d+)", 1)
    mark = len(VERSION) + 2
    claimed = F.when(said != "", F.octet_length(F.encode(head, "ISO-8859-1")) + 4 + said.cast("long") + mark)
    pieces = scratch.write(text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"), (F.octet_length(body) + mark).cast("long").alias("size"),
        claimed.alias("claimed"), body.alias("value"),
    ).filter(F.octet_length("value") > 0), "pieces")
    thin = _ranges(pieces.drop("value"), scratch, ["file", "block", "piece"])
    placed = _running(thin, F.sum, "size", "at").withColumn("at", F.coalesce("at", F.lit(0).cast("long")))
    # Places are compared on the payloads' own claims: a piece inside an earlier record's
    # reach belongs to it.
    reached = _running(placed.withColumn("end", F.col("at") + F.col("claimed")), F.max, "end", "reach")
    inside = F.coalesce(F.col("at") < F.col("reach"), F.lit(False))
    begun = _running(reached.withColumn("start", F.when(~inside, F.col("at"))), F.max, "start", "first", itself=True)
    pieces_of = F.count("*").over(Window.partitionBy("file", "first"))
    known = begun.select(F.col("piece").alias("_piece"), "at", "first", pieces_of.alias("together"))
    met = pieces.join(known, F.col("piece") == F.col("_piece"))
    version = F.encode(F.lit(f"{VERSION}\r\n"), "ISO-8859-1")
    single = met.filter("together = 1").select("file", "first", "claimed", F.concat(version, "value").alias("whole"))
    several = met.filter("together > 1").groupBy("file", "first").agg(
        F.max("claimed").alias("claimed"),
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("pieces"),
    ).select("file", "first", "claimed", F.aggregate(
        "pieces", F.lit("").cast("binary"), lambda so_far, p: F.concat(so_far, version, p["value"])
    ).alias("whole"))
    kept = F.least(F.octet_length("whole"), F.coalesce(F.col("claimed"), F.octet_length("whole")))
    record = F.substring("whole", F.lit(1), kept.cast("int"))
    return single.unionAll(several).select(
        "file", F.col("first").alias("offset"), F.octet_length(record).cast("long").alias("length"), record.alias("record")
    )


def merkle_tree(leaves: DataFrame, scratch: Scratch, name: str, leaf_range: int, fanout: int, levels: int) -> list:
    """(file, node, hash) of every level, leaves first, the root last."""
    leaves = leaves.filter("file is not null and offset is not null").groupBy(
        "file", F.col("offset").alias("node")
    ).agg(F.array_join(F.array_sort(F.collect_set("hash")), " ").alias("hash"))
    tree = [scratch.write(leaves, f"{name}-0")]
    for level in range(1, levels + 2):
        # A range holds the records that begin in it, a node above ``fanout`` ranges.
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        said = F.transform("children", lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["hash"]))
        grown = (
            tree[-1].groupBy("file", _parent(level, leaf_range, fanout, levels).alias("parent"))
            .agg(children.alias("children"))
            .select("file", F.col("parent").alias("node"), F.sha2(F.array_join(said, "\n"), 256).alias("hash"))
        )
        tree.append(scratch.write(grown, f"{name}-{level}"))
    return tree


def _parent(level: int, leaf_range: int, fanout: int, levels: int) -> Column:
    """Number, at ``level``, of the node above a node of the level below."""
    if level > levels:
        return F.lit(0).cast("long")
    return F.floor(F.col("node") / (leaf_range if level == 1 else fanout)).cast("long")


def _differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, node, expected_hash, found_hash) where the two sides differ."""
    left = expected.withColumnRenamed("hash", "expected_hash")
    right = found.withColumnRenamed("hash", "found_hash")
    return left.join(right, ["file", "node"], "full").filter(
        ~F.col("expected_hash").eqNullSafe(F.col("found_hash"))
    )


def fixity_audit(
    expected: DataFrame, found: DataFrame, leaf_range: int = LEAF_RANGE, fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """Records at which two replicas differ, one row each: file, offset, kind,
    expected_hash, found_hash, expected_root, found_root.

    Both sides are leaves: file, offset, hash.  ``kind`` is ``changed`` (other bytes at the
    same place), ``missing`` or ``extra``; a record that moved is missing at its old place
    and extra at the new one.  Rows repeating a place count once if their hashes are equal
    and are compared as the sorted list of them if not.  Rows with a null file or offset
    belong to no tree and are not audited.  Empty replicas give no rows, one empty replica
    all rows of the other; further columns are not read.
    """
    scratch = Scratch(expected.sparkSession, "fixity")
    sides = [
        merkle_tree(side, scratch, name, leaf_range, fanout, levels)
        for name, side in (("expected", expected), ("found", found))
    ]
    differ = roots = scratch.write(_differences(sides[0][-1], sides[1][-1]), "differ-root")
    for level in range(levels, -1, -1):
        above = differ.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
        parent = _parent(level + 1, leaf_range, fanout, levels)
        below = [
            tree[level].join(above, (F.col("file") == F.col("_file")) & (parent == F.col("_node")), "left_semi")
            for tree in sides
        ]
        differ = scratch.write(_differences(*below), f"differ-{level}")
    for level in range(levels + 2):
        scratch.drop(f"expected-{level}", f"found-{level}")
    kind = F.when(F.col("found_hash").isNull(), "missing").when(F.col("expected_hash").isNull(), "extra")
    named = roots.select(
        "file", F.col("expected_hash").alias("expected_root"), F.col("found_hash").alias("found_root")
    )
    return differ.join(named, "file").select(
        "file", F.col("node").alias("offset"), kind.otherwise("changed").alias("kind"),
        "expected_hash", "found_hash", "expected_root", "found_root",
    )
