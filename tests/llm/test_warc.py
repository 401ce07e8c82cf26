import hashlib

import pytest
from pyspark.sql import functions as F

from plantpulse.llm.common import Scratch
from plantpulse.llm.warc import END, fixity_audit, leaf_hash, read_archive, record_leaves, record_text, write_archive


@pytest.fixture(scope="module")
def records(spark):
    rows = [(n, n // 40, f"http://e.x/{n}", f"<p>{'é' * (n % 7)} {n}\r\n\r\n{'x' * (n * 37 % 900)}") for n in range(200)]
    rows[13] = (13, 0, "http://e.x/13", "it says WARC/1.0\r\nWARC-Type: fake\r\n\r\nin the middle")
    rows[14] = (14, 0, None, None)
    df = spark.createDataFrame(rows, "page_id long, file long, url string, html string")
    return df.withColumn("record", record_text(F.col("url"), F.col("html"), F.lit("2024-01-01T00:00:00Z")))


def offsets(rows):
    at, out = {}, {}
    for r in rows:
        out[r["page_id"]] = (r["file"], at.get(r["file"], 0))
        at[r["file"]] = at.get(r["file"], 0) + len(r["record"].encode()) + len(END)
    return out


def test_leaves_lie_at_their_byte_offsets(records):
    rows = records.orderBy("page_id").collect()
    place = offsets(rows)
    want = {(*place[r["page_id"]], hashlib.sha256(r["record"].encode()).hexdigest()) for r in rows}
    assert {tuple(r) for r in record_leaves(records, "page_id").collect()} == want


def test_archives_are_read_back(spark, records):
    scratch = Scratch(spark, "warc")
    rows = records.orderBy("page_id").collect()
    place = offsets(rows)
    placed = spark.createDataFrame(
        [(place[r["page_id"]][0], place[r["page_id"]][1], r["record"]) for r in rows],
        "file long, offset long, record string",
    )
    write_archive(placed, scratch.path("files"))
    back = read_archive(spark, scratch.path("files")).collect()
    assert {(r["offset"], bytes(r["record"])) for r in back} == {
        (place[r["page_id"]][1], r["record"].encode()) for r in rows
    }
    assert len(back) == len(rows)
    assert all(r["length"] == len(r["record"]) for r in back)


def test_archives_in_many_splits(spark, records):
    """One archive holds almost all records and is read in many splits; the places are the same."""
    scratch = Scratch(spark, "warc")
    rows = records.orderBy("page_id").collect()
    one = records.withColumn("file", F.lit(7).cast("long"))
    place, at = {}, 0
    for r in rows:
        place[r["page_id"]], at = at, at + len(r["record"].encode()) + len(END)
    leaves = record_leaves(one, "page_id")
    want = {(7, place[r["page_id"]], hashlib.sha256(r["record"].encode()).hexdigest()) for r in rows}
    assert {tuple(r) for r in leaves.collect()} == want
    write_archive(spark.createDataFrame(
        [(7, place[r["page_id"]], r["record"]) for r in rows], "file long, offset long, record string"
    ), scratch.path("one"))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for key in keys:
            spark.conf.set(key, "4k")
        back = read_archive(spark, scratch.path("one"))
        got = back.collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert {(r["offset"], bytes(r["record"])) for r in got} == {(place[r["page_id"]], r["record"].encode()) for r in rows}
    assert len(got) == len(rows)


def test_unnamed_archives_and_no_records(spark):
    rows = spark.createDataFrame(
        [(None, 1, "a", 0), (None, 2, None, 0), ("f", 1, "b", 0)], "file string, n int, record string, offset int")
    got = sorted((r["file"] or "", r["offset"]) for r in record_leaves(rows, "n").collect())
    assert got == [("", 0), ("", 5), ("f", 0)]
    assert record_leaves(rows.limit(0), "n").count() == 0


def plain(expected, found):
    a = {(r["file"], r["offset"]): r["hash"] for r in expected.collect()}
    b = {(r["file"], r["offset"]): r["hash"] for r in found.collect()}
    kind = lambda k: "missing" if k not in b else "extra" if k not in a else "changed"
    return {(*k, kind(k), a.get(k), b.get(k)) for k in a | b if a.get(k) != b.get(k)}


@pytest.mark.parametrize("size", [{}, {"leaf_range": 512, "fanout": 2, "levels": 5}, {"leaf_range": 4096, "levels": 0}])
def test_damage_is_located(records, size):
    changed = F.when(F.col("page_id").isin(3, 77, 199), F.overlay("record", F.lit("#"), F.lit(9))).otherwise(F.col("record"))
    longer = F.when(F.col("page_id") == 130, F.concat("record", F.lit("!"))).otherwise(changed)
    damaged = records.withColumn("record", longer).filter("page_id not in (39, 199)")
    expected, found = record_leaves(records, "page_id"), record_leaves(damaged, "page_id")
    got = fixity_audit(expected, found, **size).collect()
    assert {tuple(r)[:5] for r in got} == plain(expected, found)
    assert len({r["expected_root"] for r in got}) == len({r["file"] for r in got}) == 4
    assert all(r["expected_root"] != r["found_root"] for r in got)
    assert fixity_audit(expected, expected, **size).count() == 0


def test_odd_rows(spark):
    schema = "file string, offset long, record string, node long, `hash` string"
    side = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], schema).select(
        "file", "offset", "record", leaf_hash("record").alias("hash"), "node")
    a = side([("f", 0, None), ("f", 9, "a"), ("f", 9, "a"), ("f", 20, "b"), (None, 0, "c"), ("f", None, "d"), ("g", 0, "e")])
    b = side([("f", 0, ""), ("f", 9, "a"), ("f", 20, "b"), ("f", 20, "B"), ("h", 0, "e")])
    got = {(r["file"], r["offset"], r["kind"]) for r in fixity_audit(a, b).collect()}
    assert got == {("f", 20, "changed"), ("g", 0, "missing"), ("h", 0, "extra")}
    none = side([]).limit(0)
    assert fixity_audit(none, none).count() == 0
    assert {r["kind"] for r in fixity_audit(a, none).collect()} == {"missing"}


def test_no_python_on_the_path(records):
    leaves = record_leaves(records, "page_id")
    assert "Python" not in fixity_audit(leaves, leaves)._jdf.queryExecution().toString()
