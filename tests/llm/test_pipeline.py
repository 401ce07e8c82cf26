"""Each stage against a plain version on its own input, and the queries against their SQL."""
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plantpulse.llm import registry
from plantpulse.llm.common import Scratch

from tests.llm.test_anchors import plain_components, plain_hash
from tests.llm.test_line_runs import plain as plain_lines
from tests.llm.test_spaced_seeds import plain as plain_overlaps

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.write(stage(spark, out[-1], SF), str(number)))
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(stages):
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_takes_insults_and_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = dict(pairs(docs)), dict(pairs(corpus_pipeline.toxicity(spark, docs, sf)))
    assert after.items() <= before.items()
    insults = {"idiot", "moron", "scum", "pathetic", "worthless", "clown", "stupid", "loser", "trash"}
    rude = {i for i, t in before.items() if insults & set(t.lower().split())}
    clean = {
        r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0").collect()
    }
    assert len(rude & after.keys()) <= 0.1 * len(rude)
    assert len(clean & after.keys()) >= 0.98 * len(clean)


def test_lines(stages):
    want = sorted((i, kept) for i, _, _, kept in plain_lines(pairs(stages[1])))
    assert pairs(stages[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    rows = pairs(stages[2])
    roots = plain_components([plain_hash(t) for _, t in rows])
    assert pairs(stages[3]) == [row for n, row in enumerate(rows) if roots[n] == n]


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = pairs(stages[3])
    leaks = {i for i, _ in plain_overlaps(rows, items)}
    assert leaks and pairs(stages[4]) == [row for row in rows if row[0] not in leaks]


def test_packing(stages):
    from tokenizers import Tokenizer

    from plantpulse.llm.tokens import word_bpe_path

    tokenizer = Tokenizer.from_file(word_bpe_path())
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs(stages[4])}
    got = {}
    for r in stages[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, stages[5].drop("sequence_id", "offset").collect())
    )


def norm(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_are_registered(name):
    assert entry.queries()[name] is registry.QUERIES[name]


def test_thirteen_operators_and_the_pipeline():
    names = sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
