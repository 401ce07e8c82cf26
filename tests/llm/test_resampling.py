import random
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm.resampling import kth_largest, log_ratios, ngrams, resample

GOOD = [f"good{i}" for i in range(80)]
JUNK = [f"junk{i}" for i in range(80)]


@pytest.fixture(scope="module")
def tables(spark, documents):
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choices(JUNK if i % 4 == 0 else GOOD, k=rng.randint(5, 40)))) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 800, 3)], "doc_id long, quality int, toxic int")
    return rows, documents(rows), labels


def test_target_texts_are_drawn(tables):
    rows, docs, labels = tables
    got = resample(docs, labels, buckets=1024).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == 800 and abs(len(kept) - 600) <= 2
    assert sum(i % 4 != 0 for i in kept) >= 590


def test_ratios_equal_plain_counts(spark, documents):
    rng = random.Random(32)
    rows = [(i, " ".join(rng.choices(GOOD, k=rng.randint(0, 9)))) for i in range(60)]
    df = documents(rows).selectExpr("text", "doc_id % 3 = 0 AS target")
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(ngrams(text, 64).tolist())
        if i % 3 == 0:
            target.update(ngrams(text, 64).tolist())
    counts = np.array([[raw[b] + 1 for b in range(64)], [target[b] + 1 for b in range(64)]], dtype=float)
    chance = counts / counts.sum(axis=1, keepdims=True)
    assert np.allclose(log_ratios(df.repartition(5), 64, 1.0), np.log(chance[1] / chance[0]))


def test_ngrams_are_words_and_pairs():
    a, b, c = (ngrams(t, 1 << 15) for t in ("x y", "X\ty\n", "y x"))
    assert len(a) == 3 and (a == b).all()
    assert sorted(a[:2]) == sorted(c[:2]) and a[2] != c[2]
    assert len(ngrams(None, 8)) == len(ngrams(" ", 8)) == 0


def test_gumbel_keys_draw_by_importance(spark, documents):
    """Two equal halves of weight e to 1: about e/(1+e) of the first draws come from the first."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 1.0, 0.0) AS log_ratio")
    from pyspark.sql import functions as F
    chance = (F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    keyed = df.withColumn("key", F.col("log_ratio") - F.log(-F.log(chance)))
    first = keyed.orderBy(F.desc("key")).limit(2000).agg(F.avg((F.col("doc_id") % 2 == 0).cast("int"))).first()[0]
    assert abs(first - np.e / (1 + np.e)) < 0.03


@pytest.mark.parametrize("k", [1, 2, 17, 4000, 29_999, 30_000])
def test_kth_largest(spark, k):
    df = spark.range(30_000).selectExpr("cast(pmod(xxhash64(id), 9973) AS double) / 7 - 100 AS key", "id")
    want = sorted((r["key"] for r in df.collect()), reverse=True)[k - 1]
    assert kth_largest(df, "key", k) == want


def test_kth_largest_of_ties_and_too_few(spark):
    df = spark.range(20_000).selectExpr("1.5 AS key")
    assert kth_largest(df, "key", 500) == 1.5
    assert kth_largest(df, "key", 20_001) is None and kth_largest(df.limit(0), "key", 1) is None


def test_odd_rows(spark, documents, odd_rows):
    schema = "doc_id long, quality int, toxic int"
    docs = documents(odd_rows).selectExpr("*", "1 AS target", "2 AS kept", "3 AS log_ratio")
    for labels in ([], [(1, None, 0), (None, 1, 1)], [(4, 1, 0), (4, 0, 0), (6, 0, 1)]):
        got = resample(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(odd_rows)
        assert all(r["log_ratio"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["kept"] for r in resample(docs, spark.createDataFrame([], schema)).collect())
    assert resample(documents([]), spark.createDataFrame([(1, 1, 0)], schema)).count() == 0
