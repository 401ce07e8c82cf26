import random
import zlib

import numpy as np
import pytest

from plantpulse.llm.toxicity import (
    Lexicon, features, fit, label_model, logistic, mine_lexicon, toxicity, training_sample, without_toxic,
)

INSULTS = ["idiot", "moron", "scum", "vequx"]
WORDS = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"]


def corpus(rng, n):
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        if toxic:
            for insult in rng.sample(INSULTS, rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), insult + ("que" if insult == "vequx" else "") + rng.choice(["", ",", "!"]))
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.1 else text, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, documents):
    rows = corpus(random.Random(21), 900)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    truth = {i: y for i, _, y in rows}
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_labels_of_the_held_out_fold_are_never_read(spark, tables):
    rows, docs, labels = tables
    flipped = spark.createDataFrame(
        [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows],
        "doc_id long, quality int, toxic int",
    )
    a = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity(docs, flipped).collect()}
    assert a == b
    assert all(zlib.crc32(str(i).encode()) % 5 for i in [r[0] for r in docs.limit(0).collect()])


def test_wrong_labels_are_outvoted():
    rng = random.Random(22)
    rows = corpus(rng, 1500)
    labels = np.array([1 - y if rng.random() < 0.05 else y for _, _, y in rows])
    model = fit([t for _, t, _ in rows], labels)
    lexicon = Lexicon(model.lexicon)
    truth = np.array([y for _, _, y in rows])
    score = np.array([
        model.bias + sum(model.weights[i] * v for i, v in features(t, lexicon).items()) for _, t, _ in rows
    ])
    assert ((score >= 0) == truth).mean() > 0.99


def test_mined_entries_cover_words_and_beginnings():
    rows = corpus(random.Random(23), 1200)
    texts, toxic = [t for _, t, _ in rows], np.array([y for _, _, y in rows])
    lexicon = Lexicon(mine_lexicon(texts, toxic))
    assert all(lexicon.counts(f"a {w} b") for w in ("idiot", "moron", "scum", "vequxque"))
    assert not lexicon.counts("xidiot wordak")


def test_label_model_finds_accuracies_and_shares_copies():
    rng = np.random.default_rng(24)
    truth = rng.random(4000) < 0.3
    def voter(accuracy):
        right = rng.random(4000) < accuracy
        cast = rng.random(4000) < 0.8
        return np.where(cast, np.where(right == truth, 1, -1), 0)
    votes = np.stack([voter(0.9), voter(0.8), voter(0.7), voter(0.6)], axis=1)
    copied = np.hstack([votes, votes[:, [3]], votes[:, [3]], votes[:, [3]]])
    start = np.where(votes[:, 0] > 0, 0.8, 0.2)
    posterior, odds, related = label_model(votes, start, 0.3)
    assert ((posterior > 0.5) == truth).mean() > 0.88
    assert odds[0, 1] > odds[1, 1] > odds[2, 1] > odds[3, 1] > 0
    again, _, related = label_model(copied, start, 0.3)
    assert related[3, 4] > 0.9 and related[0, 3] < 0.3
    assert ((again > 0.5) == truth).mean() > 0.86


def test_logistic_recovers_weights():
    rng = np.random.default_rng(25)
    x = rng.normal(size=(20_000, 3))
    chance = 1 / (1 + np.exp(-(x @ [1.5, -2.0, 0.0] + 0.5)))
    weights, bias = logistic(x, chance)
    assert np.allclose(weights, [1.5, -2.0, 0.0], atol=0.01) and abs(bias - 0.5) < 0.01


def test_odd_rows(spark, documents, odd_rows, tables):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    got = toxicity(documents(odd_rows).selectExpr("*", "1 AS score", "2 AS held_out"), none).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] < 0.5 for r in got)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 1, 0), (4, 1, 1), (6, 0, 0)], schema)
    assert len(toxicity(documents(odd_rows), odd).collect()) == len(odd_rows)
    assert toxicity(documents([]), odd).count() == 0
    rows, docs, labels = tables
    model = fit(*training_sample(docs, labels))
    wide = documents([(1, "a scum b"), (2, "a b"), (3, None)]).selectExpr("*", "array(1, 2) AS score", "map('a', 1) AS m")
    left = without_toxic(wide, model)
    assert left.columns == wide.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_sample_is_bounded(monkeypatch, tables):
    from plantpulse.llm import toxicity as module

    rows, docs, labels = tables
    monkeypatch.setattr(module, "SAMPLE_BYTES", 20_000)
    texts, marks, _ = training_sample(docs, labels)
    assert len(texts) == len(marks) and 0 < sum(map(len, texts)) <= 20_000
    monkeypatch.setattr(module, "SAMPLE_ROWS", 50)
    texts, marks, share = training_sample(docs, labels)
    assert 10 < len(texts) < 100
    assert share < 0.5 and marks.sum() >= min(25, share * len(rows)) * 0.5


def test_long_texts_do_not_end_the_sample(spark, documents, monkeypatch):
    from plantpulse.llm import toxicity as module

    monkeypatch.setattr(module, "SAMPLE_TEXT", 2000)
    rows = [(n, "a long text " * 400 if n % 5 < 2 else f"you scum number {n}" if n % 10 == 3 else f"fine words {n}")
            for n in range(400)]
    labels = spark.createDataFrame([(n, 0, int("scum" in t)) for n, t in rows], "doc_id long, quality int, toxic int")
    texts, marks, _ = training_sample(documents(rows), labels)
    kept = [n for n, t in rows if len(t) <= 2000]
    assert 0.7 * len(kept) < len(texts) <= len(kept) and marks.sum() > 20
    monkeypatch.setattr(module, "SAMPLE_TEXT", 1 << 20)
    monkeypatch.setattr(module, "SAMPLE_BYTES", 6000)
    texts, _, _ = training_sample(documents(rows), labels)
    assert sum(map(len, texts)) <= 6000 and len(texts) > 50


def test_rare_toxic_rows_are_drawn_whole_and_weighed_back(monkeypatch, spark, documents):
    from plantpulse.llm import toxicity as module

    rng = random.Random(30)
    rows = [(n, ("scum " if n % 50 == 0 else "") + " ".join(f"w{rng.randrange(300)}" for _ in range(30))) for n in range(4000)]
    labels = spark.createDataFrame([(n, 0, int(n % 50 == 0)) for n, _ in rows], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(module, "SAMPLE_ROWS", 400)
    texts, marks, share = training_sample(documents(rows), labels)
    assert len(texts) < 500 and marks.sum() > 50 and abs(share - 0.02) < 0.005
    plain, weighed = fit(texts, marks), fit(texts, marks, share)
    assert weighed.bias < plain.bias
