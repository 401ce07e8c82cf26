import random
import re

import pytest

from plantpulse.llm.spaced_seeds import MASKS, overlaps, without_overlaps

VOCABULARY = [f"w{i}" for i in range(400)]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def plain(docs, items, least=0.8):
    """Best aligned overlap of every document with every item."""
    found = {}
    for i, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for j, item in items:
            own = re.findall(r"[^\W_]+", (item or "").lower())
            if len(own) < 5:
                continue
            best = max(
                (sum(words[s + k] == own[k] for k in range(len(own)) if 0 <= s + k < len(words))
                 for s in range(-len(own), len(words))), default=0,
            )
            if best >= least * len(own):
                found[i, j] = max(best, found.get((i, j), 0))
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    items = [(j, " ".join(passage(rng, rng.randint(15, 40)))) for j in range(12)]
    docs = []
    for i in range(80):
        words = passage(rng, rng.randint(0, 60))
        if i % 3 == 0:
            own = items[i % 12][1].split()
            for at in rng.sample(range(len(own)), int(0.2 * len(own)) if i % 2 else 0):
                own[at] = "changed"
            cut = rng.randint(0, len(words))
            words = words[:cut] + own + words[cut:]
        docs.append((i, " ".join(words).title()))
    return docs, items


@pytest.mark.parametrize("small", [200_000, 1])
def test_equals_the_plain_search(spark, documents, corpus, small):
    docs, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in overlaps(documents(docs), benchmark, small=small).collect()}
    assert got == plain(docs, items)
    assert len(got) >= 27


def test_masks_ignore_positions_and_find_any_fifth_of_substitutions():
    from itertools import combinations
    assert all(mask[-1] >= len(mask) for mask in MASKS)
    for length in range(6, 25):
        seeds = [sum(1 << (at + o) for o in mask) for mask in MASKS for at in range(length - mask[-1])]
        for changed in combinations(range(length), length // 5):
            bits = sum(1 << at for at in changed)
            assert any(not seed & bits for seed in seeds)


def test_many_short_items_are_not_broadcast(spark, documents, monkeypatch):
    """Items without a seed are dropped before anything is counted or sent."""
    from plantpulse.llm import spaced_seeds

    sent = []
    monkeypatch.setattr(spaced_seeds.F, "broadcast", lambda df: sent.append(df.count()) or df)
    short = [(n, f"answer {n}") for n in range(500)] + [(900, "one two three four five")]
    benchmark = spark.createDataFrame(short, "item_id long, text string")
    got = overlaps(documents([(1, "zero one two three four five six"), (2, "answer 7")]), benchmark).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 900)]
    assert sent and max(sent) == 1


def test_inserted_word_is_bridged(spark, documents):
    rng = random.Random(9)
    own = passage(rng, 30)
    text = " ".join([*passage(rng, 10), *own[:14], "extra", *own[14:], *passage(rng, 9)])
    benchmark = spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")
    row = overlaps(documents([(3, text)]), benchmark).first()
    assert (row["doc_id"], row["n_words"]) == (3, 30) and row["n_matched"] >= 28


def test_odd_rows(spark, documents, odd_rows):
    benchmark = spark.createDataFrame(
        [(1, None), (2, ""), (3, "too short"), (None, "Same, text HERE for all"), (5, "same text here for all"),
         (5, "same text here for all")], "item_id long, text string",
    ).selectExpr("*", "7 AS item", "8 AS seed", "9 AS at")
    docs = documents(odd_rows).selectExpr("*", "1 AS item_id", "2 AS shift", "3 AS seed")
    got = {(r["doc_id"], r["item_id"]) for r in overlaps(docs, benchmark).collect()}
    assert got == {(i, j) for i in (4, 5, None) for j in (5, None)}
    left = without_overlaps(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6, 7, 8, 9]


def test_empty_tables(spark, documents, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert overlaps(documents(odd_rows), none).count() == 0
    assert without_overlaps(documents(odd_rows), none).count() == len(odd_rows)
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert overlaps(documents([]), some).count() == 0
