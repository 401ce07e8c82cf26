import random
import re

import numpy as np
import pytest
import xxhash

from plantpulse.llm import anchors
from plantpulse.llm.anchors import blocks_of, fingerprint_links, near_duplicates, simhash, without_near_duplicates
from plantpulse.llm.common import Scratch
from plantpulse.llm.components import connected_components


def plain_hash(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=4):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \t", "one", "a b c", "a b c d", "É b\x0bC d e f g H i", "x y " * 5000])
def test_simhash(text):
    assert int.from_bytes(simhash(text), "big") == plain_hash(text)


def near_values(rng, n):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(base)
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                base ^= 1 << bit
    return out


@pytest.mark.parametrize("blocks", [2, 3])
def test_linked_values_share_an_anchor(blocks):
    """Every pair within four bits meets at the home of the one and a replica of the other."""
    rng = random.Random(2)
    codes = blocks_of(blocks, 4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 4):
            y ^= 1 << bit
        both = []
        for value in (x, y):
            homes, all_ = set(), set()
            for number, code in enumerate(codes):
                for anchor, _, home in code.anchors(np.array([value], dtype=np.uint64)):
                    for a in anchor.tolist():
                        all_.add((number, a))
                        if home:
                            homes.add((number, a))
            assert len(homes) == blocks
            both.append((homes, all_))
        assert both[0][0] & both[1][1] and both[1][0] & both[0][1]


@pytest.mark.parametrize("options", [{"blocks": 3}, {"blocks": 2}, {"blocks": 3, "crowd": 2}, {"blocks": 2, "crowd": 7}])
def test_links_join_what_all_pairs_join(spark, options):
    rng = random.Random(7)
    values = list(dict.fromkeys(near_values(rng, 150) + [0, 1, 3, 7, 15, 31, 63, 127, 255]))
    ball = rng.getrandbits(64)
    values += [v for v in {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} if v not in values]
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    scratch = Scratch(spark, "test")
    links = scratch.write(fingerprint_links(df, scratch, **options), "links")
    assert links.count() <= 60 * len(values)
    roots = {r["node"]: r["root"] for r in connected_components(links, scratch).collect()}
    want = plain_components(values)
    groups, mine = {}, {}
    for i, v in enumerate(signed):
        groups.setdefault(want[i], set()).add(v)
        mine.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_large_anchor_passes_on_a_forest():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = np.array([base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)], dtype=np.uint64)
    values = np.unique(values)
    out = []
    anchors._meet_large(values, values, 4, out)
    assert len(out) <= 2 * len(values)
    want = plain_components([int(v) for v in values])
    assert len(set(want)) == 1


def test_documents(documents, odd_rows):
    rng = random.Random(3)
    rows = list(odd_rows)
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(200)]
        rows.append((200 + 3 * i, " ".join(words)))
        words[rng.randrange(200)] = "edited"
        rows.append((201 + 3 * i, " ".join(words)))
    values = [plain_hash(t) for _, t in rows]
    roots = plain_components(values)
    lowest = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            lowest[root] = min(lowest.get(root, i), i)
    want = sorted(((i, f"{v:016x}", lowest.get(r)) for (i, _), v, r in zip(rows, values, roots)), key=repr)
    got = near_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == want
    stay = without_near_duplicates(documents(rows)).collect()
    assert len(stay) == len(set(roots))
    assert sorted(r["doc_id"] for r in stay) == sorted(lowest.values())


def test_empty_and_clashing_columns(documents):
    assert near_duplicates(documents([])).count() == 0
    df = documents([(1, "a b"), (2, "a b"), (None, "c")]).selectExpr("*", "1 AS fp", "2 AS `row`", "3 AS _own", "4 AS _best")
    out = without_near_duplicates(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, None}


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    df = spark.createDataFrame(chain + hub, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(400)}


def test_crowded_anchors_are_spread(spark):
    """No task of a crowded anchor gets more rows than two chunks, and every home meets every row."""
    rng = random.Random(4)
    near = list({0xABC ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)})
    values = np.array(near, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(1, v, n % 3 == 0) for n, v in enumerate(values)] + [(2, 7, False)],
                                 "anchor long, fp long, guest boolean")
    dealt = anchors._dealt(rows, Scratch(spark, "test"), 50).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r["anchor"], r["chunk"]), []).append(r)
    assert tasks.pop((2, 0)) and len(tasks) == -(-sum(n % 3 != 0 for n in range(len(values))) // 50) * -(-len(values) // 50)
    assert max(map(len, tasks.values())) < 200
    met = {(h["fp"], x["fp"]) for task in tasks.values() for h in task if not h["guest"] for x in task if x["guest"]}
    homes = [v for n, v in enumerate(values) if n % 3]
    assert met == {(h, v) for h in homes for v in values}
