import math

import numpy as np
import pytest

from plantpulse.llm import pivot_codes
from plantpulse.llm.pivot_codes import chosen_pivots, compress, distances, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """The same codes with every distance computed in Python integers."""
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    whole = [[math.floor(1024 * float(np.float32(c))) for c in r[1]] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))[:entries]
    width = len(whole[0]) // parts
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    book = [[cut[i][p] for i in first] for p in range(parts)]

    def near(x, b):
        return min((sum((u - v) ** 2 for u, v in zip(x, e)), k) for k, e in enumerate(b))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(near(x[p], book[p])[1], []).append(x[p])
            moved.append([
                [sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book[p])
            ])
        book = moved
    found = [[near(x[p], book[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(rows, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    text = ",".join(str(c) for b in book for e in b for c in e)
    return [
        (r[0], "".join(f"{k:02x}" for _, k in f), e, labels[r[2]], text) for r, f, e in zip(rows, found, errors)
    ]


def run(spark, rows, **args):
    out = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **args)
    return [(r["vec_id"], *r["coded"]) for r in out.collect()]


def vectors(n, width, seed=1, labels=3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(5, width)) * 0.3
    return [
        (k, (middle[k % 5] + draw.normal(size=width) * 0.1).tolist(), None if k % 7 == 0 else k % labels)
        for k in range(n)
    ]


def test_codes_equal_a_plain_search(spark):
    rows = vectors(300, 8)
    got = run(spark, rows, parts=4, entries=32, rounds=3, pivots=4)
    assert sorted(got) == sorted(plain(rows, 4, 32, 3))


def test_nulls_infinities_repeats_and_ties(spark):
    rows = vectors(40, 4) + [
        (40, None, 1), (41, [1.0, None, 1.0, 1.0], 1), (42, [1.0, float("nan"), 1.0, 1.0], 1),
        (43, [float("inf"), 0.0, 0.0, 0.0], 1), (44, [1.0, 2.0], 1), (45, [], 1),
        (None, [0.5, 0.5, 0.5, 0.5], None), (None, [0.25, 0.5, 0.5, 0.5], 2),
        (3, [0.0, 0.0, 0.0, 0.0], 0), (3, [0.0, 0.0, 0.0, 0.0], 0), (4, [-0.0001, 0.0, 0.0, 0.0], 0),
    ]
    usable = [r for r in rows if r[0] not in (44, 45)]
    got = run(spark, rows, parts=2, entries=8, rounds=4, pivots=3)
    assert sorted(got, key=str) == sorted(plain(usable, 2, 8, 4), key=str)
    assert len(got) == 45


def test_fewer_rows_than_entries_empty_tables_and_clashing_names(spark):
    rows = vectors(5, 4)
    assert sorted(run(spark, rows, parts=4)) == sorted(plain(rows, 4, 256, 4))
    clash = spark.createDataFrame(
        [(k, v, l, "x", 1) for k, v, l in rows], SCHEMA + ", coded string, whole_parts int"
    )
    out = compress(clash, parts=2, entries=2)
    assert out.columns == ["vec_id", "embedding", "label", "coded", "whole_parts", "coded_"]
    assert {r["coded"] for r in out.collect()} == {"x"}
    empty = compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[-1] == "coded"
    assert compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_what_cannot_be_coded_is_refused(spark):
    with pytest.raises(ValueError):
        run(spark, vectors(5, 6), parts=4)
    with pytest.raises(Exception, match="beyond"):
        run(spark, vectors(5, 4) + [(9, [1e9, 0.0, 0.0, 0.0], 1)], parts=4, entries=2)


@pytest.mark.parametrize("spread", [3, 400, 5_000_000])
def test_pruned_search_is_exact_and_prunes(spread):
    draw = np.random.default_rng(spread)
    middle = draw.integers(-spread, spread, (20, 6))
    entries = middle[draw.integers(0, 20, 64)] + draw.integers(-3, 4, (64, 6))
    parts = middle[draw.integers(0, 20, 3000)] + draw.integers(-3, 4, (3000, 6))
    pivots = chosen_pivots(entries, 5)
    index, error, tried = nearest(parts, distances(parts, pivots), pivots, entries)
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    if spread > 3:
        assert tried < exact.size / 2


def test_pivots_are_different_rows():
    points = np.array([[0, 0], [0, 0], [9, 9], [5, 0]])
    assert chosen_pivots(points, 2).tolist() == [[0, 0], [9, 9]]
    assert len(chosen_pivots(points, 9)) == 4
    assert pivot_codes.PIVOTS < pivot_codes.ENTRIES
