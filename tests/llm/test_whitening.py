import math
from decimal import Decimal

import numpy as np
import pytest

from plantpulse.llm import whitening
from plantpulse.llm.whitening import (
    chinese_remainders, components_of, deviations, gram, largest_roots, modular_polynomial, primes, roots_above, whiten,
)

SCHEMA = "vec_id long, embedding array<float>"


def data(n=120, width=10, seed=2):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, width)) * np.linspace(0.4, 0.05, width)).astype(np.float32)


def rows_of(x):
    return [(k, [float(c) for c in v]) for k, v in enumerate(x)]


def exact_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in integers."""
    d = len(matrix)
    m = np.array(matrix, dtype=object)
    held, coefficients = np.zeros((d, d), dtype=object), [1]
    for k in range(1, d + 1):
        held = m.dot(held) + np.eye(d, dtype=int).astype(object) * coefficients[-1]
        coefficients.append(-int(np.trace(m.dot(held))) // k)
    return coefficients[::-1]


def test_rows_equal_a_plain_decomposition(spark):
    x = data()
    got = whiten(spark.createDataFrame(rows_of(x), SCHEMA).repartition(5)).collect()
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(whole), whole.sum(axis=0)
    centred = whole - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 8
    for r in got:
        w, k, at = r["white"], r["white"]["component"] - 1, r["vec_id"]
        assert w["n"] == n
        assert int(w["deviation"]) == sum((n * int(v) - int(t)) ** 2 for v, t in zip(whole[at], s))
        assert abs(w["whitened"]) == pytest.approx(abs(centred[at] @ vectors[:, k]) / math.sqrt(values[k]), abs=1e-9)
        assert w["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-12)
        assert 0 <= w["identity_error"] < 1e-10
    signs = {}
    for r in got:
        k = r["white"]["component"] - 1
        share = centred[r["vec_id"]] @ vectors[:, k]
        if abs(share) > 1:
            signs.setdefault(k, set()).add(np.sign(share) == np.sign(r["white"]["whitened"]))
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 8


def test_nulls_infinities_repeats_and_other_lengths(spark):
    x = data(30, 3)
    odd = [(90, None), (91, [1.0, None, 0.0]), (92, [float("nan"), 0.0, 0.0]), (93, [0.0, float("-inf"), 0.0]),
           (94, [1.0]), (95, []), (None, [0.1, 0.2, 0.3]), (5, [float(c) for c in x[5]])]
    got = whiten(spark.createDataFrame(rows_of(x) + odd, SCHEMA)).collect()
    assert len(got) == 32 * 3 and {r["white"]["n"] for r in got} == {32}
    assert {r["vec_id"] for r in got} == {None, *range(30)}
    repeated = [r["white"] for r in got if r["vec_id"] == 5]
    assert len(repeated) == 6 and len(set(repeated)) == 3


def test_tables_without_spread(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, []), (2, [])], SCHEMA)).count() == 0
    one = [tuple(r["white"]) for r in whiten(spark.createDataFrame([(1, [0.5, 0.25])], SCHEMA)).collect()]
    assert one == [(1, 1, Decimal(0), None, None, None), (2, 1, Decimal(0), None, None, None)]
    line = whiten(spark.createDataFrame([(k, [k / 8, 0.0, -k / 8]) for k in range(9)], SCHEMA)).collect()
    assert {r["white"]["component"] for r in line} == {1, 2, 3}
    for r in line:
        white = r["white"]
        assert (white["whitened"] is None) == (white["component"] > 1)
        assert white["explained"] == pytest.approx(float(white["component"] == 1))
        assert white["identity_error"] < 1e-12


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, [0.5], 3, "p"), (2, [0.25], 4, "q")], SCHEMA + ", white int, deviation string")
    out = whiten(df)
    assert out.columns == ["vec_id", "embedding", "white", "deviation", "white_"]
    assert sorted((r["white"], r["deviation"]) for r in out.collect()) == [(3, "p"), (4, "q")]


def test_polynomial_of_the_scatter_is_exact(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(-900, 900, (40, 7))
    x[:, 6] = x[:, 5]
    matrix = (40 * gram(x) - np.outer(x.sum(axis=0), x.sum(axis=0)).astype(object)).tolist()
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_hessenberg_reduction_meets_zero_pivots():
    matrix = [[2, 0, 1, 0], [0, 3, 0, 0], [1, 0, 2, 5], [0, 0, 5, 9]]
    moduli = primes(10**12)
    assert all(p > 2**30 and pow(2, p - 1, p) == 1 for p in moduli)
    got = chinese_remainders({p: modular_polynomial(matrix, p) for p in moduli})
    assert got == exact_polynomial(matrix)


def test_roots_are_counted_and_isolated():
    polynomial = [1]
    for root in (0, 3, 3, 3, 10, 11):  # repeated, close and zero
        polynomial = [a - root * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    assert [roots_above(polynomial, p) for p in (0, 2, 3, 10, 11)] == [5, 5, 2, 1, 0]
    assert [float(r) for r in largest_roots(polynomial, 9)] == pytest.approx([11, 10, 3, 3, 3, 0], rel=1e-15)


def test_components_of_close_and_equal_roots():
    gap = Decimal(1)  # of 10^20: beyond double precision
    matrix = [[10**20 + 1, 0, 0, 0], [0, 10**20, 0, 0], [0, 0, 5, 0], [0, 0, 0, 5]]
    roots = largest_roots(exact_polynomial(matrix), 4)
    assert Decimal(int(roots[0] * 2)) - Decimal(int(roots[1] * 2)) == 2 * gap
    found = components_of(matrix, roots)
    assert np.abs(found[:2]) == pytest.approx(np.eye(4)[:2], abs=1e-15)
    assert found @ found.T == pytest.approx(np.eye(4), abs=1e-15)
    assert np.abs(found[2:, :2]).max() < 1e-15


def test_products_and_deviations_stay_exact_when_large():
    x = np.array([[2**24, -3], [2**24 - 1, 5], [7, -2**24]])
    assert gram(x).tolist() == [[int(sum(a * b for a, b in zip(c, d))) for d in x.T.tolist()] for c in x.T.tolist()]
    n, sums = 10**12, [5, -7]
    gaps, squares = deviations(x, n, sums)
    assert squares == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert gaps[0, 1] == -3 * n + 7
