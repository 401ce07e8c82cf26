"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Vectors are whole numbers, so n times the scatter, M = n * sum(x x') - S S', is an integer
matrix: n squared times the covariance.  Spark adds it up exactly.  Its characteristic
polynomial is found exactly as well: modulo many primes by reduction to Hessenberg form, one
Spark row a prime, and put together by Chinese remainders.  A polynomial whose roots are all
real has exactly as many roots above a point as its coefficients shifted to that point have
sign changes (Descartes), so bisection isolates the largest roots to as many bits as asked
for, repeated ones included.  A component is the null space of M minus its root, by inverse
iteration in decimal arithmetic of many digits.

What the driver holds depends on the vectors' length alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantpulse.llm.common import Scratch, free_name
from plantpulse.llm.vectors import listed, whole_matrix, whole_vectors

COMPONENTS = 8
SHIFT = 100_000
# Bits to which roots are isolated, relative to the largest; digits of the decimal solver.
ROOT_BITS = 160
DIGITS = 100
# Rows of a batch whose products are summed in float64, exact below 2^53.
EXACT = 1 << 53
MAX_LONG = (1 << 63) - 1


@dataclass
class Scatter:
    """Count, sums and n * sum(x x') - S S' of the fitted vectors, all exact."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(row[i] for i, row in enumerate(self.matrix))


def whiten(
    rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, shift: int = SHIFT
) -> DataFrame:
    """The usable rows of ``rows`` once for every component, and a struct ``white``.

    Usable vectors and their whole-number form are those of ``vectors.whole_vectors``; all of
    them are fitted, with ``shift`` added to every whole number x.  Components are the unit
    eigenvectors of x's covariance (divisor n), numbered from 1 by falling eigenvalue e, at
    most as many as the vectors are long; of either sign the one whose entry of largest size
    is positive.

    ``white`` has component; n; deviation, the exact sum over dimensions of (n * x - S)^2, a
    decimal (null from 10^38 on); whitened, x less its mean projected on the component, over
    sqrt(e); explained, e over the trace; and identity_error, the largest absolute entry of
    the whitened values' covariance, computed from the rows and centred before multiplying,
    minus the identity.

    A component of eigenvalue zero has a null ``whitened`` and is left out of
    ``identity_error``, which is null where no eigenvalue is positive (one row, or equal
    rows); ``explained`` is null where the trace is zero.  Components of equal eigenvalues
    are an orthonormal basis of their space.  Repeated rows count each; an empty table gives
    an empty one; vectors of length zero have no component.  Where a column is named
    ``white``, the struct's name is lengthened by underscores.
    """
    scratch = Scratch(rows.sparkSession, "whitening")
    out, whole = free_name(rows, "white"), free_name(rows, "whole_vector")
    kept = whole_vectors(rows, vector, whole)
    fit = scatter(scratch.write(kept.select(whole), "vectors"), whole, shift)
    names = [F.col(f"`{c}`") for c in rows.columns]
    if not fit.n or not fit.sums:
        shape = ("struct<component: int, n: bigint, deviation: decimal(38,0), whitened: double, "
                 "explained: double, identity_error: double>")
        return rows.filter(F.lit(False)).withColumn(out, F.lit(None).cast(shape))
    polynomial = characteristic_polynomial(rows.sparkSession, fit.matrix)
    roots = largest_roots(polynomial, min(components, len(fit.sums)))
    vectors = components_of(fit.matrix, roots)
    values = [float(r) / fit.n**2 for r in roots]
    held, near = free_name(kept, "deviation"), free_name(kept, "projected")
    thin = kept.select(*names, whole)
    projected = scratch.write(
        _projected(thin, whole, held, near, fit, shift, vectors, values), "projected"
    )
    error = _identity_error(projected, near, [k for k, e in enumerate(values) if e > 0])
    trace = fit.trace
    each = F.posexplode(F.arrays_zip(
        F.col(near), F.array(*[F.lit(float(r / trace) if trace else None).cast("double") for r in roots])
    )).alias("_at", "_of")
    flat = projected.select(*names, held, each)
    return flat.select(*names, F.struct(
        (F.col("_at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("bigint").alias("n"),
        F.col(held).alias("deviation"), F.col("_of")[near].alias("whitened"), F.col("_of")["1"].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    ).alias(out))


def scatter(held: DataFrame, whole: str, shift: int = 0) -> Scatter:
    """Exact moments of all vectors; every task adds its own up before anything is shuffled."""
    first = held.select(F.size(whole)).first()
    if first is None:
        return Scatter(0, [], [])
    width = first[0]
    schema = "i int, j int, total decimal(38,0)"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(width)
        moments = np.zeros((width, width), dtype=object)
        sums, n = [0] * width, 0
        for batch in batches:
            x = whole_matrix(batch.column(0))
            moments += gram(x)
            sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
            n += len(x)
        i, j, totals = upper[0].tolist(), upper[1].tolist(), moments[upper].tolist()
        i, j, totals = i + [-1] * (width + 1), j + list(range(width + 1)), totals + sums + [n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))],
            names=["i", "j", "total"],
        )

    totals = {(r["i"], r["j"]): int(r["total"]) for r in held.select(whole).mapInArrow(add_up, schema)
              .groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    n, sums = totals[-1, width], [totals[-1, j] for j in range(width)]
    matrix = [[n * totals[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    return Scatter(n, [s + n * shift for s in sums], matrix)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; float products stay below 2^53, so no digit is lost."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    most = max(1, int(np.abs(x).max(initial=0))) ** 2
    step = max(1, min(len(x), EXACT // most))
    for at in range(0, len(x), step):
        part = x[at:at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(y - M) from the constant one up, for a symmetric matrix without negative roots.

    By Maclaurin's inequality the k-th elementary symmetric sum of the roots is at most
    C(d, k) * (trace / d)^k, which says how many primes are enough.
    """
    d = len(matrix)
    mean = -(-max(1, sum(matrix[i][i] for i in range(d))) // d)
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    moduli = primes(2 * bound + 1)

    def reduce_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [modular_polynomial(matrix, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), listed(np.array(found, np.int64).reshape(len(found), d + 1), pa.int64())],
                names=["p", "residues"],
            )

    parts = min(len(moduli), spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(parts)
    rows = table.mapInArrow(reduce_all, "p long, residues array<bigint>").collect()
    return chinese_remainders({r["p"]: r["residues"] for r in rows})


def primes(beyond: int) -> list[int]:
    """Primes below 2^31, downwards, until their product passes ``beyond``."""
    small = [p for p in range(2, 46_341) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found, product, at = [], 1, 2**31 - 1
    while product <= beyond:
        if all(at % p for p in small):
            found.append(at)
            product *= at
        at -= 2
    return found


def modular_polynomial(matrix: list[list[int]], p: int) -> list[int]:
    """det(y - M) modulo p: similar Hessenberg matrix, then its leading minors in turn."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot, to = k + 1 + int(below[0]), k + 1
        if pivot != to:
            h[[to, pivot]] = h[[pivot, to]]
            h[:, [to, pivot]] = h[:, [pivot, to]]
        factor = h[k + 2:, k] * pow(int(h[to, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[to] % p) % p
        # The columns take the inverse step, which keeps the matrix similar.
        h[:, to] = (h[:, to] + (h[:, k + 2:] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - int(h[k - 1, k - 1]) * minors[k - 1]) % p
        chain = 1
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            minors[k] = (minors[k] - int(h[i - 1, k - 1]) * chain % p * minors[i - 1]) % p
    return minors[d].tolist()


def chinese_remainders(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least size with the given residues."""
    product, values = 1, None
    for p, found in residues.items():
        if values is None:
            values, product = list(found), p
            continue
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, found)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def roots_above(polynomial: list[int], point: int) -> int:
    """How many roots lie above a point: sign changes of the coefficients shifted there."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], wanted: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The largest roots in falling order, each as often as it occurs; a root of zero is zero.

    Counts part the roots; an interval that holds a single one is halved by the polynomial's
    sign alone.  The others are off by at most one part in 2^bits of their sum.
    """
    d = len(polynomial) - 1
    top = max(1, -polynomial[d - 1])  # the trace, which no root exceeds
    scale = max(0, bits - top.bit_length())
    scaled = [c << (scale * (d - k)) for k, c in enumerate(polynomial)]
    positive = d - next(k for k, c in enumerate(polynomial) if c)
    above = {0: positive, (top << scale) + 1: 0}
    found = []
    for k in range(min(wanted, d)):
        if k >= positive:
            found.append(Fraction(0))
            continue
        low = max(p for p, n in above.items() if n > k)
        high = min(p for p, n in above.items() if n <= k)
        while high - low > 1 and above[low] - above[high] > 1:
            middle = (low + high) // 2
            above[middle] = roots_above(scaled, middle)
            low, high = (middle, high) if above[middle] > k else (low, middle)
        # The one root left lies above low and at most at high.
        beyond = 1 if above[high] % 2 == 0 else -1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if _value(scaled, middle) * beyond >= 0 else (middle, high)
        found.append(Fraction(2 * low + 1, 2 << scale))
    return found


def _value(polynomial: list[int], point: int) -> int:
    value = 0
    for c in reversed(polynomial):
        value = value * point + c
    return value


def components_of(matrix: list[list[int]], roots: list) -> np.ndarray:
    """Unit vectors of the null spaces of M - root, one a row, orthogonal to one another."""
    d = len(matrix)
    found: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = DIGITS
        scale = Decimal(max(1, max(matrix[i][i] for i in range(d))))
        whole = [[Decimal(v) / scale for v in row] for row in matrix]
        for k, root in enumerate(roots):
            at = Decimal(root.numerator) / Decimal(root.denominator) / scale
            factors = _factorised(whole, at)
            vector = _unit(_less([Decimal((i * (k + 2) + k) % 17 + 1) for i in range(d)], found))
            for _ in range(3):
                vector = _unit(_less(_solved(factors, vector), found))
            found.append(vector)
    out = np.array([[float(v) for v in vector] for vector in found])
    largest = np.abs(out).argmax(axis=1)
    return out * np.sign(out[np.arange(len(out)), largest])[:, None]


def _less(vector: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    for other in others:
        share = sum(a * b for a, b in zip(vector, other))
        vector = [a - share * b for a, b in zip(vector, other)]
    return vector


def _unit(vector: list[Decimal]) -> list[Decimal]:
    length = sum(v * v for v in vector).sqrt()
    return [v / length for v in vector]


def _factorised(matrix: list[list[Decimal]], root: Decimal):
    """Row order and triangular factors of M - root; a pivot of zero becomes the smallest number kept."""
    d = len(matrix)
    a = [[v - root if i == j else v for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        order[k], order[pivot] = order[pivot], order[k]
        if not a[k][k]:
            a[k][k] = Decimal(10) ** -DIGITS
        for i in range(k + 1, d):
            factor = a[i][k] / a[k][k]
            a[i][k] = factor
            if factor:
                row, top = a[i], a[k]
                for j in range(k + 1, d):
                    row[j] -= factor * top[j]
    return a, order


def _solved(factors, right: list[Decimal]) -> list[Decimal]:
    a, order = factors
    x = [right[i] for i in order]
    for i in range(len(x)):
        x[i] -= sum(a[i][j] * x[j] for j in range(i))
    for i in reversed(range(len(x))):
        x[i] = (x[i] - sum(a[i][j] * x[j] for j in range(i + 1, len(x)))) / a[i][i]
    return x


def _projected(
    kept: DataFrame, whole: str, held: str, near: str, fit: Scatter, shift: int, vectors: np.ndarray, values: list[float]
) -> DataFrame:
    n, sums = fit.n, [s - fit.n * shift for s in fit.sums]
    schema = T.StructType([
        *kept.schema.fields[:-1], T.StructField(held, T.DecimalType(38, 0)), T.StructField(near, T.ArrayType(T.DoubleType())),
    ])
    over = np.array([math.sqrt(e) if e > 0 else math.nan for e in values])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_matrix(batch.column(batch.num_columns - 1))
            gaps, squares = deviations(x, n, sums)
            white = (gaps / n) @ vectors.T / over
            lists = listed(white, pa.float64())
            lists = pa.ListArray.from_arrays(lists.offsets, pa.array(white.ravel(), pa.float64(), from_pandas=True))
            exact = [Decimal(v) if v < 10**38 else None for v in squares]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(exact, pa.decimal128(38, 0)), lists], names=schema.names
            )

    return kept.mapInArrow(project, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n * x - S as floats, and its exact squared length, in 64 bits where they are enough."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * max(1, x.shape[1]) <= MAX_LONG:
        gaps = x * n - np.array(sums, np.int64)
        return gaps.astype(np.float64), np.einsum("ij,ij->i", gaps, gaps).tolist()
    gaps = x.astype(object) * n - np.array(sums, dtype=object)
    return gaps.astype(np.float64), (gaps * gaps).sum(axis=1).tolist()


def _identity_error(projected: DataFrame, near: str, used: list[int]) -> float | None:
    if not used:
        return None
    at = [F.col(near)[k] for k in used]
    means = projected.agg(*[F.avg(c).alias(f"m{k}") for k, c in zip(used, at)]).first()
    centred = {k: c - F.lit(means[f"m{k}"]) for k, c in zip(used, at)}
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = projected.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
