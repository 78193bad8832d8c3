"""Whitening against numpy's own eigenvectors and exact fractions."""

import random
from fractions import Fraction

import numpy as np
import pytest

from levelmark.llm import exact_roots, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, whitened double, component int"


def as_rows(vectors, **also):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3.0, 4) for i, v in vectors]


def whole(vector):
    return tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in vector)


def plain_polynomial(matrix):
    """Faddeev-LeVerrier with fractions."""
    d = len(matrix)
    m = [[Fraction(0)] * d for _ in range(d)]
    out = [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][x] * m[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(matrix[i][x] * m[x][i] for i in range(d) for x in range(d)) / k)
    return [int(c) for c in out]


def test_polynomial_of_whole_matrices(spark):
    draw = random.Random(3)
    for d in (1, 2, 3, 6, 9):
        rows = [[draw.randint(-50, 50) * draw.choice([0, 1, 1]) for _ in range(d)] for _ in range(draw.choice([d, max(1, d - 2)]))]
        matrix = [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]
        assert whitening._polynomial(spark, matrix) == plain_polynomial(matrix)


def times(roots):
    f = [1]
    for r in roots:
        f = [a - r * b for a, b in zip([*f, 0], [0, *f], strict=True)]
    return f


@pytest.mark.parametrize(
    "roots",
    [[5], [3, 3, 3], [0, 0, 7], [0], [10**20, 10**20 + 1, 4], [1, 2, 3, 4, 5, 6, 7], [8, 8, 4, 4, 4, 2, 1, 1], [64, 32, 32, 16], [1, 1]],
)
def test_roots_and_how_often(roots):
    found = exact_roots.largest_roots(times(roots), 16)
    values = [r for r in sorted(set(roots), reverse=True) if r]
    assert [r.times for r in found] == [roots.count(v) for v in values]
    for root, value in zip(found, values, strict=True):
        low, high = root.bounds()
        assert low < value <= high and (high - low) * 2**70 < value


def test_whitening_against_numpy(spark):
    random_ = np.random.default_rng(5)
    vectors = random_.normal(size=(300, 20)) @ np.diag(np.linspace(0.2, 4, 20)) + 7
    rows = list(enumerate(vectors.tolist())) + [(1000 + i, vectors[0].tolist()) for i in range(500)] + [(None, vectors[1].tolist())]
    odd = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] * 20), (2004, [*[1.0] * 19, float("inf")]), (2005, [1.0])]
    df = spark.createDataFrame(as_rows(rows + odd), SCHEMA).repartition(5)
    found = whitening.whiten(df).collect()
    assert len(found) == 16 * len(rows)

    x = np.array(sorted({whole(v) for _, v in rows}), np.float64)
    values, components = np.linalg.eigh(np.cov(x.T, bias=True))
    values, components = values[::-1], components[:, ::-1]
    n, sums = len(x), x.astype(np.int64).sum(axis=0)
    by_row = {}
    for r in found:
        by_row.setdefault((r["vec_id"], r["n"], r["deviation"]), {})[r["component"]] = r["whitened"]
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
    signs = None
    expected = {i: whole(v) for i, v in rows}
    for (i, count, deviation), got in by_row.items():
        assert count == n and deviation == sum((n * c - int(s)) ** 2 for c, s in zip(expected[i], sums, strict=True))
        plain = (np.array(expected[i]) - sums / n) @ components[:, :16] / np.sqrt(values[:16])
        got = np.array([got[k] for k in range(1, 17)])
        signs = np.sign(plain * got) if signs is None else signs
        assert np.allclose(got, plain * signs, atol=1e-8)

    # identity_error against the covariance of the whitened rows themselves
    distinct = {expected[i]: np.array([g[k] for k in range(1, 17)]) for (i, _, _), g in by_row.items()}
    covariance = np.cov(np.array(list(distinct.values())).T, bias=True)
    measured = np.abs(covariance - np.eye(16)).max()
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and abs(found[0]["identity_error"] - measured) < 1e-12


def test_close_eigenvalues_to_double_precision(spark):
    # two eigenvalues that differ by one part in 10^9: doubles alone would mix their vectors
    a = 10**9
    matrix = [[4 * a, 1, 0], [1, 4 * a + 1, 0], [0, 0, a]]
    roots = exact_roots.largest_roots(plain_polynomial(matrix), 3)
    for root in roots:
        vector = [Fraction(c) for c in exact_roots.null_space(matrix, root.low, root.shift, 1)[0].tolist()]
        value = root.bounds()[0]
        rest = [sum(m * v for m, v in zip(row, vector, strict=True)) - value * vector[i] for i, row in enumerate(matrix)]
        assert max(map(abs, rest)) < 1e-6  # of 4e9: beyond what the gap of 1 would forgive


def test_equal_eigenvalues_and_no_components(spark):
    square = [(1, [1, 0]), (2, [-1, 0]), (3, [0, 1]), (4, [0, -1])]
    rows = whitening.whiten(spark.createDataFrame(as_rows(square), SCHEMA)).collect()
    z = np.array([[r["whitened"] for r in sorted(rows, key=lambda r: r["component"]) if r["vec_id"] == i] for i in range(1, 5)])
    assert np.allclose(z.T @ z / 4, np.eye(2)) and {r["explained"] for r in rows} == {0.5}
    flat = whitening.whiten(spark.createDataFrame(as_rows([(1, [1, 2]), (2, [1, 2])]), SCHEMA))
    assert flat.count() == 0 and flat.columns[0] == "vec_id"
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    # a line in space has one component
    line = whitening.whiten(spark.createDataFrame(as_rows([(i, [i, i, 5]) for i in range(9)]), SCHEMA)).collect()
    assert len(line) == 9 and {r["explained"] for r in line} == {1.0}


def test_large_numbers(spark):
    rows = [(1, [1e15, 3.0]), (2, [-2e15, 4.0]), (3, [0.5, 1.0]), (4, [9e16, 1.0])]
    found = whitening.whiten(spark.createDataFrame(as_rows(rows), SCHEMA)).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3} and {r["deviation"] for r in found} == {None}
    assert max(r["identity_error"] for r in found) < 1e-9
