"""Whitening against exact rational arithmetic and against numpy's decomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ferrybook.llm.whitening import (
    characteristic_polynomial,
    enough_primes,
    exact_gram,
    fit_whitening,
    in_parts,
    isolate,
    null_vectors,
    roots_above,
    unit,
    whiten,
)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 as id", "2 as vector", "3 as n", "4 as component", "5 as i")


def entry(c):
    return math.floor(64 * float(np.float32(c))) + 1000000


def scatter_of(x):
    n, d = len(x), len(x[0])
    s = [sum(row[j] for row in x) for j in range(d)]
    return [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def faddeev(matrix):
    """The characteristic polynomial by another way (Faddeev and LeVerrier)."""
    d = len(matrix)
    a = np.array(matrix, dtype=object)
    out, m = [1], np.zeros((d, d), dtype=object)
    for k in range(1, d + 1):
        m = a @ m + out[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
        out.append(-(a @ m).trace() // k)
    return out[::-1]


@pytest.mark.parametrize("seed", range(6))
def test_polynomial_is_exact(spark, seed):
    rng = random.Random(seed)
    d = [1, 2, 3, 6, 9, 12][seed]
    x = [[rng.randrange(-(10 ** (1 + 3 * (seed % 3))), 10**4) for _ in range(d)] for _ in range(d + seed)]
    if seed == 4:
        x = [[v[0]] * 3 + v[3:] for v in x]  # singular
    scatter = scatter_of(x)
    assert characteristic_polynomial(spark, scatter) == faddeev(scatter)


def test_roots_are_counted_and_isolated_with_multiplicity():
    polynomial = [1]
    for root in (3, 3, 7, 50):
        polynomial = [a - root * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    assert [roots_above(polynomial, a, 1) for a in (0, 5, 6, 7, 13, 14, 99, 100)] == [4, 4, 2, 2, 2, 1, 1, 0]
    found = [isolate(polynomial, 63, place) for place in (1, 2, 3, 4)]
    assert [Fraction(a, 1 << b) for a, b, *_ in found[:2]] == [50, 7]
    assert [f[2:] for f in found] == [(1, 1), (2, 1), (3, 2), (3, 2)]
    assert all(abs(Fraction(a, 1 << b) - 3) < Fraction(1, 1 << 250) for a, b, *_ in found[2:])


def test_vectors_of_equal_roots_are_orthogonal():
    base = [[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 0], [0, 0, 0, 9]]  # roots 9, 3, 3, 1
    polynomial = faddeev(base)
    number, bits, first, many = isolate(polynomial, 16, 3)
    assert (first, many) == (2, 2)
    vectors = np.array([unit(v) for v in null_vectors(base, number, bits, many)])
    assert np.allclose(vectors @ vectors.T, np.eye(2), atol=1e-15)
    assert np.allclose(vectors @ np.array(base), 3 * vectors, atol=1e-14)


def test_close_roots_are_told_apart():
    size = 10**12
    base = [[size, 1, 0], [1, size, 0], [0, 0, size + 2]]
    polynomial = faddeev(base)
    found = [isolate(polynomial, 4 * size, k) for k in (1, 2, 3)]
    assert [Fraction(a, 1 << b) for a, b, *_ in found] == [size + 2, size + 1, size - 1]
    vector = unit(null_vectors(base, *found[1][:2], 1)[0])
    assert vector == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), 0], abs=1e-16)


def test_exact_sums_of_large_numbers():
    rng = random.Random(1)
    for size in (10, 1 << 25, 1 << 40, 1 << 61):
        x = np.array([[rng.randrange(-size, size) for _ in range(3)] for _ in range(40)], dtype=np.int64)
        exact = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
        assert exact_gram(x).tolist() == exact
    for v in (0, -1, 5, 1 << 130, -(1 << 130) + 7):
        assert sum(p << (40 * k) for k, p in enumerate(in_parts(v))) == v
    assert all(all(p % q for q in range(3, 2000, 2)) for p in enough_primes(1 << 200))


def compare(rows, got, components=32):
    """Against the decomposition of the exactly known covariance."""
    d = max(len(v) for _, v in rows)
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d]
    x = [[entry(c) for c in v] for _, v in kept]
    n, s = len(x), [sum(r[j] for r in x) for j in range(d)]
    scatter = scatter_of(x)
    values, vectors = np.linalg.eigh(np.array([[v / n**2 for v in row] for row in scatter]))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k
    by_row = {}
    for r in got:
        assert (r.n, r.vec_id is None or 1 <= r.component <= k) == (n, True)
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    centred = np.array([[v - s[j] / n for j, v in enumerate(row)] for row in x])
    expected = centred @ vectors[:, :k] / np.sqrt(values[:k])
    signs = {}
    for (i, _), row, w in zip(kept, x, expected):
        for component, found in by_row[i].items():
            for r in found:
                assert r.deviation == sum((n * v - s[j]) ** 2 for j, v in enumerate(row))
                assert r.explained == pytest.approx(values[component - 1] / values.sum(), rel=1e-9)
                sign = signs.setdefault(component, 1 if r.whitened * w[component - 1] > 0 else -1)
                assert sign * r.whitened == pytest.approx(w[component - 1], abs=1e-7)
                assert r.identity_error < 1e-9


def test_small_table_equals_numpy(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(200)]
    compare(rows, whiten(frame(spark, rows)).collect())
    compare(rows, whiten(frame(spark, rows), components=2).collect(), 2)


def test_hot_vector_and_messy_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(3)]) for i in range(60)]
    rows += [(100 + i, [1.5, -2.0, 0.0]) for i in range(60)]
    good = rows + [(None, [0.25, 3.0, 1.0])]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0])]
    bad += [(904, [float("inf"), 0.0, 0.0]), (905, [1.0, 2.0]), (906, [1e30, 0.0, 0.0])]
    compare(good, whiten(frame(spark, good + bad)).collect())
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, bad[:5])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(frame(spark, [])).columns == whiten(frame(spark, rows)).columns


def test_too_few_vectors_have_fewer_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(4)]
    fit = fit_whitening(frame(spark, rows))
    assert len(fit.roots) == 3 and fit.identity_error < 1e-9 and sum(fit.explained()) == pytest.approx(1)
    assert whiten(frame(spark, rows)).count() == 12


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [2.0**55, 0.0]), (2, [0.0, 1.0]), (3, [-(2.0**55), 5.0])]
    got = whiten(frame(spark, rows)).collect()
    assert {(r.vec_id, r.deviation is None) for r in got} == {(1, True), (2, False), (3, True)}


def test_query_on_given_embeddings(spark, sf_dir):
    from ferrybook.llm.queries import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(rows, queries()["op13_embedding_whitening"](spark, sf_dir).collect())
