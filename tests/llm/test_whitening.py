import math
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import whitening

ROWS = "vec_id long, embedding array<float>, n string, key int, x double"


def expected(vectors, components=16):
    """n, deviations by vector, explained shares, covariance and centred vectors, in whole numbers and fractions."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    listed = [list(v) for v in sorted(set(map(tuple, x)))]
    n, d = len(listed), len(listed[0])
    sums = [sum(v[i] for v in listed) for i in range(d)]
    cov = np.array([[float(sum(Fraction((n * v[i] - sums[i]) * (n * v[j] - sums[j])) for v in listed) / n**3) for j in range(d)] for i in range(d)])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviation, cov, np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])


def check(rows, vectors, components=16):
    n, deviation, cov, centred = expected(vectors)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(components, len(values))
    assert len(rows) == len(vectors) * k
    got = np.zeros((len(vectors), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-9
    want = centred @ (vecs[:, :k] / np.sqrt(values[:k]))
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-7


def test_whole_table_against_fractions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 7)) * [3, 2, 1.5, 1, 0.7, 0.4, 0.3]
    vectors = [v.astype(np.float32).tolist() for v in np.vstack([base, base[:1].repeat(40, axis=0), base[5:9]])]  # one vector makes up a third
    frame = spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in enumerate(vectors)], ROWS).repartition(5)
    check(whitening.whiten(frame).collect(), vectors)
    two = whitening.whiten(frame, components=2).collect()
    check(two, vectors, 2)


def test_odd_rows(spark):
    good = [[0.5, 1.0, -2.0], [1.5, 0.25, 0.0], [-0.5, -1.0, 4.0], [0.0, 0.0, 1.0], [2.0, -3.0, 0.5]]
    odd = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [], [1.0, 2.0], [None]]
    frame = spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(good + odd)] + [(None, good[0], "", 0, 0.0), (0, good[0], "", 0, 0.0)], ROWS)
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 3 * (len(good) + 2) and {r.n for r in rows} == {len(good)}
    assert sum(r.vec_id is None for r in rows) == 3 and sum(r.vec_id == 0 for r in rows) == 6
    twice = [r for r in rows if r.vec_id == 0]
    assert len(set(twice)) == 3
    check([r for r in rows if r.vec_id] + list(set(twice)), good)
    empty = whitening.whiten(frame.where("false"))
    assert empty.count() == 0 and empty.columns == whitening.whiten(frame).columns


def test_no_variance_and_large_entries(spark):
    one = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2])], "vec_id long, embedding array<double>")
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(one).collect()] == [(1, 0, None, 0.0, 0.0)] * 4
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and max(r.identity_error for r in rows) < 1e-12
    large = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [5e9, 3.0]), (3, [1.0, 9.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(large).collect()
    assert len(rows) == 8 and all(math.isfinite(r.whitened) for r in rows if r.component == 1) and {r.deviation for r in rows} == {None}


def test_sums_are_exact_beyond_doubles(spark):
    vectors = [[2.0**34 + i, 2.0**34 - 3 * i, float(i * i)] for i in range(9)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    listed = frame.selectExpr("transform(embedding, c -> bigint(floor(64 * c)) + 1000000L) x")
    n, _, cov, _ = expected(vectors)
    model = whitening.fit(listed)
    assert model.n == n and (model.covariance == cov).all()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 31, 64])
def test_rotations(n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n + 2))
    v = m @ m.T
    values, vectors = whitening.jacobi(v)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and np.abs(v @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_small_eigenvalues_are_accurate():
    scale = 10.0 ** -np.arange(0, 24, 3)
    inner = np.eye(8) + 0.2 * np.ones((8, 8))
    v = scale[:, None] * inner * scale
    got = whitening.jacobi(v)[0]
    a = [[Fraction(float(c)) for c in row] for row in v]  # the product of all eigenvalues, exactly
    det = Fraction(1)
    for i in range(8):
        det *= a[i][i]
        for r in range(i + 1, 8):
            f = a[r][i] / a[i][i]
            a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    product = Fraction(1)
    for e in got:
        product *= Fraction(float(e))
    assert abs(float(product / det) - 1) < 1e-11
    assert got[-1] < 1e-40
