"""op13: against a direct eigen-decomposition of the covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def direct(rows, components=8):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [i for i, _ in kept], n, deviation, y @ vectors / np.sqrt(values), values / np.trace(v)


def compare(got, rows, components=8):
    ids, n, deviation, w, explained = direct(rows, components)
    k = w.shape[1]
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(ids) * k
    assert all(r.n == n and r.identity_error <= 1e-10 for r in got)
    for c in range(k):
        rs = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id, abs(r.whitened)))
        own = sorted(zip(ids, deviation, w[:, c]), key=lambda t: (t[0] is None, t[0], abs(t[2])))
        assert [(r.vec_id, r.deviation) for r in rs] == [t[:2] for t in own]
        a, b = np.array([r.whitened for r in rs]), np.array([t[2] for t in own])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-8
        assert all(r.explained == pytest.approx(explained[c], rel=1e-10) for r in rs)


def random_rows(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(2, 0.2, d) + 3
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n, d", [(40, 5), (200, 40)])
def test_equals_the_direct_decomposition(spark, n, d):
    rows = random_rows(n, d)
    rows += [(7000, None), (7001, [None] + rows[0][1][1:]), (7002, [math.nan] * d), (7003, [math.inf] * d), (None, rows[3][1])]
    rows += rows[:2]
    compare(whitening.whitened(frame(spark, rows)).collect(), rows)


def test_equal_eigenvalues_and_a_dominant_one(spark):
    """Equal spectra have no certain axes, but whitening holds; a dominant axis does not hide the rest."""
    rows = [(i, [float(np.float32(s if j == i % 40 else 0)) for j in range(40)]) for i, s in enumerate([1, -1] * 40)]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 640 and got[0].identity_error < 1e-10
    strong = [(i, [1000.0 * v[0], *v[1:]]) for i, v in random_rows(150, 48, 5)]
    compare(whitening.whitened(frame(spark, strong)).collect(), strong)


def test_defined_results(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    # Other lengths and entries beyond the integers are left out.
    rows = random_rows(60, 6)
    more = rows + [(900, [1.0] * 7), (901, [1e30] + [0.0] * 5)]
    compare(whitening.whitened(frame(spark, more)).collect(), rows)


def test_clashing_names(spark):
    rows = random_rows(50, 4)
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "vector", "n", "x", "dim", "component")})
    compare(whitening.whitened(df).collect(), rows)


def test_rank_below_eight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b), float(a)] + [0.5] * 9) for i, (a, b) in enumerate(rng.integers(-9, 9, (40, 2)))]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}
    assert got[0].identity_error < 1e-10


def test_exact_deviations():
    x = np.array([[1 << 39, -5], [3, 4]], np.int64)
    n, sums = 10**6, [10**17 + 7, -12345]
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]
    small = np.array([[100001, 99990]], np.int64)
    assert whitening._deviations(small, 3, [300001, 299971]) == [(300003 - 300001) ** 2 + (299970 - 299971) ** 2]


def test_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    compare(whitening.whitened(df).collect(), rows)
