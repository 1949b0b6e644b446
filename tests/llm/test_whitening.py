"""Whitening against exact fractions and numpy, with clustered and equal eigenvalues and odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgemark.llm import whitening
from hedgemark.llm.catalog import op11_whitening
from hedgemark.sources.tables import stage


def plain(vectors):
    """n, sums and exact covariance (as fractions) of the scaled vectors."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in z), n ** 3) for j in range(d)] for i in range(d)]
    return x, n, sums, z, cov


def check(rows, vectors, components):
    x, n, sums, z, cov = plain(vectors)
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))[::-1]
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * components
    w = np.array([[got[k, c + 1].whitened for c in range(components)] for k in range(n)])
    assert np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(components)).max() < 1e-9
    for k in range(n):
        for c in range(components):
            r = got[k, c + 1]
            assert (r.n, r.deviation) == (n, sum(v * v for v in z[k]))
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
            assert 0 <= r.identity_error < 1e-9
    return w


def frame(spark, vectors, **more):
    rows = [(k, [float(c) for c in v], k, "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, doc string")


def test_small_vectors(spark):
    vectors = np.random.RandomState(1).normal(size=(60, 6)).astype(np.float32) * [9, 5, 3, 2, 1, .5]
    rows = whitening.whiten(frame(spark, vectors).repartition(5)).collect()
    w = check(rows, np.float32(vectors).tolist(), 6)
    x, n, sums, _, cov = plain(np.float32(vectors).tolist())
    values, right = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    mean = np.array([float(Fraction(s, n) - 1_000_000) for s in sums])
    other = (np.array(x, float) - 1_000_000 - mean) @ right[:, ::-1] / np.sqrt(values[::-1])
    assert np.abs(np.abs(w) - np.abs(other)).max() < 1e-9


@pytest.mark.parametrize("values", [
    [5, 3, 2, 1], [1, 1, 1, 1], [4, 4 - 1e-9, 4 - 2e-9, 1], [7, 7 - 1e-5, 7 - 1e-5 - 1e-12, 2, 2, 1e-9], [3, 2, 1e-13, 0],
    list(1 + 1e-7 * np.arange(12)) + list(3 + 1e-11 * np.arange(12)), list(2.0 ** -np.arange(24))])
def test_eigenvectors(values):
    """Against the known decomposition: residual, orthogonality, and each eigenvector as far as the gap to the next allows."""
    values = np.sort(np.array(values, np.longdouble))[::-1]
    q = np.linalg.qr(np.random.RandomState(3).normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to the last bit
        q = q @ (3 * np.eye(len(q), dtype=q.dtype) - q.T @ q) / 2
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    eps = float(np.finfo(np.longdouble).eps)
    norm = float(max(abs(values)))
    assert np.abs(got - values).max() < 100 * eps * norm
    assert np.abs(x.T @ x - np.eye(len(q))).max() < 100 * eps
    assert np.abs(a @ x - x * got).max() < 400 * eps * norm
    for k in range(len(q)):
        gap = min([float(abs(values[k] - v)) for j, v in enumerate(values) if j != k])
        if gap > 1e-12:
            assert np.abs(np.abs(x[:, k]) - np.abs(q[:, k])).max() < 2000 * eps * norm / gap


def test_clustered_vectors(spark):
    """Signed unit vectors of lengths that differ little: eigenvalues in clusters, the axes as eigenvectors."""
    lengths = [40.0, 40.0 + 1 / 64, 40.0 + 2 / 64, 2.0]
    vectors = [[s * length if j == k else 0.0 for j in range(4)] for k, length in enumerate(lengths) for s in (1, -1)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    w = check(rows, vectors, 4)
    assert np.abs(np.abs(w).max(0) - 2).max() < 1e-9  # each component has its two vectors alone: sqrt(8 / 2)


def test_odd_rows(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [4.0, 4.0], [4.0, 4.0]]
    odd = [None, [], [1.0], [None, 1.0], [float("nan"), 1.0], [1.0, float("inf")], [float("-inf"), 0.0]]
    rows = [(k, v) for k, v in enumerate(good)] + [(None if k == 1 else 90, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), good, 2)
    repeated = whitening.whiten(df.unionAll(df).withColumn("n", F.lit(1))).collect()
    assert len(repeated) == 16 and {r.n for r in repeated} == {8}


def test_nothing_to_learn(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        got = whitening.whiten(frame(spark, vectors))
        assert got.columns == names and got.collect() == []
    flat = [[1.0, k, 2.0 * k] for k in range(5)]  # one direction only
    check(whitening.whiten(frame(spark, flat)).collect(), flat, 1)


def test_huge_entries(spark):
    vectors = [[1e9 * k, float(k % 3)] for k in range(7)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    _, n, _, z, _ = plain(vectors)
    assert {(r.vec_id, r.deviation) for r in got} == \
        {(k, v if (v := sum(c * c for c in z[k])) < 1 << 63 else None) for k in range(n)}
    assert max(r.identity_error for r in got) < 1e-6


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = stage(op11_whitening(spark, sf), "whitened")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = [r.embedding for r in table.orderBy("vec_id").collect()]
    check(got.collect(), vectors, 32)
