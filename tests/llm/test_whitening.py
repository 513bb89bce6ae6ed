import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import whitening


def plain(vectors):
    """(x, S, eigenvalues, eigenvectors) by a dense solver over exact integers."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    s, n = x.sum(axis=0), len(x)
    d = (x - s // n) - (s % n) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    return x, s, e[::-1], u[:, ::-1]


def check(got, keys, vectors, components=8):
    x, s, e, u = plain(vectors)
    n, k = len(x), min(components, x.shape[1])
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i in keys for c in range(k))
    place = {i: j for j, i in enumerate(keys)}
    z = np.full((n, k), np.nan)
    for r in got:
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[place[r.vec_id]], s)) and r.deviation_exact == str(r.deviation)
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-10
        assert r.identity_error <= 1e-12
        z[place[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(z.T @ z / n, np.eye(k), atol=1e-10) and np.allclose(z.mean(axis=0), 0, atol=1e-10)
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    return np.abs(np.abs((z * want).mean(axis=0)) - 1).max()


def test_whole_table_against_a_dense_solver(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.collect()
    got = whitening.whiten(vectors).collect()
    assert check(got, [r.vec_id for r in rows], [r.embedding for r in rows]) < 1e-9


def test_bad_rows_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(v)) for v in row] for row in rng.normal(size=(40, 5)) * [9, 5, 3, 2, 1]]
    good[7] = good[8]
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], []]
    rows = [(i, v, "x") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").withColumn("y_", F.lit("n"))
    got = whitening.whiten(df).collect()
    assert check(got, list(range(40)), good) < 1e-9


def test_empty_single_and_flat_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], empty.schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], empty.schema)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0]) for i in range(3)], empty.schema)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-12
    large = whitening.whiten(spark.createDataFrame([(1, [3e9, 0.0]), (2, [-3e9, 1.0])], empty.schema)).collect()
    assert {r.deviation for r in large} == {None} and len({r.deviation_exact for r in large}) == 1 and int(large[0].deviation_exact) > 2**63


@pytest.mark.parametrize("spectrum", ["clustered", "repeated", "graded"])
def test_eigenpairs_of_hard_spectra(spectrum):
    rng = np.random.default_rng(5)
    d = 120
    e = {"clustered": 100 + 1e-4 * np.arange(d), "repeated": np.repeat(np.arange(1.0, 13.0), 10), "graded": 10.0 ** np.linspace(-6, 6, d)}[spectrum]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * e) @ q.T
    passes = []
    values, vectors = whitening.jacobi_davidson(lambda x: passes.append(x.shape[1]) or a @ x, d, 8)
    assert np.allclose(values, np.sort(e)[::-1][:8], rtol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-13)
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * e.max()


def test_corrections_solve_the_projected_equation():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 30))
    a = a @ a.T
    e, u = np.linalg.eigh(a)
    ritz = np.linalg.qr(u[:, -3:] + 0.01 * rng.normal(size=(30, 3)))[0]
    theta = np.diag(ritz.T @ a @ ritz)
    r = whitening.off(ritz, a @ ritz - ritz * theta)
    t = whitening.corrections(lambda x: a @ x, ritz, theta, r, steps=200, share=1e-12)
    for i in range(3):
        left = whitening.off(ritz, (a @ t[:, [i]] - theta[i] * t[:, [i]]))[:, 0] + r[:, i]
        assert np.linalg.norm(left) <= 1e-8 * np.linalg.norm(r[:, i]) and np.abs(ritz.T @ t[:, i]).max() < 1e-10
