"""Whitening against dense linear algebra, and vectors of every odd kind."""

import numpy as np
from pyspark.sql import functions as F

from signflow.llm import whitening


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 33):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        e = 10.0 ** -np.arange(n) if n < 9 else rng.random(n)
        e = np.sort(e)[::-1]
        got, vectors = whitening.jacobi(q @ np.diag(e) @ q.T)
        assert np.allclose(got, e, rtol=1e-6, atol=1e-14) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
    scale = np.diag([1e6, 1.0, 1e-6])  # a graded matrix: all eigenvalues to full relative precision
    core = np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]])
    got, _ = whitening.jacobi(scale @ core @ scale)
    inverse, _ = whitening.jacobi(np.diag(1 / np.diag(scale)) @ np.linalg.inv(core) @ np.diag(1 / np.diag(scale)))
    assert np.allclose(got, 1 / inverse[::-1], rtol=1e-12)
    assert whitening.jacobi(np.zeros((2, 2)))[0].tolist() == [0, 0]


def dense(rows):
    """What is asked for, by numpy, in Python integers where exact."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(0)
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(1)]
    centred = (x * n - s).astype(float) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, e[::-1], (centred @ q[:, ::-1])


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(400, 40)) @ np.diag(np.linspace(3, 0.2, 40))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>, deviation string").repartition(7)
    got = whitening.whiten(table).toPandas()
    n, deviation, e, projected = dense(rows.astype(float))
    assert len(got) == 400 * 32 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    assert got.groupby("vec_id").deviation.first().tolist() == deviation
    for k in range(32):
        own = got[got.component == k + 1].sort_values("vec_id")
        want = projected[:, k] / np.sqrt(e[k])
        sign = np.sign(own.whitened.to_numpy() @ want)
        assert np.allclose(own.whitened, sign * want, atol=1e-8) and np.allclose(own.explained, e[k] / e.sum(), rtol=1e-10)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 2.0]), (1, [3.0, 2.0]), (None, [0.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.whiten(table).orderBy(F.col("vec_id").asc_nulls_last(), "component").collect()
    assert [r["vec_id"] for r in got] == [0, 0, 1, 1, 1, 1, None, None] and {r["n"] for r in got} == {4}
    assert [r["explained"] for r in got[:2]] == [1.0, 0.0] and all((r["whitened"] is None) == (r["component"] == 2) for r in got)  # no variance
    assert whitening.whiten(table.limit(0)).collect() == [] and whitening.whiten(table.where("embedding is null")).columns == whitening.whiten(table).columns
    alone = whitening.whiten(table.limit(1)).collect()
    assert [(r["deviation"], r["whitened"], r["identity_error"]) for r in alone] == [(0, None, None)] * 2
    huge = spark.createDataFrame([(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [3e15, 5.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(huge).collect()  # beyond a long
    assert {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-3
    ties = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"] for r in whitening.whiten(ties).collect()} == {1}
