"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from strandcall.llm import whitening
from strandcall.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_rows(rows):
    """The vectors that count, as the contract has them."""
    whole = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    sizes = [len(r.embedding) for r in whole]
    width = max(set(sizes), key=lambda k: (sizes.count(k), k))
    return [r for r in whole if len(r.embedding) == width]


@pytest.mark.parametrize("where", ["given", "odd"])
def test_op12(spark, odd_dir, where):
    folder = SF_DIR if where == "given" else odd_dir
    rows = plain_rows(spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r.embedding] for r in rows], np.int64)
    n, sums = len(x), x.sum(axis=0)
    apart = (x - sums / n).astype(float)
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, x.shape[1])
    found = QUERIES["op12_bidiagonal_whitening"](spark, folder).collect()
    assert len(found) == n * k and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-10
    assert len({r.identity_error for r in found}) == 1
    want = sorted(((r.vec_id, int(((n * row - sums) ** 2).sum())) for r, row in zip(rows, x)), key=repr)
    assert sorted(((r.vec_id, r.deviation) for r in found if r.component == 1), key=repr) == want
    assert {r.component: r.explained for r in found} == {c + 1: pytest.approx(values[c] / values.sum(), rel=1e-9) for c in range(k)}
    plain = apart @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        got = np.sort([r.whitened for r in found if r.component == c + 1])
        assert min(np.abs(got - np.sort(s * plain[:, c])).max() for s in (1, -1)) < 1e-7


def test_same_sign_for_all_rows(spark):
    """A component's values have mean 0 and variance 1, and components are not correlated."""
    found = QUERIES["op12_bidiagonal_whitening"](spark, SF_DIR).collect()
    ids = sorted({r.vec_id for r in found})
    y = np.zeros((len(ids), 32))
    at = {v: k for k, v in enumerate(ids)}
    for r in found:
        y[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(np.cov(y.T, bias=True) - np.eye(32)).max() < 1e-10


def test_components_without_variance(spark):
    rows = spark.createDataFrame([(k, [0.5, k / 4, 1.0 - k / 4]) for k in range(8)], "vec_id long, embedding array<double>")
    found = whitening.whiten(rows).collect()
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert all(r.explained == pytest.approx(float(r.component == 1)) and r.identity_error < 1e-12 for r in found)
    same = whitening.whiten(rows.selectExpr("vec_id", "array(0.5D, 0.25D) embedding")).collect()
    assert all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in same)


def test_long_deviations():
    x, sums = np.array([[1 << 40, 0], [0, 1 << 40]]), np.array([1 << 40, 1 << 40])
    assert whitening.deviations(x, 2, sums) == [2 << 80, 2 << 80]
    with pytest.raises(ArithmeticError):
        whitening.grid(whitening.pa.array([[1e300]]), 1)


def matrices():
    rng = np.random.default_rng(0)
    turn = lambda k: np.linalg.qr(rng.normal(size=(k, k)))[0]
    yield rng.normal(size=(500, 64))
    yield np.floor(64 * rng.normal(size=(20_000, 64)) * 0.12)
    yield rng.normal(size=(500, 40)) * 10.0 ** -np.arange(40)
    yield rng.normal(size=(500, 5)) @ rng.normal(size=(5, 20))
    yield rng.normal(size=(4, 20))
    yield np.vstack([np.eye(12)] * 5)
    yield np.zeros((5, 7))
    yield np.diag(np.abs(np.arange(21) - 10.0) + 1) + np.diag(np.ones(20), 1)
    for _ in range(60):
        k = int(rng.integers(2, 30))
        base = rng.choice([5.0, 3, 2, 1, 0, 1e-5], k) * (1 + rng.choice([0, 1e-13, 1e-9, 1e-6, 1e-4]) * rng.normal(size=k))
        yield turn(k) @ np.diag(base) @ turn(k)


def test_singular_pairs():
    """Also for equal, almost equal and zero values, and for ones over forty decades."""
    for a in matrices():
        r = whitening.joined(iter(np.array_split(a, 3)), a.shape[1])
        diagonal, above, w = whitening.bidiagonal(r)
        values, right = whitening.right_vectors(diagonal, above)
        v, most = w @ right, max(np.abs(values).max(), 1e-100)
        assert np.abs(values - np.linalg.svd(a, compute_uv=False)[: len(values)] if len(a) >= len(r) else 0).max() / most < 1e-13
        assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-10
        assert np.abs(a.T @ (a @ v) - v * values**2).max() / most**2 < 1e-13


def test_dqds_is_accurate_for_small_values():
    """Entries over thirty decades: each value to a relative error of rounding, as the determinant shows."""
    diagonal, above = 10.0 ** -np.arange(0, 30, 3.0), 10.0 ** -np.arange(1, 28, 3.0)
    found = whitening.dqds(diagonal, above)
    assert np.prod(found) == pytest.approx(np.prod(diagonal), rel=1e-13)


def test_many_triangles_are_joined(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows, width = whitening.usable(rows, "embedding")
    one, many = whitening.fit(rows.coalesce(1), width), whitening.fit(rows.repartition(70, "vec_id"), width)
    assert (one.n, list(one.sums)) == (many.n, list(many.sums))
    assert many.eigenvalues == pytest.approx(one.eigenvalues, rel=1e-12)
