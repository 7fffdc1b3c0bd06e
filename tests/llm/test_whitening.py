import math

import numpy as np
import pytest

from tessera.llm import whitening as white

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n long, place long, value double"


def table(spark, vectors, kind="float", ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4, 5.0) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA.replace("float", kind))


def by_definition(x, components):
    """Whitened rows with numpy's eigenvectors of the plain covariance."""
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return e[::-1], centred @ v[:, ::-1][:, :components] / np.sqrt(e[::-1][:components])


def run(df, components=8):
    return sorted(white.whitened(df, white.fit_whitening(df, components), components).collect(), key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.component))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_the_definition(spark, kind):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * np.geomspace(1, 1e-2, 12)).astype(np.float32)
    rows = run(table(spark, vectors.tolist(), kind))
    x = np.floor(1024 * vectors.astype(float)) + 100_000
    e, want = by_definition(x, 8)
    got = np.array([r.whitened for r in rows]).reshape(400, 8)
    signs = np.sign((got * want).sum(axis=0))
    np.testing.assert_allclose(got * signs, want, atol=1e-9)
    np.testing.assert_allclose([r.explained for r in rows[:8]], e[:8] / e.sum(), rtol=1e-10)
    exact = [sum((400 * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    assert [r.deviation for r in rows[::8]] == exact
    assert {r.n for r in rows} == {400} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_unusable_rows_go_and_others_stay(spark):
    vectors = [[1, 2], None, [1, None], [math.nan, 1], [math.inf, 1], [-math.inf, 0], [3, 1], [2], [], [1, 2], [0, 5]]
    rows = run(table(spark, vectors, ids=[None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 10]))
    assert [r.vec_id for r in rows] == [None] * 2 + [6] * 2 + [7] * 2 + [8] * 4 + [10] * 2
    assert {r.n for r in rows} == {6}
    x = np.floor(1024 * np.array([[1, 2], [3, 1], [2, 0], [0, 0], [1, 2], [0, 5.0]])) + 100_000
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    np.testing.assert_allclose([r.explained for r in rows[:2]], want / want.sum())


def test_nothing_to_whiten(spark):
    assert run(table(spark, [])) == []
    assert run(table(spark, [None, [None]])) == []
    assert run(table(spark, [[], []])) == []
    (one,) = run(table(spark, [[3.0]]))
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, None, None)
    rows = run(table(spark, [[1, 1, 0], [2, 2, 0], [4, 4, 0]]))  # varies along one direction
    assert [r.whitened is None for r in rows[:3]] == [False, True, True] and rows[0].identity_error < 1e-9
    assert rows[0].explained == pytest.approx(1)


def test_large_entries_are_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 2.0], [3.0, 7.0], [2.0**46, 0.0]]
    rows = run(table(spark, vectors, "double"))
    assert [r.vec_id for r in rows] == [0, 0, 1, 1, 2, 2] and {r.n for r in rows} == {3}
    assert rows[0].deviation is None and rows[0].identity_error < 1e-3
    x = [[int(1024 * v) + 100_000 for v in row] for row in vectors[:3]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert rows[4].deviation == sum((3 * v - t) ** 2 for v, t in zip(x[2], s, strict=True))


def test_rotations_find_small_eigenvalues():
    rng = np.random.default_rng(3)
    grades = np.geomspace(1, 1e-9, 9)
    core = rng.normal(size=(9, 9)) * 0.1
    matrix = (np.eye(9) + core + core.T) * np.outer(grades, grades)
    values, vectors = white.jacobi(matrix)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(9), atol=1e-13)
    np.testing.assert_allclose(vectors * values @ vectors.T, matrix, atol=1e-15)
    assert (np.diff(values) <= 0).all()
    # The smallest one to full relative accuracy: the determinant is the product of all.
    scaled = np.linalg.det(np.eye(9) + core + core.T)
    np.testing.assert_allclose(np.prod(values / grades**2), scaled, rtol=1e-10)
    assert white.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_too_wide_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(white, "DIMENSIONS", 2)
    with pytest.raises(ValueError, match="3 entries"):
        white.fit_whitening(table(spark, [[1, 2, 3]]))
