"""Whitening: eigenvalues and vectors against numpy, the report against a plain version, defined cases."""

import math
import random

import numpy as np
import pytest

from tallyframe.llm.whitening import principal_components, whitening_report

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def some_vectors(count=300, size=20, seed=2):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1 / (1 + j % 7)) for j in range(size)]) for i in range(count)]


def plain(rows):
    """Whole numbers, fit list, eigenvalues and vectors with exact sums and numpy's own solver."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for i, v in kept if len(v) == longest]
    fit = np.array(sorted({x for _, x in kept}), dtype=object)
    sums, n = fit.sum(axis=0), len(fit)
    centred = np.array(fit - np.array([s / n for s in sums]), dtype=float)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], components[:, ::-1].T


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "matrix",
    [
        symmetric(np.arange(1, 41) ** 2.0, 1),
        symmetric([5.0] * 10 + [2.0] * 15 + [1e-3] * 15, 2),
        symmetric([1 + 1e-10 * i for i in range(30)], 3),
        symmetric(10.0 ** -np.arange(0, 10, 0.5), 4),
        np.diag([3.0, 3.0, 1.0, 7.0, 7.0]),
        np.diag([4.0, 0.0, 0.0]),
        np.array([[2.0]]),
        np.array([[2.0, 1.0], [1.0, 2.0]]),
    ],
)
def test_components_are_eigenvectors(matrix):
    values, found = principal_components(matrix)
    expected = np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(values)]
    scale = expected[0]
    assert np.max(np.abs(values - expected)) < 1e-13 * scale
    assert np.max(np.abs(found @ found.T - np.eye(len(found)))) < 1e-12
    assert np.max(np.abs(matrix @ found.T - found.T * values)) < 1e-12 * scale


def test_no_variance():
    assert len(principal_components(np.zeros((4, 4)))[0]) == 0
    assert len(principal_components(np.zeros((0, 0)))[0]) == 0


def test_equal_to_the_plain_version(spark):
    rows = some_vectors()
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[3][1]), (901, None), (902, [1.0, None] * 10), (903, [float("nan")] * 20)]
    rows += [(904, [float("inf")] * 20), (905, []), (906, [1.0, 2.0])]
    kept, n, sums, values, components = plain(rows)
    found = {}
    for r in whitening_report(vectors(spark, rows)).collect():
        found.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(found) == 16 * len({i for i, _ in kept}) and sum(map(len, found.values())) == 16 * len(kept)
    signs = {}
    for i, x in kept:
        apart = np.array([c - s / n for c, s in zip(x, sums)])
        for k in range(16):
            for r in found[i, k + 1]:
                assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
                expected = apart @ components[k] / math.sqrt(values[k])
                if abs(expected) > 1e-6:
                    assert signs.setdefault(k, np.sign(expected * r["whitened"])) == np.sign(expected * r["whitened"])
                assert abs(abs(r["whitened"]) - abs(expected)) < 1e-8
                assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
                assert r["identity_error"] < 1e-9


def test_defined_cases(spark):
    assert whitening_report(vectors(spark, [])).count() == 0
    assert whitening_report(vectors(spark, [(1, [])])).count() == 0
    assert whitening_report(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    rows = whitening_report(vectors(spark, [(1, [0.0, 3.0]), (2, [1.0, 3.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in rows) == [(1, 1, 2, 4096, 1.0), (2, 1, 2, 4096, 1.0)]
    huge = {r["vec_id"]: r for r in whitening_report(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.0])])).collect()}
    assert set(huge) == {1, 2, 3} and huge[1]["deviation"] is None and huge[2]["deviation"] is None
    assert all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-4 and r["identity_error"] < 1e-4 for r in huge.values())
