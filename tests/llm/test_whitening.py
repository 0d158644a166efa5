"""op12: the spectrum against numpy's, rows against plain whole-number arithmetic."""

import math

import numpy as np
import pytest

from strandflow.llm.queries import op12_whitening
from strandflow.llm.whitening import polar_factor, spectrum, whitened

RANDOM = np.random.default_rng(11)


def symmetric(values):
    q = np.linalg.qr(RANDOM.normal(size=(len(values), len(values))))[0]
    return (q * values) @ q.T


MATRICES = {
    "covariance": np.cov(RANDOM.normal(size=(64, 500))),
    "spread": symmetric(np.logspace(0, -9, 40)),
    "repeated": symmetric(np.repeat([5.0, 2.0, 1.0], 7)),
    "repeated and low rank": symmetric(np.concatenate((np.repeat([4.0, 1.0], 5), np.zeros(10)))),
    "symmetric about the shift": symmetric(np.concatenate((np.arange(-5.0, 6), [0, 0]))),
    "close": symmetric(1 + 1e-7 * np.arange(20)),
    "large": 1e12 * symmetric(np.arange(1.0, 30)),
    "small": 1e-12 * symmetric(np.arange(1.0, 30)),
    "diagonal": np.diag(np.arange(9.0)),
    "identity": np.eye(6),
    "zero": np.zeros((5, 5)),
    "one": np.array([[3.0]]),
    "two": np.array([[2.0, 1.0], [1.0, -1.0]]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_spectrum(name):
    h = MATRICES[name]
    values, vectors = spectrum(h)
    norm = max(np.linalg.norm(h), 1e-300)
    expected, own = np.linalg.eigh(h)
    assert np.abs(values - expected[::-1]).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(h))).max() < 1e-13
    assert np.abs(h @ vectors - vectors * values).max() <= 1e-13 * norm
    gaps = np.abs(np.diff(expected[::-1], prepend=np.inf, append=-np.inf))
    alone = np.minimum(gaps[:-1], gaps[1:]) > 1e-3 * norm
    assert (1 - np.abs(np.sum(vectors * own[:, ::-1], axis=0))[alone] < 1e-13).all()


def test_polar_factor():
    h = MATRICES["covariance"] - np.eye(64)
    u = polar_factor(h)
    values, vectors = np.linalg.eigh(h)
    assert np.abs(u - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


def plain(rows, components=16):
    """{(key, component): (n, deviation, |whitened|, explained)} of vectors of one length, with numpy's eigenvectors."""
    kept = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), [int(x) for x in fit.sum(axis=0)]
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    out = []
    for k, x in kept:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for c in range(min(components, len(s))):
            e, own = values[-1 - c], vectors[:, -1 - c]
            out.append((k, c + 1, n, deviation, abs((np.array(x) - np.array(s) / n) @ own / math.sqrt(e)), e / np.trace(v)))
    return out


def same(found, expected):
    order = lambda r: (str(r[0]), r[1], r[4])
    found = sorted(((r[0], r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=order)
    expected = sorted(expected, key=order)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in expected], rtol=1e-7, atol=1e-7)


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    found = op12_whitening(spark, "/root/testdata/sf0.01").collect()
    same(found, plain([tuple(r) for r in table.collect()]))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_odd_rows(spark):
    base = [(i, [float(x) for x in RANDOM.normal(size=3)]) for i in range(40)]
    rows = [*base, (1, base[1][1]), (None, base[2][1]), (50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "'x' key", "'y' component", "struct(1 as `a b`) `we ``ird`")
    # The entry of 1e300 does not fit and takes no part.
    same(whitened(df, "id", "v").collect(), plain([r for r in rows if r[0] not in (54, 55)]))
    # Vectors of other lengths are whitened among themselves.
    more = spark.createDataFrame([(100 + i, [float(x) for x in RANDOM.normal(size=2)]) for i in range(9)], "id long, v array<double>")
    both = whitened(df.select("id", "v").union(more), "id", "v").collect()
    same([r for r in both if (r.id or 0) >= 100], plain([tuple(r) for r in more.collect()]))
    assert len(both) == 42 * 3 + 9 * 2


def test_no_variance_and_no_rows(spark):
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect() == []
    assert whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    flat = whitened(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component) for r in flat) == [(i, 1) for i in range(5)]


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(x) * 2.0**30 for x in RANDOM.integers(-9, 9, size=2)]) for i in range(30)]
    found = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    expected = {r[:2]: r[3] if r[3] < 1 << 63 else None for r in plain(rows)}
    assert {(r.vec_id, r.component): r.deviation for r in found} == expected and None in expected.values()
