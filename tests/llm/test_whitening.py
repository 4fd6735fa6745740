"""Whitening: components against a library's eigenvectors, rows against a plain version."""

import math

import numpy as np
import pytest

from stockweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x double"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [1.0], [2.0, 1.0], [3.0, 3.0], [0.0, 0.0, 0.0], list(range(40)), [1e6, 1.0, 1e-6, 0.0], [1.0] * 6 + [2.0] * 5,
        [5.0, 1.0, 1.0 + 1e-14, 1.0 - 1e-14], np.geomspace(1, 1e12, 30), np.random.default_rng(3).random(64), [-1.0, 0.0, 1.0],
    ],
)
def test_components_are_eigenvectors(values):
    cov = symmetric(values)
    cov = (cov + cov.T) / 2
    got, vectors = whitening.components_of(cov)
    size = max(np.abs(values).max(), 1e-300)
    assert np.allclose(got, np.sort(values)[::-1], atol=1e-13 * size, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(cov @ vectors - vectors * got).max() <= 1e-12 * size


def test_polar_factor_of_an_ill_conditioned_matrix():
    a = symmetric([1.0, -1e-12, 1e-6, -3.0])
    u = whitening.polar(a)
    assert np.allclose(u @ u, np.eye(4), atol=1e-12) and round(np.trace(u)) == 0


def plain(rows, k=16):
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in ok]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for i, v in ok if len(v) == d]
    fit = np.array(sorted({x for _, x in xs}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = [j for j in np.argsort(-values) if values[j] > 1e-12 * values.max()][:k]
    out = {}
    for i, x in xs:
        delta = [n * a - b for a, b in zip(x, s)]
        for c, j in enumerate(order, 1):
            w = float(np.array([float(v) / n for v in delta]) @ vectors[:, j]) / math.sqrt(values[j])
            out.setdefault((i, c), []).append((n, sum(v * v for v in delta), abs(w), values[j] / values.sum()))
    return out


def test_rows_match_a_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(20) * np.geomspace(1, 0.05, 20)).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + rows[:3] + [(None, rows[1][1]), (5000, [0.0] * 20)]
    rows += [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c", 0.5) for i, v in rows], SCHEMA).repartition(5)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    want = plain(rows)
    assert set(got) == set(want)
    for key, found in got.items():
        assert len(found) == len(want[key])
        n, deviation, w, share = want[key][0]
        for r in found:
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(abs(r["whitened"]) - w) < 1e-9 and abs(r["explained"] - share) < 1e-10 * share + 1e-15
            assert 0 <= r["identity_error"] < 1e-9


def test_few_components_and_large_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 1e30 if i == 3 else 0.0], 1, "c", 0.5) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and {r["vec_id"] for r in got} == set(range(6))
    assert all(r["deviation"] is None for r in got)
    line = [(i, [float(i), 2.0 * i], 1, "c", 0.5) for i in range(9)]
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()} == {1}


def test_no_rows_without_variance(spark):
    same = [(i, [1.0, 2.0], 1, "c", 0.5) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(same, SCHEMA))
    assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
