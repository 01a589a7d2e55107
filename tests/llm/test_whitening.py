"""Rank-one updates of a spectrum, and whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from tidegrid.llm import whitening
from tidegrid.llm.spectra import Spectrum, rank_one


@pytest.mark.parametrize("width", [1, 2, 7, 30])
def test_rank_one_updates_follow_the_matrix(width):
    rng = np.random.default_rng(width)
    d, q, whole = np.zeros(width), np.eye(width), np.zeros((width, width))
    for k in range(80):
        v = rng.standard_normal(width) * 10.0 ** rng.uniform(-5, 5)
        v = np.eye(width)[k % width] * 2.0 if k % 9 == 0 else np.zeros(width) if k % 17 == 0 else np.round(v) if k % 5 == 0 else v
        d, q = rank_one(d, q, v)
        whole += np.outer(v, v)
        size = np.abs(whole).max() + 1e-300
        assert np.abs(q * d @ q.T - whole).max() < 1e-13 * size * width and np.abs(q.T @ q - np.eye(width)).max() < 1e-12


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((900, 12)) * np.arange(1, 13) * 100).astype(np.int64) + 100_000
    parts = []
    for rows in (x[:3], x[3:4], x[4:500], x[500:]):
        held = Spectrum.empty(12)
        held.add_rows(rows)
        parts.append(Spectrum.of(*held.state()))
    for other in parts[1:]:
        parts[0].add(other)
    c = x - x.mean(axis=0)
    assert parts[0].n == 900 and parts[0].sums() == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].values, np.linalg.eigvalsh(c.T @ c), rtol=1e-11)


def brute(rows, k):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], c @ u[:, :k], e


def test_whitening_against_a_plain_eigendecomposition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 50)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(a)) for a in rng.standard_normal(11) * np.arange(2, 13) / 10]) for i in range(600)] + [(None, [0.5] * 11), (700, [0.25] * 11), (700, [0.25] * 11)]
    odd = [(900, None), (901, []), (902, [None] * 11), (903, [math.nan] + [0.0] * 10), (904, [math.inf] * 11), (905, [1.0] * 4)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS vector", "2 AS component", "3 AS part").repartition(7)
    got = whitening.whiten(docs).collect()
    deviations, projected, e = brute(rows, 8)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {603}
    assert sorted(map(str, {(r.vec_id, r.deviation) for r in got})) == sorted(map(str, {(i, d) for (i, _), d in zip(rows, deviations)}))
    ids = [i for i, _ in rows]
    for k in range(8):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        want = projected[:, k] / np.sqrt(e[k])
        sign = np.sign(mine[0] * want[0])
        assert max(abs(mine[i] - sign * w) for i, w in zip(ids, want)) < 1e-10
    assert np.allclose([next(r.explained for r in got if r.component == k + 1) for k in range(8)], e[:8] / e.sum(), rtol=1e-12)
    assert {r.identity_error for r in got}.pop() < 1e-12


def test_few_dimensions_no_variance_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, whitening.whiten(docs).collect()))
    assert [r[:2] for r in got] == [(i, k) for i in (1, 2, 3) for k in (1, 2)]
    assert all(r[4] is None and r[5] == 0 for r in got if r[1] == 2) and all(abs(r[5] - 1) < 1e-12 for r in got if r[1] == 1)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.deviation, r.explained) for r in same] == [(None, 0, 0.0)] * 2
    assert whitening.whiten(docs.limit(0)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [2.0**40]), (2, [-(2.0**40)])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in huge] == [None, None]
