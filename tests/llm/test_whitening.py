"""Whitening against plain integers and numpy, over the table and over odd rows."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from flowlens.llm import queries, whitening
from flowlens.llm.common import table

from ..conftest import SF

ODD = "vec_id long, embedding array<float>, label int, n long, x double, weight string, white string"


def brute(vectors, weights=None):
    """n, deviations, covariance with exact sums, eigenvalues and eigenvectors of the x vectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = x if weights is None else sorted({tuple(v) for v in x})
    n, total = len(fit), [sum(v[j] for v in fit) for j in range(len(fit[0]))]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    d = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, total, strict=True)] for v in x])
    f = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, total, strict=True)] for v in fit])
    e, u = np.linalg.eigh(f.T @ f / n)
    return n, deviation, d, e[::-1], u[:, ::-1]


def held(rows, ids, vectors, weights=None):
    n, deviation, d, e, u = brute(vectors, weights)
    k = max(r["component"] for r in rows)
    white = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * k and len(white) == len(rows)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-4
    for c in range(1, k + 1):
        want = d @ u[:, c - 1] / np.sqrt(e[c - 1])
        got = np.array([white[i, c]["whitened"] for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert all(abs(white[i, c]["explained"] * e.sum() / e[c - 1] - 1) < 1e-9 for i in ids[:5])
    assert all(white[i, 1]["n"] == n and white[i, 1]["deviation"] == v for i, v in zip(ids, deviation, strict=True))
    return k


def test_query_against_brute_force(spark):
    table_rows = [r for r in table(spark, SF, "embeddings").collect() if r["embedding"] is not None]
    rows = queries.op13_embedding_whitening(spark, SF).collect()
    assert held(rows, [r["vec_id"] for r in table_rows], [r["embedding"] for r in table_rows]) == 32


@pytest.mark.parametrize("weights", ["count", "one"])
def test_copies_weigh_in_the_fit(spark, weights):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6)).astype(np.float32)
    v = np.concatenate([base, base[:1].repeat(60, axis=0), base[1:2] + np.float32(1e-4)])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(7)
    assert held(whitening.whiten(frame, weights).collect(), list(range(len(v))), v, None if weights == "count" else weights) == 6


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, -0.25, 3.0]), (2, [1.0, 2.0, -1.0]), (3, [0.0, -0.0, 0.01]), (4, [-2.0, 0.7, 0.3]), (4, [-2.0, 0.7, 0.3]), (None, [9.0, 1.0, 1.0])]
    bad = [(5, None), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [1.0, 0.0]), (10, [])]
    frame = spark.createDataFrame([(i, v, 1, 2, 0.5, "w", "y") for i, v in good + bad], ODD)
    rows = whitening.whiten(frame).collect()
    n, deviation, d, e, u = brute([np.float32(v) for _, v in good])
    assert n == 6 and Counter(r["vec_id"] for r in rows) == Counter([1, 2, 3, 4, 4, None] * 3)
    assert {(r["vec_id"], r["deviation"]) for r in rows} == {(i, x) for (i, _), x in zip(good, deviation, strict=True)}
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.where("vec_id = 1")).collect() == []  # no variance
    assert whitening.whiten(frame.where("vec_id IN (5, 6, 7, 8, 10)")).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(frame, "two")


def test_flat_directions_are_no_components_and_far_entries_stay_exact(spark):
    v = [[float(i % 5), 1.0, float(i // 5)] for i in range(20)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert held(whitening.whiten(frame).collect(), list(range(20)), v) == 2
    far = [[1e30, 0.0], [-1e30, 1.0], [1e12, 5.0], [3.0, 2.0]]
    rows = whitening.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(far)], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in rows} == {0, 1, 2, 3} and rows[0]["deviation"] is None and all(np.isfinite(r["whitened"]) for r in rows)
