"""Contour integration against numpy's eigenpairs, and whitening against a plain fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import contour, whitening


def symmetric(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (turn * values) @ turn.T


@pytest.mark.parametrize("values", [
    np.arange(1.0, 33), np.array([1e6, 3.0, 2.9999999, 1, 1, 1, 0, 0]), np.array([5.0, 5, 5, 5, 5, 1]), np.array([2.0]),
    np.geomspace(1, 1e-9, 40), np.zeros(5), np.array([7.0, 0, 0]), np.concatenate([np.full(60, 1.0), [1.0000001, 9]])])
def test_leading_pairs(values):
    a = symmetric(values)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    least = np.abs(a).sum(1).max() * len(a) * 1e-15
    k = min(4, int((want > least).sum()))
    found, vectors = contour.top_pairs(a, 4)
    assert len(found) == k and np.abs(found - want[:k]).max(initial=0) <= 1e-13 * max(1e-300, want[0]) * len(a)
    assert np.abs(a @ vectors - vectors * found).max(initial=0) <= 1e-12 * max(want[0], 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-12


def test_inertia_counts_and_intervals():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        a[rng.random((n, n)) < 0.3] = 0
        a = np.triu(a, 1) + np.triu(a, 1).T  # zero pivots: blocks of two are needed
        values = np.linalg.eigvalsh(a)
        for shift in (*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1):
            if np.abs(values - shift).min() > 1e-9:
                assert contour.count_above(a, shift) == (values > shift).sum()
    a = symmetric(np.arange(-10.0, 11))
    found, vectors = contour.interval_pairs(a, -3.5, 2.5)
    assert np.allclose(found, [2, 1, 0, -1, -2, -3], atol=1e-12) and np.allclose(a @ vectors, vectors * found, atol=1e-11)
    assert len(contour.interval_pairs(a, 2.2, 2.8)[0]) == 0


def fitted(vectors, k=4):
    """{position: rows} by a plain fit with whole numbers as Python integers."""
    used = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in vectors.items()}
    fit = sorted(set(map(tuple, used.values())))
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dim)]
    z = np.array([[(n * x[d] - sums[d]) / n for d in range(dim)] for x in fit])
    v = z.T @ z / n
    values, turns = np.linalg.eigh(v)
    values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
    out = {}
    for i, x in used.items():
        own = np.array([(n * x[d] - sums[d]) / n for d in range(dim)])
        out[i] = (n, sum((n * x[d] - sums[d]) ** 2 for d in range(dim)), own @ turns / np.sqrt(values), values / np.trace(v))
    return out


@pytest.mark.parametrize("offset", [0.0, 5e5])
def test_rows_are_whitened_like_a_plain_fit(spark, offset):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((120, 6)) * [9, 5, 3, 2, 0.5, 0.1] + offset).astype(np.float32)
    vectors = {i: v.tolist() for i, v in enumerate(base)}
    vectors |= {500 + i: vectors[7] for i in range(200)}  # copies are fitted once
    odd = [(900, None, "x"), (901, [1.0] * 5 + [None], "x"), (902, [1.0] * 5 + [float("nan")], "x"), (903, [], "x"),
           (904, [1.0] * 5 + [float("inf")], "x"), (905, [1.0] * 7, "x"), (906, [1.0] * 5 + [3e38], "x")]
    rows = spark.createDataFrame([(i, v, "clash") for i, v in vectors.items()] + odd + [(3, vectors[3], "twice")],
                                 "vec_id long, embedding array<float>, component string")
    got = whitening.whiten(rows.repartition(5)).toPandas()
    want = fitted(vectors)
    assert len(got) == 4 * (len(vectors) + 1) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-6
    first = got[got.vec_id == 0].sort_values("component").whitened.to_numpy()
    sign = np.sign(first * want[0][2])
    for i, part in got.sort_values("component").groupby("vec_id"):
        n, deviation, white, explained = want[i]
        part = part.iloc[:: 2] if i == 3 else part
        assert (part.n == n).all() and (part.deviation == deviation).all()
        assert np.allclose(part.whitened * sign, white, atol=1e-6) and np.allclose(part.explained, explained, rtol=1e-9)


def test_packing_and_exact_sums():
    rng = np.random.default_rng(2)
    rows = [rng.integers(-(1 << b), 1 << b, 9) for b in (0, 6, 7, 8, 15, 16, 31, 32, 61) for _ in range(9)]
    assert (whitening.unpack([whitening.pack(r) for r in rows], 9) == np.array(rows)).all()
    assert len(whitening.pack(np.array([-128, 127]))) == 3 and len(whitening.pack(np.array([-129, 0]))) == 5
    centre = whitening.Centre(3, [10, -1, 1 << 40])
    x = np.array([[4, 0, 1 << 39], [1 << 20, -5, 7]])
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, centre.sums)) for r in x]
    assert centre.deviation(x) == [v if v < 2**63 else None for v in exact] and exact[0] > 2**63
    assert centre.deviation(np.array([[3, 0, (1 << 40) // 3]])) == [1 + 1 + (3 * ((1 << 40) // 3) - (1 << 40)) ** 2]


def test_empty_and_constant_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0 and whitening.whiten(one).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).orderBy("vec_id").collect()
    assert [r.component for r in got] == [1, 1, 1] and got[0].explained == 1.0
    assert whitening.whiten(line, id="vec_id").columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
