"""Kernel sums of several states against all pairs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import noise
from pyspark.sql import functions as F

from panelwright.operators import distances, gauss, kernel


def plain(x, a, e, bw):
    k = np.exp(-bw * ((x[:, None] - x[None]) ** 2).sum(-1))
    ka = np.abs(a[:, None] - a[None])
    i, j = np.triu_indices(len(x), 1)
    return ((1 + ka + k + ka * k) * np.outer(e, e))[i, j].mean(), (k * np.outer(e, e))[i, j].sum()


def test_interpolation_is_exact_to_rounding():
    rng = np.random.default_rng(0)
    for d in range(-gauss.REACH, gauss.REACH + 1):
        u, v = rng.uniform(-1, 1, 200), rng.uniform(-1, 1, 200)
        want = np.exp(-((d * gauss.WIDTH + (u - v) * gauss.WIDTH / 2) ** 2))
        got = np.einsum("ra,ab,rb->r", gauss._interpolation(u), gauss._between(d), gauss._interpolation(v))
        assert np.abs(got - want).max() < 1e-12


@pytest.mark.parametrize("p,bw", [(2, 0.05), (2, 4.0), (3, 0.3), (3, 2.0), (4, 0.05)])
def test_loss_of_several_states_is_that_of_all_pairs(spark, monkeypatch, p, bw):
    monkeypatch.setattr(gauss, "PART", 40)  # cells in several parts
    rng = np.random.default_rng(p)
    n = 300 if p < 4 else 120
    x = rng.standard_normal((n, p)) * [3, 1, 2, 1][:p]
    x[: n // 3] = x[0]  # a third of the rows in one place
    a, e, g = rng.integers(0, 2, n), rng.standard_normal(n), rng.integers(0, 2, n) * 7
    names = [f"s{i}" for i in range(p)]
    td = spark.createDataFrame(pd.DataFrame({"cluster": g, "a": a, "tde": e} | {c: x[:, i] for i, c in enumerate(names)})).repartition(6)
    loss = {r.cluster: r.loss for r in kernel.kernel_td_loss(td, names, bw).collect()}
    pair = {r.cluster: r.s for r in kernel.kernel_pair_sum(td, names, bw, "cluster").collect()}
    for k in (0, 7):
        at = g == k
        want_loss, want_pair = plain(x[at], a[at], e[at], bw)
        assert loss[k] == pytest.approx(want_loss, abs=1e-11) and pair[k] == pytest.approx(want_pair, abs=1e-8)


def test_cells_at_the_rim_of_blocks(spark):
    """Points on cell borders, far apart, negative: partners across blocks are met once."""
    grid = [(i * 2.0, j * 2.0) for i in range(-6, 7) for j in range(-5, 6)]
    x = np.array(grid)
    e = np.cos(np.arange(len(x)))
    td = spark.createDataFrame(pd.DataFrame({"cluster": 1, "a": 1, "tde": e, "u": x[:, 0], "v": x[:, 1]}))
    _, want = plain(x, np.ones(len(x)), e, 1.0)
    assert kernel.kernel_pair_sum(td, ["u", "v"], 1.0, "cluster").first().s == pytest.approx(want, abs=1e-10)
    with pytest.raises(ValueError):
        gauss.cell_weights(td, ["u"] * 5, {"e": "tde"}, 1.0, "cluster")
    assert kernel.kernel_pair_sum(td.limit(0), ["u", "v"], 1.0, "cluster").count() == 0
    one = kernel.kernel_pair_sum(td.withColumn("w", F.lit(0.0)), ["u", "v", "w"], 1.0, "cluster").first().s
    assert one == pytest.approx(want, abs=1e-10)


# Distances of all pairs

def all_distances(v):
    v = np.asarray(v, float)
    i, j = np.triu_indices(len(v), 1)
    d = np.abs(v[i] - v[j])
    return np.sort(d[d > 0])


@pytest.mark.parametrize("kind", ["whole", "clustered", "wide"])
def test_order_statistics_of_pair_distances(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    v = {
        "whole": rng.integers(0, 60, 500).astype(float),
        "clustered": np.concatenate([np.full(90, 3.25), rng.normal(0, 1e-6, 150), rng.normal(5, 1e-3, 150), [1e3]]),
        "wide": np.exp(rng.normal(0, 6, 250)) - 1e4}[kind]
    monkeypatch.setattr(distances, "PAIRS", 2)
    d = all_distances(v)
    found = distances.PairDistances(spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double"), first=16)
    assert found.pairs == len(d)
    assert found.nth(len(d) // 5) == d[len(d) // 5]
    assert found.median() == pytest.approx(np.median(d), rel=1e-15)


def test_medians_without_distances(spark):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "s double")
    assert kernel.median_bandwidth(frame([]), ["s"]).first()[:] == (None, None)
    assert kernel.median_bandwidth(frame([2.0, 2.0, None]), ["s"]).first()[:] == (None, None)
    assert kernel.median_bandwidth(frame([2.0, 2.0, 6.0]), ["s"]).first()[:] == (4.0, 0.25)


def test_lagged_products_are_exact():
    counts = [3, 0, (1 << 40) + 7, 1, 1 << 33]
    assert distances._lagged(counts) == [sum(counts[i] * counts[i + k] for i in range(5 - k)) for k in range(1, 5)]


def test_steps_are_not_broadcast_to_the_kernel_loss(spark, tmp_path):
    """TD errors meet their states by a merge, however small their files are."""
    from panelwright.queries import policies

    rows = [(i, dt.datetime(1995 + t // 12, t % 12 + 1, 5 + j), float(noise(i, 40 * t + j) % 50 + 1), float(noise(i, 90 * t + j) % 9000), 0.05 * j,
             "RN"[noise(i, 70 * t + j) % 2]) for i in range(6) for t in range(14) for j in range(3)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    td = policies.td_with_states(spark, str(tmp_path))
    plan = td._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert td.count() == 6 * 13
    assert policies.kernel_td_loss(spark, str(tmp_path)).first()["loss"] is not None
