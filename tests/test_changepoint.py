"""Change scans against refitting every segment, planted changes, and the null law."""

import numpy as np
import pandas as pd
import pytest
from conftest import changed, design, panel_frame, sse, steady, step_arrays
from pyspark.sql import functions as F

from panelwright.functions.grid import ScanGrid
from panelwright.operators import moments as mo
from panelwright.operators.transitions import transitions
from panelwright.plans import changepoint as cp
from panelwright.plans import nulls

# Splits 2 .. kappa - 2.
GRID = ScanGrid(51, kappa_min=8, step=1, eps=2 / 51)


def brute(pdf, grid, p, scale=1.0):
    _, t, a, s, y = step_arrays(pdf, p)
    x, end, out = design(a, s), grid.n_times - 1, {}
    for k in grid.kappas():
        for u in grid.splits(k):
            w = t >= end - k
            lo, hi = w & (t < end - k + u), t >= end - k + u
            n = w.sum() * p
            out[k, u] = scale * n / 2 * np.log((sse(x[w], y[w]) / n) / ((sse(x[lo], y[lo]) + sse(x[hi], y[hi])) / n))
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_scan_equals_refitting_every_segment(spark, p):
    pdf = panel_frame(range(6), 30, changed, p)
    grid = ScanGrid(30, kappa_min=12, step=3, eps=0.1)
    states = [f"s{j + 1}" for j in range(p)]
    trans = transitions(spark.createDataFrame(pdf), states)
    want = brute(pdf, grid, p)
    for spread in (False, True):
        got = {(r["kappa"], r["u"]): r["stat"] for r in cp.split_statistics(trans, grid, p, spread=spread).collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-7
    best = {r["kappa"]: (r["u"], r["stat"]) for r in cp.best_splits(trans, grid, p).collect()}
    for k in grid.kappas():
        top = max(v for (kk, _), v in want.items() if kk == k)
        assert abs(best[k][1] - top) < 1e-7 and abs(want[k, best[k][0]] - top) < 1e-9


def test_one_action_only_falls_back(spark):
    pdf = panel_frame(range(6), 30, changed, action=0)
    grid = ScanGrid(30, kappa_min=15, step=5, eps=0.1)
    want = brute(pdf, grid, 1)
    got = cp.split_statistics(transitions(spark.createDataFrame(pdf), ["s1"]), grid).collect()
    assert max(abs(r["stat"] - want[r["kappa"], r["u"]]) for r in got) < 1e-7


def test_result_does_not_depend_on_order_or_partitions(spark, change_panel):
    base = transitions(spark.createDataFrame(change_panel), ["s1"])
    a = {tuple(r[:3]): r[3] for r in cp.best_splits(base, GRID).collect()}
    b = {tuple(r[:3]): r[3] for r in cp.best_splits(base.orderBy(F.rand(3)).repartition(5), GRID).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-8


def test_planted_change_is_found_and_none_invented(spark, change_panel, steady_panel):
    assert GRID.splits(10) == list(range(2, 9))
    trans = transitions(spark.createDataFrame(pd.concat([change_panel, steady_panel])), ["s1"])
    labels = trans.select("subject").distinct().withColumn("cluster", (F.col("subject") >= 100).cast("int"))
    found = {r["cluster"]: r["tau"] for r in cp.detect_transition_change(
        trans, GRID, assignment=labels, alpha=0.01, draws=4000).collect()}
    assert found == {0: 25, 1: 0}


def test_individual_detection_equals_one_run_per_subject(spark, change_panel):
    trans = transitions(spark.createDataFrame(change_panel), ["s1"])
    limits = spark.range(1).select(F.explode(GRID.kappa_column()).alias("kappa"), F.lit(4.0).alias("threshold"))
    each = {r["subject"]: r["tau"] for r in cp.detect_individually(trans, GRID, limits=limits).collect()}
    for i in (0, 5):
        alone = cp.detect_transition_change(trans.filter(F.col("subject") == i), GRID, limits=limits).first()
        assert each[i] == alone["tau"]


def test_first_rejection_uses_the_window_before(spark):
    grid = ScanGrid(30, kappa_min=10, step=2)
    best = spark.createDataFrame([(0, 10, 5, 1.0), (0, 12, 5, 9.0), (0, 14, 5, 9.0), (1, 10, 5, 9.0), (2, 10, 5, 0.0)],
                                 "cluster int, kappa int, u int, stat double")
    limits = spark.createDataFrame([(k, 5.0) for k in (10, 12, 14)], "kappa int, threshold double")
    got = {r["cluster"]: r["tau"] for r in cp.first_rejection(best, limits, grid).collect()}
    assert got == {0: 29 - 10, 1: 29 - 10, 2: 0}


def test_cyclic_shift(spark, change_panel):
    pdf = change_panel[change_panel.t < 20]
    trans = transitions(spark.createDataFrame(pdf), ["s1"])
    got = {r["shift"]: r["stat"] for r in cp.cyclic_shift_statistics(trans, 20, 8).collect()}
    _, t, a, s, y = step_arrays(pdf)
    x, n = design(a, s), len(t)
    for shift in (0, 1, 7, 18):
        seq = np.roll(np.arange(19), shift)
        first = np.isin(t, seq[:8])
        want = n * np.log(sse(x, y) / (sse(x[first], y[first]) + sse(x[~first], y[~first])))
        assert abs(got[shift] - want) < 1e-8
    two = panel_frame(range(4), 20, changed, 2)
    got = cp.cyclic_shift_statistics(transitions(spark.createDataFrame(two), ["s1", "s2"]), 20, 8, p=2).filter("shift = 0").first()
    _, t, a, s, y = step_arrays(two, 2)
    x, first = design(a, s), t < 8
    want = 2 * len(t) * np.log(sse(x, y) / (sse(x[first], y[first]) + sse(x[~first], y[~first])))
    assert abs(got["stat"] - want) < 1e-8


def test_permutation_limits_bracket_a_steady_panel(spark, steady_panel):
    trans = transitions(spark.createDataFrame(steady_panel), ["s1"])
    grid = ScanGrid(51, kappa_min=30, kappa_max=42, step=10, eps=0.1)
    mom = cp.time_moments(cp.label(trans, None), 1)
    a = cp.permutation_sample(mom, grid, 1, 150).orderBy("kappa", "rep").toPandas()
    b = cp.permutation_sample(mom.repartition(3), grid, 1, 150).orderBy("kappa", "rep").toPandas()
    assert len(a) == 300 and np.allclose(a["stat"], b["stat"]) and (a["stat"] > 0).all()
    found = cp.detect_transition_change(trans, grid, threshold="permutation", draws=150).first()
    assert found["tau"] == 0


def test_mean_and_marginal_change(spark, change_panel):
    n_times, eps, kappas = 51, 0.1, (20, 30)
    df = spark.createDataFrame(change_panel)
    cube = change_panel.sort_values(["subject", "t"])["s1"].to_numpy().reshape(12, 51)
    fwd = np.cumsum(cube, 1) / np.arange(1, 52)
    bwd = np.flip(np.cumsum(np.flip(cube, 1), 1) / np.arange(1, 52), 1)
    k = 30
    us = list(range(int(n_times - eps * n_times) - 1, int(n_times - k + eps * n_times), -1))
    stats = [np.sqrt((n_times - u) * (u - n_times + k) / k**2) * 12 * abs((fwd[:, u] - bwd[:, u + 1]).sum()) for u in us]
    got = cp.detect_mean_change(df, n_times, kappas, eps, c1=1e-6).first()
    assert abs(got["stat"] - max(stats)) < 1e-9 and got["tau"] == us[int(np.argmax(stats))] and got["kappa"] == 30
    low = cp.detect_mean_change(df, n_times, kappas, eps, c1=1e9).first()
    assert low["tau"] == int(n_times - k + eps * n_times) + 1
    for variance in ("mle", "as_coded"):
        vals = []
        for u in us:
            y1, y2, n = cube[:, : u + 1], cube[:, u + 1:], cube.size
            v1 = (y1.var() * y1.size + y2.var() * y2.size) / (n if variance == "mle" else 12)
            ll = lambda y, m, v: np.sum(-0.5 * np.log(2 * np.pi * v) - (y - m) ** 2 / (2 * v))
            vals.append((ll(y1, y1.mean(), v1) + ll(y2, y2.mean(), v1) - ll(cube, cube.mean(), cube.var())) / (k * 12))
        got = cp.detect_marginal_change(df, n_times, kappas, eps, c1=1e-9, variance=variance).first()
        assert abs(got["stat"] - max(vals)) < 1e-9


def test_null_sample_has_the_law_of_the_direct_simulation(spark):
    got = nulls.null_sample(spark, [10, 20], 4, 3000, block=100).toPandas()
    rng = np.random.default_rng(5)
    direct = []
    for _ in range(3000):
        x = rng.standard_normal((3, 20, 4))  # three subjects: their number cancels
        best = 0.0
        for u in range(1, 20):
            c1 = np.sqrt((20 - u) / (3 * u * 20)) * x[:, :u].sum((0, 1))
            c2 = np.sqrt(u / (3 * (20 - u) * 20)) * x[:, u:].sum((0, 1))
            best = max(best, ((c1 - c2) ** 2).sum())
        direct.append(best)
    ours = got[got.kappa == 20]["stat"]
    assert len(ours) == 3000
    for q, tol in ((0.5, 0.5), (0.9, 0.9), (0.95, 1.2)):
        assert abs(np.quantile(ours, q) - np.quantile(direct, q)) < tol
    low, high = (r["threshold"] for r in nulls.thresholds(nulls.null_sample(spark, [10, 40], 4, 2000), 0.05).orderBy("kappa").collect())
    assert low < high


def test_chi2_null(spark):
    s = nulls.null_sample(spark, [5, 9], 3, 4000, "chi2", [1, 10]).groupBy("kappa").agg(F.avg("stat").alias("m")).orderBy("kappa").collect()
    assert abs(s[0]["m"] - 3) < 0.2 and s[1]["m"] > 6


def test_null_cache_reads_what_it_has(spark, tmp_path):
    cache = nulls.NullCache(spark, str(tmp_path / "cache"))
    a = cache.sample([5, 6], 2, 300).orderBy("kappa", "rep").toPandas()
    before = sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))
    b = cache.sample([5, 6, 7], 2, 300).orderBy("kappa", "rep").toPandas()
    after = sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))
    assert set(before) <= set(after) and set(b["kappa"]) == {5, 6, 7}
    assert np.array_equal(a["stat"], b[b.kappa < 7]["stat"])
    cache.sample([5, 7], 2, 300).count()
    assert sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet")) == after


def test_null_cache_tells_split_counts_apart(spark, tmp_path):
    cache = nulls.NullCache(spark, str(tmp_path / "cache"))
    mean = [cache.sample([30], 8, 500, "chi2", [n]).agg(F.avg("stat")).first()[0] for n in (2, 28, 2)]
    assert mean[0] == mean[2] and mean[1] > mean[0] + 5


def test_draws_do_not_depend_on_the_request(spark):
    for kind, counts in (("bridge", {30: None, 40: None}), ("chi2", {30: 5, 40: 20})):
        n = None if kind == "bridge" else list(counts.values())
        alone = nulls.null_sample(spark, [30], 3, 400, kind, n and n[:1]).orderBy("rep").toPandas()
        both = nulls.null_sample(spark, [30, 40], 3, 400, kind, n).filter("kappa = 30").orderBy("rep").toPandas()
        assert np.allclose(alone["stat"], both["stat"], rtol=0, atol=1e-12)


def test_pvalues(spark):
    best = spark.createDataFrame([(0, 5, 2, 2.5)], "cluster int, kappa int, u int, stat double")
    sample = spark.createDataFrame([(5, i, float(i)) for i in range(10)], nulls.NULL_SCHEMA)
    assert abs(cp.with_pvalues(best, sample).first()["pvalue"] - 0.7) < 1e-12


@pytest.mark.parametrize("p", [1, 3])
def test_moments_reproduce_least_squares(spark, p):
    pdf = panel_frame(range(5), 25, changed, p)
    states = [f"s{j + 1}" for j in range(p)]
    trans = transitions(spark.createDataFrame(pdf), states).withColumn("g", F.lit(1))
    _, t, a, s, y = step_arrays(pdf, p)
    x = design(a, s)
    c = np.linalg.lstsq(x, y, rcond=None)[0]
    row = mo.fit_by(trans, "g", p).first()
    assert np.allclose(np.array(row["coef"]).reshape(p, -1).T, c, atol=1e-9) and abs(row["sse"] - sse(x, y)) < 1e-8
    layout = mo.Moments(p)
    m = np.array([mo.moments_by(trans, ["g"], p).first()[n] for n in layout.names])
    other = np.arange(c.size, dtype=float).reshape(c.shape) / 10
    assert abs(layout.sse_weights(other) @ m - ((y - x @ other) ** 2).sum()) < 1e-7
    assert abs(float(mo.batch_sse(layout, m)) - sse(x, y)) < 1e-8


def test_minimum_norm_with_one_action(spark):
    for action in (0, 1):
        pdf = panel_frame(range(4), 20, steady, action=action)
        trans = transitions(spark.createDataFrame(pdf), ["s1"]).withColumn("g", F.lit(1))
        _, _, a, s, y = step_arrays(pdf)
        c = np.linalg.lstsq(design(a, s), y, rcond=None)[0]
        assert np.allclose(mo.fit_by(trans, "g", 1).first()["coef"], c[:, 0], atol=1e-8)


@pytest.mark.parametrize("pack,batch", [(1, 7), (5, 1000), (64, 40)])
def test_packs_of_subjects_are_scanned_like_groups(spark, change_panel, monkeypatch, pack, batch):
    """Subjects with gaps, of unequal length and without a row in some windows."""
    df = spark.createDataFrame(change_panel).filter("not (subject = 2 and t < 45) and not (subject = 3 and t > 20) and t % 11 <> subject % 11")
    mom = cp.time_moments(transitions(df, ["s1"]).withColumn("cluster", F.col("subject") * 3), 1)
    grid = ScanGrid(51, kappa_min=8, eps=0.05)
    monkeypatch.setattr(cp, "CLUSTERS", pack)
    monkeypatch.setattr(cp, "spread_partitions", lambda df: 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        order = ["cluster", "kappa", "u"]
        for best in (True, False):
            got = cp.scan_many(mom, grid, 1, best_only=best).orderBy(*order).toPandas()
            want = cp.split_statistics(None, grid, 1, mom=mom, best_only=best).orderBy(*order).toPandas()
            pd.testing.assert_frame_equal(got, want, check_dtype=False)
        assert cp.scan_many(mom.limit(0), grid, 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_window_of_a_replicate_is_a_shuffle_of_its_own_steps(spark, steady_panel):
    """A window's draws don't depend on which other windows are asked for, and have the law of fresh shuffles."""
    mom = cp.time_moments(cp.label(transitions(spark.createDataFrame(steady_panel), ["s1"]), None), 1)
    many = cp.permutation_sample(mom, ScanGrid(51, kappa_min=25), 1, 60)
    one = cp.permutation_sample(mom, ScanGrid(51, kappa_min=30, kappa_max=31), 1, 60)
    a, b = (x.filter("kappa = 30").orderBy("rep").toPandas() for x in (many, one))
    assert (a.stat == b.stat).all() and len(a) == 60
    assert many.select("kappa").distinct().count() == len(ScanGrid(51, kappa_min=25).kappas())
    rows = mom.orderBy("t").toPandas()
    layout, names = mo.Moments(1), mo.Moments(1).names
    window = rows[rows.t >= 20][names].to_numpy(float)
    rng, u = np.random.default_rng(0), np.asarray(ScanGrid(51, kappa_min=30, kappa_max=31).splits(30))
    fresh = []
    for _ in range(400):
        left = np.cumsum(window[rng.permutation(30)], axis=0)[u - 1]
        total = window.sum(0)
        fresh.append((0.5 * total[0] * np.log(mo.batch_sse(layout, total) / (mo.batch_sse(layout, left) + mo.batch_sse(layout, total - left)))).max())
    assert abs(np.mean(fresh) - a.stat.mean()) < 4 * np.std(fresh) / 60**0.5


def test_long_walks_are_held_in_parts(spark, monkeypatch):
    whole = nulls.null_sample(spark, [10, 20], 2, 30).orderBy("kappa", "rep").toPandas()
    key = [1, 0 << 20 | 2]
    walk = np.cumsum(np.random.Generator(np.random.Philox(key=key)).standard_normal((20, 30, 2)).transpose(1, 0, 2), axis=1)
    u = np.arange(1, 20)
    bridge = walk[:, :19] - (u / 20)[None, :, None] * walk[:, 19:20]
    assert np.allclose(whole[whole.kappa == 20].stat, ((bridge**2).sum(2) * 20 / (u * (20 - u))).max(1))
    monkeypatch.setattr(nulls, "WALK", 8 * 20 * 2 * 7)
    assert np.array_equal(nulls._bridge_block(key, 30, [10, 20], 2)[:, 1], whole[whole.kappa == 20].stat)
