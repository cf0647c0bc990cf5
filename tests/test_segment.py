"""Segmentation and alternating estimation against plain numpy loops and planted groups."""

import numpy as np
import pandas as pd
import pytest
from conftest import changed, design, panel_frame, steady, step_arrays
from pyspark.sql import functions as F

from panelwright.functions import criteria
from panelwright.operators import summary
from panelwright.operators.transitions import fill_dense, transitions
from panelwright.plans import alternate, segment
from panelwright.plans import changepoint as cp


def numpy_em(pdf, k, labels, max_iter, p=1):
    """Hard EM on rows, with the repair of empty clusters; labels is {subject: k}."""
    subj, _, a, s, y = step_arrays(pdf, p)
    x, ids = design(a, s), np.unique(subj)
    lab = np.array([labels[i] for i in ids])
    n = np.array([(subj == i).sum() for i in ids])
    for m in range(max_iter):
        errs = np.zeros((len(ids), k))
        w = 1.0 / n[np.searchsorted(ids, subj)]
        row_lab = lab[np.searchsorted(ids, subj)]
        for j in range(k):
            at = row_lab == j
            c = np.zeros((x.shape[1], p))
            if at.any():
                sw = np.sqrt(w[at])[:, None]
                c = np.linalg.lstsq(x[at] * sw, y[at] * sw, rcond=None)[0]
            e = ((y - x @ c) ** 2).sum(1)
            errs[:, j] = [e[subj == i].sum() for i in ids]
        new = errs.argmin(1)
        loss = -(errs.min(1) / n).sum()
        taken = []
        for j in sorted(set(range(k)) - set(new)):
            for i in np.argsort(errs[:, j], kind="stable"):
                if i in taken or (new == new[i]).sum() == 1:
                    continue
                loss += errs[i, new[i]] / n[i] - errs[i, j] / n[i]
                new[i] = j
                taken.append(i)
                break
        done = np.array_equal(new, lab)
        lab = new
        if done:
            break
    return dict(zip(ids.tolist(), lab.tolist())), loss


@pytest.fixture(scope="module")
def mixed():
    return pd.concat([panel_frame(range(8), 30, lambda t: (0, -0.5, 0.3, 0.5)), panel_frame(range(100, 106), 30, steady)])


def run(spark, pdf, k, label, max_iter=20, p=1):
    trans = transitions(spark.createDataFrame(pdf), [f"s{j + 1}" for j in range(p)])
    got = segment.cluster_by_dynamics(segment.prepared(trans, p), k, p, label, max_iter)
    return {r["subject"]: r["cluster"] for r in got.assignment.collect()}, got


@pytest.mark.parametrize("k,max_iter", [(2, 20), (3, 4), (3, 1)])
def test_em_equals_plain_loop(spark, mixed, k, max_iter):
    want, loss = numpy_em(mixed, k, {i: i % k for i in mixed.subject.unique()}, max_iter)
    got, seg = run(spark, mixed, k, (F.col("subject") % k).cast("int"), max_iter)
    assert got == want and abs(seg.loss - loss) < 1e-8


def test_two_planted_groups_are_separated(spark, mixed):
    got, _ = run(spark, mixed, 2, (F.col("subject") % 2).cast("int"))
    assert len({got[i] for i in range(8)}) == 1 and len({got[i] for i in range(100, 106)}) == 1 and got[0] != got[100]


def test_empty_clusters_are_repaired(spark, mixed):
    """All subjects start in cluster 0, so clusters 1 and 2 begin empty."""
    want, loss = numpy_em(mixed, 3, {i: 0 for i in mixed.subject.unique()}, 1)
    got, seg = run(spark, mixed, 3, F.lit(0), 1)
    assert set(got.values()) == {0, 1, 2}
    assert got == want and abs(seg.loss - loss) < 1e-8
    want, loss = numpy_em(mixed, 3, {i: 0 for i in mixed.subject.unique()}, 15)
    got, seg = run(spark, mixed, 3, F.lit(0), 15)
    assert got == want and abs(seg.loss - loss) < 1e-8


def test_two_state_em(spark):
    pdf = pd.concat([panel_frame(range(5), 20, changed, 2), panel_frame(range(50, 55), 20, steady, 2)])
    want, loss = numpy_em(pdf, 2, {i: i % 2 for i in pdf.subject.unique()}, 10, 2)
    got, seg = run(spark, pdf, 2, (F.col("subject") % 2).cast("int"), 10, 2)
    assert got == want and abs(seg.loss - loss) < 1e-8


def test_grid_of_k_equals_single_runs(spark, mixed):
    trans = transitions(spark.createDataFrame(mixed), ["s1"])
    subj = segment.prepared(trans, 1)
    many = segment.cluster_by_dynamics_grid(subj, [1, 2, 3], 1, max_iter=8)
    for k in (1, 2, 3):
        one = segment.cluster_by_dynamics(subj, k, 1, max_iter=8)
        assert abs(many[k].loss - one.loss) < 1e-10 and many[k].iterations == one.iterations
    best, table = segment.select_k(subj, [1, 2, 3], 1, 30, (1.0, 1.0), "sqrtN", 0.01, max_iter=8)
    rows = {r["k"]: r["ic"] for r in table.collect()}
    assert best.k == max(rows, key=rows.get)
    assert abs(rows[2] - (many[2].loss - 0.01 * 2 * np.sqrt(14))) < 1e-9


def test_quality_and_density(spark, mixed):
    subj = segment.prepared(transitions(spark.createDataFrame(mixed), ["s1"]), 1)
    labels = subj.select("subject", (F.col("subject") >= 100).cast("int").alias("cluster"))
    total = segment.cluster_quality(subj, labels, 1).agg(F.sum("loss_normalized")).first()[0]
    _, loss = numpy_em(mixed, 2, {i: int(i >= 100) for i in mixed.subject.unique()}, 1)
    assert abs(total - loss) < 1e-8  # the planted labels are stable, so both use the same fit
    coefs = segment.weighted_fit(subj.join(labels, "subject"), 2, 1)
    e = np.array([list(r) for r in subj.select(*segment.error_columns(coefs, 1)).collect()])
    sc = np.sqrt((e**2).mean())
    want = (np.exp(-0.5 * (e / sc) ** 2) / (sc * np.sqrt(2 * np.pi))).sum()
    assert abs(segment.density_loss(subj, coefs, 1).first()["loss"] - want) < 1e-9


def test_level_clusterings(spark):
    rows = [(i, t, float((i >= 5) * 10 + (i * 7 + t * 3) % 5 / 5)) for i in range(10) for t in range(12)]
    df = spark.createDataFrame(rows, "subject bigint, t int, s1 double")
    lev = segment.subject_levels(df, ["s1"], 2)
    # The scaled distance has no term for the variance, so its start must be near the groups.
    for out in (segment.cluster_by_mean(lev, 2), segment.cluster_by_marginal(lev, 2, (F.col("subject") >= 4).cast("int"))):
        lab = {r["subject"]: r["cluster"] for r in out.collect()}
        assert len({lab[i] for i in range(5)}) == 1 and len({lab[i] for i in range(5, 10)}) == 1 and lab[0] != lab[9]


def test_adjusted_rand_extremes(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(12)], "subject bigint, cluster int")
    same = spark.createDataFrame([(i, (i % 3) + 5) for i in range(12)], "subject bigint, cluster int")
    one = spark.createDataFrame([(i, 0) for i in range(12)], "subject bigint, cluster int")
    assert summary.adjusted_rand(a, same).first()["ari"] == 1.0
    assert abs(summary.adjusted_rand(a, one).first()["ari"]) < 1e-12
    assert summary.adjusted_rand(one, one).first()["ari"] == 1.0


def test_relative_error_skips_zero_truth(spark):
    pred = spark.createDataFrame([(1, 12), (2, 3), (3, 20)], "subject int, tau int")
    true = spark.createDataFrame([(1, 10), (2, 0), (3, 25)], "subject int, tau int")
    r = summary.relative_error(pred, true).first()
    assert abs(r["err"] - 0.2) < 1e-12 and r["n_used"] == 2 and r["n_zero"] == 1


@pytest.fixture(scope="module")
def doubly(spark, change_panel, steady_panel):
    return transitions(spark.createDataFrame(pd.concat([change_panel, steady_panel])), ["s1"])


# Splits 2 .. kappa - 2.
SETTINGS = dict(n_times=51, p=1, kappa_min=20, kappa_interval=1, epsilon=2 / 51, draws=4000)


def _planted(result):
    rows = result.collect()
    lab = {r["subject"]: r["cluster"] for r in rows}
    tau = {r["subject"]: r["tau"] for r in rows}
    assert len({lab[i] for i in range(12)}) == 1 and len({lab[i] for i in range(100, 112)}) == 1 and lab[0] != lab[100]
    assert {tau[i] for i in range(12)} == {25} and {tau[i] for i in range(100, 112)} == {0}


def test_alternating_finds_planted_groups_and_changes(spark, doubly):
    est = alternate.PanelSegmenter(k=2, init="clusters", max_iter=5, **SETTINGS).fit(doubly)
    _planted(est.result)
    assert est.k == 2 and len(est.k_path) == len(est.loss_list) and est.run_log().count() == len(est.k_path)
    est = alternate.PanelSegmenter(k=2, init="changepoints", max_iter=4, **SETTINGS).fit(doubly)
    _planted(est.result)


def test_tuning_over_k(spark, doubly):
    best, table = alternate.fit_tune_k([1, 2], doubly, init="clusters", max_iter=3, penalty="sqrtN", c=0.01, **SETTINGS)
    rows = {r["k"]: r["ic"] for r in table.collect()}
    assert rows[2] > rows[1] and best.k == 2
    _planted(best.result)


def test_presets(spark, doubly):
    zero = alternate.run_method("overall", doubly, 51)
    assert zero.filter("cluster <> 0 or tau <> 0").count() == 0 and zero.count() == 24
    truth = zero.withColumn("tau", F.lit(7))
    assert alternate.run_method("oracle", doubly, 51, truth=truth).filter("tau = 7").count() == 24
    limits = dict(SETTINGS)
    limits.pop("n_times")
    only = alternate.run_method("only_cp", doubly.filter("subject < 100"), 51, **limits).collect()
    assert {(r["cluster"], r["tau"]) for r in only} == {(0, 25)}
    with pytest.raises(ValueError):
        alternate.run_method("nothing", doubly, 51)


def test_criterion(spark):
    row = spark.range(1).select(
        F.lit(2.0).alias("k"), F.lit(10.0).alias("n"), F.lit(50.0).alias("t"), F.lit(3.0).alias("c"),
        F.lit(200.0).alias("sum_len"), F.lit(20.0).alias("mean_len"), F.lit(-30.0).alias("loss"))
    n, t = 10, 50
    want = {"log": 2 * np.log(200), "sqrt": 2 * np.sqrt(200), "logN": 2 * np.log(10), "Nlog(NT)/T": 6 * n * np.log(n * t) / t,
            "sqrt{Nlog(NT)/T}": 6 * np.sqrt(n * np.log(n * t) / t), "sqrtN": 6 * np.sqrt(10)}
    for name, pen in want.items():
        assert abs(row.select(criteria.criterion(name)).first()[0] - (-30 - pen)) < 1e-9
    dyn = row.select(criteria.criterion("Nlog(NT)/T", dynamic_t=True)).first()[0]
    assert abs(dyn - (-30 - 6 * n * np.log(n * 20) / 20)) < 1e-9
    assert abs(row.select(criteria.criterion("BIC")).first()[0] - (-10 * np.log(3) - 2 * np.log(10))) < 1e-9


def test_mean_example_runs_on_levels(spark):
    rows = [(i, t, float((i >= 5) * 10 + (t >= 25) * 4 + (i * 7 + t * 3) % 5 / 5), t % 2) for i in range(10) for t in range(51)]
    df = spark.createDataFrame(rows, "subject bigint, t int, s1 double, a int")
    est = alternate.PanelSegmenter(51, k=2, init="clusters", example="mean", max_iter=2, kappa_min=20, c1=1e-6).fit(
        transitions(df, ["s1"]))
    lab = {r["subject"]: r["cluster"] for r in est.result.collect()}
    tau = {r["tau"] for r in est.result.collect()}
    assert len({lab[i] for i in range(5)}) == 1 and lab[0] != lab[9] and all(20 <= x <= 30 for x in tau)


def test_many_clusters(spark):
    """More clusters than one block of pairs holds are scored as by numpy."""
    pdf = panel_frame(range(90), 12, lambda t: (0, -0.5, 0.3, 0.5))
    held, segment.PAIRS = segment.PAIRS, 400
    try:
        got, _ = run(spark, pdf, 80, (F.col("subject") % 80).cast("int"), max_iter=1)
    finally:
        segment.PAIRS = held
    assert len(got) == 90 and len(set(got.values())) <= 80
    m = np.abs(np.random.default_rng(1).normal(size=(50, 6)))
    w = np.random.default_rng(2).normal(size=(80, 6))
    lab, err = segment._nearest_cluster(m, w)
    assert (lab == (m @ w.T).argmin(1)).all() and np.allclose(err, (m @ w.T).min(1))


def test_mean_detection_on_a_gapped_panel(spark):
    """The detector sees the dense panel, rows before gaps included, and windows up to the last one."""
    pdf = panel_frame(range(12), 40, steady)
    pdf = pdf[~((pdf["t"] == 20) & (pdf["subject"] < 6))]
    panel = spark.createDataFrame(pdf)
    trans = transitions(panel, ["s1"])
    seg = alternate.PanelSegmenter(40, k=1, example="mean", kappa_min=10)
    zero = trans.select("subject").distinct().withColumn("cluster", F.lit(0))
    got = seg._detect(trans, zero).first()
    dense = fill_dense(panel.select("subject", "t", "s1"), 40, {"s1": 0.0})
    want = cp.detect_mean_change(dense, 40, (10, 39), assignment=zero).first()
    assert got["kappa"] == 39 and got["tau"] == want["tau"] and abs(got["stat"] - want["stat"]) < 1e-9
