"""Policy learning, evaluation, kernels, penalties and Q tests against row-level numpy."""

import numpy as np
import pandas as pd
import pytest
from conftest import changed, design, panel_frame, steady, step_arrays
from pyspark.sql import functions as F

from panelwright.functions.features import FeatureMap
from panelwright.functions.grid import ScanGrid
from panelwright.operators import kernel
from panelwright.operators.transitions import transitions
from panelwright.plans import changepoint as cp
from panelwright.plans import penalised, policy, qtest

LINEAR = FeatureMap("polynomial", degree=1)


@pytest.fixture(scope="module")
def pdf():
    return panel_frame(range(8), 25, steady)


@pytest.fixture(scope="module")
def rows(spark, pdf):
    return policy.policy_rows(transitions(spark.createDataFrame(pdf), ["s1"]), ["s1"], LINEAR).cache()


def arrays(pdf):
    subj, t, a, s, y = step_arrays(pdf)
    one = np.ones((len(s), 1))
    return subj, t, a, np.hstack([one, s]), np.hstack([one, y]), y[:, 0]


def fit(x, y):
    return np.linalg.lstsq(x, y, rcond=None)[0]


def numpy_fqi(pdf, gamma, max_iter, tol=1e-6, early=False):
    _, _, a, x, z, r = arrays(pdf)
    acts = np.unique(a)
    c = {k: fit(x[a == k], r[a == k]) for k in acts}
    old = {k: np.zeros((a == k).sum()) for k in acts}
    err, it, low, errs = 1.0, 0, np.inf, []
    while err > tol and it <= max_iter:
        target = r + gamma * np.max([z @ c[k] for k in acts], axis=0)
        c = {k: fit(x[a == k], target[a == k]) for k in acts}
        pred = {k: x[a == k] @ c[k] for k in acts}
        num = np.sqrt(sum(((pred[k] - old[k]) ** 2).sum() for k in acts))
        err = num / (np.linalg.norm(np.concatenate([old[k] for k in acts])) + 1e-6)
        old, it = pred, it + 1
        errs.append(err)
        if early and abs(err - low) < 1e-5:
            break
        low = min(low, err)
    return c, errs


@pytest.mark.parametrize("max_iter,early", [(4, False), (60, False), (60, True)])
def test_fitted_q_iteration(rows, pdf, max_iter, early):
    want, errs = numpy_fqi(pdf, 0.5, max_iter, early=early)
    got = policy.fitted_q_iteration(rows, 0.5, max_iter, early_stopping=early)
    assert got.iterations[0] == len(errs) and np.allclose(got.errors[0], errs, rtol=1e-5, atol=1e-9)
    for a in (0, 1):
        assert np.allclose(got.model.coefs[0, a], want[a], atol=1e-7)
    assert got.converged[0] == (errs[-1] <= 1e-6 or early)


def test_clusters_are_fitted_in_one_run(spark):
    both = pd.concat([panel_frame(range(4), 20, steady), panel_frame(range(50, 54), 20, changed)])
    trans = transitions(spark.createDataFrame(both), ["s1"]).withColumn("g", F.when(F.col("subject") >= 50, 7).otherwise(3))
    got = policy.fitted_q_iteration(policy.policy_rows(trans, ["s1"], LINEAR, "g"), 0.5, 30)
    for g, part in ((3, both[both.subject < 50]), (7, both[both.subject >= 50])):
        want, errs = numpy_fqi(part, 0.5, 30)
        assert got.iterations[g] == len(errs)
        for a in (0, 1):
            assert np.allclose(got.model.coefs[g, a], want[a], atol=1e-7)


def test_model_table_round_trip(spark, rows):
    model = policy.fitted_q_iteration(rows, 0.5, 3).model
    again = policy.LinearQ.from_frame(model.frame(spark))
    a = policy.greedy(rows, model).select("subject", "t", "opt_action", "opt_value").collect()
    b = policy.greedy_from_table(rows, again.frame(spark)).select("subject", "t", "opt_action", "opt_value").collect()
    assert {tuple(x[:3]) for x in a} == {tuple(x[:3]) for x in b}


def test_greedy_prefers_action_zero_on_ties_and_skips_missing(rows):
    tie = policy.LinearQ({(0, 0): [1.0, 0.0], (0, 1): [1.0, 0.0]})
    assert policy.greedy(rows, tie).filter("opt_action = 1").count() == 0
    only = policy.LinearQ({(0, 1): [1.0, 0.0]})
    assert policy.greedy(rows, only).filter("opt_action = 0").count() == 0


def numpy_fqe(pdf, coefs, gamma, max_iter, pi, rule):
    _, _, a, x, z, r = arrays(pdf)
    c, acts = dict(coefs), np.unique(pi)
    q = np.select([pi == k for k in acts], [z @ c[k] for k in acts])
    for it in range(max_iter):
        target = r + gamma * q
        for k in acts:
            c[k] = fit(x[a == k], target[a == k])
        new = np.select([pi == k for k in acts], [z @ c[k] for k in acts])
        err = np.mean((new - q) ** 2) if rule == "absolute" else np.mean((new - q) ** 2 / q**2)
        q = new
        if err < 1e-7:
            break
    return c, q, it + 1


@pytest.mark.parametrize("rule,max_iter", [("absolute", 3), ("absolute", 100), ("relative", 3), ("relative", 100)])
def test_fitted_q_evaluation(rows, pdf, rule, max_iter):
    start = policy.fitted_q_iteration(rows, 0.5, 5).model
    _, _, _, _, z, _ = arrays(pdf)
    q = np.column_stack([z @ start.coefs[0, a] for a in (0, 1)])
    pi = (q[:, 1] > q[:, 0]).astype(int)
    want, values, its = numpy_fqe(pdf, {a: start.coefs[0, a] for a in (0, 1)}, 0.5, max_iter, pi, rule)
    got = policy.fitted_q_evaluation(rows, start, 0.5, max_iter, rule=rule)
    assert got.iterations[0] == its
    for a in np.unique(pi):
        assert np.allclose(got.model.coefs[0, a], want[a], atol=1e-7)
    v = got.values().orderBy("subject", "t").toPandas()
    assert np.allclose(v["value"], values, atol=1e-7) and np.array_equal(v["pi"], pi)


def test_constant_policy_and_unobserved_action(spark, rows, pdf):
    start = policy.fitted_q_iteration(rows, 0.5, 3).model
    done = policy.fitted_q_evaluation(rows, start, 0.5, 50, policy="constant", constant=1)
    _, values, _ = numpy_fqe(pdf, {a: start.coefs[0, a] for a in (0, 1)}, 0.5, 50, np.ones(len(arrays(pdf)[0]), int), "absolute")
    assert np.allclose(done.values().orderBy("subject", "t").toPandas()["value"], values, atol=1e-7)
    idle = policy.policy_rows(transitions(spark.createDataFrame(panel_frame(range(4), 15, steady, action=0)), ["s1"]), ["s1"], LINEAR)
    only = policy.fitted_q_evaluation(idle, start, 0.5, 5, policy="constant", constant=1)
    assert only.unobserved == [(0, 1)] and only.values().filter("value is not null").count() == 0
    assert only.report(spark).count() == 1


def test_random_policy_and_exploration_are_reproducible(rows):
    start = policy.fitted_q_iteration(rows, 0.5, 3).model
    a = policy.fitted_q_evaluation(rows, start, 0.5, 5, policy="random", seed=3).values()
    b = policy.fitted_q_evaluation(rows.repartition(7), start, 0.5, 5, policy="random", seed=3).values()
    assert {(r["subject"], r["t"], r["pi"]) for r in a.collect()} == {(r["subject"], r["t"], r["pi"]) for r in b.collect()}
    share = a.agg(F.avg("pi")).first()[0]
    assert 0.1 < share < 0.4
    g = policy.epsilon_greedy(policy.greedy(rows, start), 0.3)
    moved = g.agg(F.avg((F.col("action") != F.col("opt_action")).cast("int"))).first()[0]
    assert 0.05 < moved < 0.3


def test_votes(spark, rows):
    low, high = [0.0, 0.0], [1.0, 0.0]
    m = [policy.LinearQ({(0, 0): low, (0, 1): high}), policy.LinearQ({(0, 0): [2.0, 0.0], (0, 1): low})]
    tie = policy.vote(rows, m).groupBy("a", "q").count().collect()
    assert [(r["a"], r["q"]) for r in tie] == [(0, 2.0)]
    three = policy.vote(rows, [*m, policy.LinearQ({(0, 0): low, (0, 1): [3.0, 0.0]})]).groupBy("a", "q").count().collect()
    assert [(r["a"], r["q"]) for r in three] == [(1, 2.0)]


def test_ope_by_segment(spark):
    both = pd.concat([panel_frame(range(6), 20, steady), panel_frame(range(50, 56), 20, changed)])
    trans = transitions(spark.createDataFrame(both), ["s1"]).withColumn("g", (F.col("subject") >= 50).cast("int"))
    base = policy.policy_rows(trans, ["s1"], LINEAR, "g")
    model = policy.fitted_q_iteration(base, 0.5, 10).model
    labels = trans.select("subject", (F.col("subject") % 2).cast("int").alias("k_test")).distinct()
    got = {r["subject"]: r for r in policy.ope_by_segment(base, labels, model, 0.5, 30).collect()}
    assert len(got) == 12
    for kt in (0, 1):
        for kr in (0, 1):
            part = both[(both.subject % 2 == kt) & ((both.subject >= 50) == bool(kr))]
            subj, t, _, x, z, _ = arrays(part)
            start = {a: model.coefs[kr, a] for a in (0, 1)}
            q = np.column_stack([z @ start[a] for a in (0, 1)])
            c, _, _ = numpy_fqe(part, start, 0.5, 30, (q[:, 1] > q[:, 0]).astype(int), "relative")
            first = t == 0
            want = np.max([x[first] @ c[a] for a in (0, 1)], axis=0)
            for i, v in zip(subj[first], want):
                assert got[i]["k_test"] == kt and got[i]["k_train"] == kr and abs(got[i]["value"] - v) < 1e-7


def test_cv_at_folds(spark, pdf):
    trans = transitions(spark.createDataFrame(pdf), ["s1"])
    folds = trans.select("subject").distinct().withColumn("fold", (F.col("subject") % 2).cast("int"))
    got = policy.select_linear_cv(trans, folds, ["s1"], [LINEAR], 0.5, 5, 1e-4, False).first()["test_error"]
    losses = []
    for f in (0, 1):
        c, _ = numpy_fqi(pdf[pdf.subject % 2 != f], 0.5, 5, tol=1e-4)
        _, _, a, x, z, r = arrays(pdf[pdf.subject % 2 == f])
        q = np.where(a == 1, x @ c[1], x @ c[0])
        losses.append(np.mean((r + 0.5 * np.maximum(z @ c[0], z @ c[1]) - q) ** 2))
    assert abs(got - np.mean(losses)) < 1e-9


def test_trees(spark, pdf, tmp_path):
    rows = policy.tree_rows(transitions(spark.createDataFrame(pdf), ["s1"]), ["s1"])
    model = policy.tree_q_iteration(rows, 0.5, 2, 5, 1)
    td = policy.tree_td_error(rows, model, 0.5)
    first = td.agg(policy.squared_loss(td)).first()[0]
    model.write(str(tmp_path / "trees"))
    again = policy.tree_td_error(rows, policy.TreeQ.read(str(tmp_path / "trees")), 0.5)
    assert abs(again.agg(policy.squared_loss(again)).first()[0] - first) < 1e-12 and first > 0


# --- kernels

def test_kernel_loss_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    # Two groups, one with far outliers, so cells are far apart.
    x = np.concatenate([rng.normal(0, 1, 120), rng.normal(0, 1, 60), [400.0, 401.0, -300.0]])
    g = np.array([0] * 120 + [1] * 63)
    a, e = rng.integers(0, 2, len(x)), rng.normal(size=len(x))
    df = spark.createDataFrame(pd.DataFrame({"cluster": g, "x": x, "a": a, "tde": e}))
    for bw in (0.05, 2.0):
        loss = {r["cluster"]: r["loss"] for r in kernel.kernel_td_loss(df, "x", bw).collect()}
        pair = {r["cluster"]: r["s"] for r in kernel.kernel_pair_sum(df, "x", bw, "cluster").collect()}
        for k in (0, 1):
            xs, as_, es = x[g == k], a[g == k], e[g == k]
            i, j = np.triu_indices(len(xs), 1)
            ks, ka = np.exp(-bw * (xs[i] - xs[j]) ** 2), np.abs(as_[i] - as_[j])
            assert abs(loss[k] - np.mean((1 + ka + ks + ka * ks) * es[i] * es[j])) < 1e-12
            assert abs(pair[k] - (ks * es[i] * es[j]).sum()) < 1e-9


def test_fourier_loss_is_close(spark):
    rng = np.random.default_rng(4)
    x, a, e = rng.normal(size=(150, 2)), rng.integers(0, 2, 150), rng.normal(size=150)
    df = spark.createDataFrame(pd.DataFrame({"cluster": 0, "u": x[:, 0], "v": x[:, 1], "a": a, "tde": e}))
    fmap = FeatureMap("rbf", dim=200, bandwidth=0.5)
    terms = fmap.terms([F.col("u"), F.col("v")])[1:]
    wide = df.select("*", *[t.alias(f"f{i}") for i, t in enumerate(terms)])
    got = kernel.kernel_td_loss_features(wide, [f"f{i}" for i in range(200)]).first()["loss"]
    i, j = np.triu_indices(150, 1)
    ks, ka = np.exp(-0.5 * ((x[i] - x[j]) ** 2).sum(1)), np.abs(a[i] - a[j])
    assert abs(got - np.mean((1 + ka + ks + ka * ks) * e[i] * e[j])) < 0.05


def test_median_bandwidth(spark, pdf):
    two = pdf.assign(s2=pdf.s1 * pdf.t)
    x = two[["s1", "s2"]].to_numpy()
    i, j = np.triu_indices(len(x), 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    got = kernel.median_bandwidth(spark.createDataFrame(two), ["s1", "s2"], block=100, bins=16).first()
    assert abs(got["median"] - np.median(d[d > 0])) < 1e-12
    many = panel_frame(range(150), 12, changed)
    x = many["s1"].round(2).to_numpy()
    d = np.abs(x[:, None] - x[None, :])[np.triu_indices(len(x), 1)]
    got = kernel.median_bandwidth(spark.createDataFrame(many.assign(s1=x)), ["s1"]).first()
    assert abs(got["median"] - np.median(d[d > 0])) < 1e-12
    few = kernel.sample_subjects(spark.createDataFrame(pdf), 3)
    assert few.select("subject").distinct().count() == 3 and few.count() == 75


# --- penalties

@pytest.mark.parametrize("penalty,gamma", [("SCAD", 3.7), ("MCP", 3.0), ("MCP", 1.5), ("SCAD", 2.5)])
def test_shrinkage_minimises_the_penalised_square(penalty, gamma):
    grid, alpha = np.linspace(-6, 6, 240001), 0.7
    size = np.abs(grid)
    if penalty == "MCP":
        pen = np.where(size <= gamma * alpha, alpha * size - size**2 / (2 * gamma), gamma * alpha**2 / 2)
    else:
        pen = np.where(size <= alpha, alpha * size, np.where(
            size <= gamma * alpha, (2 * gamma * alpha * size - size**2 - alpha**2) / (2 * (gamma - 1)), alpha**2 * (gamma + 1) / 2))
    for step in (1.0, 0.5):
        for z in (-3.0, -1.2, -0.4, 0.3, 0.9, 1.6, 2.2, 5.0):
            best = grid[np.argmin((grid - z) ** 2 / (2 * step) + pen)]
            assert abs(penalised._shrink(np.array(z), step, alpha, gamma, penalty) - best) < 1e-3


def test_penalised_fit(spark, pdf):
    trans = transitions(spark.createDataFrame(pdf), ["s1"]).withColumn("cluster", F.lit(0))
    _, _, a, s, y = step_arrays(pdf)
    x = design(a, s)
    plain = penalised.penalised_fit(trans, 1, 0.0, 3.0).first()
    assert np.allclose(plain["coef"], np.linalg.lstsq(x, y, rcond=None)[0][:, 0], atol=1e-6)
    # Stationarity of the penalised optimum, from the rows themselves.
    w = np.array(penalised.penalised_fit(trans, 1, 0.02, 3.0).first()["coef"])
    grad = x.T @ (x @ w - y[:, 0]) / len(y)
    for j in range(4):
        size = abs(w[j])
        slope = 0.02 if size <= 0.02 else max((3.0 * 0.02 - size) / 2.0, 0.0)
        assert (abs(grad[j]) <= 0.02 + 1e-6) if size == 0 else abs(grad[j] + np.sign(w[j]) * slope) < 1e-6
    # All coefficients vanish at the large alpha: the next one down is used.
    down = penalised.penalised_fit(trans, 1, 50.0, 3.0, [0.001, 50.0]).first()
    assert down["alpha"] == 0.001 and down["n_nonzero"] > 0


def test_penalised_cv_uses_folds(spark):
    big = panel_frame(range(12), 20, steady)
    trans = transitions(spark.createDataFrame(big), ["s1"]).withColumn("cluster", (F.col("subject") >= 11).cast("int"))
    got = penalised.penalised_cv(trans, 1, {"alpha": [0.0, 40.0], "gamma": [3.0]}, nfold=3).collect()
    first = {r["alpha"]: r for r in got if r["cluster"] == 0}
    assert first[0.0]["selected"] and first[40.0]["test_error"] == penalised.EMPTY_ERROR
    fold = {r["subject"]: r["f"] for r in trans.select("subject", penalised.subject_fold(3).alias("f")).distinct().collect()}
    subj, _, a, s, y = step_arrays(big[big.subject < 11])
    x, f, errs = design(a, s), np.array([fold[i] for i in subj]), []
    for k in sorted(set(f)):
        c = np.linalg.lstsq(x[f != k], y[f != k], rcond=None)[0]
        errs.append(np.mean((y[f == k] - x[f == k] @ c) ** 2))
    assert abs(first[0.0]["test_error"] - np.mean(errs)) < 1e-8
    small = [r for r in got if r["cluster"] == 1 and r["selected"]]
    assert [r["alpha"] for r in small] == [40.0]


def test_sparse_scan_without_penalty_is_the_dense_scan(spark, change_panel):
    trans = transitions(spark.createDataFrame(change_panel), ["s1"]).withColumn("cluster", F.lit(0))
    grid = ScanGrid(51, kappa_min=20, step=4, eps=0.1)
    none = {"alpha": [0.0], "gamma": [3.0]}
    sparse = {r["kappa"]: r["stat"] for r in penalised.sparse_scan(trans, grid, 1, none).collect()}
    # Its splits start one below the dense ones: int(eps T) against int(eps T - 1) + 1.
    dense = {r["kappa"]: r["stat"] for r in cp.best_splits(trans, grid).collect()}
    assert sparse.keys() == dense.keys()
    assert all(abs(sparse[k] - dense[k]) < 1e-6 for k in dense)
    found, per = penalised.detect_sparse_change(trans, ScanGrid(51, kappa_min=20, eps=0.05), 1, {"alpha": [0.01], "gamma": [3.0]}, draws=600)
    assert 22 <= found.first()["tau"] <= 25 and per.filter("pvalue < 0 or pvalue > 1").count() == 0


def test_changepoint_quality_and_fitted_values(spark, change_panel):
    trans = transitions(spark.createDataFrame(change_panel), ["s1"]).withColumn("cluster", F.lit(0))
    taus = spark.createDataFrame([(0, 25)], "cluster int, tau int")
    q = penalised.changepoint_quality(trans, taus, 51, 1, {"alpha": [0.0], "gamma": [3.0]}, cv=False)
    _, t, a, s, y = step_arrays(change_panel)
    x, at = design(a, s), t >= 25
    c = np.linalg.lstsq(x[at], y[at], rcond=None)[0]
    want = ((y[at] - x[at] @ c) ** 2).sum()
    r = q.first()
    assert abs(r["loss"] + want) < 1e-6 and abs(r["loss_per_step"] + want / 25) < 1e-7
    assert abs(r["sigma2"] - want / (at.sum() - 4)) < 1e-8 and r["df"] == 4
    fit_ = penalised.fitted_values(trans.filter("t >= 25"), q, 1).orderBy("subject", "t").toPandas()
    assert np.allclose(fit_["fit1"], (x[at] @ c)[:, 0], atol=1e-6)


# --- Q tests

def test_multiplier_noise_is_standard_normal_and_keyed():
    key = np.arange(2000, dtype=np.int64) * 7919
    z = qtest.normals(key, 11, 1)
    assert z.shape == (2000, 11) and abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert np.array_equal(z[::-1], qtest.normals(key[::-1], 11, 1)) and not np.allclose(z, qtest.normals(key, 11, 2))
    assert abs(np.corrcoef(z[:, 0], z[:, 1])[0, 1]) < 0.1


def test_q_change(spark):
    moved = panel_frame(range(30), 40, lambda t: (0.0, 1.0, 0.3, 0.0) if t < 20 else (0.0, -1.0, 0.3, 0.0))
    still = panel_frame(range(200, 230), 40, steady)
    out = {}
    for name, data in (("moved", moved), ("still", still)):
        trans = transitions(spark.createDataFrame(data), ["s1"])
        res = qtest.q_change_test(trans, ["s1"], [20], 39, LINEAR, gamma=0.5, draws=200, max_iter=30)
        out[name] = {r["statistic"]: r["pvalue"] for r in res.summary.collect()}
        if name == "moved":
            sides = [numpy_fqi(data[data.t <= 20], 0.5, 30)[0], numpy_fqi(data[data.t >= 20], 0.5, 30)[0]]
            _, _, a, x, _, _ = arrays(data)
            diff = np.abs(np.where(a == 1, x @ (sides[0][1] - sides[1][1]), x @ (sides[0][0] - sides[1][0]))).mean()
            got = res.table.filter("statistic = 'empirical'").first()["value"]
            assert abs(got - diff * np.sqrt(20 * 19 / 39)) < 1e-6
    assert all(p < 0.05 for p in out["moved"].values())
    assert all(p > 0.01 for p in out["still"].values())


def test_windows_without_covariates_are_kept(spark, change_panel):
    """A penalty that keeps nothing leaves every window, without a limit and without a rejection."""
    trans = transitions(spark.createDataFrame(change_panel), ["s1"]).withColumn("cluster", F.lit(0))
    found, per = penalised.detect_sparse_change(
        trans, ScanGrid(51, kappa_min=40, eps=0.05), 1, {"alpha": [1e6], "gamma": [3.0]}, draws=50)
    rows = per.collect()
    assert rows and all(r["df"] == 0 and r["threshold"] is None and r["pvalue"] == 1.0 for r in rows)
    assert found.first()["tau"] == 0


def test_basis_selection_computes_the_steps_once(spark, pdf, monkeypatch):
    """One table of steps with folds serves all maps and both sides, with the errors of each by itself."""
    from panelwright.operators.ranking import contiguous_chunks
    from panelwright.plans import qtest

    trans = transitions(spark.createDataFrame(pdf), ["s1"])
    folds = contiguous_chunks(trans.select("subject").distinct(), "subject", 3)
    maps = [FeatureMap("polynomial", degree=1), FeatureMap("polynomial", degree=2)]
    want = [0.0, 0.0]
    for side in ("t < 20", "t >= 20"):
        for r in policy.select_linear_cv(trans.filter(side), folds, ["s1"], maps, 0.5, 3, 1e-4, False).collect():
            want[r.param_id] += r.test_error
    sources = []
    keep = policy.select_linear_cv
    monkeypatch.setattr(policy, "select_linear_cv", lambda rows, *rest: sources.append(tuple(rows.inputFiles())) or keep(rows, *rest))
    got = {r.param_id: r.test_error for r in qtest.select_basis(trans, folds, ["s1"], 20, maps, 0.5, 3).collect()}
    assert np.allclose([got[0], got[1]], want) and len(sources) == 2
    assert all("basis-steps" in f for s in sources for f in s) and set(sources[0]) == set(sources[1])


def test_basis_query_runs_to_its_stop_rule(spark, monkeypatch):
    """G-11 fits until the fitted values settle, on both sides and for both maps."""
    from panelwright.queries import QUERIES, testing

    panel = panel_frame(range(9), 60, steady)
    panel["r"] = panel["s1"] + 1.0
    trans = transitions(spark.createDataFrame(panel), ["s1"])
    monkeypatch.setattr(testing, "scaled", lambda spark, sf: trans)
    fits, fit = [], policy.fitted_q_iteration
    monkeypatch.setattr(policy, "fitted_q_iteration", lambda *x, **y: fits.append(fit(*x, **y)) or fits[-1])
    got = QUERIES["G-11"](spark, "").collect()
    assert len(fits) == 4 and sorted(r.param_id for r in got) == [0, 1]
    for found in fits:
        assert all(found.converged.values()) and len(found.converged) == 3
        assert all(e[-1] <= 1e-4 < min(e[:-1]) and len(e) > 4 for e in found.errors.values())
