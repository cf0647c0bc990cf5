"""Grouped regression trees against a row-level search, and tree policies against numpy loops."""

import numpy as np
import pandas as pd
import pytest
from conftest import changed, panel_frame, steady
from pyspark.sql import functions as F

from panelwright.functions.features import FeatureMap
from panelwright.operators.transitions import transitions
from panelwright.plans import policy, trees

LINEAR = FeatureMap("polynomial", degree=1)


def exact_tree(x, y, depth, leaf):
    """Nested (feature, threshold, left, right) or a value: the best split between any two values."""
    best = (0.0, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for low, high in zip(values, values[1:]):
                left = x[:, f] <= (low + high) / 2
                if min(left.sum(), (~left).sum()) >= leaf:
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                    if gain > best[0] + 1e-10 * y.sum() ** 2 / len(y):
                        best = (gain, (f, (low + high) / 2, left))
    if best[1] is None:
        return y.mean()
    f, threshold, left = best[1]
    return f, threshold, exact_tree(x[left], y[left], depth - 1, leaf), exact_tree(x[~left], y[~left], depth - 1, leaf)


def follow(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, threshold, low, high = tree
    return np.where(x[:, f] <= threshold, follow(low, x), follow(high, x))


def tree_fqi(x, a, r, z, gamma, depth, leaf, max_iter, tol=1e-6, early=False):
    acts = np.unique(a)
    q = {k: exact_tree(x[a == k], r[a == k], depth, leaf) for k in acts}
    old, errs, low = np.zeros(len(x)), [], np.inf
    while True:
        y = r + gamma * np.max([follow(q[k], z) for k in acts], axis=0)
        q = {k: exact_tree(x[a == k], y[a == k], depth, leaf) for k in acts}
        new = np.zeros(len(x))
        for k in acts:
            new[a == k] = follow(q[k], x[a == k])
        errs.append(np.linalg.norm(new - old) / (np.linalg.norm(old) + 1e-6))
        old = new
        if (early and abs(errs[-1] - low) < 1e-5) or len(errs) > max_iter or errs[-1] <= tol:
            return q, errs
        low = min(low, errs[-1])


def tree_fqe(x, a, r, z, start, gamma, depth, leaf, max_iter):
    acts = sorted(start)
    pi = np.array(acts)[np.argmax([follow(start[k], z) for k in acts], axis=0)]

    def taken(q):
        return np.select([pi == k for k in acts], [follow(q[k], z) for k in acts])

    q, old, rounds = dict(start), taken(start), 0
    for _ in range(max_iter):
        y, rounds = r + gamma * old, rounds + 1
        for k in np.unique(pi):
            if (a == k).any():
                q[k] = exact_tree(x[a == k], y[a == k], depth, leaf)
        new = taken(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            err = np.mean((new - old) ** 2 / old**2)
        old = new
        if err < 1e-7:
            break
    return q, rounds


@pytest.fixture(scope="module")
def pdf():
    """Steps of two clusters with states on a coarse grid, so that every value has a bin."""
    frames = [panel_frame(range(8), 30, changed, p=2), panel_frame(range(50, 57), 30, steady, p=2)]
    out = pd.concat(frames, ignore_index=True)
    out[["s1", "s2"]] = np.round(out[["s1", "s2"]] * 8) / 8
    out["cluster"] = (out.subject >= 50).astype(int) * 5
    return out


@pytest.fixture(scope="module")
def rows(spark, pdf):
    panel = spark.createDataFrame(pdf)
    steps = transitions(panel.drop("cluster"), ["s1", "s2"])
    labelled = steps.join(panel.select("subject", "cluster").distinct(), "subject")
    return policy.policy_rows(labelled, ["s1", "s2"], LINEAR, "cluster").cache()


def arrays(rows, where="true"):
    got = rows.filter(where).orderBy("cluster", "subject", "t").toPandas()
    return got, [got[["x1", "x2"]].to_numpy(), got.a.to_numpy(), got.r.to_numpy(), got[["z1", "z2"]].to_numpy()]


def values(model, rows, prefix="x"):
    q0, q1 = model.columns([F.col(f"{prefix}{i}") for i in range(3)], F.col("cluster"))
    return rows.select("cluster", "subject", "t", q0.alias("q0"), q1.alias("q1")).orderBy("cluster", "subject", "t").toPandas()


@pytest.mark.parametrize("depth,leaf,early", [(1, 5, False), (2, 10, False), (3, 8, True), (4, 3, False)])
def test_tree_q_iteration_is_that_of_exact_trees(rows, depth, leaf, early):
    fit = trees.tree_policies(rows, 0.3, depth, leaf, max_iter=40, early_stopping=early, bins=500)
    assert fit.trees.clusters == [0, 5]
    for m, k in enumerate(fit.trees.clusters):
        part, (x, a, r, z) = arrays(rows, f"cluster = {k}")
        want, errs = tree_fqi(x, a, r, z, 0.3, depth, leaf, 40, early=early)
        assert fit.iterations[m] == len(errs) and np.allclose(fit.errors[m], errs, rtol=1e-6, atol=1e-9)
        got = values(fit.trees, rows.filter(f"cluster = {k}"))
        assert np.allclose(got.q0, follow(want[0], x)) and np.allclose(got.q1, follow(want[1], x))


def test_rounds_end_at_the_limit(rows):
    fit = trees.tree_policies(rows, 0.9, 2, 5, max_iter=3)
    assert fit.iterations == [4, 4] and fit.converged == [False, False]


def test_bins_of_many_values(spark):
    x = [float(i * i) for i in range(1000)] + [7.0] * 400
    rows = spark.createDataFrame([(v, 1.0) for v in x], "x1 double, x0 double").select("x0", "x1", F.col("x0").alias("z0"), F.col("x1").alias("z1"))
    one, many = trees.bins_of(rows, 16)
    edges = many.edges
    assert len(one.edges) == 0 and 10 <= len(edges) <= 15
    values = np.sort(np.unique(x))
    for e in edges:  # midway between neighbours
        i = np.searchsorted(values, e)
        assert e == (values[i - 1] + values[i]) / 2
    assert np.bincount(np.searchsorted(edges, x)).max() <= 400 + 1400 / 16 + 1


def test_nodes_survive_a_table(spark, rows, tmp_path):
    fit = trees.tree_policies(rows, 0.5, 3, 8, max_iter=2)
    path = str(tmp_path / "nodes")
    fit.trees.frame(spark).write.parquet(path)
    again = trees.Trees.from_frame(spark.read.parquet(path), 3)
    pd.testing.assert_frame_equal(values(fit.trees, rows), values(again, rows))


def test_models_of_blocks_and_one_pass_agree(rows, monkeypatch):
    whole = trees.tree_policies(rows, 0.7, 3, 8, max_iter=4)
    monkeypatch.setattr(trees, "HELD", 1)
    blocks = trees.tree_policies(rows, 0.7, 3, 8, max_iter=4)
    pd.testing.assert_frame_equal(values(whole.trees, rows), values(blocks.trees, rows))


def test_cross_validation_over_all_settings(spark, rows):
    folded = rows.withColumn("fold", F.pmod("subject", F.lit(3)).cast("int"))
    grid = [{"max_depth": d, "min_samples_leaf": s} for d in (1, 3) for s in (4, 15)]
    got = {(r.cluster, r.param_id): r.test_error for r in trees.select_tree_cv(
        folded, grid, 3, 0.3, max_iter=5, early_stopping=False, bins=500).collect()}
    assert len(got) == 8
    for k in (0, 5):
        part, (x, a, r, z) = arrays(rows, f"cluster = {k}")
        fold = part.subject.to_numpy() % 3
        for i, params in enumerate(grid):
            losses = []
            for f in range(3):
                t = fold != f
                q, _ = tree_fqi(x[t], a[t], r[t], z[t], 0.3, params["max_depth"], params["min_samples_leaf"], 5, tol=1e-4)
                own = np.where(a == 1, follow(q[1], x), follow(q[0], x))
                tde = r + 0.3 * np.maximum(follow(q[0], z), follow(q[1], z)) - own
                losses.append((tde[~t] ** 2).mean())
            assert got[k, i] == pytest.approx(np.mean(losses), rel=1e-9)


def test_evaluation_grows_trees_anew(rows):
    train, test = rows.filter("t < 18"), rows.filter("t >= 18")
    bins = trees.bins_of(rows, 500)
    fit = trees.fit_q(trees.cells(train, bins), [trees.Spec(k, -1, 2, 6) for k in (0, 5)], bins, 0.3, 50)
    labels = rows.select("subject").distinct().withColumn("k_test", F.pmod("subject", F.lit(2)) + (1 << 40))
    got = trees.ope_by_segment(test, labels, fit.trees, 0.3, 2, 6, 200).toPandas()
    assert set(got.k_test) == {1 << 40, (1 << 40) + 1} and set(got.k_train) == {0, 5} and len(got) == 15
    for (k_test, k_train), part in got.groupby(["k_test", "k_train"]):
        _, (x, a, r, z) = arrays(train, f"cluster = {k_train}")
        start, _ = tree_fqi(x, a, r, z, 0.3, 2, 6, 50)
        frame, (x, a, r, z) = arrays(test, f"cluster = {k_train} and subject % 2 = {k_test % 2}")
        want, _ = tree_fqe(x, a, r, z, start, 0.3, 2, 6, 200)
        first = x[frame.groupby("subject").t.idxmin().to_numpy()]
        q = np.stack([follow(want[k], first) for k in (0, 1)])
        assert np.allclose(part.sort_values("subject").value.to_numpy(), q.max(0))


def test_an_action_without_rows(spark, rows):
    only = rows.filter("a = 0 or cluster = 5")
    fit = trees.tree_policies(only, 0.5, 2, 5, max_iter=3)
    got = values(fit.trees, rows)
    assert got[got.cluster == 0].q1.isna().all() and got[got.cluster == 5].q1.notna().all() and got.q0.notna().all()
    greedy = policy.greedy(rows, fit.trees)
    assert greedy.filter("cluster = 0").agg(F.max("opt_action")).first()[0] == 0
    full = trees.tree_policies(rows, 0.5, 2, 5, max_iter=3)
    done = trees.evaluate_q(trees.cells(only.filter("t > 15"), full.trees.bins), full.trees, full.specs, 0.5, 20)
    assert set(done.unobserved) <= {(0, 1)}
    assert not np.isnan(done.trees.value[:, :, 0]).any()


def test_missing_values_and_no_rows(spark, rows):
    odd = rows.withColumn("x1", F.when(F.col("t") == 3, None).otherwise(F.col("x1"))).withColumn(
        "r", F.when(F.col("t") == 4, float("nan")).otherwise(F.col("r")))
    fit = trees.tree_policies(odd, 0.5, 2, 5, max_iter=2)
    again = trees.tree_policies(rows.filter("t not in (3, 4)"), 0.5, 2, 5, max_iter=2)
    assert fit.iterations == again.iterations
    scored = values(fit.trees, odd)
    assert scored[scored.t == 3].q0.isna().all() and scored[scored.t != 3].q0.notna().all()
    assert trees.clusters_of(rows.limit(0)) == []


def test_rows_after_the_change(spark, rows):
    taus = spark.createDataFrame([(0, 25), (1, None)], "subject long, tau int")
    kept = trees.post_change(rows, taus)
    low = {r.subject: r.t for r in kept.groupBy("subject").agg(F.min("t").alias("t")).collect()}
    assert low[0] == 25 and low[1] == 0 and low[50] == 0 and kept.columns == rows.columns


def test_any_regressor_in_learning_and_evaluation(rows):
    one = rows.filter("cluster = 0")
    grow = trees.fitter(2, 6, bins=500)
    model = policy.q_iteration_with(one, grow, 0.3, 3)
    _, (x, a, r, z) = arrays(one)
    want, _ = tree_fqi(x, a, r, z, 0.3, 2, 6, 2)
    got = values(model, one)
    assert np.allclose(got.q0, follow(want[0], x)) and np.allclose(got.q1, follow(want[1], x))
    done, errs = policy.evaluate_with(one, grow, model, 0.3, 40, rule="relative")
    plain, rounds = tree_fqe(x, a, r, z, want, 0.3, 2, 6, 40)
    got = values(done, one)
    assert len(errs) == rounds
    taken = sorted({int(k) for k in np.argmax([follow(want[k], z) for k in (0, 1)], axis=0)})
    for k in taken:
        assert np.allclose(got[f"q{k}"], follow(plain[k], x))
    linear = policy.fitted_q_iteration(one, 0.3, 30).model
    by_sums = policy.fitted_q_evaluation(one, linear, 0.3, 25, rule="absolute")
    by_fits, errs = policy.evaluate_with(one, policy.mllib_linear, linear, 0.3, 25)
    assert len(errs) == by_sums.iterations[0]
    for key, c in by_sums.model.coefs.items():
        assert np.allclose(c, by_fits.coefs[key], atol=1e-6)
