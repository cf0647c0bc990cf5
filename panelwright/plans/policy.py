"""Policy learning and off-policy evaluation on transitions.

A linear Q function is one coefficient vector per (cluster, action). The
products X'X are summed once; each iteration of fitted-Q iteration is one
aggregate over the rows. Evaluation of a fixed policy needs no further pass:
its update is linear in the coefficients, so the sums of phi(s,a) phi(s',a')
taken once carry all iterations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, DecisionTreeRegressor, LinearRegression)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.features import FeatureMap
from panelwright.operators import kernel
from panelwright.operators.moments import min_norm_solve
from panelwright.operators.ranking import assign_folds
from panelwright.operators.summary import majority_vote
from panelwright.session import materialize

ACTIONS = (0, 1)
MODEL_SCHEMA = "cluster int, action int, coef array<double>"


class LinearQ:
    """Coefficients by (cluster, action); a missing pair was never observed."""

    def __init__(self, coefs: dict[tuple[int, int], np.ndarray]):
        self.coefs = {k: np.asarray(v, dtype=float) for k, v in coefs.items()}

    @property
    def clusters(self) -> list[int]:
        return sorted({k for k, _ in self.coefs})

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(int(k), int(a), [float(x) for x in v]) for (k, a), v in sorted(self.coefs.items())]
        return spark.createDataFrame(rows, MODEL_SCHEMA)

    @staticmethod
    def from_frame(models: DataFrame) -> LinearQ:
        """One row per (cluster, action): a handful of rows."""
        return LinearQ({(r["cluster"], r["action"]): np.array(r["coef"]) for r in models.collect()})

    def columns(self, terms: Sequence[Column], cluster: Column) -> list[Column]:
        """Q of each action at the given features; NULL for a pair never observed.

        The coefficients are one constant array, so the generated code is the
        same in every iteration and is compiled once.
        """
        known = self.clusters
        out = []
        for a in ACTIONS:
            held = []
            for k in known:
                v = self.coefs.get((k, a))
                held.append("cast(null as array<double>)" if v is None else
                            "array(" + ",".join(f"{float(x)!r}D" for x in v) + ")")
            table = F.expr("array(" + ",".join(held) + ")")
            at = F.lit(0) if len(known) == 1 else F.array_position(
                F.expr("array(" + ",".join(map(str, known)) + ")"), cluster).cast("int") - 1
            row = F.get(table, at)
            q = None
            for i, term in enumerate(terms):
                part = F.get(row, F.lit(i)) * term
                q = part if q is None else q + part
            out.append(q)
        return out


def policy_rows(trans: DataFrame, states: Sequence[str], fmap: FeatureMap, cluster: str | None = None) -> DataFrame:
    """(cluster, subject, t, a, r, x*, z*): features of s and of the next state."""
    now = fmap.terms([F.col(c) for c in states])
    nxt = fmap.terms([F.col(f"y{i + 1}") for i in range(len(states))])
    k = F.col(cluster).cast("int") if cluster else F.lit(0)
    return trans.select(
        k.alias("cluster"), "subject", "t", F.col("a").cast("int").alias("a"), F.col("r").cast("double").alias("r"),
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(now)],
        *[c.cast("double").alias(f"z{i}") for i, c in enumerate(nxt)])


def _width(rows: DataFrame) -> int:
    return sum(1 for c in rows.columns if c[0] == "x" and c[1:].isdigit())


def _cols(prefix: str, d: int) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(d)]


def _grams(rows: DataFrame, d: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]]:
    """{(cluster, action): (X'X, X'r, n)}."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.groupBy("cluster", "a").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col("r")).alias(f"b_{i}") for i in range(d)]).collect()
    out = {}
    for row in got:
        g = np.zeros((d, d))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
        out[row["cluster"], row["a"]] = (g, np.array([row[f"b_{i}"] for i in range(d)]), row["n"])
    return out


def _solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return min_norm_solve(g, b[:, None])[:, 0]


@dataclass
class QFit:
    model: LinearQ
    errors: dict[int, list[float]] = field(default_factory=dict)
    iterations: dict[int, int] = field(default_factory=dict)
    converged: dict[int, bool] = field(default_factory=dict)


def _all_but_own(grams: dict) -> dict:
    """Sums over the rows of all clusters but the model's own."""
    zero = (0.0, 0.0, 0)
    total: dict[int, tuple] = {}
    for (_, a), own in grams.items():
        total[a] = tuple(x + y for x, y in zip(total.get(a, zero), own))
    out = {}
    for k in {k for k, _ in grams}:
        for a, sums in total.items():
            rest = tuple(x - y for x, y in zip(sums, grams.get((k, a), zero)))
            if rest[2]:
                out[k, a] = rest
    return out


def _left_out_targets(rows: DataFrame, model: LinearQ, gamma: float, d: int) -> DataFrame:
    """(cluster, a, b_0, ...): X'target of each model over the rows of all other clusters.

    A task keeps one small sum per model and action, so a row is read once for all models.
    """
    known = model.clusters
    coefs = np.full((len(ACTIONS), d, len(known)), np.nan)
    for (k, a), v in model.coefs.items():
        coefs[ACTIONS.index(a), :, known.index(k)] = v

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(known), len(ACTIONS), d))
        for pdf in batches:
            x, z = (pdf[[f"{c}{i}" for i in range(d)]].to_numpy(float) for c in "xz")
            own, a = pdf["cluster"].to_numpy(), pdf["a"].to_numpy()
            best = np.fmax.reduce([z @ c for c in coefs])
            target = (pdf["r"].to_numpy(float)[:, None] + gamma * best) * (own[:, None] != np.array(known))
            for i, action in enumerate(ACTIONS):
                at = a == action
                total[:, i] += target[at].T @ x[at]
        yield pd.DataFrame([(k, a, *total[m, i]) for m, k in enumerate(known) for i, a in enumerate(ACTIONS)],
                           columns=["cluster", "a", *[f"b_{i}" for i in range(d)]])

    sums = ", ".join(f"b_{i} double" for i in range(d))
    return rows.select("cluster", "a", "r", *_cols("x", d), *_cols("z", d)).mapInPandas(fold, f"cluster int, a int, {sums}")


def fitted_q_iteration(
    rows: DataFrame,
    gamma: float = 0.95,
    max_iter: int = 200,
    tol: float = 1e-6,
    early_stopping: bool = False,
    init: LinearQ | None = None,
    left_out: bool = False,
) -> QFit:
    """Linear fitted-Q iteration, all clusters in the same passes.

    The change of the fitted values is a quadratic form in X'X, so the stop
    rule costs nothing. A cluster that has stopped keeps its coefficients.
    With ``left_out`` the model of a cluster learns from all other clusters: those are folds.
    """
    d = _width(rows)
    grams = _grams(rows, d)
    if left_out:
        grams = _all_but_own(grams)
    clusters = sorted({k for k, _ in grams})
    if init is None:
        coefs = {key: _solve(g, b) for key, (g, b, _) in grams.items()}
    else:
        coefs = {key: init.coefs[key] for key in grams}
    fit = QFit(LinearQ(coefs), {k: [] for k in clusters}, {k: 0 for k in clusters}, {k: True for k in clusters})
    old = {key: np.zeros(d) for key in grams}
    smallest = {k: np.inf for k in clusters}
    active = set(clusters)
    while active:
        if left_out:
            parts, terms = _left_out_targets(rows, fit.model, gamma, d), _cols("b_", d)
        else:
            best = F.greatest(*fit.model.columns(_cols("z", d), F.col("cluster")))
            target = F.col("r") + F.lit(float(gamma)) * best
            parts, terms = rows, [F.col(f"x{i}") * target for i in range(d)]
        got = parts.groupBy("cluster", "a").agg(*[F.sum(x).alias(f"b_{i}") for i, x in enumerate(terms)]).collect()
        new = dict(coefs)
        for row in got:
            key = row["cluster"], row["a"]
            if key[0] in active and key in grams:
                new[key] = _solve(grams[key][0], np.array([row[f"b_{i}"] for i in range(d)]))
        for k in list(active):
            keys = [key for key in grams if key[0] == k]
            step = sum((new[x] - old[x]) @ grams[x][0] @ (new[x] - old[x]) for x in keys)
            size = sum(old[x] @ grams[x][0] @ old[x] for x in keys)
            err = float(np.sqrt(max(step, 0.0)) / (np.sqrt(max(size, 0.0)) + 1e-6))
            for x in keys:
                old[x] = new[x]
            fit.errors[k].append(err)
            fit.iterations[k] += 1
            if early_stopping and abs(err - smallest[k]) < 1e-5:
                active.discard(k)
            elif fit.iterations[k] > max_iter:
                fit.converged[k] = False
                active.discard(k)
            elif err <= tol:
                active.discard(k)
            smallest[k] = min(smallest[k], err)
        coefs = new
        fit.model = LinearQ(coefs)
    return fit


def q_iteration_with(rows: DataFrame, fitter, gamma: float, updates: int):
    """Fitted-Q iteration with any regressor.

    ``fitter(rows) -> model`` gets the rows with a ``target`` column and
    returns an object whose ``columns(features, cluster)`` gives Q per action,
    such as :class:`LinearQ`.
    """
    model = fitter(rows.withColumn("target", F.col("r")))
    d = _width(rows)
    for _ in range(updates):
        best = F.greatest(*model.columns(_cols("z", d), F.col("cluster")))
        model = fitter(rows.withColumn("target", F.col("r") + F.lit(float(gamma)) * best))
    return model


def mllib_linear(rows: DataFrame, reg: float = 0.0) -> LinearQ:
    """A fitter for :func:`q_iteration_with`: MLlib linear regression per action.

    The first feature is the constant; MLlib fits it as the intercept.
    """
    d = _width(rows)
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(1, d)], outputCol="features").transform(rows)
    est = LinearRegression(featuresCol="features", labelCol="target", regParam=reg, solver="normal")
    coefs = {}
    for a in [r["a"] for r in rows.select("a").distinct().collect()]:
        fit = est.fit(data.filter(F.col("a") == a))
        coefs[0, a] = np.concatenate([[fit.intercept], fit.coefficients.toArray()])
    return LinearQ(coefs)


# --- acting

def greedy(rows: DataFrame, model: LinearQ, prefix: str = "x") -> DataFrame:
    """Add ``opt_action`` and ``opt_value``; action 0 wins ties."""
    q0, q1 = model.columns(_cols(prefix, _width(rows)), F.col("cluster"))
    return rows.withColumn("_q0", q0).withColumn("_q1", q1).withColumn(
        "opt_action", F.when(F.coalesce(F.col("_q1") > F.col("_q0"), F.col("_q0").isNull()), 1).otherwise(0)
    ).withColumn("opt_value", F.greatest("_q0", "_q1")).drop("_q0", "_q1")


def greedy_from_table(rows: DataFrame, models: DataFrame, prefix: str = "x") -> DataFrame:
    """The same with the model as a (cluster, action, coef) table; works on streams.

    The table holds one row per (cluster, action).
    """
    d = _width(rows)
    wide = models.groupBy("cluster").agg(*[
        F.max(F.when(F.col("action") == a, F.col("coef"))).alias(f"_c{a}") for a in ACTIONS])
    j = rows.join(wide, "cluster")

    def q(a: int) -> Column:
        out = F.lit(0.0)
        for i in range(d):
            out = out + F.get(f"_c{a}", F.lit(i)) * F.col(f"{prefix}{i}")
        return out

    return j.withColumn("_q0", q(0)).withColumn("_q1", q(1)).withColumn(
        "opt_action", F.when(F.coalesce(F.col("_q1") > F.col("_q0"), F.col("_q0").isNull()), 1).otherwise(0)
    ).withColumn("opt_value", F.greatest("_q0", "_q1")).drop("_q0", "_q1", "_c0", "_c1")


def vote(rows: DataFrame, models: Sequence[LinearQ], keys: Sequence[str] = ("subject", "t"), prefix: str = "x") -> DataFrame:
    """(keys, a, q): each model's arg-max action, then the majority; smallest action on ties.

    The handful of models is unrolled into columns, so a row stays one row.
    """
    d = _width(rows)
    picks, values = [], []
    for m in models:
        q0, q1 = m.columns(_cols(prefix, d), F.col("cluster"))
        picks.append(F.when(F.coalesce(q1 > q0, q0.isNull()), 1).otherwise(0))
        values.append(F.greatest(q0, q1))
    out = rows.select(*keys, F.array(*picks).alias("p"), F.array(*values).alias("v"))
    ones = F.aggregate("p", F.lit(0), lambda s, x: s + x)
    out = out.withColumn("a", F.when(ones * 2 > F.lit(len(models)), 1).otherwise(0))
    agreed = F.filter(F.zip_with("p", "v", lambda p, v: F.when(p == F.col("a"), v)), lambda x: x.isNotNull())
    return out.withColumn("_s", agreed).select(
        *keys, "a", (F.aggregate("_s", F.lit(0.0), lambda s, x: s + x) / F.size("_s")).alias("q"))


def vote_long(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Majority over a long table of (keys, model, a, q) for any number of models."""
    return majority_vote(scored, keys)


def uniform(*cols: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key columns and the seed only."""
    h = F.xxhash64(*cols, F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def epsilon_greedy(scored: DataFrame, eps: float, keys: Sequence[str] = ("subject", "t"), seed: int = 1) -> DataFrame:
    """Add ``action``: a fair coin with probability eps, else ``opt_action``."""
    explore = uniform(*keys, F.lit("explore"), seed=seed) < eps
    coin = (uniform(*keys, F.lit("coin"), seed=seed) < 0.5).cast("int")
    return scored.withColumn("action", F.when(explore, coin).otherwise(F.col("opt_action")))


# --- temporal difference

def with_td_error(rows: DataFrame, model: LinearQ, gamma: float) -> DataFrame:
    """Add ``q``, ``q_next`` and ``tde`` = r + gamma * max Q(s') - Q(s, a).

    As in training, an action that was never observed is left out of the
    maximum, and its rows count with Q = 0.
    """
    d = _width(rows)
    q0, q1 = model.columns(_cols("x", d), F.col("cluster"))
    best = F.greatest(*model.columns(_cols("z", d), F.col("cluster")))
    return rows.withColumn("q", F.coalesce(F.when(F.col("a") == 1, q1).otherwise(q0), F.lit(0.0))).withColumn(
        "q_next", best).withColumn("tde", F.col("r") + F.lit(float(gamma)) * F.col("q_next") - F.col("q"))


# --- evaluation of a fixed policy

def _policy_column(rows: DataFrame, policy: str, model: LinearQ | None, seed: int, constant: int,
                   models: Sequence[LinearQ]) -> DataFrame:
    """Add ``pi``: the policy's action at the next state."""
    if policy == "greedy":
        return greedy(rows, model, "z").withColumnRenamed("opt_action", "pi").drop("opt_value")
    if policy == "random":
        return rows.withColumn("pi", (uniform("subject", "t", seed=seed) < 0.25).cast("int"))
    if policy == "constant":
        return rows.withColumn("pi", F.lit(constant))
    if policy == "vote":
        d = _width(rows)
        picks = []
        for m in models:
            q0, q1 = m.columns(_cols("z", d), F.col("cluster"))
            picks.append(F.when(F.coalesce(q1 > q0, q0.isNull()), 1).otherwise(0))
        total = picks[0]
        for x in picks[1:]:
            total = total + x
        return rows.withColumn("pi", F.when(total * 2 > len(models), 1).otherwise(0))
    raise ValueError(f"unknown policy {policy}")


@dataclass
class Evaluation:
    """``model``: evaluated Q. ``acted``: the rows with the policy's next action.

    ``unobserved``: (cluster, action) pairs that the policy takes but no row does.
    """

    model: LinearQ
    acted: DataFrame
    iterations: dict[int, int]
    unobserved: list[tuple[int, int]]

    def values(self) -> DataFrame:
        """(cluster, subject, t, pi, value): Q of the policy at the next state; NULL where unobserved."""
        q0, q1 = self.model.columns(_cols("z", _width(self.acted)), F.col("cluster"))
        return self.acted.select("cluster", "subject", "t", "pi",
                                 F.when(F.col("pi") == 1, q1).otherwise(q0).alias("value"))

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.unobserved, "cluster int, action int")


def fitted_q_evaluation(
    rows: DataFrame,
    start: LinearQ,
    gamma: float = 0.95,
    max_iter: int = 200,
    policy: str = "greedy",
    seed: int = 1,
    constant: int = 0,
    models: Sequence[LinearQ] = (),
    rule: str = "absolute",
    early_stopping: bool = False,
) -> Evaluation:
    """Q of a fixed policy by repeated regression, started from a fitted model.

    One pass sums phi phi', phi r and phi psi' per (cluster, action, next
    action); the iterations are then small matrix products. ``absolute`` stops
    at a mean squared change below 1e-7, also a quadratic form. ``relative``
    divides by the square of the old value row by row: the iterates are
    computed first and one further pass scores all of them.
    """
    d = _width(rows)
    acted = _policy_column(rows, policy, start, seed, constant, models)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = acted.groupBy("cluster", "a", "pi").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col(f"z{j}")).alias(f"m_{i}_{j}") for i in range(d) for j in range(d)],
        *[F.sum(F.col(f"x{i}") * F.col("r")).alias(f"b_{i}") for i in range(d)]).collect()

    def sym(row, name):
        g = np.zeros((d, d))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"{name}_{i}_{j}"]
        return g

    g: dict[Any, np.ndarray] = {}
    b: dict[Any, np.ndarray] = {}
    m: dict[Any, np.ndarray] = {}
    h: dict[Any, np.ndarray] = {}
    n: dict[int, int] = {}
    for row in sums:
        k, a, pi = row["cluster"], row["a"], row["pi"]
        g[k, a] = g.get((k, a), 0) + sym(row, "g")
        b[k, a] = b.get((k, a), 0) + np.array([row[f"b_{i}"] for i in range(d)])
        m[k, a, pi] = np.array([[row[f"m_{i}_{j}"] for j in range(d)] for i in range(d)])
        h[k, pi] = h.get((k, pi), 0) + sym(row, "h")
        n[k] = n.get(k, 0) + row["n"]
    chosen = {k: sorted({pi for kk, pi in h if kk == k}) for k in n}
    unobserved = [(k, a) for k in n for a in chosen[k] if (k, a) not in g]
    coefs = {key: v for key, v in start.coefs.items() if key[0] in n}
    for key in unobserved:
        coefs.pop(key, None)
    paths: dict[int, list[dict]] = {}
    iterations: dict[int, int] = {}
    for k in n:
        live = [a for a in chosen[k] if (k, a) in g]
        path = [{a: coefs[k, a] for a in ACTIONS if (k, a) in coefs}]
        for a in live:
            path[0].setdefault(a, np.zeros(d))
        for step in range(max_iter):
            cur, nxt = path[-1], dict(path[-1])
            for a in live:
                z = b[k, a] + gamma * sum((m[k, a, pi] @ cur[pi] for pi in live if (k, a, pi) in m), np.zeros(d))
                nxt[a] = _solve(g[k, a], z)
            path.append(nxt)
            change = sum((nxt[a] - cur[a]) @ h[k, a] @ (nxt[a] - cur[a]) for a in live if (k, a) in h)
            if rule == "absolute" and change / n[k] < 1e-7:
                break
            if not all(np.all(np.isfinite(v)) for v in nxt.values()):
                break
            if rule == "relative" and change == 0.0:
                break
        paths[k], iterations[k] = path, len(path) - 1
    if rule == "relative" and max_iter > 0:
        errs = _relative_changes(acted, paths, d)
        for k in n:
            smallest, stop = np.inf, len(paths[k]) - 1
            for i, err in enumerate(errs[k]):
                if early_stopping and abs(err - smallest) < 1e-5:
                    stop = i + 1
                    break
                smallest = min(smallest, err)
                if err < 1e-7:
                    stop = i + 1
                    break
            paths[k] = paths[k][: stop + 1]
            iterations[k] = stop
    final = {(k, a): v for k, path in paths.items() for a, v in path[-1].items()}
    return Evaluation(LinearQ(final), acted, iterations, unobserved)


def _relative_changes(acted: DataFrame, paths: dict[int, list[dict]], d: int) -> dict[int, np.ndarray]:
    """Mean over rows of (Q_new - Q_old)^2 / Q_old^2 for every step of every path, in one pass."""
    stacked = {}
    for k, path in paths.items():
        stacked[k] = {a: np.array([step.get(a, np.full(d, np.nan)) for step in path]).T for a in ACTIONS
                      if any(a in step for step in path)}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, list] = {}
        for pdf in batches:
            z_all = pdf[[f"z{i}" for i in range(d)]].to_numpy(float)
            k_all, p_all = pdf["cluster"].to_numpy(), pdf["pi"].to_numpy()
            for k in np.unique(k_all):
                for a, c in stacked[int(k)].items():
                    z = z_all[(k_all == k) & (p_all == a)]
                    for lo in range(0, len(z), 2048):
                        q = z[lo: lo + 2048] @ c
                        with np.errstate(divide="ignore", invalid="ignore"):
                            e = (np.diff(q, axis=1) ** 2 / q[:, :-1] ** 2)
                        cur = acc.setdefault(int(k), [0, np.zeros(c.shape[1] - 1)])
                        cur[0] += len(e)
                        cur[1] = cur[1] + e.sum(0)
        rows = [(k, v[0], v[1].tolist()) for k, v in acc.items()]
        yield pd.DataFrame(rows, columns=["cluster", "n", "e"])

    got = acted.select("cluster", "pi", *[f"z{i}" for i in range(d)]).mapInPandas(
        fold, "cluster int, n bigint, e array<double>")
    long = got.select("cluster", "n", F.posexplode("e").alias("i", "e")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum("e").alias("e")).collect()
    out = {k: np.zeros(len(path) - 1) for k, path in paths.items()}
    for row in long:
        out[row["cluster"]][row["i"]] = row["e"] / row["n"]
    return out


def initial_values(rows: DataFrame, policy_model: LinearQ, evaluated: LinearQ) -> DataFrame:
    """(cluster, subject, value): evaluated Q at each subject's first state under the greedy action."""
    first = rows.groupBy("cluster", "subject").agg(F.min(F.struct("t", "a", "r", *_cols("x", _width(rows)),
                                                                  *_cols("z", _width(rows)))).alias("f"))
    flat = greedy(first.select("cluster", "subject", "f.*"), policy_model)
    q0, q1 = evaluated.columns(_cols("x", _width(flat)), F.col("cluster"))
    return flat.select("cluster", "subject", F.when(F.col("opt_action") == 1, q1).otherwise(q0).alias("value"))


def pair_labels(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``rows`` with ``cluster`` = the number of the (test, train) pair of labels, and the pairs in order.

    ``rows`` have the training label as ``cluster``; ``labels`` has (subject, k_test). There are as many pairs
    as labels times labels at most.
    """
    # By the size of its compressed files the side of all steps would be broadcast.
    both = rows.withColumn("k_train", F.col("cluster").cast("long")).drop("cluster").join(
        labels.select("subject", F.col("k_test").cast("long").alias("k_test")).hint("merge"), "subject")
    found = both.select("k_test", "k_train").distinct().filter("k_test is not null and k_train is not null").collect()
    pairs = sorted((r["k_test"], r["k_train"]) for r in found)
    table = rows.sparkSession.createDataFrame(
        [(*pair, i) for i, pair in enumerate(pairs)], "k_test long, k_train long, cluster int")
    return both.join(table, ["k_test", "k_train"]).select(*rows.columns), pairs


def ope_by_segment(rows: DataFrame, labels: DataFrame, model: LinearQ, gamma: float, max_iter: int = 500,
                   early_stopping: bool = False) -> DataFrame:
    """(subject, k_test, k_train, value): evaluation inside every (test, train) pair of labels.

    ``rows`` are test steps with ``cluster`` = training label; ``labels`` has
    (subject, k_test). All pairs are evaluated in the same passes: each pair is
    a group of its own that starts from its training label's model. For trees see
    :func:`trees.ope_by_segment`.
    """
    paired, pairs = pair_labels(rows, labels)
    spread = LinearQ({(i, a): v for i, (_, k_train) in enumerate(pairs) for (k, a), v in model.coefs.items() if k == k_train})
    done = fitted_q_evaluation(paired, spread, gamma, max_iter, rule="relative", early_stopping=early_stopping)
    # The start action is greedy under the Q that evaluation ended with.
    value = initial_values(paired, done.model, done.model)
    table = rows.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "cluster int, k_test long, k_train long")
    return value.join(table, "cluster").select("subject", "k_test", "k_train", "value")


def evaluate_with(rows: DataFrame, fitter, start, gamma: float = 0.95, max_iter: int = 200, policy: str = "greedy",
                  rule: str = "absolute", early_stopping: bool = False, tol: float = 1e-7, seed: int = 1, constant: int = 0,
                  models: Sequence = ()) -> tuple[Any, list[float]]:
    """Q of a fixed policy with any regressor, refitted each round; the model and each round's change.

    ``fitter`` and the models are as in :func:`q_iteration_with`. The policy's actions are chosen once, from
    ``start``, and written; a round is one fit and one aggregate. Stop rules are those of
    :func:`fitted_q_evaluation`, over all rows together.
    """
    acted = materialize(_policy_column(rows, policy, start, seed, constant, models), "acted")
    features, cluster = _cols("z", _width(rows)), F.col("cluster")

    def taken(model) -> Column:
        q0, q1 = model.columns(features, cluster)
        return F.coalesce(F.when(F.col("pi") == 1, q1).otherwise(q0), F.lit(0.0))

    model, errors, smallest = start, [], float("inf")
    while len(errors) < max_iter:
        following = fitter(acted.withColumn("target", F.col("r") + F.lit(float(gamma)) * taken(model)))
        step = F.pow(F.col("new") - F.col("old"), F.lit(2.0))
        step = step if rule == "absolute" else step / F.nullif(F.pow(F.col("old"), F.lit(2.0)), F.lit(0.0))
        err = acted.select(taken(following).alias("new"), taken(model).alias("old")).agg(F.avg(step)).first()[0] or 0.0
        errors.append(err)
        model = following
        if err < tol or (early_stopping and abs(err - smallest) < 1e-5):
            break
        smallest = min(smallest, err)
    return model, errors


# --- regression trees

class TreeQ:
    """One MLlib regression tree per action."""

    def __init__(self, trees: dict[int, DecisionTreeRegressionModel]):
        self.trees = trees

    def add_values(self, df: DataFrame, features: str, prefix: str) -> DataFrame:
        for a, tree in self.trees.items():
            df = tree.copy({tree.featuresCol: features, tree.predictionCol: f"{prefix}{a}"}).transform(df)
        return df

    def write(self, path: str) -> None:
        for a, tree in self.trees.items():
            tree.write().overwrite().save(f"{path}/action={a}")

    @staticmethod
    def read(path: str, actions: Sequence[int] = ACTIONS) -> TreeQ:
        return TreeQ({a: DecisionTreeRegressionModel.load(f"{path}/action={a}") for a in actions})


def tree_rows(trans: DataFrame, states: Sequence[str]) -> DataFrame:
    """(subject, t, a, r, now, next): state vectors for the trees."""
    p = len(states)
    out = VectorAssembler(inputCols=list(states), outputCol="now").transform(trans)
    out = VectorAssembler(inputCols=[f"y{i + 1}" for i in range(p)], outputCol="next").transform(out)
    return out.select("subject", "t", "a", "r", "now", "next")


def tree_q_iteration(rows: DataFrame, gamma: float = 0.95, max_depth: int = 3, min_leaf: int = 40, max_iter: int = 3,
                     max_bins: int = 64, seed: int = 1, tol: float = 1e-6, early_stopping: bool = False) -> TreeQ:
    """Fitted-Q iteration with a regression tree per action.

    The target of a round depends on the rows and on the last trees only, so
    the plan does not grow with the rounds. Rounds end as in the linear case:
    after max_iter + 1 of them, or when the fitted values settle.
    """
    actions = [r["a"] for r in rows.select("a").distinct().orderBy("a").collect()]

    def grow(df: DataFrame, target: Column) -> TreeQ:
        data = df.withColumn("target", target)
        trees = {}
        for a in actions:
            est = DecisionTreeRegressor(
                featuresCol="now", labelCol="target", predictionCol=f"p{a}", maxDepth=max_depth,
                minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed)
            trees[a] = est.fit(data.filter(F.col("a") == a).select("now", "target"))
        return TreeQ(trees)

    model = grow(rows, F.col("r"))
    smallest = float("inf")

    def taken(prefix: str) -> Column:
        out = F.lit(0.0)
        for a in actions:
            out = F.when(F.col("a") == a, F.col(f"{prefix}{a}")).otherwise(out)
        return out

    for step in range(max_iter + 1):
        scored = model.add_values(rows, "next", "n")
        best = F.greatest(*[F.col(f"n{a}") for a in actions]) if len(actions) > 1 else F.col(f"n{actions[0]}")
        nxt = grow(scored, F.col("r") + F.lit(gamma) * best)
        if step == max_iter:
            return nxt
        own = nxt.add_values(rows, "now", "w")
        # The first round is compared with zero, as no fitted values precede it.
        own = model.add_values(own, "now", "o") if step else own
        before = taken("o") if step else F.lit(0.0)
        row = own.agg(F.sum(F.pow(taken("w") - before, F.lit(2))).alias("d"), F.sum(F.pow(before, F.lit(2))).alias("s")).first()
        model = nxt
        err = float(np.sqrt(row["d"]) / (np.sqrt(row["s"]) + 1e-6))
        if err <= tol or (early_stopping and abs(err - smallest) < 1e-5):
            break
        smallest = min(smallest, err)
    return model


def tree_td_error(rows: DataFrame, model: TreeQ, gamma: float) -> DataFrame:
    scored = model.add_values(model.add_values(rows, "now", "o"), "next", "n")
    actions = list(model.trees)
    q = F.lit(0.0)
    for a in actions:
        q = F.when(F.col("a") == a, F.col(f"o{a}")).otherwise(q)
    best = F.greatest(*[F.col(f"n{a}") for a in actions]) if len(actions) > 1 else F.col(f"n{actions[0]}")
    return scored.withColumn("tde", F.col("r") + F.lit(gamma) * best - q)


# --- model selection

def squared_loss(td: DataFrame) -> Column:
    return F.avg(F.col("tde") * F.col("tde"))


def kernel_metric(states: Sequence[str], panel: DataFrame | None = None, bandwidth: float | None = None,
                  panel_states: Sequence[str] | None = None):
    """A metric for cross-validation: the kernel loss over the columns ``states`` of the rows.

    Without a ``bandwidth`` it is one over the median distance of the panel's states.
    """
    if bandwidth is None:
        bandwidth = kernel.median_bandwidth(panel, list(panel_states or states)).first()["bandwidth"]
    return lambda td: kernel.kernel_td_loss(td, list(states), bandwidth)


def with_folds(trans: DataFrame, folds: DataFrame | int | None) -> DataFrame:
    """``trans`` with a ``fold``: of its subject, its step or its row, as the keys of ``folds`` tell; or that many by rule.

    None says that ``trans`` has a ``fold`` already.
    """
    if folds is None:
        return trans
    if isinstance(folds, int):
        return assign_folds(trans, folds)
    keys = [c for c in ("subject", "t") if c in folds.columns]
    return trans.join(folds.select(*keys, "fold"), keys)


def select_linear_cv(
    trans: DataFrame,
    folds: DataFrame | int | None,
    states: Sequence[str],
    maps: Sequence[FeatureMap],
    gamma: float,
    max_iter: int = 300,
    tol: float = 1e-4,
    early_stopping: bool = True,
    times: DataFrame | None = None,
    metric=None,
) -> DataFrame:
    """(param_id, test_error): mean test loss over folds for each feature map.

    All folds train in the same passes over one copy of the rows. ``folds`` as in
    :func:`with_folds`. ``times`` restricts fitting and scoring to sampled steps.
    ``metric`` maps a table with ``tde`` to one ``loss`` per ``cluster`` (:func:`kernel_metric`); the
    default is the mean square.
    """
    spark = trans.sparkSession
    if times is not None:
        trans = trans.join(times.select("t").distinct(), "t", "left_semi")
    base = with_folds(trans, folds)
    out = []
    for i, fmap in enumerate(maps):
        rows = materialize(policy_rows(base, states, fmap, "fold"), "cv-rows")
        fit = fitted_q_iteration(rows, gamma, max_iter, tol, early_stopping, left_out=True)
        td = with_td_error(rows, fit.model, gamma)
        if metric is None:
            per = td.groupBy("cluster").agg(squared_loss(td).alias("loss"))
        else:
            per = metric(td)
        out.append((i, per.agg(F.avg("loss")).first()[0]))
    return spark.createDataFrame(out, "param_id int, test_error double")


def best_param(errors: DataFrame) -> int:
    """The parameter of smallest error, the first on ties."""
    return errors.orderBy("test_error", "param_id").first()["param_id"]


def select_tree_cv(trans: DataFrame, folds: DataFrame, states: Sequence[str], grid: Sequence[dict], gamma: float,
                   max_iter: int = 1) -> DataFrame:
    """(param_id, test_error) over a grid of tree settings."""
    rows = materialize(tree_rows(trans, states).join(folds.select("subject", "fold"), "subject"), "tree-rows")
    n_folds = rows.agg(F.max("fold")).first()[0] + 1
    out = []
    for i, params in enumerate(grid):
        losses = []
        for f in range(n_folds):
            model = tree_q_iteration(rows.filter(F.col("fold") != f), gamma, params["max_depth"],
                                     params["min_samples_leaf"], max_iter)
            td = tree_td_error(rows.filter(F.col("fold") == f), model, gamma)
            losses.append(td.agg(squared_loss(td)).first()[0])
        out.append((i, float(np.mean(losses))))
    return trans.sparkSession.createDataFrame(out, "param_id int, test_error double")
