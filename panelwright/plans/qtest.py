"""Tests for a change of the optimal Q function at candidate times.

Every candidate u splits the steps into t < u and t >= u. The two Q functions
of all candidates are fitted in the same passes: a row belongs to one side of
every candidate, so the group of a row is (candidate, side).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.features import FeatureMap
from panelwright.operators.ranking import quantiles
from panelwright.plans import policy
from panelwright.session import materialize

STATS = ("maximum", "normalised", "integral", "empirical")


def normals(key: np.ndarray, count: int, seed: int) -> np.ndarray:
    """(rows, count) standard normals that depend on the row key and seed only."""
    with np.errstate(over="ignore"):
        n = -(-count // 2)
        x = key.astype(np.uint64)[:, None] + np.arange(1, 2 * n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
        x = x ^ (x >> np.uint64(31))
    u = ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    r, t = np.sqrt(-2.0 * np.log(u[:, :n])), 2.0 * np.pi * u[:, n:]
    return np.concatenate([r * np.cos(t), r * np.sin(t)], axis=1)[:, :count]


@dataclass
class QChange:
    """Statistics per candidate and their multiplier-bootstrap replicates.

    ``table``: (u, statistic, value). ``boot``: {statistic: replicates of the
    maximum over u}. ``summary``: (statistic, value, pvalue).
    """

    table: DataFrame
    summary: DataFrame
    boot: dict[str, np.ndarray]


def _feature_values(fmap: FeatureMap, states: Sequence[str], points: np.ndarray, spark) -> np.ndarray:
    """Features of a handful of grid points, through the same column expressions."""
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(points)],
                                  "i int, " + ", ".join(f"{c} double" for c in states))
    terms = fmap.terms([F.col(c) for c in states])
    got = frame.select("i", *[t.cast("double").alias(f"f{j}") for j, t in enumerate(terms)]).orderBy("i").collect()
    return np.array([list(r)[1:] for r in got])


def q_change_test(
    trans: DataFrame,
    states: Sequence[str],
    candidates: Sequence[int],
    n_steps: int,
    fmap: FeatureMap,
    gamma: float = 0.95,
    theta: float = 0.5,
    grid_points: int = 10,
    draws: int = 1000,
    max_iter: int = 400,
    tol: float = 1e-6,
    seed: int = 0,
) -> QChange:
    """Compare Q before and after every candidate time.

    ``maximum`` and ``normalised`` (by its standard error) over a box of
    states, ``integral`` under a normal reference law, ``empirical`` over the
    panel's own rows; each times (u (T-u) / T)^theta and maximised over u.
    """
    spark = trans.sparkSession
    p = len(states)
    base = policy.policy_rows(trans, states, fmap)
    d = sum(1 for c in base.columns if c[0] == "x" and c[1:].isdigit())
    groups = F.array(*[(F.lit(2 * i) + (F.col("t") >= u).cast("int")) for i, u in enumerate(candidates)])
    rows = materialize(base.withColumn("cluster", F.explode(groups)), "q-test-rows")
    model = policy.fitted_q_iteration(rows, gamma, max_iter, tol).model

    # TD errors and, with the greedy next action, the sums that make W and the sandwich.
    td = policy.with_td_error(rows, model, gamma)
    td = policy.greedy(td, model, "z").withColumnRenamed("opt_action", "pi")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = td.groupBy("cluster", "a", "pi").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("tde") * F.col("tde")).alias(f"v_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"x{i}") * F.col(f"z{j}")).alias(f"m_{i}_{j}") for i in range(d) for j in range(d)]).collect()
    m = len(candidates)
    w = np.zeros((2 * m, 2 * d, 2 * d))
    v = np.zeros((2 * m, 2 * d, 2 * d))
    n = np.zeros(2 * m)
    for r in sums:
        g, a, pi = r["cluster"], r["a"], r["pi"]
        n[g] += r["n"]
        sa, sp = slice(a * d, a * d + d), slice(pi * d, pi * d + d)
        for i, j in pairs:
            for x, y in {(i, j), (j, i)}:
                w[g, a * d + x, a * d + y] += r[f"g_{i}_{j}"]
                v[g, a * d + x, a * d + y] += r[f"v_{i}_{j}"]
        w[g, sa, sp] -= gamma * np.array([[r[f"m_{i}_{j}"] for j in range(d)] for i in range(d)])
    w = w / n[:, None, None]
    inv = np.array([np.linalg.pinv(x) for x in w])
    sandwich = np.array([inv[g] @ v[g] @ inv[g].T / n[g] ** 2 for g in range(2 * m)])
    beta = np.zeros((2 * m, 2 * d))
    for (g, a), c in model.coefs.items():
        beta[g, a * d: a * d + d] = c

    # Multiplier bootstrap of the coefficients: W^-1 mean(phi * e * noise).
    scores = _multiplier_sums(td, d, 2 * m, draws, seed)
    noise_beta = np.einsum("gij,gjb->gib", inv, scores) / n[:, None, None]

    # Points of the box and of the normal reference law.
    facts = trans.agg(*[F.avg(c).alias(f"m_{c}") for c in states],
                      *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a in states for b in states]).first()
    rng = np.random.Generator(np.random.Philox(key=[seed, 7]))
    ends = [quantiles(trans, [], c, {"low": 0.05, "high": 0.95}).first() for c in states]
    low, high = np.array([e["low"] for e in ends]), np.array([e["high"] for e in ends])
    box = rng.uniform(low, high, size=(grid_points, p))
    cov = np.array([[facts[f"c_{a}_{b}"] for b in states] for a in states])
    ref = rng.multivariate_normal([facts[f"m_{c}"] for c in states], cov, size=grid_points)
    fbox, fref = _feature_values(fmap, states, box, spark), _feature_values(fmap, states, ref, spark)

    delta = beta[0::2] - beta[1::2]
    noise_delta = noise_beta[0::2] - noise_beta[1::2]
    middle = sandwich[0::2] + sandwich[1::2]
    emp, boot_emp = _empirical(trans, states, fmap, delta, noise_delta, d)
    table, boot = [], {s: np.zeros(draws) for s in STATS}
    for i, u in enumerate(candidates):
        factor = (u * (n_steps - u) / n_steps) ** theta
        value = dict.fromkeys(STATS, 0.0)
        rep = {s: np.zeros(draws) for s in STATS}
        for a in policy.ACTIONS:
            sl = slice(a * d, a * d + d)
            diff, noise = np.abs(fbox @ delta[i, sl]), np.abs(fbox @ noise_delta[i, sl])
            sd = np.sqrt(np.maximum(np.einsum("ji,ik,jk->j", fbox, middle[i, sl, sl], fbox), 1e-300))
            value["maximum"] = max(value["maximum"], diff.max())
            rep["maximum"] = np.maximum(rep["maximum"], noise.max(0))
            value["normalised"] = max(value["normalised"], (diff / sd).max())
            rep["normalised"] = np.maximum(rep["normalised"], (noise / sd[:, None]).max(0))
            value["integral"] += np.abs(fref @ delta[i, sl]).sum() / (grid_points * len(policy.ACTIONS))
            rep["integral"] += np.abs(fref @ noise_delta[i, sl]).sum(0) / (grid_points * len(policy.ACTIONS))
        value["empirical"], rep["empirical"] = emp[i], boot_emp[i]
        for s in STATS:
            table.append((int(u), s, float(value[s] * factor)))
            boot[s] = np.maximum(boot[s], rep[s] * factor)
    top = {s: max(x for _, name, x in table if name == s) for s in STATS}
    summary = [(s, float(top[s]), float(np.mean(boot[s] >= top[s]))) for s in STATS]
    return QChange(spark.createDataFrame(table, "u int, statistic string, value double"),
                   spark.createDataFrame(summary, "statistic string, value double, pvalue double"), boot)


def _multiplier_sums(td: DataFrame, d: int, groups: int, draws: int, seed: int) -> np.ndarray:
    """(groups, 2d, draws): sums of phi * e * noise, one matrix product per batch."""
    xs = [f"x{i}" for i in range(d)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((groups, 2 * d, draws))
        for pdf in batches:
            key, g, a = pdf["key"].to_numpy(), pdf["cluster"].to_numpy(), pdf["a"].to_numpy()
            scored = pdf[xs].to_numpy(float) * pdf[["tde"]].to_numpy(float)
            for lo in range(0, len(pdf), 4096):
                at = slice(lo, lo + 4096)
                xi = normals(key[at], draws, seed)
                for gg in np.unique(g[at]):
                    for aa in policy.ACTIONS:
                        pick = (g[at] == gg) & (a[at] == aa)
                        if pick.any():
                            acc[gg, aa * d: aa * d + d] += scored[at][pick].T @ xi[pick]
        yield pd.DataFrame({"g": np.repeat(np.arange(groups), 2 * d), "i": np.tile(np.arange(2 * d), groups),
                            "v": [acc[g, i].tolist() for g in range(groups) for i in range(2 * d)]})

    got = td.select(F.xxhash64("subject", "t").alias("key"), "cluster", "a", "tde", *xs).mapInPandas(
        fold, "g int, i int, v array<double>")
    summed = got.select("g", "i", F.posexplode("v").alias("b", "v")).groupBy("g", "i", "b").agg(F.sum("v").alias("v"))
    out = np.zeros((groups, 2 * d, draws))
    for r in summed.collect():
        out[r["g"], r["i"], r["b"]] = r["v"]
    return out


def _empirical(trans: DataFrame, states: Sequence[str], fmap: FeatureMap, delta: np.ndarray, noise: np.ndarray,
               d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean over all rows of |Q1 - Q2| at (s, a), observed and per replicate, in one pass."""
    m, draws = len(delta), noise.shape[-1]
    base = policy.policy_rows(trans, states, fmap).select("a", *[f"x{i}" for i in range(d)])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, acc = 0, np.zeros((m, 1 + draws))
        for pdf in batches:
            a, x = pdf["a"].to_numpy(), pdf[[f"x{i}" for i in range(d)]].to_numpy(float)
            count += len(x)
            for act in policy.ACTIONS:
                sl = slice(act * d, act * d + d)
                xa = x[a == act]
                for lo in range(0, len(xa), 4096):
                    part = xa[lo: lo + 4096]
                    for i in range(m):
                        acc[i, 0] += np.abs(part @ delta[i, sl]).sum()
                        acc[i, 1:] += np.abs(part @ noise[i, sl]).sum(0)
        yield pd.DataFrame({"i": np.arange(m), "n": count, "v": [row.tolist() for row in acc]})

    got = base.mapInPandas(fold, "i int, n bigint, v array<double>")
    rows = got.select("i", "n", F.posexplode("v").alias("b", "v")).groupBy("i", "b").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out = np.zeros((m, 1 + draws))
    for r in rows:
        out[r["i"], r["b"]] = r["v"] / r["n"]
    return out[:, 0], out[:, 1:]


def select_basis(trans: DataFrame, folds: DataFrame, states: Sequence[str], u: int, maps: Sequence[FeatureMap],
                 gamma: float, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """(param_id, test_error): two-sided cross-validated TD error per feature map.

    The error of a map is the sum of its errors on the steps before and from u. The steps are computed
    once, with their folds, for all maps and both sides.
    """
    steps = trans.select("subject", "t", "a", "r", *states, *[f"y{i + 1}" for i in range(len(states))])
    trans = materialize(policy.with_folds(steps, folds), "basis-steps")
    left = policy.select_linear_cv(trans.filter(F.col("t") < u), None, states, maps, gamma, max_iter, tol, False)
    right = policy.select_linear_cv(trans.filter(F.col("t") >= u), None, states, maps, gamma, max_iter, tol, False)
    return left.unionByName(right).groupBy("param_id").agg(F.sum("test_error").alias("test_error"))
