"""Penalised transition regressions (SCAD, MCP) on sums of products.

Rows are summed once by Spark; every fit, fold and window works on Grams of
2 + 2p columns. Training folds are total minus fold, windows are prefix
differences, so neither cross-validation nor the scan reads a row again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.grid import ScanGrid, parameter_grid
from panelwright.functions.scalars import TINY
from panelwright.operators.moments import Moments, gram_solve, moments_by
from panelwright.plans import nulls
from panelwright.plans.changepoint import _reject, spread_partitions, share_above
from panelwright.session import materialize

# Coefficients below this size count as zero, and the error given
# to a fit without any covariate.
ZERO = 1e-4
EMPTY_ERROR = 1e10
# Fixed value: smallest cluster whose penalty is tuned.
MIN_SUBJECTS = 10


def _shrink(z: np.ndarray, step: float, alpha: float, gamma: float, penalty: str) -> np.ndarray:
    """Minimiser of (w - z)^2 / (2 step) + penalty(w)."""
    size, sign = np.abs(z), np.sign(z)
    soft = sign * np.maximum(size - alpha * step, 0.0)
    if penalty == "MCP":
        if gamma <= step:
            return np.where(size > np.sqrt(gamma * step) * alpha, z, 0.0)
        return np.where(size <= gamma * alpha, soft / (1.0 - step / gamma), z)
    if penalty == "SCAD":
        if gamma <= 1.0 + step:
            return np.where(size > alpha * (step + 1.0 + gamma) / 2.0, z, soft)
        middle = ((gamma - 1.0) * z - sign * gamma * alpha * step) / (gamma - 1.0 - step)
        return np.where(size <= alpha * (1.0 + step), soft, np.where(size <= gamma * alpha, middle, z))
    raise ValueError(f"unknown penalty {penalty}")


def penalised_coef(xx: np.ndarray, xy: np.ndarray, obs: float, alpha: float, gamma: float, penalty: str = "SCAD",
                   max_iter: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent for 1/(2 obs) |Y - XW|^2 + sum penalty(W), all responses at once."""
    h, c = xx / obs, xy / obs
    w = np.zeros_like(c)
    for _ in range(max_iter):
        move = 0.0
        for j in range(len(h)):
            if h[j, j] <= 0:
                continue
            z = w[j] + (c[j] - h[j] @ w) / h[j, j]
            new = _shrink(z, 1.0 / h[j, j], alpha, gamma, penalty)
            move = max(move, float(np.max(np.abs(new - w[j]))))
            w[j] = new
        if move < tol:
            break
    return w


def fit_with_fallback(xx: np.ndarray, xy: np.ndarray, obs: float, alpha: float, gamma: float, alphas: Sequence[float],
                      penalty: str) -> tuple[np.ndarray, float]:
    """Coefficients; while all are zero, the next entry down the list of alphas is tried."""
    at = list(alphas).index(alpha)
    while True:
        w = penalised_coef(xx, xy, obs, alphas[at], gamma, penalty)
        if np.any(np.abs(w) > ZERO) or at == 0:
            return w, alphas[at]
        at -= 1


def _sse(xx, xy, yy, w) -> float:
    return float(max(yy.sum() - 2 * np.sum(xy * w) + np.sum(w * (xx @ w)), 0.0))


def choose_params(layout: Moments, folds: np.ndarray, grid: Sequence[dict], penalty: str) -> tuple[dict, list[float]]:
    """The parameter of smallest mean test error (first on ties) from sums per fold."""
    total = folds.sum(0)
    p, errors = layout.p, []
    used = [f for f in folds if f[0] > 0]
    for params in grid:
        errs = []
        for f in used:
            xx, xy, _ = layout.design(total - f)
            w = penalised_coef(xx, xy, (total - f)[0] * p, params["alpha"], params["gamma"], penalty)
            if not np.any(np.abs(w) > ZERO):
                errs.append(EMPTY_ERROR)
                continue
            errs.append(_sse(*layout.design(f), w) / (f[0] * p))
        errors.append(float(np.mean(errs)) if errs else EMPTY_ERROR)
    best, low = grid[0], np.inf
    for params, e in zip(grid, errors):
        if e < low:
            best, low = params, e
    return best, errors


def strongest(param_grid: dict[str, list]) -> dict:
    return {"alpha": max(param_grid["alpha"]), "gamma": max(param_grid["gamma"])}


def subject_fold(nfold: int, seed: int = 0) -> Column:
    """Fold of a subject by hash: no ranking and no shuffle."""
    return F.pmod(F.xxhash64("subject", F.lit(seed)), F.lit(nfold)).cast("int")


def _fold_sums(rows: DataFrame, keys: Sequence[str], p: int, nfold: int, seed: int) -> DataFrame:
    sums = moments_by(rows.withColumn("fold", subject_fold(nfold, seed)), [*keys, "fold"], p)
    sizes = rows.groupBy("cluster").agg(F.countDistinct("subject").alias("n_subjects"))
    # One row per cluster.
    return sums.join(sizes, "cluster")


def penalised_cv(rows: DataFrame, p: int, param_grid: dict[str, list], nfold: int = 5, penalty: str = "SCAD",
                 seed: int = 0) -> DataFrame:
    """(cluster, alpha, gamma, test_error, selected) over the grid.

    A cluster of fewer than ten subjects is not tuned: it gets the largest
    alpha and gamma.
    """
    layout, grid = Moments(p), parameter_grid(param_grid)

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        best, errors = choose_params(layout, pdf[layout.names].to_numpy(float), grid, penalty)
        if pdf["n_subjects"].iloc[0] < MIN_SUBJECTS:
            best = strongest(param_grid)
        return pd.DataFrame({"cluster": key[0], "alpha": [g["alpha"] for g in grid], "gamma": [g["gamma"] for g in grid],
                             "test_error": errors, "selected": [g == best for g in grid]})

    kind = rows.schema["cluster"].dataType.simpleString()
    return _fold_sums(rows, ["cluster"], p, nfold, seed).groupBy("cluster").applyInPandas(
        run, f"cluster {kind}, alpha double, gamma double, test_error double, selected boolean")


def penalised_fit(rows: DataFrame, p: int, alpha: float, gamma: float, alphas: Sequence[float] | None = None,
                  penalty: str = "SCAD") -> DataFrame:
    """(cluster, alpha, coef, n_nonzero): one penalised fit per cluster with the zero fallback."""
    layout = Moments(p)
    alphas = list(alphas or [alpha])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cluster, m in zip(pdf["cluster"], pdf[layout.names].to_numpy(float)):
                xx, xy, _ = layout.design(m)
                w, used = fit_with_fallback(xx, xy, m[0] * p, alpha, gamma, alphas, penalty)
                out.append((cluster, used, w.T.ravel().tolist(), int(np.sum(np.abs(w) > ZERO))))
            yield pd.DataFrame(out, columns=["cluster", "alpha", "coef", "n_nonzero"])

    kind = rows.schema["cluster"].dataType.simpleString()
    return moments_by(rows, ["cluster"], p).mapInPandas(
        run, f"cluster {kind}, alpha double, coef array<double>, n_nonzero int")


def changepoint_quality(rows: DataFrame, taus: DataFrame, n_times: int, p: int, param_grid: dict[str, list],
                        nfold: int = 5, cv: bool = True, penalty: str = "SCAD", seed: int = 0) -> DataFrame:
    """(cluster, tau, loss, loss_per_step, sigma2, df, coef) of the post-change fit.

    loss = -SSE; loss_per_step = -SSE / (T-1-tau); sigma2 = SSE / (n - df), df
    counting nonzero coefficients.
    """
    layout, grid = Moments(p), parameter_grid(param_grid)
    after = rows.join(taus.select("cluster", "tau"), "cluster").filter("t >= tau")

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        folds = pdf[layout.names].to_numpy(float)
        if cv and pdf["n_subjects"].iloc[0] >= MIN_SUBJECTS:
            params, _ = choose_params(layout, folds, grid, penalty)
        else:
            params = strongest(param_grid)
        total = folds.sum(0)
        xx, xy, yy = layout.design(total)
        w, _ = fit_with_fallback(xx, xy, total[0] * p, params["alpha"], params["gamma"], param_grid["alpha"], penalty)
        df, sse = int(np.sum(np.abs(w) > ZERO)), _sse(xx, xy, yy, w)
        tau = int(key[1])
        return pd.DataFrame({"cluster": [key[0]], "tau": [tau], "loss": [-sse], "loss_per_step": [-sse / (n_times - 1 - tau)],
                             "sigma2": [sse / (total[0] * p - df)], "df": [df], "coef": [w.T.ravel().tolist()]})

    kind = rows.schema["cluster"].dataType.simpleString()
    return _fold_sums(after, ["cluster", "tau"], p, nfold, seed).groupBy("cluster", "tau").applyInPandas(
        run, f"cluster {kind}, tau int, loss double, loss_per_step double, sigma2 double, df int, coef array<double>")


def fitted_values(rows: DataFrame, models: DataFrame, p: int) -> DataFrame:
    """(subject, t, cluster, y1.., fit1..): observed and fitted next states."""
    d = 2 + 2 * p
    j = rows.join(models.select("cluster", "coef"), "cluster")
    terms = [F.lit(1.0), F.col("a"), *[F.col(f"s{i + 1}") for i in range(p)],
             *[F.col("a") * F.col(f"s{i + 1}") for i in range(p)]]
    fits = []
    for r in range(p):
        out = F.lit(0.0)
        for i, term in enumerate(terms):
            out = out + F.get("coef", F.lit(r * d + i)) * term
        fits.append(out.alias(f"fit{r + 1}"))
    return j.select("subject", "t", "cluster", *[f"y{i + 1}" for i in range(p)], *fits)


def sparse_scan(rows: DataFrame, grid: ScanGrid, p: int, param_grid: dict[str, list], nfold: int = 5,
                penalty: str = "SCAD", interval: int = 5, per_observation: bool = False, seed: int = 0) -> DataFrame:
    """(cluster, kappa, u, stat, df, alpha, gamma): best split of every window.

    The penalty is tuned at the first of every ``interval`` windows. A
    penalised fit of the window picks covariates; both segments are refitted
    on these by least squares. ``rows`` carry ``cluster`` and states that are
    standardised within it. One task handles one cluster and one run of
    windows that share a penalty.
    """
    layout, params_list = Moments(p), parameter_grid(param_grid)
    names, end = layout.names, grid.n_times - 1
    ks_all = [k for k in grid.kappas() if k > int(2 * grid.eps * grid.n_times)]
    sums = _fold_sums(rows, ["cluster", "t"], p, nfold, seed)
    blocks = -(-len(ks_all) // interval)
    work = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("block"))

    def scan(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        per = np.zeros((nfold, end, len(names)))
        np.add.at(per, (pdf["fold"].to_numpy(), pdf["t"].to_numpy()), pdf[names].to_numpy(float))
        hist = np.concatenate([np.zeros((1, len(names))), np.cumsum(per.sum(0), axis=0)])
        out, params = [], None
        for k in ks_all[int(key[1]) * interval: (int(key[1]) + 1) * interval]:
            if params is None:
                if pdf["n_subjects"].iloc[0] >= MIN_SUBJECTS:
                    params, _ = choose_params(layout, per[:, end - k:].sum(1), params_list, penalty)
                else:
                    params = strongest(param_grid)
            whole = hist[end] - hist[end - k]
            obs = whole[0] * p
            if obs <= 0:
                continue
            xx, xy, yy = layout.design(whole)
            w, alpha = fit_with_fallback(xx, xy, obs, params["alpha"], params["gamma"], param_grid["alpha"], penalty)
            keep = np.abs(w) > ZERO
            u = np.arange(int(grid.eps * grid.n_times), int(k - grid.eps * grid.n_times) + 1)
            u = u[(u > 0) & (u < k)]
            if len(u) == 0:
                continue
            mid = hist[end - k + u]
            sse1 = np.zeros(len(u))
            for part in (mid - hist[end - k], hist[end] - mid):
                pxx, pxy, pyy = layout.design(part)
                for r in range(p):
                    cols = np.flatnonzero(keep[:, r])
                    sse = pyy[:, r].copy()
                    if len(cols):
                        sub, rhs = pxx[:, cols][:, :, cols], pxy[:, cols, r: r + 1]
                        coef, _ = gram_solve(sub, rhs)
                        sse = sse - np.einsum("uij,uij->u", rhs, coef)
                    sse1 += np.maximum(sse, 0.0)
            v0 = max(_sse(xx, xy, yy, w) / obs, TINY)
            stat = 0.5 * obs * np.log(v0 / np.maximum(sse1 / obs, TINY))
            if per_observation:
                stat = stat / whole[0]
            i = int(np.argmax(stat))
            out.append((key[0], k, int(u[i]), float(stat[i]), int(keep.sum()), alpha, params["gamma"]))
        return pd.DataFrame(out, columns=["cluster", "kappa", "u", "stat", "df", "alpha", "gamma"])

    kind = rows.schema["cluster"].dataType.simpleString()
    return work.repartition(spread_partitions(work), "cluster", "block").groupBy("cluster", "block").applyInPandas(
        scan, f"cluster {kind}, kappa int, u int, stat double, df int, alpha double, gamma double")


def detect_sparse_change(rows: DataFrame, grid: ScanGrid, p: int, param_grid: dict[str, list], draws: int = 2000,
                         level: float = 0.01, **settings) -> tuple[DataFrame, DataFrame]:
    """(cluster, tau, ...) and the table of all windows with threshold and p-value.

    The null law depends on the window and on the number of covariates picked,
    so limits are drawn for the counts that occur. A window in which the penalty keeps no
    covariate has no limit (threshold NULL, p-value 1) and can't reject.
    """
    best = sparse_scan(rows, grid, p, param_grid, **settings)
    best = materialize(best, "sparse-scan")
    spark = rows.sparkSession
    # At most (2 + 2p) p different counts.
    dfs = sorted({r["df"] for r in best.select("df").distinct().collect()} - {0})
    laws = spark.createDataFrame([], "kappa int, df int, threshold double, _draws array<double>")
    for df in dfs:
        laws = laws.unionByName(
            nulls.null_sample(spark, grid.kappas(), df, draws).groupBy("kappa", F.lit(df).alias("df")).agg(
                F.percentile("stat", F.lit(1.0 - level)).alias("threshold"), F.collect_list("stat").alias("_draws")))
    per = best.join(laws, ["kappa", "df"], "left").withColumn(
        "pvalue", F.coalesce(share_above("_draws", "stat"), F.lit(1.0))).drop("_draws")
    return _reject(per, grid), per
