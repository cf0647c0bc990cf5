"""Change-point detection jobs.

Rows are reduced to sums per (cluster, t) first; every later step works on at
most K * T rows, and the candidate grid is evaluated next to the sums it needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.grid import ScanGrid
from panelwright.functions.scalars import TINY
from panelwright.operators.moments import Moments, action_sse, batch_sse, moments_by
from panelwright.plans import nulls

# A cluster's grid is always spread over tasks, so many windows in each.
KAPPA_BLOCK = 16
# Clusters that are scored at once where every subject is one.
CLUSTERS = 64


def label(trans: DataFrame, assignment: DataFrame | None) -> DataFrame:
    """Attach the cluster; with no assignment all subjects form cluster 0."""
    if assignment is None:
        return trans.withColumn("cluster", F.lit(0))
    return trans.join(assignment.select("subject", "cluster"), "subject")


def time_moments(labelled: DataFrame, p: int) -> DataFrame:
    """(cluster, t, sums)."""
    return moments_by(labelled, ["cluster", "t"], p)


def prefix_moments(mom: DataFrame, p: int) -> DataFrame:
    """(cluster, t, sums up to and including t)."""
    w = Window.partitionBy("cluster").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mom.select("cluster", "t", *[F.sum(c).over(w).alias(c) for c in Moments(p).names])


def spread_partitions(df: DataFrame) -> int:
    """Tasks for a step that computes far more than it reads.

    Given as an explicit count, so that adaptive execution does not merge the
    small partitions into one task.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _history(pdf: pd.DataFrame, names: Sequence[str], end: int) -> np.ndarray:
    """(end + 1, q): entry i holds the sums over t < i; steps without rows add nothing."""
    t = pdf["t"].to_numpy()
    if len(t) and (t.min() < 0 or t.max() >= end):
        raise ValueError(f"a transition starts outside of 0..{end - 1}")
    dense = np.zeros((end, len(names)))
    dense[t] = pdf[list(names)].to_numpy(float)
    return np.vstack([np.zeros((1, len(names))), np.cumsum(dense, axis=0)])


def _score_grid(mom: DataFrame, grid: ScanGrid, p: int, scale: float, per_observation: bool,
                best_only: bool, spread: bool) -> DataFrame:
    """Score the grid of every cluster from its running sums.

    A group is one cluster's T rows of sums (or, with ``spread``, those rows
    and a block of window lengths), so its size follows the horizon and not
    the number of subjects or raw rows.
    """
    layout = Moments(p)
    names, end = layout.names, grid.n_times - 1
    keys = ["cluster"]
    if spread:
        blocks = F.sequence(F.lit(0), F.lit((len(grid.kappas()) - 1) // KAPPA_BLOCK))
        mom = mom.select("*", F.explode(blocks).alias("block"))
        keys = ["cluster", "block"]

    def scan(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        ks = grid.kappas()
        if spread:
            ks = ks[int(key[1]) * KAPPA_BLOCK: (int(key[1]) + 1) * KAPPA_BLOCK]
        hist = _history(pdf, names, end)[None]
        return _scanned([key[0]], hist, ks, grid, layout, scale, per_observation, best_only)

    kind = mom.schema["cluster"].dataType.simpleString()
    return (
        mom.repartition(spread_partitions(mom), *keys).groupBy(*keys)
        .applyInPandas(scan, f"cluster {kind}, kappa int, u int, stat double")
    )


def _scanned(clusters: Sequence, hist: np.ndarray, kappas: Sequence[int], grid: ScanGrid, layout: Moments, scale: float,
             per_observation: bool, best_only: bool) -> pd.DataFrame:
    """(cluster, kappa, u, stat) of clusters with running sums ``hist`` (clusters, end + 1, q), in one pass of arrays."""
    p, end = layout.p, grid.n_times - 1
    out: list[tuple[np.ndarray, ...]] = []
    for k, u in _chunks(kappas, grid, max(1000, 40000 // len(hist))):
        whole = hist[:, end, None] - hist[:, end - k]
        mid = hist[:, end - k + u]
        obs = whole[:, :, 0] * p
        first = np.flatnonzero(np.diff(k, prepend=-1))
        ends = np.append(first, len(k))
        sse0 = np.repeat(batch_sse(layout, whole[:, first]), np.diff(ends), axis=1)
        sse1 = batch_sse(layout, mid - hist[:, end - k]) + batch_sse(layout, hist[:, end, None] - mid)
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = 0.5 * scale * obs * np.log(np.maximum(sse0 / obs, TINY) / np.maximum(sse1 / obs, TINY))
            if per_observation:
                stat = stat * p / obs
        keep = obs > 0
        if best_only:
            mask = np.zeros(keep.shape, dtype=bool)
            for a, b in zip(ends[:-1], ends[1:]):
                mask[np.arange(len(hist)), a + np.argmax(stat[:, a:b], axis=1)] = True
            keep = keep & mask
        at, where = np.nonzero(keep)
        out.append((at, k[where], u[where], stat[at, where]))
    if not out:
        return pd.DataFrame({"cluster": [], "kappa": [], "u": [], "stat": []})
    at, k, u, stat = (np.concatenate(v) for v in zip(*out))
    return pd.DataFrame({"cluster": np.asarray(clusters)[at], "kappa": k, "u": u, "stat": stat})


def scan_many(mom: DataFrame, grid: ScanGrid, p: int, scale: float = 1.0, per_observation: bool = False,
              best_only: bool = True) -> DataFrame:
    """(cluster, kappa, u, stat) for very many small clusters: ``CLUSTERS`` of them are scored at once.

    The clusters of a task come in order, as offsets into its rows; none is a group of its own.
    """
    layout = Moments(p)
    names, end = layout.names, grid.n_times - 1

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster, t = pdf["cluster"].to_numpy(), pdf["t"].to_numpy()
        if t.min() < 0 or t.max() >= end:
            raise ValueError(f"a transition starts outside of 0..{end - 1}")
        first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        place = np.cumsum(np.concatenate([[0], (cluster[1:] != cluster[:-1]).astype(np.int64)]))
        hist = np.zeros((len(first), end + 1, len(names)))
        hist[place, t + 1] = pdf[names].to_numpy(float)
        np.cumsum(hist, axis=1, out=hist)
        return _scanned(cluster[first], hist, grid.kappas(), grid, layout, scale, per_observation, best_only)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
            cluster = rows["cluster"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])) if len(rows) else np.zeros(0, int)
            # The last cluster may go on in the next batch.
            whole = (len(first) - 1) // CLUSTERS * CLUSTERS if len(first) else 0
            for i in range(0, whole, CLUSTERS):
                yield packed(rows.iloc[first[i]: first[i + CLUSTERS]])
            held = [rows.iloc[first[whole]:]] if len(first) else []
        for rows in held:
            if len(rows):
                cluster = rows["cluster"].to_numpy()
                first = np.append(np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])), len(rows))
                for i in range(0, len(first) - 1, CLUSTERS):
                    yield packed(rows.iloc[first[i]: first[min(i + CLUSTERS, len(first) - 1)]])

    kind = mom.schema["cluster"].dataType.simpleString()
    return (mom.select("cluster", "t", *names).repartition(spread_partitions(mom), "cluster").sortWithinPartitions("cluster")
            .mapInPandas(scan, f"cluster {kind}, kappa int, u int, stat double"))


def _chunks(kappas: Sequence[int], grid: ScanGrid, size: int = 20000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window lengths and splits as flat arrays, whole windows at a time."""
    ks, us, held = [], [], 0
    for k in kappas:
        u = np.asarray(grid.splits(k), dtype=np.int64)
        if len(u) == 0:
            continue
        ks.append(np.full(len(u), k, dtype=np.int64))
        us.append(u)
        held += len(u)
        if held >= size:
            yield np.concatenate(ks), np.concatenate(us)
            ks, us, held = [], [], 0
    if held:
        yield np.concatenate(ks), np.concatenate(us)


def split_statistics(
    trans: DataFrame,
    grid: ScanGrid,
    p: int = 1,
    assignment: DataFrame | None = None,
    lr_scale: float = 1.0,
    per_observation: bool = False,
    spread: bool = True,
    mom: DataFrame | None = None,
    best_only: bool = False,
) -> DataFrame:
    """(cluster, kappa, u, stat): log-likelihood ratio of every candidate split.

    With maximum-likelihood variances it is n/2 * ln(v0/v1), n counting rows
    times response variables. ``lr_scale=2`` gives the chi-square scale;
    ``per_observation`` divides by the number of rows; ``best_only`` keeps the
    largest statistic of each window, the smallest u on ties.
    """
    if mom is None:
        mom = time_moments(label(trans, assignment), p)
    return _score_grid(mom, grid, p, lr_scale, per_observation, best_only, spread)


def best_splits(trans: DataFrame, grid: ScanGrid, p: int = 1, assignment: DataFrame | None = None,
                **kw) -> DataFrame:
    """(cluster, kappa, u, stat): the best split of every window."""
    return split_statistics(trans, grid, p, assignment, best_only=True, **kw)


def best_split(stats: DataFrame) -> DataFrame:
    """The best split of every window from a table of all splits."""
    best = F.max(F.struct("stat", (-F.col("u")).alias("neg"))).alias("b")
    return stats.groupBy("cluster", "kappa").agg(best).select(
        "cluster", "kappa", (-F.col("b.neg")).alias("u"), F.col("b.stat").alias("stat"))


def first_rejection(best: DataFrame, limits: DataFrame, grid: ScanGrid) -> DataFrame:
    """(cluster, tau, kappa, stat, threshold).

    kappa is the shortest window whose statistic reaches its threshold; tau is
    the start of the window before it (of the first window if there is none),
    and 0 without a rejection. All windows are scored in one pass, so stopping
    early would save nothing.
    """
    return _reject(best.join(limits, "kappa"), grid)


def with_pvalues(best: DataFrame, sample: DataFrame) -> DataFrame:
    """Add ``pvalue``: the share of null draws of the same window above the statistic.

    A window's draws travel as one array, whose length is the number of draws.
    """
    draws = sample.groupBy("kappa").agg(F.collect_list("stat").alias("_draws"))
    return best.join(draws, "kappa").withColumn("pvalue", share_above("_draws", "stat")).drop("_draws")


def share_above(draws: str, stat: str) -> F.Column:
    """Share of the array's values above ``stat``."""
    return F.size(F.filter(draws, lambda x: x > F.col(stat))) / F.size(draws)


def dense_df(p: int) -> int:
    return (2 + 2 * p) * p


def detect_transition_change(
    trans: DataFrame,
    grid: ScanGrid,
    p: int = 1,
    assignment: DataFrame | None = None,
    limits: DataFrame | None = None,
    alpha: float = 0.01,
    draws: int = 10000,
    threshold: str = "bridge",
    lr_scale: float = 1.0,
    cache: nulls.NullCache | None = None,
    seed: int = 1,
    mom: DataFrame | None = None,
    many: bool = False,
) -> DataFrame:
    """Latest change of the transition regression per cluster.

    ``threshold``: ``bridge`` (default), ``chi2`` or ``permutation``; or pass a
    (kappa, threshold) table as ``limits``. ``many`` scores clusters in packs: right for
    thousands of small ones.
    """
    if mom is None:
        mom = time_moments(label(trans, assignment), p)
    best = scan_many(mom, grid, p, lr_scale) if many else best_splits(trans, grid, p, assignment, lr_scale=lr_scale, mom=mom)
    if limits is None and threshold == "permutation":
        perm = permutation_thresholds(mom, grid, p, draws, alpha, lr_scale, seed)
        seen = best.join(perm, ["cluster", "kappa"])
        return _reject(seen, grid)
    if limits is None:
        spark = mom.sparkSession
        ks = grid.kappas()
        counts = [max(len(grid.splits(k)), 1) for k in ks] if threshold == "chi2" else None
        kind = "bridge" if threshold == "bridge" else "chi2"
        if cache is not None:
            sample = cache.sample(ks, dense_df(p), draws, kind, counts, seed)
        else:
            sample = nulls.null_sample(spark, ks, dense_df(p), draws, kind, counts, seed)
        limits = nulls.thresholds(sample, alpha)
    return first_rejection(best, limits, grid)


def _reject(seen: DataFrame, grid: ScanGrid) -> DataFrame:
    hit = F.min(F.when(F.col("stat") >= F.col("threshold"), F.struct("kappa", "stat", "threshold")))
    before = F.greatest(F.col("h.kappa") - grid.step, F.lit(grid.kappa_min))
    return seen.groupBy("cluster").agg(hit.alias("h")).select(
        "cluster",
        F.when(F.col("h").isNull(), 0).otherwise(F.lit(grid.n_times - 1) - before).cast("int").alias("tau"),
        F.col("h.kappa").alias("kappa"), F.col("h.stat").alias("stat"), F.col("h.threshold").alias("threshold"),
    )


def detect_individually(trans: DataFrame, grid: ScanGrid, p: int = 1, **kw) -> DataFrame:
    """Every subject is its own cluster; the result's key is the subject."""
    own = trans.withColumn("cluster", F.col("subject"))
    mom = time_moments(own, p)
    return detect_transition_change(own, grid, p, mom=mom, many=True, **kw).withColumnRenamed("cluster", "subject")


def permutation_sample(mom: DataFrame, grid: ScanGrid, p: int, draws: int, lr_scale: float = 1.0,
                       seed: int = 1, block: int = 25) -> DataFrame:
    """(cluster, kappa, rep, stat): scan maximum after shuffling the window's steps.

    Whole steps move, so a shuffle reorders the sums per (cluster, t). A replicate draws one
    number per step; a window's steps are ordered by theirs, so one copy of the sums serves all
    windows of a block of replicates. Work is split by cluster and block.
    """
    layout = Moments(p)
    names, end = layout.names, grid.n_times - 1
    work = mom.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // block) - 1))).alias("block"))

    def shuffle(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        cluster, b = key[0], int(key[1])
        reps = min(block, draws - b * block)
        sums = np.zeros((end, len(names)))
        sums[pdf["t"].to_numpy()] = pdf[names].to_numpy(float)
        rng = np.random.Generator(np.random.Philox(key=[seed * 1_000_003, b]))
        # Drawn from the last step back: a window's order does not depend on the horizon.
        place = rng.random((end, reps)).T[:, ::-1]
        out = []
        for k in grid.kappas():
            u = np.asarray(grid.splits(k), dtype=int)
            if not len(u):
                continue
            window = sums[end - k:]
            total = window.sum(0)
            left = np.cumsum(window[np.argsort(place[:, end - k:], axis=1)], axis=1)[:, u - 1]
            obs = total[0] * p
            sse0 = batch_sse(layout, total)
            sse1 = batch_sse(layout, left) + batch_sse(layout, total - left)
            stat = 0.5 * lr_scale * obs * np.log(np.maximum(sse0 / obs, TINY) / np.maximum(sse1 / obs, TINY))
            out.append((np.full(reps, k), b * block + np.arange(reps), stat.max(axis=1)))
        kappa, rep, stat = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0),) * 3
        return pd.DataFrame({"cluster": cluster, "kappa": kappa.astype(np.int32), "rep": rep.astype(np.int64), "stat": stat})

    kind = mom.schema["cluster"].dataType.simpleString()
    keys = ["cluster", "block"]
    return work.repartition(spread_partitions(mom), *keys).groupBy(*keys).applyInPandas(
        shuffle, f"cluster {kind}, kappa int, rep bigint, stat double")


def permutation_thresholds(mom: DataFrame, grid: ScanGrid, p: int, draws: int, alpha: float,
                           lr_scale: float = 1.0, seed: int = 1) -> DataFrame:
    """(cluster, kappa, threshold)."""
    sample = permutation_sample(mom, grid, p, draws, lr_scale, seed)
    return sample.groupBy("cluster", "kappa").agg(F.percentile("stat", F.lit(1.0 - alpha)).alias("threshold"))


def cyclic_shift_statistics(trans: DataFrame, n_times: int, u: int, p: int = 1,
                            assignment: DataFrame | None = None) -> DataFrame:
    """(cluster, shift, stat): 2 x log-likelihood ratio at split u for every roll of time.

    After a roll by j, step t stands at position (t + j) mod (T-1).
    """
    layout = Moments(p)
    steps = n_times - 1
    mom = time_moments(label(trans, assignment), p)
    rolled = mom.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("shift"))
    left = (F.col("t") + F.col("shift")) % steps < u
    sums = rolled.groupBy("cluster", "shift").agg(
        *[F.sum(c).alias(c) for c in layout.names],
        *[F.sum(F.when(left, F.col(c)).otherwise(0.0)).alias(f"l_{c}") for c in layout.names],
    )
    if p == 1:
        full = {c: F.col(c) for c in layout.names}
        lhs = {c: F.col(f"l_{c}") for c in layout.names}
        rhs = {c: F.col(c) - F.col(f"l_{c}") for c in layout.names}
        rows = sums.select("cluster", "shift", F.col("m_n").alias("n"), action_sse(full).alias("sse0"),
                           (action_sse(lhs) + action_sse(rhs)).alias("sse1"))
    else:
        def solve(batches):
            for pdf in batches:
                tot = pdf[layout.names].to_numpy(float)
                lft = pdf[[f"l_{c}" for c in layout.names]].to_numpy(float)
                yield pd.DataFrame({
                    "cluster": pdf["cluster"], "shift": pdf["shift"], "n": tot[:, 0],
                    "sse0": batch_sse(layout, tot),
                    "sse1": batch_sse(layout, lft) + batch_sse(layout, tot - lft)})

        kind = mom.schema["cluster"].dataType.simpleString()
        rows = sums.mapInPandas(solve, f"cluster {kind}, shift int, n double, sse0 double, sse1 double")
    obs = F.col("n") * F.lit(float(p))
    return rows.select(
        "cluster", "shift",
        (obs * F.ln(F.greatest(F.col("sse0") / obs, F.lit(TINY)) / F.greatest(F.col("sse1") / obs, F.lit(TINY)))
         ).alias("stat"))


# --- changes of the mean and of the marginal distribution

def _level_prefix(panel: DataFrame, assignment: DataFrame | None, state: str) -> DataFrame:
    """(cluster, t, n, s, q) running count, sum and sum of squares, with cluster size."""
    rows = label(panel, assignment)
    per_t = rows.groupBy("cluster", "t").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(state).alias("s"),
        F.sum(F.col(state) * F.col(state)).alias("q"))
    run = Window.partitionBy("cluster").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("cluster")
    return per_t.select(
        "cluster", "t", F.max("n").over(every).alias("size"),
        *[F.sum(c).over(run).alias(c) for c in "nsq"],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in "nsq"],
    )


def _level_grid(pref: DataFrame, n_times: int, kappas: Sequence[int], eps: float) -> DataFrame:
    """Pair every row u with the windows whose trimmed range holds it."""
    top = int(n_times - eps * n_times) - 1
    ks = F.sequence(F.lit(int(kappas[0])), F.lit(int(kappas[-1])))
    return (
        pref.withColumnRenamed("t", "u").filter(F.col("u") <= top)
        .select("*", F.explode(ks).alias("kappa"))
        .filter(F.col("u") > (F.lit(n_times) - F.col("kappa") + F.lit(eps * n_times)).cast("int"))
    )


def _last_window(scored: DataFrame, n_times: int, eps: float, limit: F.Column, rule: str) -> DataFrame:
    """tau per cluster from (cluster, kappa, u, size, stat).

    ``as_coded``: the longest window decides. ``first``: the shortest window
    that rejects decides, and without a rejection tau is 0.
    """
    best = scored.groupBy("cluster", "kappa", "size").agg(
        F.max(F.struct("stat", (-F.col("u")).alias("neg"))).alias("b")
    ).select("cluster", "kappa", (-F.col("b.neg")).alias("u"), F.col("b.stat").alias("stat"), limit.alias("threshold"))
    start = (F.lit(n_times) - F.col("kappa") + F.lit(eps * n_times)).cast("int") + 1
    best = best.withColumn("tau", F.when(F.col("stat") < F.col("threshold"), start).otherwise(F.col("u")))
    row = F.struct("kappa", "tau", "stat", "threshold")
    if rule == "as_coded":
        pick = best.groupBy("cluster").agg(F.max(row).alias("r"))
        return pick.select("cluster", F.col("r.tau").cast("int").alias("tau"), "r.kappa", "r.stat", "r.threshold")
    pick = best.groupBy("cluster").agg(
        F.min(F.when(F.col("stat") >= F.col("threshold"), row)).alias("r"))
    return pick.select("cluster", F.coalesce(F.col("r.tau"), F.lit(0)).cast("int").alias("tau"),
                       "r.kappa", "r.stat", "r.threshold")


def detect_mean_change(panel: DataFrame, n_times: int, kappas: Sequence[int], eps: float = 0.1,
                       c1: float = 1.0, c2: float = 0.5, assignment: DataFrame | None = None,
                       state: str = "s1", n_subjects: int | None = None, rule: str = "as_coded") -> DataFrame:
    """Weighted CUSUM of forward minus backward means, per cluster.

    The panel must be dense (see ``fill_dense``): then the sum over subjects of
    their running means is the running mean of the sums over subjects.
    """
    pref = _level_prefix(panel, assignment, state)
    if n_subjects is None:
        n_subjects = panel.select("subject").distinct().count()
    t_all = float(n_times)
    fwd = F.col("s") / (F.col("u") + 1)
    bwd = (F.col("s_all") - F.col("s")) / (t_all - 1 - F.col("u"))
    weight = F.sqrt((t_all - F.col("u")) * (F.col("u") - t_all + F.col("kappa")) / (F.col("kappa") * F.col("kappa")))
    stat = weight * F.col("size") * F.abs(fwd - bwd)
    scored = _level_grid(pref, n_times, kappas, eps).select("cluster", "kappa", "u", "size", stat.alias("stat"))
    limit = F.lit(c1) * F.pow(F.col("kappa") * F.col("size"), F.lit(-c2)) * F.log10(F.lit(n_subjects * t_all))
    return _last_window(scored, n_times, eps, limit, rule)


def detect_marginal_change(panel: DataFrame, n_times: int, kappas: Sequence[int], eps: float = 0.1,
                           c1: float = 1.0, c2: float = 0.5, assignment: DataFrame | None = None,
                           state: str = "s1", n_subjects: int | None = None, rule: str = "as_coded",
                           variance: str = "mle") -> DataFrame:
    """Gaussian two-segment likelihood ratio of the state's level, per cluster.

    ``variance="as_coded"`` divides the two-segment sum of squares by the number
    of subjects instead of the number of values.
    """
    pref = _level_prefix(panel, assignment, state)
    if n_subjects is None:
        n_subjects = panel.select("subject").distinct().count()
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    n2, s2, q2 = F.col("n_all") - n, F.col("s_all") - s, F.col("q_all") - q
    sse1 = (q - s * s / n) + (q2 - s2 * s2 / n2)
    sse0 = F.col("q_all") - F.col("s_all") * F.col("s_all") / F.col("n_all")
    v0 = sse0 / F.col("n_all")
    if variance == "mle":
        gain = F.col("n_all") / 2 * F.ln(v0 / (sse1 / F.col("n_all")))
    else:
        gain = (F.col("n_all") / 2 * F.ln(v0 / (sse1 / F.col("size")))
                + F.col("n_all") / 2 - F.col("size") / 2)
    stat = gain / (F.col("kappa") * F.col("size"))
    scored = _level_grid(pref, n_times, kappas, eps).select("cluster", "kappa", "u", "size", stat.alias("stat"))
    limit = F.pow(F.lit(c1) * F.pow(F.col("kappa") * F.col("size"), F.lit(-c2))
                  * F.log10(F.lit(float(n_subjects * n_times))), F.lit(2.0))
    return _last_window(scored, n_times, eps, limit, rule)
