"""Segmentation jobs: group subjects by their dynamics.

A subject enters every iteration only through its sums of products, so the
panel is read once. An assignment is a function of the cluster coefficients
(K small matrices held by the driver); one aggregate per iteration scores all
subjects, counts the changes and sums the products of the next fit. Subject
rows are never shuffled inside the loop and no lineage grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.criteria import criterion
from panelwright.operators.moments import Moments, min_norm_solve, moments_by
from panelwright.session import materialize

# Errors of a batch are computed for so many (subject, cluster) pairs at a time.
PAIRS = 1 << 21


@dataclass
class Segmentation:
    """An assignment with its loss; ``coefs[k]`` is the (2+2p, p) matrix of cluster k."""

    assignment: DataFrame
    loss: float
    k: int
    iterations: int
    coefs: np.ndarray | None
    scored: DataFrame | None = None


def subject_moments(trans: DataFrame, p: int, tau: DataFrame | int | None = None) -> DataFrame:
    """(subject, sums) over the steps at or after the subject's change point.

    ``tau``: one number for all, or a (subject, tau) table.
    """
    if isinstance(tau, int):
        trans = trans.filter(F.col("t") >= tau)
    elif tau is not None:
        trans = trans.join(tau.select("subject", "tau"), "subject").filter("t >= tau")
    return moments_by(trans, ["subject"], p)


def hashed_labels(k: int, seed: int) -> F.Column:
    """A fixed pseudo-random start: the same label for a subject on every run."""
    return F.pmod(F.xxhash64("subject", F.lit(seed)), F.lit(k)).cast("int")


def _error(weights: np.ndarray, names: Sequence[str]) -> F.Column:
    terms = [f"{float(w)!r}D * {c}" for w, c in zip(weights, names) if w != 0.0]
    return F.expr(" + ".join(terms) if terms else "0.0D")


def error_columns(coefs: np.ndarray, p: int) -> list[F.Column]:
    """Residual sum of squares of a subject under every cluster's coefficients."""
    layout = Moments(p)
    return [_error(layout.sse_weights(c), layout.names) for c in coefs]


def _argmin(errors: F.Column) -> F.Column:
    return (F.array_position(errors, F.array_min(errors)) - 1).cast("int")


def weighted_fit(labelled: DataFrame, k: int, p: int) -> np.ndarray:
    """Coefficients per cluster, every subject weighted by 1 / its number of steps."""
    names = Moments(p).names
    rows = labelled.groupBy("cluster").agg(*[F.sum(F.col(c) / F.col("m_n")).alias(c) for c in names]).collect()
    m = np.zeros((k, len(names)))
    for r in rows:
        m[int(r["cluster"])] = [r[c] for c in names]
    return _fit(m, p)


def _fit(m: np.ndarray, p: int) -> np.ndarray:
    xx, xy, _ = Moments(p).design(m)
    return min_norm_solve(xx, xy)


class _Run:
    """State of one K between iterations: who labels a subject, and who does next."""

    def __init__(self, k: int, init: str | None, seed: int):
        self.k, self.init, self.seed = k, init, seed
        self.weights: np.ndarray | None = None
        self.overrides: dict = {}
        self.coefs: np.ndarray | None = None
        self.loss, self.iterations = 0.0, 0

    def frozen(self) -> tuple:
        return self.init, self.weights, dict(self.overrides)


def _nearest_cluster(m: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of smallest error, the first on ties, and that error for every row of sums."""
    size = max(1, PAIRS // len(weights))
    lab, err = np.zeros(len(m), dtype=int), np.zeros(len(m))
    for at in range(0, len(m), size):
        errs = m[at: at + size] @ weights.T
        best = np.argmin(errs, axis=1)
        lab[at: at + size], err[at: at + size] = best, errs[np.arange(len(best)), best]
    return lab, err


def _labels(pdf: pd.DataFrame, m: np.ndarray, k: int, state: tuple) -> tuple[np.ndarray, np.ndarray | None]:
    """Labels of a batch under a frozen state, and the error under the own label."""
    init, weights, overrides = state
    if weights is None:
        return pdf[init].to_numpy().astype(int), None
    lab, err = _nearest_cluster(m, weights)
    if overrides:
        moved = pdf["subject"].map(overrides)
        at = np.flatnonzero(moved.notna())
        lab[at] = moved.iloc[at].astype(int)
        err[at] = (m[at] * weights[lab[at]]).sum(1)
    return lab, err


def _label_sums(subj: DataFrame, states: dict[int, tuple], new: dict[int, np.ndarray] | None, p: int):
    """{k: {label: (n, changed, loss, weighted sums)}} in one pass for all K.

    Every task adds up its subjects and sends at most K rows per K; ``new`` are
    the weights to reassign with (none: sums under the current labels).
    """
    names = Moments(p).names
    q = len(names)
    cols = [f"v{i}" for i in range(3 + q)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {k: np.zeros((k, 3 + q)) for k in states}
        for pdf in batches:
            m = pdf[names].to_numpy(float)
            inv = 1.0 / m[:, :1]
            for k, state in states.items():
                old, _ = _labels(pdf, m, k, state)
                lab, loss = old, np.zeros(len(m))
                if new is not None:
                    lab, err = _nearest_cluster(m, new[k])
                    loss = err * inv[:, 0]
                part = np.column_stack([np.ones(len(m)), lab != old, loss, m * inv])
                np.add.at(acc[k], lab, part)
        rows = [(k, j, *acc[k][j]) for k in states for j in range(k) if acc[k][j, 0] > 0]
        yield pd.DataFrame(rows, columns=["k", "label", *cols])

    schema = "k int, label int, " + ", ".join(f"{c} double" for c in cols)
    rows = subj.mapInPandas(fold, schema).groupBy("k", "label").sum(*cols).collect()
    out: dict[int, dict] = {k: {} for k in states}
    for r in rows:
        v = np.array(r[2:], dtype=float)
        out[r["k"]][r["label"]] = (int(v[0]), int(v[1]), float(v[2]), v[3:])
    return out


def _assign(subj: DataFrame, k: int, state: tuple, p: int) -> DataFrame:
    """(subject, cluster, err, m_n) under a frozen state."""
    names = Moments(p).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = pdf[names].to_numpy(float)
            lab, err = _labels(pdf, m, k, state)
            yield pd.DataFrame({"subject": pdf["subject"], "cluster": lab.astype(np.int32),
                                "err": np.zeros(len(m)) if err is None else err, "m_n": m[:, 0]})

    kind = subj.schema["subject"].dataType.simpleString()
    return subj.mapInPandas(run, f"subject {kind}, cluster int, err double, m_n double")


def _nearest(subj: DataFrame, k: int, target: int, state: tuple, new: np.ndarray, p: int, n: int) -> list:
    """The n subjects with the smallest error under cluster ``target``."""
    names = Moments(p).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = pdf[names].to_numpy(float)
            old, _ = _labels(pdf, m, k, state)
            errs = m @ new.T
            best = np.lexsort((pdf["subject"].to_numpy(), errs[:, target]))[:n]
            yield pd.DataFrame({"subject": pdf["subject"].to_numpy()[best], "old": old[best].astype(np.int32),
                                "err": errs[best, target], "errs": list(errs[best]), "m": list(m[best])})

    kind = subj.schema["subject"].dataType.simpleString()
    near = subj.mapInPandas(run, f"subject {kind}, old int, err double, errs array<double>, m array<double>")
    return near.orderBy("err", "subject").limit(n).collect()


def _repair(subj: DataFrame, run: _Run, new: np.ndarray, got: dict, p: int) -> tuple[dict, float, int]:
    """Give every empty cluster the subject that fits it best.

    A subject already moved, or alone in its cluster, is passed over. At most
    2K subjects can be passed over, so the 2K+1 best candidates are enough.
    """
    overrides: dict = {}
    shift, moved = 0.0, 0
    counts = {j: v[0] for j, v in got.items()}
    sums = {j: v[3] for j, v in got.items()}
    for j in range(run.k):
        if counts.get(j, 0) > 0:
            continue
        for row in _nearest(subj, run.k, j, run.frozen(), new, p, 2 * run.k + 1):
            held = int(np.argmin(row["errs"]))
            if row["subject"] in overrides or counts.get(held, 0) <= 1:
                continue
            n = row["m"][0]
            shift += row["errs"][held] / n - row["errs"][j] / n
            moved += int(row["old"] != j) - int(row["old"] != held)
            v = np.array(row["m"]) / n
            sums[held] = sums[held] - v
            sums[j] = v
            counts[held] -= 1
            counts[j] = 1
            overrides[row["subject"]] = j
            break
    for j, v in sums.items():
        got[j] = (counts[j], 0, 0.0, v)
    return overrides, shift, moved


def cluster_by_dynamics_grid(
    subj: DataFrame,
    ks: Sequence[int],
    p: int,
    init: dict[int, F.Column] | None = None,
    max_iter: int = 50,
    seed: int = 1,
) -> dict[int, Segmentation]:
    """Mixture of transition regressions (hard EM) for every K of a list at once.

    ``subj`` is a materialised (subject, sums) table. ``init`` gives the start
    label per K as a column of ``subj``; the default is a hash of the subject.
    All K that have not converged share one pass per iteration. The scores are
    a matrix product per batch of subjects, in blocks of ``PAIRS``. The driver holds
    (2 + 2p) p numbers for each of the K clusters.
    """
    q = len(Moments(p).names)
    begin = {f"_start{k}": (init or {}).get(k, hashed_labels(k, seed)) for k in ks}
    subj = subj.withColumns(begin)
    runs = {k: _Run(k, f"_start{k}", seed) for k in ks}

    def fitted(k: int, got: dict) -> np.ndarray:
        m = np.zeros((k, q))
        for j, v in got.items():
            m[j] = v[3]
        return _fit(m, p)

    active = dict(runs)
    got = _label_sums(subj, {k: r.frozen() for k, r in active.items()}, None, p)
    step = 0
    while active:
        step += 1
        new = {}
        for k, run in active.items():
            run.coefs = fitted(k, got[k])
            new[k] = np.array([Moments(p).sse_weights(c) for c in run.coefs])
        got = _label_sums(subj, {k: r.frozen() for k, r in active.items()}, new, p)
        for k, run in list(active.items()):
            mine = got[k]
            changed = sum(v[1] for v in mine.values())
            run.loss = -sum(v[2] for v in mine.values())
            run.iterations = step
            overrides: dict = {}
            if len(mine) < k:
                overrides, shift, moved = _repair(subj, run, new[k], mine, p)
                run.loss += shift
                changed += moved
            run.weights, run.overrides = new[k], overrides
            if changed == 0 or step >= max_iter:
                del active[k]
    out = {}
    for k, run in runs.items():
        scored = _assign(subj, k, run.frozen(), p)
        out[k] = Segmentation(scored.select("subject", "cluster"), run.loss, k, run.iterations, run.coefs, scored)
    return out


def cluster_by_dynamics(subj: DataFrame, k: int, p: int, init: F.Column | None = None,
                        max_iter: int = 50, seed: int = 1) -> Segmentation:
    """The same for one K."""
    start = None if init is None else {k: init}
    return cluster_by_dynamics_grid(subj, [k], p, start, max_iter, seed)[k]


def one_step(subj: DataFrame, k: int, p: int, label: F.Column) -> DataFrame:
    """(subject, cluster, err): one fit and one reassignment from given labels."""
    coefs = weighted_fit(subj.withColumn("cluster", label), k, p)
    errs = F.array(*error_columns(coefs, p))
    return subj.select("subject", errs.alias("e")).select(
        "subject", _argmin(F.col("e")).alias("cluster"), F.array_min("e").alias("err"))


def density_loss(subj: DataFrame, coefs: np.ndarray, p: int) -> DataFrame:
    """Sum of normal densities of all subject-by-cluster errors, scale = their root mean square."""
    long = subj.select(F.explode(F.array(*error_columns(coefs, p))).alias("e"))
    scale = long.agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).scalar()
    z = F.col("e") / scale
    return long.agg(F.sum(F.exp(-z * z / 2) / (scale * F.lit(float(np.sqrt(2 * np.pi))))).alias("loss"))


def error_weights(labelled: DataFrame, p: int) -> DataFrame:
    """(cluster, w): the weights that turn a subject's sums into its error under the cluster's fit.

    The fits are solved where the cluster's sums are, so any number of clusters will do.
    """
    layout = Moments(p)
    sums = labelled.groupBy("cluster").agg(*[F.sum(F.col(c) / F.col("m_n")).alias(c) for c in layout.names])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coefs = _fit(pdf[layout.names].to_numpy(float), p)
            yield pd.DataFrame({"cluster": pdf["cluster"], "w": [layout.sse_weights(c) for c in coefs]})

    kind = labelled.schema["cluster"].dataType.simpleString()
    return sums.mapInPandas(solve, f"cluster {kind}, w array<double>")


def cluster_quality(subj: DataFrame, assignment: DataFrame, p: int) -> DataFrame:
    """(cluster, n_subjects, loss_normalized, loss_unnormalized) of the own-cluster fit.

    Normalised: minus the sum over subjects of SSE / steps. The overall quality
    is the sum of the normalised column. ``subj`` is read twice: materialise it first.
    """
    names = Moments(p).names
    labelled = subj.join(assignment, "subject")
    terms = [F.col(c) * F.get("w", F.lit(i)) for i, c in enumerate(names)]
    own = F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))
    rows = labelled.join(error_weights(labelled, p), "cluster")
    return rows.select("cluster", own.alias("e"), "m_n").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        (-F.sum(F.col("e") / F.col("m_n"))).alias("loss_normalized"),
        (-F.sum("e")).alias("loss_unnormalized"))


def select_k(
    subj: DataFrame,
    ks: Sequence[int],
    p: int,
    n_times: int,
    seg_len: tuple[float, float],
    penalty: str = "sqrtN",
    c: float = 2.0,
    dynamic_t: bool = False,
    max_iter: int = 50,
    seed: int = 1,
    init: dict[int, F.Column] | None = None,
) -> tuple[Segmentation, DataFrame]:
    """The K of largest criterion (first on ties) and the table of all K.

    ``seg_len`` is (sum, mean) over subjects of T - 1 - tau.
    """
    found = cluster_by_dynamics_grid(subj, ks, p, init, max_iter, seed)
    n = subj.count()
    table = criterion_table(subj, [(i, k, found[k].loss, n) for i, k in enumerate(ks)], n_times, seg_len,
                            penalty, c, dynamic_t)
    best = table.orderBy(F.col("ic").desc(), "pos").first()
    return found[best["k"]], table


def criterion_table(df: DataFrame, rows, n_times: int, seg_len: tuple[float, float], penalty: str,
                    c: float, dynamic_t: bool = False) -> DataFrame:
    """(pos, k, loss, n, ic): the criterion of a list of fits."""
    spark = df.sparkSession
    base = spark.createDataFrame([(int(i), int(k), float(loss), int(n)) for i, k, loss, n in rows],
                                 "pos int, k int, loss double, n bigint")
    facts = base.withColumns({
        "t": F.lit(float(n_times)), "c": F.lit(float(c)),
        "sum_len": F.lit(float(seg_len[0])), "mean_len": F.lit(float(seg_len[1]))})
    return facts.select("pos", "k", "loss", "n", criterion(penalty, dynamic_t).alias("ic"))


def segment_lengths(tau: DataFrame, n_times: int) -> tuple[float, float]:
    """(sum, mean) over subjects of T - 1 - tau from a (subject, tau) table."""
    row = tau.agg(F.sum(n_times - 1 - F.col("tau")).alias("s"), F.avg(n_times - 1 - F.col("tau")).alias("m")).first()
    return float(row["s"]), float(row["m"])


# --- clustering without a regression

def subject_levels(panel: DataFrame, states: Sequence[str], tau: DataFrame | int, shift: int = 0,
                   last: int | None = None) -> DataFrame:
    """(subject, n, s, q): count, sum and sum of squares over steps t >= tau + shift and all states."""
    if isinstance(tau, int):
        rows = panel.filter(F.col("t") >= tau + shift)
    else:
        rows = panel.join(tau.select("subject", "tau"), "subject").filter(F.col("t") >= F.col("tau") + shift)
    if last is not None:
        rows = rows.filter(F.col("t") <= last)
    total, square = F.lit(0.0), F.lit(0.0)
    for c in states:
        total, square = total + F.col(c), square + F.col(c) * F.col(c)
    return rows.groupBy("subject").agg(
        (F.count(F.lit(1)) * len(states)).cast("double").alias("n"), F.sum(total).alias("s"), F.sum(square).alias("q"))


def cluster_by_mean(levels: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k-means on the subject mean after its change point."""
    rows = VectorAssembler(inputCols=["mean"], outputCol="features").transform(
        levels.select("subject", (F.col("s") / F.col("n")).alias("mean")))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("subject", "mean", "cluster")


def marginal_step(levels: DataFrame, label: F.Column, k: int) -> tuple[F.Column, list, bool]:
    """Cluster moments under ``label`` and the label column of the next step."""
    rows = levels.groupBy(label.alias("g")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    errs = [F.lit(float("inf"))] * k
    for r in rows:
        mean = r["s"] / r["n"]
        var = max(r["q"] / r["n"] - mean * mean, np.finfo(float).tiny)
        dist = F.col("q") - F.lit(2.0 * mean) * F.col("s") + F.lit(mean * mean) * F.col("n")
        errs[int(r["g"])] = dist / F.lit(var)
    return _argmin(F.array(*errs)), rows, len(rows) < k


def cluster_by_marginal(levels: DataFrame, k: int, init: F.Column | None = None, max_iter: int = 50,
                        seed: int = 1) -> DataFrame:
    """Reassign subjects by scaled distance to the cluster mean until nothing moves."""
    label = hashed_labels(k, seed) if init is None else init
    for _ in range(max_iter):
        nxt, _, _ = marginal_step(levels, label, k)
        moved = levels.filter(label != nxt).limit(1).count()
        label = nxt
        if not moved:
            break
    return levels.select("subject", label.alias("cluster"))


# --- contrasts between (cluster, before/after) blocks

def block_contrasts(trans: DataFrame, labels: DataFrame, p: int, reference: tuple[int, int] = (0, 0)) -> DataFrame:
    """(cluster, after, term, response, coef, contrast): one regression per block.

    ``labels`` holds (subject, cluster, tau). The contrast is the block's
    coefficient less the reference block's, as fitted to the residuals of the
    reference model.
    """
    rows = trans.join(labels, "subject").withColumn("after", (F.col("t") >= F.col("tau")).cast("int"))
    layout = Moments(p)
    blocks = moments_by(rows, ["cluster", "after"], p).collect()
    m = np.array([[r[c] for c in layout.names] for r in blocks])
    xx, xy, _ = layout.design(m)
    coef = min_norm_solve(xx, xy)
    base = next(i for i, r in enumerate(blocks) if (r["cluster"], r["after"]) == reference)
    terms = ["1", "a"] + [f"s{i + 1}" for i in range(p)] + [f"a:s{i + 1}" for i in range(p)]
    out = []
    for i, r in enumerate(blocks):
        diff = min_norm_solve(xx[i], xy[i] - xx[i] @ coef[base])
        for j in range(p):
            for d, name in enumerate(terms):
                out.append((r["cluster"], r["after"], name, f"y{j + 1}", float(coef[i, d, j]), float(diff[d, j])))
    return trans.sparkSession.createDataFrame(
        out, "cluster int, after int, term string, response string, coef double, contrast double")


def prepared(trans: DataFrame, p: int, tau: DataFrame | int | None = None) -> DataFrame:
    """Subject sums written once to the shared folder, ready for the loops above."""
    return materialize(subject_moments(trans, p, tau), "subject-moments")
