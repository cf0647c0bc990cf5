"""Alternating estimation: change points given clusters, clusters given change points.

The loop state is small: a (subject, cluster, tau) table in the shared folder
and one change point per cluster. Transitions are held partitioned by subject,
so attaching new labels does not shuffle them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.grid import ScanGrid
from panelwright.operators.summary import adjusted_rand
from panelwright.operators.transitions import fill_dense
from panelwright.plans import changepoint as cp
from panelwright.plans import nulls, segment
from panelwright.session import materialize, run_path

RUN_LOG = "iter int, stage string, k int, loss double"


@dataclass
class Estimate:
    """Result of one alternating run.

    ``result`` has one row per subject: (subject, cluster, tau).
    """

    result: DataFrame
    k: int
    loss: float
    ic: float
    iter_num: int
    loss_list: list[float] = field(default_factory=list)
    k_path: list[int] = field(default_factory=list)

    def run_log(self) -> DataFrame:
        rows = [(i, "cluster", k, float(loss)) for i, (k, loss) in enumerate(zip(self.k_path, self.loss_list))]
        return self.result.sparkSession.createDataFrame(rows, RUN_LOG)


class PanelSegmenter:
    """Front door: ``PanelSegmenter(...).fit(transitions)``.

    ``k`` is a number of clusters, or a list to choose from in every round.
    ``init`` is ``changepoints`` (cluster by given change points first) or
    ``clusters``. ``detector`` and ``clusterer`` replace the built-in steps:
    ``detector(trans, assignment, grid) -> (cluster, tau)`` and
    ``clusterer(trans, tau, k, start) -> Segmentation``.
    """

    def __init__(
        self,
        n_times: int,
        p: int = 1,
        k: int | Sequence[int] = 2,
        init: str = "changepoints",
        example: str = "cdist",
        kappa_min: int | None = None,
        kappa_max: int | None = None,
        kappa_interval: int = 1,
        epsilon: float = 0.1,
        alpha: float = 0.01,
        df: int | None = None,
        max_iter: int = 1,
        max_iter_gmr: int = 100,
        draws: int = 50000,
        threshold: str = "bridge",
        penalty: str = "sqrtN",
        c: float = 2.0,
        dynamic_t: bool = False,
        c1: float = 1.0,
        c2: float = 0.5,
        seed: int = 1,
        early_stopping: bool = True,
        warm_start: bool = True,
        only_changepoints: bool = False,
        only_clusters: bool = False,
        limits: DataFrame | None = None,
        detector: Callable | None = None,
        clusterer: Callable | None = None,
    ):
        if example not in ("cdist", "mean", "marginal"):
            raise ValueError(f"unknown example {example}")
        self.grid = ScanGrid(n_times, kappa_min, kappa_max, kappa_interval, epsilon)
        self.n_times, self.p, self.k, self.init, self.example = n_times, p, k, init, example
        self.alpha, self.df = alpha, df or cp.dense_df(p)
        self.max_iter, self.max_iter_gmr = max_iter, max_iter_gmr
        self.draws, self.threshold = draws, threshold
        self.penalty, self.c, self.dynamic_t = penalty, c, dynamic_t
        self.c1, self.c2 = c1, c2
        self.seed, self.early_stopping, self.warm_start = seed, early_stopping, warm_start
        self.only_changepoints, self.only_clusters = only_changepoints, only_clusters
        self.limits, self.detector, self.clusterer = limits, detector, clusterer

    # steps

    def _limits(self, spark) -> DataFrame | None:
        if self.limits is None and self.threshold in ("bridge", "chi2") and self.example == "cdist":
            ks = self.grid.kappas()
            counts = [max(len(self.grid.splits(k)), 1) for k in ks] if self.threshold == "chi2" else None
            sample = nulls.null_sample(spark, ks, self.df, self.draws, self.threshold, counts, self.seed)
            # One row per window length, drawn once per fit.
            self.limits = materialize(nulls.thresholds(sample, self.alpha), "limits")
        return self.limits

    def _detect(self, trans: DataFrame, assignment: DataFrame) -> DataFrame:
        """(cluster, tau)."""
        if self.detector is not None:
            return self.detector(trans, assignment, self.grid)
        if self.example == "cdist":
            return cp.detect_transition_change(
                trans, self.grid, self.p, assignment, limits=self._limits(trans.sparkSession), alpha=self.alpha,
                draws=self.draws, threshold=self.threshold, seed=self.seed)
        run = cp.detect_mean_change if self.example == "mean" else cp.detect_marginal_change
        # These scans go one window further than the regression's, to n_times - 1.
        bounds = (self.grid.kappa_min, min(self.grid.kappa_max, self.n_times) - 1)
        states = {f"s{i + 1}": 0.0 for i in range(self.p)}
        return run(fill_dense(self._levels(trans), self.n_times, states), self.n_times, bounds, self.grid.eps, self.c1, self.c2, assignment)

    def _levels(self, trans: DataFrame) -> DataFrame:
        """(subject, t, s1..sp): the states of all time points that a transition starts from or leads to."""
        states = [f"s{i + 1}" for i in range(self.p)]
        ends = F.array(
            F.struct("t", *states),
            F.struct((F.col("t") + 1).alias("t"), *[F.col(f"y{i + 1}").alias(c) for i, c in enumerate(states)]))
        return trans.select("subject", F.inline(ends)).groupBy("subject", "t").agg(
            *[F.any_value(c).alias(c) for c in states])

    def _cluster(self, trans: DataFrame, tau: DataFrame | int, start: DataFrame | None):
        """A Segmentation of the subjects on the steps at or after their tau."""
        if self.clusterer is not None:
            return self.clusterer(trans, tau, self.k, start)
        states = [f"s{i + 1}" for i in range(self.p)]
        if self.example != "cdist":
            if not isinstance(self.k, int):
                raise ValueError("clustering by means or marginals needs one number of clusters, not a list")
            lev = segment.subject_levels(self._levels(trans), states, tau)
            labels = segment.cluster_by_mean(lev, self.k, 0).select("subject", "cluster")
            return segment.Segmentation(materialize(labels, "labels"), 0.0, self.k, 1, None)
        subj = segment.subject_moments(trans, self.p, tau)
        if isinstance(self.k, int):
            init = None
            if start is not None and self.warm_start:
                subj = subj.join(start.select("subject", F.col("cluster").alias("start")), "subject")
                init = F.col("start")
            subj = materialize(subj, "subject-moments")
            return segment.cluster_by_dynamics(subj, self.k, self.p, init, self.max_iter_gmr, self.seed)
        subj = materialize(subj, "subject-moments")
        if isinstance(tau, int):
            lens = (float(subj.count() * (self.n_times - 1 - tau)), float(self.n_times - 1 - tau))
        else:
            lens = segment.segment_lengths(tau, self.n_times)
        best, _ = segment.select_k(subj, list(self.k), self.p, self.n_times, lens, self.penalty, self.c,
                                   self.dynamic_t, self.max_iter_gmr, self.seed)
        return best

    def _state(self, assignment: DataFrame, taus: DataFrame) -> DataFrame:
        """(subject, cluster, tau), written once per round."""
        out = assignment.join(taus.select("cluster", "tau"), "cluster")
        return materialize(out.select("subject", "cluster", "tau"), "labels")

    def _ic(self, state: DataFrame, loss: float, k: int) -> float:
        lens = segment.segment_lengths(state, self.n_times)
        n = state.count()
        return segment.criterion_table(state, [(0, k, loss, n)], self.n_times, lens, self.penalty, self.c,
                                       self.dynamic_t).first()["ic"]

    @staticmethod
    def _moved(a: DataFrame, b: DataFrame) -> bool:
        j = a.select("subject", F.col("tau").alias("x")).join(b.select("subject", F.col("tau").alias("y")), "subject")
        return j.filter("x <> y").limit(1).count() > 0

    # loops

    def fit(self, trans: DataFrame, changepoints: DataFrame | None = None,
            assignment: DataFrame | None = None, prepared: bool = False) -> Estimate:
        """``changepoints``: (subject, tau); ``assignment``: (subject, cluster).

        ``prepared`` says that ``trans`` comes from :func:`held`.
        """
        if not prepared:
            with held(trans) as rows:
                return self.fit(rows, changepoints, assignment, prepared=True)
        if self.init == "changepoints":
            return self.detect_and_segment(trans, changepoints, assignment)
        return self.segment_and_detect(trans, assignment)

    def segment_and_detect(self, trans: DataFrame, assignment: DataFrame | None = None) -> Estimate:
        """Clusters first. Stops when the change points settle, or the loss does."""
        if assignment is None:
            first = self._cluster(trans, self.n_times - self.grid.kappa_min - 1, None)
            assignment, loss, k = first.assignment, first.loss, first.k
        else:
            loss = 0.0
            k = assignment.select("cluster").distinct().count()
        losses, k_path = [loss], [k]
        best, state, before, m = float("inf"), None, None, 0
        for m in range(self.max_iter):
            state = self._state(assignment, self._detect(trans, assignment))
            if (m != 0 and not self._moved(state, before)) or m == self.max_iter - 1:
                break
            if self.early_stopping:
                if abs(losses[-1] - best) < 1e-5:
                    # The round that stops early doesn't count.
                    loss, m = losses[-2], max(m - 1, 0)
                    break
                best = min(best, losses[-1])
            if not self.only_changepoints:
                found = self._cluster(trans, state, state)
                assignment, loss, k = found.assignment, found.loss, found.k
            k_path.append(k)
            losses.append(loss)
            before = state
        return Estimate(state, k_path[-1], loss, self._ic(state, loss, k_path[-1]), m, losses, k_path)

    def detect_and_segment(self, trans: DataFrame, changepoints: DataFrame | None = None,
                           assignment: DataFrame | None = None) -> Estimate:
        """Clusters under given change points, then change points, until both settle."""
        subjects = trans.select("subject").distinct()
        if changepoints is None:
            changepoints = subjects.withColumn("tau", F.lit(self.n_times - self.grid.kappa_min - 1))
        before = materialize(changepoints.select("subject", "tau"), "labels")
        start, losses, k_path = assignment, [], []
        previous, state, loss, m, k = None, None, 0.0, 0, 0
        for m in range(self.max_iter):
            found = self._cluster(trans, before, start)
            loss, k = found.loss, found.k
            if self.only_clusters:
                state = materialize(found.assignment.join(before, "subject"), "labels")
            else:
                state = self._state(found.assignment, self._detect(trans, found.assignment))
            subj = materialize(segment.subject_moments(trans, self.p, state), "subject-moments")
            quality = segment.cluster_quality(subj, state.select("subject", "cluster"), self.p)
            losses.append(quality.agg(F.sum("loss_normalized")).first()[0])
            same_tau = not self._moved(state, before)
            same_labels = previous is not None and adjusted_rand(previous, state).first()["ari"] == 1.0
            settled = same_tau and same_labels
            if settled or m == self.max_iter - 1:
                if not settled:
                    loss = losses[-1]
                k_path.append(k)
                break
            if self.early_stopping and len(losses) > 1 and losses[-1] <= losses[-2]:
                loss, state, k = losses[-2], previous, k_path[-1]
                break
            before, previous, start = state, state, state
            k_path.append(k)
        used = state.select("cluster").distinct().count()
        return Estimate(state, used, loss, self._ic(state, loss, used), m, losses, k_path)


@contextmanager
def held(trans: DataFrame) -> Iterator[DataFrame]:
    """Transitions written once and kept partitioned by subject while a run lasts."""
    rows = materialize(trans, "transitions").repartition("subject").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _tune(ks: Sequence[int], rows: DataFrame, init_labels: dict[int, DataFrame], changepoints: DataFrame | None,
          settings: dict) -> tuple[Estimate, DataFrame]:
    if "limits" not in settings:
        # The limits do not depend on K: drawn once for all runs.
        settings["limits"] = PanelSegmenter(k=1, **settings)._limits(rows.sparkSession)
    runs = {k: PanelSegmenter(k=k, **settings).fit(rows, changepoints, init_labels.get(k), prepared=True) for k in ks}
    table = rows.sparkSession.createDataFrame(
        [(i, k, r.k, float(r.loss), float(r.ic)) for i, (k, r) in enumerate(runs.items())],
        "pos int, k int, k_used int, loss double, ic double")
    best = max(ks, key=lambda k: runs[k].ic)
    return runs[best], table


def fit_tune_k(ks: Sequence[int], trans: DataFrame, init_labels: dict[int, DataFrame] | None = None,
               changepoints: DataFrame | None = None, **settings) -> tuple[Estimate, DataFrame]:
    """One full run per K; the largest criterion wins, the first on ties."""
    with held(trans) as rows:
        return _tune(ks, rows, init_labels or {}, changepoints, dict(settings))


def fit_tune_k_each_iter(ks: Sequence[int], trans: DataFrame, rounds: int = 1,
                         changepoints: DataFrame | None = None, **settings) -> tuple[Estimate, DataFrame]:
    """One iteration for every K per round; the change points of the best K start
    the next round, labels are kept per K."""
    labels: dict[int, DataFrame] = {}
    log, best = [], None
    settings = {**settings, "max_iter": 1}
    with held(trans) as rows:
        for i in range(rounds):
            if "limits" not in settings:
                settings["limits"] = PanelSegmenter(k=1, **settings)._limits(rows.sparkSession)
            runs = {k: PanelSegmenter(k=k, **settings).fit(rows, changepoints, labels.get(k), prepared=True) for k in ks}
            chosen = max(ks, key=lambda k: runs[k].ic)
            log += [(i, k, float(r.loss), float(r.ic), k == chosen) for k, r in runs.items()]
            labels = {k: r.result.select("subject", "cluster") for k, r in runs.items()}
            best, changepoints = runs[chosen], runs[chosen].result.select("subject", "tau")
    return best, trans.sparkSession.createDataFrame(
        log, "iter int, k int, loss double, ic double, chosen boolean")


# Names of the estimation methods and what each one fixes.
PRESETS = ("overall", "only_clusters", "only_cp", "proposed", "oracle", "cluster_atend", "cp_indi")


def run_method(method: str, trans: DataFrame, n_times: int, ks: Sequence[int] = (1, 2, 3, 4),
               truth: DataFrame | None = None, **settings) -> DataFrame:
    """(subject, cluster, tau) by method name.

    ``overall``: one cluster, no change. ``only_clusters``: clusters on all
    steps. ``only_cp``: one cluster, its change point. ``proposed``: both.
    ``oracle``: the given (subject, cluster, tau). ``cluster_atend``: clusters
    on the last step. ``cp_indi``: a change point per subject.
    """
    subjects = trans.select("subject").distinct()
    zero = subjects.select("subject", F.lit(0).alias("cluster"))
    if method == "overall":
        return zero.withColumn("tau", F.lit(0))
    if method == "oracle":
        return truth.select("subject", "cluster", "tau")
    if method in ("only_clusters", "cluster_atend"):
        at = 0 if method == "only_clusters" else n_times - 2
        seg = PanelSegmenter(n_times, k=list(ks), init="changepoints", only_clusters=True, max_iter=1, **settings)
        return seg.fit(trans, subjects.withColumn("tau", F.lit(at))).result
    if method == "only_cp":
        seg = PanelSegmenter(n_times, k=1, init="clusters", only_changepoints=True, max_iter=1, **settings)
        return seg.fit(trans, assignment=zero).result
    if method == "cp_indi":
        seg = PanelSegmenter(n_times, k=1, **settings)
        found = cp.detect_individually(trans, seg.grid, seg.p, limits=seg._limits(trans.sparkSession))
        return found.select("subject", F.col("subject").alias("cluster"), "tau")
    if method == "proposed":
        rounds = settings.pop("max_iter", 10)
        return PanelSegmenter(n_times, k=list(ks), init="clusters", max_iter=rounds, **settings).fit(trans).result
    raise ValueError(f"unknown method {method}")


def test_period_labels(kind: str, trans: DataFrame, n_times: int, own: DataFrame, t_train: int,
                       proposed: DataFrame | None = None, ks: Sequence[int] = (1, 2, 3, 4), **settings) -> DataFrame:
    """(subject, cluster) used for scoring.

    ``test_set_only``: clusters on the test steps. ``after_cp``: on all steps
    after the method's own change points. ``after_proposed_cp``: after the
    given ones. ``proposed_g_index`` and ``g_index``: labels as they are.
    """
    if kind == "g_index":
        return own.select("subject", "cluster")
    if kind == "proposed_g_index":
        return proposed.select("subject", "cluster")
    seg = PanelSegmenter(n_times, k=list(ks), init="changepoints", only_clusters=True, max_iter=1, **settings)
    if kind == "test_set_only":
        rows = trans.filter(F.col("t") >= t_train)
        return seg.fit(rows, trans.select("subject").distinct().withColumn("tau", F.lit(t_train))).result.select(
            "subject", "cluster")
    source = own if kind == "after_cp" else proposed
    if kind not in ("after_cp", "after_proposed_cp"):
        raise ValueError(f"unknown label source {kind}")
    return seg.fit(trans, source.select("subject", "tau")).result.select("subject", "cluster")


def write_estimate(est: Estimate, path: str, method: str, seed: int) -> None:
    """One partition per (method, seed): labels, change points, loss, rounds and K path."""
    out = est.result.select(
        "*", F.lit(est.loss).alias("loss"), F.lit(est.iter_num).alias("iter_num"),
        F.array(*[F.lit(k) for k in est.k_path]).alias("k_path"),
        F.lit(method).alias("method"), F.lit(seed).alias("seed"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("method", "seed").parquet(path))


def estimate_path(spark) -> str:
    return run_path(spark, "estimates")
