"""Regression trees as Q functions, grown for all clusters, folds and settings at once.

States are cut into bins once; a tree splits between bins, so rows with equal bins
are alike to every tree and are summed to one *cell* first. Trees grow level by
level: a pass over the cells adds up count and target per (model, action, node,
feature, bin), a shuffle merges the tasks' histograms, and the best split of each node is
read off them. Only the smaller child of a split is counted, its sibling is the parent
less the child. A row enters the histograms of every model that it trains in the same
pass, so folds and settings make no copies of rows. Targets are computed in the pass, from
the last round's trees.

With at most ``bins`` distinct values a state has a bin for each, and the trees are those
of an exact search. Rows with a null or NaN state or reward are left out. An action
without a row in a group has no tree; its value is null and it is never the best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.ranking import cumulative_counts
from panelwright.plans.policy import ACTIONS, _width, initial_values, pair_labels, with_td_error
from panelwright.session import materialize

BINS = 64
#: Bytes of histograms that a task and the driver hold; more models are grown block by block.
HELD = 1 << 27
_TREE_SCHEMA = "model int, cluster int, action int, node int, feature int, threshold double, value double"
# Share of a node's sum of squares that is rounding: a split must gain more.
_LEAST_GAIN = 1e-10


@dataclass(frozen=True)
class Spec:
    """One model: the rows of ``cluster`` but for those of the fold ``left_out``."""

    cluster: int
    left_out: int = -1
    max_depth: int = 3
    min_leaf: int = 40


# --- bins and cells

@dataclass(frozen=True)
class Bins:
    """Smallest and largest value of each bin of a feature, and the edges midway between the bins."""

    low: np.ndarray
    high: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, ends: Sequence[tuple[float, float]]) -> Bins:
        low, high = (np.array([e[i] for e in sorted(ends)], float) for i in (0, 1))
        return cls(low, high, (high[:-1] + low[1:]) / 2)

    @classmethod
    def between(cls, edges: Sequence[float]) -> Bins:
        """Bins of which the edges alone are known."""
        edges = np.array(sorted(edges), float)
        return cls(np.append(edges[:1], edges), np.append(edges, edges[-1:]), edges)

    def code(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value; one that equals an edge belongs below it."""
        return np.searchsorted(self.edges, values, "left")

    def cut(self, left: int, right: int) -> int:
        """The last bin on the left of the place midway between two bins."""
        place = (self.high[left] + self.low[right]) / 2
        return max(left, min(int(np.searchsorted(self.high, place, "right")), right) - 1)


def bins_of(rows: DataFrame, bins: int = BINS) -> list[Bins]:
    """Bins of each feature, from the values of x0, x1, ... and of z0, z1, ... together.

    A bin holds the values with the same floor(bins * values below / values), or a single
    value where there are no more than ``bins`` of them.
    """
    out = []
    for i in range(_width(rows)):
        both = rows.select(F.explode(F.array(f"x{i}", f"z{i}")).alias("v")).filter("v is not null and not isnan(v)")
        values = materialize(cumulative_counts(both, [], "v"), "bins")
        if values.count() <= bins:
            ends = [(r["value"], r["value"]) for r in values.select("value").collect()]
        else:
            place = F.floor(F.lit(bins) * F.col("below") / F.col("n")).alias("bin")
            ends = [(r["low"], r["high"]) for r in values.groupBy(place).agg(
                F.min("value").alias("low"), F.max("value").alias("high")).collect()]
        out.append(Bins.of(ends))
    return out


def cells(rows: DataFrame, bins: Sequence[Bins]) -> DataFrame:
    """(cluster, fold, a, x0.., z0.., n, r, rr): rows with equal bins as one, with the sums of r and r^2.

    ``rows`` are those of :func:`policy.policy_rows`, with a ``fold`` column or none.
    """
    d = len(bins)
    features = [f"x{i}" for i in range(d)] + [f"z{i}" for i in range(d)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [bins[i % d].code(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int32)
                     for i, c in enumerate(features)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("cluster", "fold", "a", "r")] + [pa.array(c) for c in codes],
                names=["cluster", "fold", "a", "r", *features])

    whole = F.lit(True)
    for c in ("r", *features):
        whole &= F.col(c).isNotNull() & ~F.isnan(c)
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(0)
    flat = rows.filter(whole).select("cluster", fold.alias("fold"), "a", "r", *features)
    schema = "cluster int, fold int, a int, r double, " + ", ".join(f"{c} int" for c in features)
    summed = flat.mapInArrow(coded, schema).groupBy("cluster", "fold", "a", *features).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    return materialize(summed, "cells")


# --- trees as arrays

@dataclass
class Trees:
    """Complete binary trees by (model, action, node): node i has children 2i + 1 and 2i + 2.

    ``feature`` is -1 at a leaf; a bin up to ``cut`` goes left. ``clusters`` tells the cluster that
    a model serves.
    """

    clusters: list[int]
    bins: list[Bins]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, clusters: Sequence[int], bins: Sequence[Bins], depth: int) -> Trees:
        shape = (len(clusters), len(ACTIONS), (2 << depth) - 1)
        return cls(list(clusters), list(bins), np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.full(shape, np.nan))

    @property
    def depth(self) -> int:
        return (self.feature.shape[2] + 1).bit_length() - 2

    def nodes(self, model: int | np.ndarray, action: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        for _ in range(self.depth):
            f = self.feature[model, action, at]
            right = codes[rows, np.maximum(f, 0)] > self.cut[model, action, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def predict(self, model: int | np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(rows, actions): values; NaN for an action never observed."""
        return np.stack([self.value[model, a, self.nodes(model, a, codes)] for a in range(len(ACTIONS))], axis=1)

    def columns(self, terms: Sequence[Column], cluster: Column) -> list[Column]:
        """Q of each action at the given features; null for a pair never observed.

        The node arrays travel with the function, and a batch of rows is scored at once.
        """
        place = {k: i for i, k in enumerate(self.clusters)}
        trees = self

        @F.arrow_udf(", ".join(f"q{a} double" for a in ACTIONS))
        def scored(clusters: pa.Array, *features: pa.Array) -> pa.Array:
            known = np.array([place.get(k, -1) for k in clusters.to_pylist()], np.int64)
            raw = [np.asarray(f.to_numpy(zero_copy_only=False), np.float64) for f in features]
            bad = (known < 0) | np.any([np.isnan(v) for v in raw], axis=0)
            codes = np.stack([b.code(v) for b, v in zip(trees.bins, raw)], axis=1)
            q = trees.predict(np.maximum(known, 0), codes)
            q[bad] = np.nan
            return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in q.T], [f"q{a}" for a in ACTIONS])

        found = scored(cluster.cast("int"), *[t.cast("double") for t in terms])
        return [found.getField(f"q{a}") for a in ACTIONS]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per node that is reached: (model, cluster, action, node, feature, threshold, value); feature -1 at a leaf."""
        rows = []
        for m, a, i in zip(*np.nonzero(~np.isnan(self.value))):
            f = int(self.feature[m, a, i])
            threshold = float(self.bins[f].edges[self.cut[m, a, i]]) if f >= 0 else None
            rows.append((int(m), int(self.clusters[m]), int(ACTIONS[a]), int(i), f, threshold, float(self.value[m, a, i])))
        return spark.createDataFrame(rows, _TREE_SCHEMA)

    @classmethod
    def from_frame(cls, frame: DataFrame, d: int) -> Trees:
        """Trees of ``d`` features from their node table, a handful of rows; the edges are the thresholds in use."""
        rows = frame.collect()
        bins = [Bins.between({r["threshold"] for r in rows if r["feature"] == f}) for f in range(d)]
        clusters = {r["model"]: r["cluster"] for r in rows}
        depth = max((r["node"] + 1).bit_length() - 1 for r in rows) if rows else 0
        out = cls.empty([clusters[m] for m in sorted(clusters)], bins, depth)
        place = {m: i for i, m in enumerate(sorted(clusters))}
        for r in rows:
            at = place[r["model"]], ACTIONS.index(r["action"]), r["node"]
            out.value[at], out.feature[at] = r["value"], r["feature"]
            if r["feature"] >= 0:
                out.cut[at] = int(bins[r["feature"]].code(r["threshold"]))
        return out

    def take(self, models: Sequence[int], clusters: Sequence[int]) -> Trees:
        """The chosen models in order, serving other clusters."""
        at = list(models)
        return Trees(list(clusters), self.bins, self.feature[at].copy(), self.cut[at].copy(), self.value[at].copy())


# --- passes over the cells

@dataclass
class _Pass:
    """What a pass needs: which models train on a cell, last round's trees, and the trees that grow."""

    specs: list[Spec]
    active: list[int]
    gamma: float
    last: Trees | None
    policy: Trees | None
    grown: Trees | None = None
    level: int = 0
    build: np.ndarray | None = None
    before: Trees | None = None
    relative: bool = False

    def rows(self, batch: pa.RecordBatch, d: int, held_out: bool = False):
        """(model, arrays) of the cells that each active model trains on, or is tested on."""
        get = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        x = np.stack([get[f"x{i}"] for i in range(d)], axis=1)
        z = np.stack([get[f"z{i}"] for i in range(d)], axis=1)
        by_cluster: dict[int, list[int]] = {}
        for m in self.active:
            by_cluster.setdefault(self.specs[m].cluster, []).append(m)
        for k in np.unique(get["cluster"]):
            own = np.flatnonzero(get["cluster"] == k)
            for m in by_cluster.get(int(k), ()):
                left_out = self.specs[m].left_out
                at = own
                if left_out >= 0:
                    at = own[(get["fold"][own] == left_out) == held_out]
                if len(at):
                    yield m, x[at], z[at], get["a"][at].astype(np.int64), get["n"][at], get["r"][at], get["rr"][at]

    def next_value(self, trees: Trees, model: int, z: np.ndarray) -> np.ndarray:
        """Value of the next state: the best action's, or that of the policy's action."""
        q = trees.predict(model, z)
        if self.policy is None:
            return np.fmax.reduce(q, axis=1)
        return q[np.arange(len(z)), best_action(self.policy.predict(model, z))]


def best_action(q: np.ndarray) -> np.ndarray:
    """The first of the best actions; NaN is never the best."""
    return np.where(np.isnan(q), -np.inf, q).argmax(axis=1)


def _histograms(batches: Iterator[pa.RecordBatch], job: _Pass, d: int, bins: int) -> Iterator[pa.RecordBatch]:
    """(model, slot, n, s): a task's count and target by (action, node of the level, feature, bin).

    Slot -1 has the squared change of the last round's values, and what it is measured against.
    """
    nodes = 1 << job.level
    size = len(ACTIONS) * nodes * d * bins
    n_sums: dict[int, np.ndarray] = {}
    s_sums: dict[int, np.ndarray] = {}
    changes: dict[int, np.ndarray] = {}
    for batch in batches:
        for m, x, z, a, n, r, _ in job.rows(batch, d):
            y = r if job.last is None else r + job.gamma * n * job.next_value(job.last, m, z)
            if job.before is not None or job.relative:
                changes[m] = changes.get(m, 0) + _change(job, m, x, z, a, n)
            node = job.grown.nodes(m, a, x) - (nodes - 1)
            counted = node >= 0  # a leaf of an earlier level is negative here
            counted[counted] = job.build[m, a[counted], node[counted]]
            if not counted.any():
                continue
            base = (a * nodes + node)[counted]
            for f in range(d):
                slot = (base * d + f) * bins + x[counted, f]
                n_sums[m] = n_sums.get(m, 0) + np.bincount(slot, n[counted], size)
                s_sums[m] = s_sums.get(m, 0) + np.bincount(slot, y[counted], size)
    for m in n_sums:
        slot = np.flatnonzero(n_sums[m])
        yield _rows(m, slot, n_sums[m][slot], s_sums[m][slot])
    for m, (step, against) in changes.items():
        yield _rows(m, np.array([-1]), np.array([step]), np.array([against]))


def _rows(model: int, slot: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(slot), model, np.int32)), pa.array(slot.astype(np.int32)), pa.array(n.astype(np.float64)),
         pa.array(s.astype(np.float64))], names=["model", "slot", "n", "s"])


def _change(job: _Pass, m: int, x: np.ndarray, z: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Squared change of fitted values and their old square; relative: sum of the ratios, and rows."""
    if job.relative:
        new, old = job.next_value(job.last, m, z), job.next_value(job.before, m, z)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.array([(n * (new - old) ** 2 / old**2).sum(), n.sum()])
    at = np.arange(len(x))
    new = job.last.predict(m, x)[at, a]
    old = job.before.predict(m, x)[at, a] if job.before.clusters else np.zeros(len(x))
    return np.array([(n * (new - old) ** 2).sum(), (n * old**2).sum()])


def _merged(found: DataFrame) -> pa.Table:
    return found.groupBy("model", "slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()


class Grower:
    """Grows trees of all ``specs`` on ``table`` (:func:`cells`), a level per pass."""

    def __init__(self, table: DataFrame, specs: Sequence[Spec], bins: Sequence[Bins]):
        self.table, self.specs, self.all_bins = table, list(specs), list(bins)
        self.d, self.bins = len(bins), _most_bins(bins)
        self.depth = max(s.max_depth for s in specs)

    def empty(self) -> Trees:
        return Trees.empty([s.cluster for s in self.specs], self.all_bins, self.depth)

    def _count(self, job: _Pass) -> tuple[dict[int, np.ndarray], dict[int, tuple[float, float]]]:
        """Histograms (2, action, node, feature, bin) by model, and changes by model."""
        d, bins = self.d, self.bins
        got = _merged(self.table.mapInArrow(lambda b: _histograms(b, job, d, bins), "model int, slot int, n double, s double"))
        model, slot, n, s = (got[c].to_numpy() for c in ("model", "slot", "n", "s"))
        shape = (2, len(ACTIONS), 1 << job.level, d, bins)
        found: dict[int, np.ndarray] = {}
        for m in np.unique(model[slot >= 0]):
            h = np.zeros(shape)
            at = (model == m) & (slot >= 0)
            h.reshape(2, -1)[:, slot[at]] = n[at], s[at]
            found[int(m)] = h
        return found, {int(model[i]): (n[i], s[i]) for i in np.flatnonzero(slot < 0)}

    def round(self, active: Sequence[int], gamma: float, last: Trees | None, policy: Trees | None = None,
              before: Trees | None = None, relative: bool = False) -> tuple[Trees, dict[int, tuple[float, float]]]:
        """Trees of the active models on targets from ``last``, and the changes from ``before`` to ``last``."""
        trees = self.empty()
        n_actions = len(ACTIONS)
        held: dict[int, np.ndarray] = {}
        build = np.ones((len(self.specs), n_actions, 1), bool)
        changes: dict[int, tuple[float, float]] = {}
        for level in range(max(self.depth, 1)):
            job = _Pass(self.specs, list(active), gamma, last, policy, trees, level, build,
                        before if level == 0 else None, relative and level == 0)
            found, moved = self._count(job)
            changes |= moved
            if level:
                found = {m: self._with_siblings(m, h, found.get(m), build, trees, level) for m, h in held.items()}
            held = {}
            build = np.zeros((len(self.specs), n_actions, 2 << level), bool)
            for m, h in found.items():
                if self._split(trees, m, h, level, build[m]) and level + 1 < self.specs[m].max_depth:
                    held[m] = h
            if not held:
                break
            active = list(held)
        return trees, changes

    def _with_siblings(self, m: int, parent: np.ndarray, counted: np.ndarray | None, build: np.ndarray, trees: Trees,
                       level: int) -> np.ndarray:
        """The level's histograms: counted children as they are, the others as parent less sibling."""
        out = np.zeros((2, len(ACTIONS), 1 << level, self.d, self.bins)) if counted is None else counted
        first = (1 << (level - 1)) - 1
        for a, i in zip(*np.nonzero(trees.feature[m, :, first : 2 * first + 1] >= 0)):
            small, large = (2 * i, 2 * i + 1) if build[m, a, 2 * i] else (2 * i + 1, 2 * i)
            out[:, a, large] = parent[:, a, i] - out[:, a, small]
        return out

    def _split(self, trees: Trees, m: int, h: np.ndarray, level: int, build: np.ndarray) -> bool:
        """Split the nodes of a level where it gains; mark the smaller children. True if any was split."""
        spec = self.specs[m]
        n, s = h
        first = (1 << level) - 1
        total, target = n[:, :, 0].sum(-1), s[:, :, 0].sum(-1)
        there = total > 0.5
        if level == 0:
            trees.value[m, :, 0] = np.where(there[:, 0], target[:, 0] / np.maximum(total[:, 0], 1), np.nan)
        if not spec.max_depth:
            return False
        left_n, left_s = n.cumsum(-1), s.cumsum(-1)
        right_n, right_s = total[:, :, None, None] - left_n, target[:, :, None, None] - left_s
        # Counts are whole numbers, kept as doubles.
        allowed = (np.round(left_n) >= max(spec.min_leaf, 1)) & (np.round(right_n) >= max(spec.min_leaf, 1))
        whole = (target**2 / np.maximum(total, 1))[:, :, None, None]
        gain = np.where(allowed, left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - whole, -np.inf)
        flat = gain.reshape(*gain.shape[:2], -1)
        rounding = _LEAST_GAIN * whole[..., 0, 0]
        # The first of the best: gains apart by no more than rounding are equal.
        best = (flat >= (flat.max(-1) - rounding)[..., None]).argmax(-1)
        split = there & (flat.max(-1) > rounding)
        for a, i in zip(*np.nonzero(split)):
            f, c = divmod(int(best[a, i]), self.bins)
            node = first + i
            there_n = np.flatnonzero(n[a, i, f] > 0.5)
            place = int(np.searchsorted(there_n, c, "right"))
            trees.feature[m, a, node] = f
            trees.cut[m, a, node] = self.all_bins[f].cut(int(there_n[place - 1]), int(there_n[place]))
            trees.value[m, a, 2 * node + 1] = left_s[a, i, f, c] / left_n[a, i, f, c]
            trees.value[m, a, 2 * node + 2] = right_s[a, i, f, c] / right_n[a, i, f, c]
            build[a, 2 * i + int(left_n[a, i, f, c] > right_n[a, i, f, c])] = True
        return bool(split.any())


def _most_bins(bins: Sequence[Bins]) -> int:
    return max((len(b.edges) for b in bins), default=0) + 1


def _blocks(specs: Sequence[Spec], bins: Sequence[Bins]) -> Iterator[list[int]]:
    """Models in blocks whose histograms fit in ``HELD`` bytes."""
    if not specs:
        return
    one = max(16 * len(ACTIONS) * len(bins) * _most_bins(bins) << max(s.max_depth for s in specs), 1)
    per = max(1, HELD // one)
    for at in range(0, len(specs), per):
        yield list(range(at, min(at + per, len(specs))))


def _stacked(parts: list[Trees], bins: Sequence[Bins]) -> Trees:
    """Models of several blocks as one, all as deep as the deepest."""
    if not parts:
        return Trees.empty([], bins, 0)
    depth = max(t.depth for t in parts)
    out = Trees.empty([k for t in parts for k in t.clusters], parts[0].bins, depth)
    at = 0
    for t in parts:
        m, _, n = t.feature.shape
        for name in ("feature", "cut", "value"):
            getattr(out, name)[at : at + m, :, :n] = getattr(t, name)
        at += m
    return out


def _kept(new: Trees, old: Trees, active: Sequence[int], taken: np.ndarray | None = None) -> Trees:
    """``new`` for the active models, ``old`` for those that have stopped; of ``taken`` actions only, where they have rows."""
    for m in range(len(new.clusters)):
        for a in range(len(ACTIONS)):
            if m not in active or (taken is not None and (np.isnan(new.value[m, a, 0]) or not taken[m, a])):
                n = old.feature.shape[2]
                for name in ("feature", "cut", "value"):
                    getattr(new, name)[m, a, :n] = getattr(old, name)[m, a]
    return new


# --- learning and evaluation

@dataclass
class TreeFit:
    trees: Trees
    specs: list[Spec]
    errors: list[list[float]] = field(default_factory=list)
    converged: list[bool] = field(default_factory=list)

    @property
    def iterations(self) -> list[int]:
        return [len(e) for e in self.errors]


def fit_q(table: DataFrame, specs: Sequence[Spec], bins: Sequence[Bins], gamma: float = 0.95, max_iter: int = 200,
          tol: float = 1e-6, early_stopping: bool = False) -> TreeFit:
    """Fitted-Q iteration with trees; each model stops by its own rule.

    A model ends when the fitted values change by at most ``tol`` of their size, after
    max_iter + 1 rounds, or, with ``early_stopping``, when the change settles. The change of a
    round is measured by the first pass of the next.
    """
    parts, errors, converged = [], [], []
    for block in _blocks(specs, bins):
        own = [specs[i] for i in block]
        fit = _fit_block(table, own, bins, gamma, max_iter, tol, early_stopping)
        parts.append(fit.trees)
        errors += fit.errors
        converged += fit.converged
    return TreeFit(_stacked(parts, bins), list(specs), errors, converged)


def _fit_block(table, specs, bins, gamma, max_iter, tol, early_stopping) -> TreeFit:
    grower = Grower(table, specs, bins)
    active = list(range(len(specs)))
    errors: list[list[float]] = [[] for _ in specs]
    converged = [True] * len(specs)
    smallest = [np.inf] * len(specs)
    nothing = Trees.empty([], bins, 0)
    last, _ = grower.round(active, gamma, None)
    trees, _ = grower.round(active, gamma, last)
    before = nothing  # the first round is compared with zero
    while True:
        following, changes = grower.round(active, gamma, trees, before=before)
        for m in list(active):
            step, size = changes.get(m, (0.0, 0.0))
            err = float(np.sqrt(step) / (np.sqrt(size) + 1e-6))
            errors[m].append(err)
            if early_stopping and abs(err - smallest[m]) < 1e-5:
                active.remove(m)
            elif len(errors[m]) > max_iter:
                converged[m] = False
                active.remove(m)
            elif err <= tol:
                active.remove(m)
            smallest[m] = min(smallest[m], err)
        if not active:
            return TreeFit(trees, list(specs), errors, converged)
        before, trees = trees, _kept(following, trees, active)


def _losses(batches: Iterator[pa.RecordBatch], job: _Pass, d: int) -> Iterator[pa.RecordBatch]:
    """(model, slot, n, s): held-out rows and their squared TD errors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for m, x, z, a, n, r, rr in job.rows(batch, d, held_out=True):
            own = job.last.predict(m, x)[np.arange(len(x)), a]
            rest = job.gamma * job.next_value(job.last, m, z) - np.nan_to_num(own)
            sums[m] = sums.get(m, 0) + np.array([n.sum(), (rr + 2 * r * rest + n * rest**2).sum()])
    for m, (n, s) in sums.items():
        yield _rows(m, np.array([0]), np.array([n]), np.array([s]))


def td_losses(table: DataFrame, fit: TreeFit, gamma: float) -> np.ndarray:
    """Mean squared TD error of each model on its left-out fold, NaN without a row; an action never seen counts as 0."""
    job = _Pass(fit.specs, list(range(len(fit.specs))), gamma, fit.trees, None)
    d = len(fit.trees.bins)
    got = _merged(table.mapInArrow(lambda b: _losses(b, job, d), "model int, slot int, n double, s double"))
    out = np.full(len(fit.specs), np.nan)
    out[got["model"].to_numpy()] = got["s"].to_numpy() / got["n"].to_numpy()
    return out


@dataclass
class TreeEvaluation:
    """``trees``: the evaluated Q. ``unobserved``: (cluster, action) that the policy takes but no row does; they keep the start's tree."""

    trees: Trees
    iterations: list[int]
    errors: list[list[float]]
    unobserved: list[tuple[int, int]]


def _taken(batches: Iterator[pa.RecordBatch], job: _Pass, d: int) -> Iterator[pa.RecordBatch]:
    """(model, slot, n, s): how often the policy takes each action at the next states."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for m, _, z, _, n, _, _ in job.rows(batch, d):
            sums[m] = sums.get(m, 0) + np.bincount(best_action(job.policy.predict(m, z)), n, len(ACTIONS))
    for m, n in sums.items():
        yield _rows(m, np.arange(len(ACTIONS)), n, n)


def evaluate_q(table: DataFrame, start: Trees, specs: Sequence[Spec], gamma: float = 0.95, max_iter: int = 500,
               early_stopping: bool = False, tol: float = 1e-7) -> TreeEvaluation:
    """Q of the greedy policy of ``start`` on other rows: the trees are grown anew each round.

    Only actions that the policy takes at a next state are grown, the others keep their tree. ``start`` has a model for each of ``specs``. Rounds end at a mean squared relative change
    below ``tol`` of the next states' values, with ``early_stopping`` when it settles, or after ``max_iter``.
    """
    grower = Grower(table, specs, start.bins)
    active = list(range(len(specs)))
    errors: list[list[float]] = [[] for _ in specs]
    smallest = [np.inf] * len(specs)
    if max_iter <= 0:
        return TreeEvaluation(start, [0] * len(specs), errors, [])
    job, d = _Pass(list(specs), active, gamma, None, start), len(start.bins)
    got = _merged(table.mapInArrow(lambda b: _taken(b, job, d), "model int, slot int, n double, s double"))
    taken = np.zeros((len(specs), len(ACTIONS)), bool)
    taken[got["model"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy() > 0
    trees, _ = grower.round(active, gamma, start, policy=start)
    unobserved = [(specs[m].cluster, ACTIONS[a]) for m, a in zip(*np.nonzero(taken)) if np.isnan(trees.value[m, a, 0])]
    trees, before = _kept(trees, start, active, taken), start
    while True:
        following, changes = grower.round(active, gamma, trees, policy=start, before=before, relative=True)
        for m in list(active):
            total, n = changes.get(m, (0.0, 1.0))
            err = total / n
            errors[m].append(err)
            if (early_stopping and abs(err - smallest[m]) < 1e-5) or err < tol or len(errors[m]) >= max_iter:
                active.remove(m)
            smallest[m] = min(smallest[m], err)
        if not active:
            return TreeEvaluation(trees, [len(e) for e in errors], errors, unobserved)
        before, trees = trees, _kept(following, trees, active, taken)


def clusters_of(rows: DataFrame) -> list[int]:
    return sorted(r["cluster"] for r in rows.select("cluster").distinct().collect())


def tree_policies(rows: DataFrame, gamma: float = 0.95, max_depth: int = 3, min_leaf: int = 50, max_iter: int = 200,
                  tol: float = 1e-6, early_stopping: bool = False, bins: int = BINS) -> TreeFit:
    """A tree Q function for each cluster of ``rows`` (:func:`policy.policy_rows`)."""
    own = bins_of(rows, bins)
    specs = [Spec(k, -1, max_depth, min_leaf) for k in clusters_of(rows)]
    return fit_q(cells(rows, own), specs, own, gamma, max_iter, tol, early_stopping)


def select_tree_cv(rows: DataFrame, grid: Sequence[dict], n_folds: int, gamma: float = 0.95, max_iter: int = 200,
                   tol: float = 1e-4, early_stopping: bool = True, bins: int = BINS, metric=None) -> DataFrame:
    """(cluster, param_id, test_error) over a grid of {max_depth, min_samples_leaf}; ``rows`` have a ``fold``.

    All clusters, folds and settings grow in the same passes. The error is the mean over folds of
    the mean squared TD error of the left-out rows, as far as a fold has rows; or of ``metric``
    (:func:`policy.kernel_metric`), which scores the rows once per setting.
    """
    own = bins_of(rows, bins)
    table = cells(rows, own)
    keys, specs = [], []
    for k in clusters_of(rows):
        for i, params in enumerate(grid):
            for fold in range(n_folds):
                keys.append((k, i))
                specs.append(Spec(k, fold, params["max_depth"], params["min_samples_leaf"]))
    fit = fit_q(table, specs, own, gamma, max_iter, tol, early_stopping)
    losses = td_losses(table, fit, gamma) if metric is None else _metric_losses(rows, fit, keys, gamma, metric)
    by_key: dict[tuple[int, int], list[float]] = {}
    for key, loss in zip(keys, losses):
        by_key.setdefault(key, []).append(loss)
    out = [(int(k), i, float(np.nanmean(v))) for (k, i), v in by_key.items()]
    return rows.sparkSession.createDataFrame(out, "cluster int, param_id int, test_error double")


def _metric_losses(rows: DataFrame, fit: TreeFit, keys: Sequence[tuple[int, int]], gamma: float, metric) -> np.ndarray:
    """The metric of each model on its left-out rows; one scoring of all rows per setting."""
    out = np.full(len(keys), np.nan)
    for param in sorted({i for _, i in keys}):
        models = [m for m, (_, i) in enumerate(keys) if i == param]
        places = [(fit.specs[m].cluster, fit.specs[m].left_out, n) for n, m in enumerate(models)]
        table = rows.sparkSession.createDataFrame(places, "cluster int, fold int, place int")
        own = rows.join(table, ["cluster", "fold"]).drop("cluster").withColumnRenamed("place", "cluster")
        for r in metric(with_td_error(own, fit.trees.take(models, range(len(models))), gamma)).collect():
            out[models[r["cluster"]]] = r["loss"]
    return out


def fitter(max_depth: int = 3, min_leaf: int = 50, bins: int = BINS):
    """A fitter for :func:`policy.q_iteration_with` and :func:`policy.evaluate_with`: one tree per cluster and action."""

    def fit(rows: DataFrame) -> Trees:
        d = _width(rows)
        features = [f"{p}{i}" for p in "xz" for i in range(d)]
        targets = rows.select("cluster", "a", F.col("target").alias("r"), *features)
        own = bins_of(targets, bins)
        specs = [Spec(k, -1, max_depth, min_leaf) for k in clusters_of(rows)]
        return Grower(cells(targets, own), specs, own).round(range(len(specs)), 0.0, None)[0]

    return fit


def ope_by_segment(rows: DataFrame, labels: DataFrame, trees: Trees, gamma: float = 0.95, max_depth: int = 3,
                   min_leaf: int = 50, max_iter: int = 500, early_stopping: bool = False) -> DataFrame:
    """(subject, k_test, k_train, value): tree evaluation inside every (test, train) pair of labels.

    As :func:`policy.ope_by_segment`, with the regressor that learned the policies: each pair starts from
    its training label's trees and grows them anew each round on its test rows.
    """
    paired, pairs = pair_labels(rows, labels)
    place = {k: i for i, k in enumerate(trees.clusters)}
    known = [i for i, (_, k_train) in enumerate(pairs) if k_train in place]
    start = trees.take([place[pairs[i][1]] for i in known], known)
    specs = [Spec(i, -1, max_depth, min_leaf) for i in known]
    done = evaluate_q(cells(paired, trees.bins), start, specs, gamma, max_iter, early_stopping)
    # The start action is greedy under the Q that evaluation ended with.
    value = initial_values(paired, done.trees, done.trees)
    table = rows.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "cluster int, k_test long, k_train long")
    return value.join(table, "cluster").select("subject", "k_test", "k_train", "value")


def post_change(rows: DataFrame, taus: DataFrame) -> DataFrame:
    """The rows of each subject from its change point on; ``taus`` has (subject, tau), null or absent means the start."""
    at = taus.select("subject", "tau")
    return rows.join(at, "subject", "left").filter(F.col("t") >= F.coalesce("tau", F.lit(0))).select(*rows.columns)
