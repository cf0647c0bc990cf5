"""Sums over all pairs of rows, computed without forming the pairs.

For one state variable the Gaussian kernel is expanded about cell centres. A
value at offset u from the centre of its cell contributes, for every cell
distance D that still matters, the terms

    u^j exp(-bw u^2 -+ 2 bw D u),   j = 0, 1, ...

and the sum over pairs of two cells is a short inner product of the two cells'
summed terms. The cost is linear in the rows, the error is that of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import distances, gauss

# Cells are one kernel width wide; beyond REACH cells the kernel is below 1e-16.
REACH = 7
TERMS = 14

from panelwright.session import materialize


def _terms(u: np.ndarray, shift: float, bw: float) -> np.ndarray:
    """(rows, TERMS): sqrt((2 bw)^j / j!) u^j exp(-bw u^2 - 2 bw shift u)."""
    scale = np.array([math.exp(0.5 * (j * math.log(2 * bw) - math.lgamma(j + 1))) for j in range(TERMS)])
    return np.exp(-bw * u * u - 2 * bw * shift * u)[:, None] * scale * np.power(u[:, None], np.arange(TERMS))


def kernel_moments(rows: DataFrame, x: str, weights: dict[str, str], bandwidth: float, by: str) -> DataFrame:
    """(by, cell, d, <weight sums>): summed terms per group, cell and cell distance d."""
    width = 1.0 / math.sqrt(bandwidth)
    names = list(weights)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = pdf["x"].to_numpy(float)
            cell = np.floor(v / width).astype(np.int64)
            u = v - (cell + 0.5) * width
            w = pdf[names].to_numpy(float)
            code, inv = np.unique(np.column_stack([pdf["g"].to_numpy(), cell]), axis=0, return_inverse=True)
            inv = inv.ravel()
            out = []
            for d in range(-REACH, REACH + 1):
                # Partner cell is d cells above: centre difference is -d widths.
                t = _terms(u, -d * width, bandwidth)
                for i, name in enumerate(names):
                    acc = np.zeros((len(code), TERMS))
                    np.add.at(acc, inv, t * w[:, i: i + 1])
                    out += [(int(g), int(c), d, name, a.tolist()) for (g, c), a in zip(code, acc)]
            yield pd.DataFrame(out, columns=["g", "cell", "d", "name", "v"])

    flat = rows.select(F.col(by).cast("bigint").alias("g"), F.col(x).cast("double").alias("x"),
                       *[F.col(c).cast("double").alias(n) for n, c in weights.items()])
    got = flat.mapInPandas(fold, "g bigint, cell bigint, d int, name string, v array<double>")
    summed = got.select("g", "cell", "d", "name", F.posexplode("v").alias("j", "v")).groupBy(
        "g", "cell", "d", "name", "j").agg(F.sum("v").alias("v"))
    return summed


def kernel_products(moments: DataFrame, bandwidth: float) -> DataFrame:
    """(g, left, right, s): sum over ordered pairs (with i = j) of w_left w_right K."""
    width = 1.0 / math.sqrt(bandwidth)
    a = moments.select("g", "cell", "d", "j", F.col("name").alias("left"), F.col("v").alias("va"))
    # The partner's record names the same pair of cells from the other side.
    b = moments.select("g", (F.col("cell") + F.col("d")).alias("cell"), (-F.col("d")).alias("d"), "j",
                       F.col("name").alias("right"), F.col("v").alias("vb"))
    j = a.join(b, ["g", "cell", "d", "j"])
    dist = F.col("d") * width
    return j.groupBy("g", "left", "right").agg(
        F.sum(F.col("va") * F.col("vb") * F.exp(-bandwidth * dist * dist)).alias("s"))


def _products(rows: DataFrame, states: Sequence[str], weights: dict[str, str], bandwidth: float, by: str) -> DataFrame:
    """The pair sums of one state by its expansion, those of several on tensor grids."""
    if len(states) == 1:
        return kernel_products(kernel_moments(rows, states[0], weights, bandwidth, by), bandwidth)
    return gauss.kernel_products(rows, states, weights, bandwidth, by)


def _listed(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def kernel_td_loss(td: DataFrame, x: str | Sequence[str], bandwidth: float, by: str = "cluster") -> DataFrame:
    """(by, loss): mean over pairs i < j of (1 + Ka + Ks + Ka Ks) tde_i tde_j.

    Ks = exp(-bw |s_i - s_j|^2) over the states ``x``; Ka = |a_i - a_j| = a_i + a_j - 2 a_i a_j for
    binary actions.
    """
    states = _listed(x)
    rows = td.select(F.col(by).alias(by), *[F.col(c) for c in states], F.col("tde").alias("e"),
                     (F.col("tde") * F.col("a")).alias("ae"))
    prods = _products(rows, states, {"e": "e", "ae": "ae"}, bandwidth, by)
    ks = prods.groupBy("g").agg(
        F.sum(F.when((F.col("left") == "e") & (F.col("right") == "e"), F.col("s"))).alias("uu"),
        F.sum(F.when((F.col("left") == "e") & (F.col("right") == "ae"), F.col("s"))).alias("uv"),
        F.sum(F.when((F.col("left") == "ae") & (F.col("right") == "ae"), F.col("s"))).alias("vv"))
    plain = rows.groupBy(by).agg(F.sum("e").alias("u"), F.sum("ae").alias("v"), F.sum(F.col("e") * F.col("e")).alias("q"),
                                 F.count(F.lit(1)).cast("double").alias("n"))
    j = plain.join(ks, plain[by] == ks["g"])
    one = F.col("u") * F.col("u") + 2 * F.col("u") * F.col("v") - 2 * F.col("v") * F.col("v") - F.col("q")
    two = F.col("uu") + 2 * F.col("uv") - 2 * F.col("vv") - F.col("q")
    return j.select(by, ((one + two) / (F.col("n") * (F.col("n") - 1))).alias("loss"))


def kernel_pair_sum(td: DataFrame, x: str | Sequence[str], bandwidth: float, by: str) -> DataFrame:
    """(by, s): sum over pairs i < j of Ks tde_i tde_j."""
    states = _listed(x)
    rows = td.select(F.col(by).alias(by), *[F.col(c) for c in states], F.col("tde").alias("e"))
    prods = _products(rows, states, {"e": "e"}, bandwidth, by)
    diag = rows.groupBy(by).agg(F.sum(F.col("e") * F.col("e")).alias("q"))
    return diag.join(prods.select("g", "s"), diag[by] == F.col("g")).select(by, ((F.col("s") - F.col("q")) / 2).alias("s"))


def kernel_td_loss_features(td: DataFrame, features: list[str], by: str = "cluster") -> DataFrame:
    """The same loss with Ks replaced by random Fourier features: an approximation,
    for several state variables."""
    aggs = [F.sum(F.col("tde")).alias("u"), F.sum(F.col("tde") * F.col("a")).alias("v"),
            F.sum(F.col("tde") * F.col("tde")).alias("q"), F.count(F.lit(1)).cast("double").alias("n")]
    norm = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    aggs.append(F.sum(F.col("tde") * F.col("tde") * norm).alias("qn"))
    for c in features:
        aggs += [F.sum(F.col("tde") * F.col(c)).alias(f"u_{c}"), F.sum(F.col("tde") * F.col("a") * F.col(c)).alias(f"v_{c}")]
    g = td.groupBy(by).agg(*aggs)
    one = F.col("u") * F.col("u") + 2 * F.col("u") * F.col("v") - 2 * F.col("v") * F.col("v") - F.col("q")
    two = sum((F.col(f"u_{c}") * F.col(f"u_{c}") + 2 * F.col(f"u_{c}") * F.col(f"v_{c}")
               - 2 * F.col(f"v_{c}") * F.col(f"v_{c}") for c in features), F.lit(0.0)) - F.col("qn")
    return g.select(by, ((one + two) / (F.col("n") * (F.col("n") - 1))).alias("loss"))


def sample_subjects(panel: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """All rows of at most n subjects, chosen by a hash of the subject."""
    pick = panel.select("subject").distinct().orderBy(F.xxhash64("subject", F.lit(seed)), "subject").limit(n)
    return panel.join(pick, "subject", "left_semi")


def median_bandwidth(panel: DataFrame, states: list[str], n: int | None = None, seed: int = 0, block: int = 1024,
                     bins: int = 8192) -> DataFrame:
    """(median, bandwidth): exact median of the positive distances between all pairs of rows.

    One state takes :class:`distances.PairDistances`, which forms no pairs. For several, equal states
    are one point with a weight, and points are dealt into blocks of about ``block``; a task handles one
    pair of blocks. Distances are counted per bin, and the median's bin is divided again until it holds a
    single distance. ``n`` takes the rows of that many sampled subjects only; it is off by default.
    """
    panel = panel if n is None else sample_subjects(panel, n, seed)
    if len(states) == 1:
        middle = distances.median_distance(panel, states[0])
        return panel.sparkSession.createDataFrame([(middle, None if middle is None else 1.0 / middle)], "median double, bandwidth double")
    points = materialize(
        panel.select(F.array(*[F.col(c).cast("double") for c in states]).alias("x"))
        .groupBy("x").agg(F.count(F.lit(1)).alias("w")), "points")
    blocks = max(1, -(-points.count() // block))
    rows = points.withColumn("own", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    pairs = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select(
        "own", "x", "w", F.least("own", "o").alias("b1"), F.greatest("own", "o").alias("b2"))
    span = points.agg(*[(F.max(F.col("x")[j]) - F.min(F.col("x")[j])).alias(str(j)) for j in range(len(states))]).first()
    top = math.sqrt(sum(float(v) ** 2 for v in span)) * (1 + 1e-9) or 1.0

    def counted(low: float, high: float) -> list:
        """(bin, pairs, least, largest) of the positive distances from low to high."""
        width = (high - low) / bins or 1.0

        def count(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
            w, own = pdf["w"].to_numpy(), pdf["own"].to_numpy()
            left = np.flatnonzero(own == key[0])
            right = left if key[0] == key[1] else np.flatnonzero(own == key[1])
            out: list[pd.DataFrame] = []
            for at, i in enumerate(left):
                other = right[at + 1:] if key[0] == key[1] else right
                d = np.sqrt(((x[other] - x[i]) ** 2).sum(1))
                keep = (d > 0) & (d >= low) & (d <= high)
                out.append(pd.DataFrame({"d": d[keep], "c": w[i] * w[other][keep]}))
                if sum(map(len, out)) > 1 << 20:
                    out = [packed(pd.concat(out))]
            return packed(pd.concat(out)) if out else packed(pd.DataFrame({"d": [], "c": []}))

        def packed(found: pd.DataFrame) -> pd.DataFrame:
            if "lo" not in found:
                found = found.assign(lo=found["d"], hi=found["d"])
            found["lo"], found["hi"] = found["lo"].fillna(found["d"]), found["hi"].fillna(found["d"])
            b = np.minimum((found["lo"].to_numpy(float) - low) / width, bins - 1).astype(np.int64)
            g = found.assign(b=b).groupby("b", as_index=False).agg({"c": "sum", "lo": "min", "hi": "max"})
            return g.assign(d=g["lo"])[["b", "d", "c", "lo", "hi"]].astype({"b": "int64", "c": "int64"})

        return (pairs.groupBy("b1", "b2").applyInPandas(count, "b bigint, d double, c bigint, lo double, hi double")
                .groupBy("b").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .orderBy("b").collect())

    first = counted(0.0, top)
    total = sum(r["c"] for r in first)
    if not total:
        return panel.sparkSession.createDataFrame([(None, None)], "median double, bandwidth double")

    def nth(rank: int) -> float:
        cells = first
        while True:
            for r in cells:
                if rank < r["c"]:
                    break
                rank -= r["c"]
            if r["lo"] == r["hi"]:
                return r["lo"]
            cells = counted(r["lo"], r["hi"])

    low = nth((total - 1) // 2)
    median = low if total % 2 else (low + nth(total // 2)) / 2
    return panel.sparkSession.createDataFrame([(median, 1.0 / median)], "median double, bandwidth double")
