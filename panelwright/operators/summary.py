"""Aggregates over panels, labels and result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import mean_se_text
from panelwright.operators.ranking import cumulative_counts


# --- labels

def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def first_index(assignment: DataFrame) -> DataFrame:
    """(cluster, first_subject, n): smallest subject and size of every label."""
    return assignment.groupBy("cluster").agg(F.min("subject").alias("first_subject"), F.count(F.lit(1)).alias("n"))


def cross_tab(df: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Counts of ``col`` per ``row``; absent pairs are 0. Give ``values`` to save a pass."""
    out = df.groupBy(row).pivot(col, list(values) if values is not None else None).agg(F.count(F.lit(1)))
    return out.fillna(0)


def presence(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, present): the sorted set of ``col`` values seen in each row group."""
    return df.groupBy(row).agg(F.sort_array(F.collect_set(col)).alias("present"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari, n): agreement of two (subject, cluster) tables.

    One join and one contingency aggregate; the pair counts are sums over the
    contingency cells, so no pair of subjects is ever formed.
    """
    cells = (
        a.select("subject", F.col("cluster").alias("ca"))
        .join(b.select("subject", F.col("cluster").alias("cb")), "subject")
        .groupBy("ca", "cb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )

    def pairs(df: DataFrame, key: str, name: str) -> DataFrame:
        per = df.groupBy(key).agg(F.sum("n").alias("n"))
        return per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    sa = pairs(cells, "ca", "v").scalar()
    sb = pairs(cells, "cb", "v").scalar()
    total = cells.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sij"))
    every = F.col("n") * (F.col("n") - 1) / 2
    expected = sa * sb / F.nullif(every, F.lit(0.0))
    top = (sa + sb) / 2
    return total.select(
        F.when(F.coalesce(top - expected, F.lit(0.0)) == 0, F.lit(1.0))
        .otherwise((F.col("sij") - expected) / (top - expected)).alias("ari"),
        F.col("n").cast("bigint").alias("n"))


def relative_error(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(err, n_used, n_zero): mean of |pred - true| / true over subjects with true > 0."""
    j = pred.select("subject", F.col("tau").alias("p")).join(
        true.select("subject", F.col("tau").alias("q")), "subject")
    return j.agg(
        F.avg(F.when(F.col("q") != 0, F.abs(F.col("p") - F.col("q")) / F.col("q"))).alias("err"),
        F.sum((F.col("q") != 0).cast("bigint")).alias("n_used"),
        F.sum((F.col("q") == 0).cast("bigint")).alias("n_zero"))


# --- panel levels

def before_after(rows: DataFrame, states: Sequence[str]) -> DataFrame:
    """(cluster, <state>_before, <state>_after): means either side of ``tau``."""
    aggs = []
    for c in states:
        aggs += [F.avg(F.when(F.col("t") < F.col("tau"), F.col(c))).alias(f"{c}_before"),
                 F.avg(F.when(F.col("t") >= F.col("tau"), F.col(c))).alias(f"{c}_after")]
    return rows.groupBy("cluster").agg(*aggs)


def discounted_return(rows: DataFrame, gamma: float, t0: int, reward: str = "r") -> DataFrame:
    """(average, discounted): mean reward from t0 on, and the mean over subjects of
    the sum of r * gamma^(t - t0)."""
    per = rows.filter(F.col("t") >= t0).groupBy("subject").agg(
        F.sum(F.col(reward) * F.pow(F.lit(gamma), F.col("t") - t0)).alias("d"),
        F.sum(reward).alias("s"), F.count(reward).alias("n"))
    return per.agg((F.sum("s") / F.sum("n")).alias("average"), F.avg("d").alias("discounted"))


# --- result tables

def mean_se(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, mean, size, std, se): sample standard deviation, se = std / sqrt(n)."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("size"), F.stddev_samp(value).alias("std"),
    ).withColumn("se", F.col("std") / F.sqrt(F.col("size")))


def mean_se_table(df: DataFrame, keys: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    return mean_se(df, keys, value).select(*keys, mean_se_text(F.col("mean"), F.col("se"), digits).alias("text"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "measure", "value")


def difference_to_reference(long: DataFrame, reference: str, keys: Sequence[str] = ("setting", "seed", "measure")) -> DataFrame:
    """Add ``diff`` = reference policy's value - own value.

    0 for the reference itself, NULL where the reference has no such run.
    """
    ref = long.filter(F.col("policy") == reference).select(*keys, F.col("value").alias("_ref"))
    out = long.join(ref, list(keys), "left")
    return out.withColumn(
        "diff", F.when(F.col("policy") == reference, F.lit(0.0)).otherwise(F.col("_ref") - F.col("value"))).drop("_ref")


def horizon_table(df: DataFrame, row: str, col: str, value: str, columns: Sequence) -> DataFrame:
    """One row per method, one column per horizon, and the mean over those present."""
    wide = df.groupBy(row).pivot(col, list(columns)).agg(F.avg(value))
    present = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    total = F.aggregate(present, F.lit(0.0), lambda s, v: s + v)
    return wide.withColumn("average", total / F.nullif(F.size(present), F.lit(0)))


def name_effects(df: DataFrame, col: str, names: Sequence[str] = ("Strong", "Moderate", "Weak")) -> DataFrame:
    """(col, effect): named in descending order when there are exactly three values,
    else the value itself."""
    distinct = df.select(col).distinct()
    # The list of effect sizes is a handful of settings of the study.
    ranked = distinct.orderBy(F.col(col).desc()).limit(len(names) + 1).collect()
    if len(ranked) != len(names):
        return distinct.withColumn("effect", F.col(col).cast("string"))
    text = F.lit(names[-1])
    for r, name in list(zip(ranked, names))[:-1]:
        text = F.when(F.col(col) == F.lit(r[0]), F.lit(name)).otherwise(text)
    return distinct.withColumn("effect", text)


# --- ranks

def smallest(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """(key, order, rn): the n smallest rows of every key.

    Rows are ranked inside hashed shares of a key first and only the n best of
    each share go on, so a key with most of the rows is not sorted in one task.
    """
    share = F.pmod(F.xxhash64(*order), F.lit(64))
    first = Window.partitionBy(key, "_share").orderBy(*order)
    local = df.select(key, *order, share.alias("_share")).withColumn("rn", F.row_number().over(first))
    final = Window.partitionBy(key).orderBy(*order)
    return local.filter(F.col("rn") <= n).drop("_share", "rn").withColumn(
        "rn", F.row_number().over(final)).filter(F.col("rn") <= n)


def exceedance(stats: DataFrame, stat: str, values: DataFrame, col: str) -> DataFrame:
    """Add ``pvalue``: the share of ``values`` above each statistic.

    Statistics join the value axis with weight 0; running counts over the axis
    then give every share, so no statistic meets a value as a pair.
    """
    axis = values.select(F.col(col).cast("double").alias("x"), F.lit(1).alias("w")).unionByName(
        stats.select(F.col(stat).cast("double").alias("x"), F.lit(0).alias("w")))
    cum = cumulative_counts(axis, [], "x", "w")
    share = (F.col("n") - F.col("below") - F.col("c")) / F.col("n")
    return stats.withColumn("_x", F.col(stat).cast("double")).join(
        cum.select(F.col("value").alias("_x"), share.alias("pvalue")), "_x").drop("_x")


# --- two-group multivariate test

def manova(rows: DataFrame, states: Sequence[str], group: str, by: str) -> DataFrame:
    """(by, n, wilks, pillai, hotelling, roy, f, df1, df2, pvalue): two groups of rows.

    Group sums and products come from one aggregate; each result row is a
    p x p solve.
    """
    p = len(states)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(by, group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(states)],
        *[F.sum(F.col(states[i]) * F.col(states[j])).alias(f"q_{i}_{j}") for i, j in pairs])
    wide = sums.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(
        group, F.array("n", *[f"s_{i}" for i in range(p)], *[f"q_{i}_{j}" for i, j in pairs]).alias("v")))).alias("g")
    ).filter(F.size("g") == 2).select(by, F.col("g")[0]["v"].alias("v0"), F.col("g")[1]["v"].alias("v1"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, v0, v1 in zip(pdf[by], pdf["v0"], pdf["v1"]):
                means, within, ns = [], np.zeros((p, p)), []
                for v in (np.asarray(v0, float), np.asarray(v1, float)):
                    mean = v[1: 1 + p] / v[0]
                    for (i, j), q in zip(pairs, v[1 + p:]):
                        within[i, j] += q - v[0] * mean[i] * mean[j]
                        within[j, i] = within[i, j]
                    means.append(mean)
                    ns.append(v[0])
                d = means[0] - means[1]
                n = ns[0] + ns[1]
                root = float(ns[0] * ns[1] / n * d @ np.linalg.solve(within, d))
                df2 = n - p - 1
                f = root * df2 / p
                out.append((key, int(n), 1 / (1 + root), root / (1 + root), root, root, f, p, int(df2),
                            f_tail(f, p, df2)))
            yield pd.DataFrame(out, columns=[by, "n", "wilks", "pillai", "hotelling", "roy", "f", "df1", "df2", "pvalue"])

    kind = rows.schema[by].dataType.simpleString()
    return wide.mapInPandas(
        test, f"{by} {kind}, n bigint, wilks double, pillai double, hotelling double, roy double, "
              "f double, df1 int, df2 bigint, pvalue double")


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f): regularised incomplete beta by its continued fraction."""
    if f <= 0:
        return 1.0
    a, b, x = d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(b, a, 1.0 - x)
    return _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x)
                     + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + even * d)
        c = 1.0 + even / c
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + odd * d)
        c = 1.0 + odd / c
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


# --- votes

def majority_vote(votes: DataFrame, keys: Sequence[str], action: str = "a", value: str = "q") -> DataFrame:
    """(keys, a, q): the most frequent action, the smallest on ties, and the mean
    value over the models that chose it."""
    per = votes.groupBy(*keys, action).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_v"))
    best = F.max(F.struct("_n", (-F.col(action)).alias("_neg"), "_v")).alias("b")
    return per.groupBy(*keys).agg(best).select(
        *keys, (-F.col("b._neg")).cast("int").alias(action), F.col("b._v").alias(value))


def td_error(r: Column, gamma: float, q_next: Column, q_now: Column) -> Column:
    return r + F.lit(gamma) * q_next - q_now
