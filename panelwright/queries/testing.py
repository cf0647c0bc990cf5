"""Penalised regressions and Q-change tests (survey P-*, G-04, G-09..G-11, D-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.features import FeatureMap
from panelwright.operators import ranking
from panelwright.operators.scaling import zscore_by
from panelwright.operators.transitions import transitions
from panelwright.plans import penalised, qtest
from panelwright.plans.changepoint import label
from panelwright.queries.base import END_SQL, query
from panelwright.queries.detection import narrow_transitions, scan_grid
from panelwright.queries.policies import GAMMA, scaled
from panelwright.queries.prepare import region_tau
from panelwright.queries.summaries import BASE
from panelwright.sources.tables import horizon, region_assignment, supplier_month

GRID = {"alpha": [0.001, 0.01, 0.05], "gamma": [3.0, 10.0]}
STATES = ["s1", "s2", "s3"]


def cluster_scaled(spark, sf):
    """Three states standardised within their region, as labelled transitions."""
    panel = supplier_month(spark, sf).join(region_assignment(spark, sf), "subject")
    panel = zscore_by(panel, "cluster", STATES, suffix="")
    return label(transitions(panel.drop("cluster"), STATES), region_assignment(spark, sf))


@query("P-04")
def penalised_fit(spark, sf):
    out = penalised.penalised_fit(cluster_scaled(spark, sf), 3, 0.01, 3.0, GRID["alpha"])
    return out.select("cluster", "alpha", F.transform("coef", lambda c: F.round(c, 6)).alias("coef"), "n_nonzero")


@query("P-05")
def penalised_cv(spark, sf):
    return penalised.penalised_cv(cluster_scaled(spark, sf), 3, GRID).withColumn("test_error", F.round("test_error", 6))


@query("G-04")
def sparse_change(spark, sf):
    grid = scan_grid(spark, sf, kappa_min=30, step=5)
    found, _ = penalised.detect_sparse_change(cluster_scaled(spark, sf), grid, 3, GRID, draws=500)
    return found


@query("D-27", f"""{BASE}, e AS (SELECT cluster, a, count(*) AS n, regr_syy(y1, s1) - regr_sxy(y1, s1) ** 2 / regr_sxx(y1, s1) AS sse
  FROM lab WHERE t >= cluster * 10 GROUP BY ALL), s AS (SELECT cluster, sum(sse) AS sse, sum(n) AS n FROM e GROUP BY cluster)
SELECT cluster, CAST(cluster * 10 AS INTEGER) AS tau, round(-sse / 1000, 4) AS loss, round(-sse / ({END_SQL} - cluster * 10) / 1000, 6) AS loss_per_step,
  round(sse / (n - 4), 4) AS sigma2, 4 AS df FROM s""")
def changepoint_quality(spark, sf):
    """Post-change fit per region; without a penalty it is least squares."""
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    q = penalised.changepoint_quality(rows, region_tau(spark, sf), horizon(spark, sf), 1, {"alpha": [0.0], "gamma": [3.0]}, cv=False)
    return q.select("cluster", "tau", F.round(F.col("loss") / 1000, 4).alias("loss"),
                    F.round(F.col("loss_per_step") / 1000, 6).alias("loss_per_step"),
                    F.round("sigma2", 4).alias("sigma2"), "df")


def q_test(spark, sf):
    return qtest.q_change_test(scaled(spark, sf), ["s1"], [20, 40, 60], horizon(spark, sf) - 1, FeatureMap("polynomial", degree=1),
                               gamma=0.5, draws=200, max_iter=40)


@query("G-09")
def q_change_statistics(spark, sf):
    return q_test(spark, sf).table.withColumn("value", F.round("value", 6))


@query("G-10")
def q_change_bootstrap(spark, sf):
    return q_test(spark, sf).summary.select("statistic", F.round("value", 6).alias("value"), "pvalue")


@query("G-11")
def select_basis(spark, sf):
    """Linear against quadratic state features, by test error on both sides of month 40."""
    trans = scaled(spark, sf)
    folds = ranking.contiguous_chunks(trans.select("subject").distinct(), "subject", 3)
    maps = [FeatureMap("rbf", dim=0), FeatureMap("polynomial", degree=2)]
    return qtest.select_basis(trans, folds, ["s1"], 40, maps, GAMMA).withColumn(
        "test_error", F.round("test_error", 6))
