"""Extension points (survey 2.14): user code in the place of a built-in step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import criteria
from panelwright.functions.features import FeatureMap
from panelwright.operators import ranking
from panelwright.operators.moments import Moments, fit_by, moments_by
from panelwright.plans import alternate, policy, segment
from panelwright.plans.changepoint import label
from panelwright.queries.base import TRANS, query
from panelwright.queries.detection import narrow_transitions
from panelwright.queries.policies import BW, FQI, GAMMA, LINEAR, cv_sql, linear_rows, scaled
from panelwright.queries.segmenting import em_sql, scaled_transitions, start
from panelwright.queries.summaries import FACTS, facts
from panelwright.sources.tables import horizon, region_assignment
from panelwright.session import materialize


@query("U-01", f"{FQI} SELECT CAST(a AS INTEGER) AS action, round(CASE a WHEN 1 THEN c1 ELSE c0 END, 4) AS c, round(CASE a WHEN 1 THEN b1 ELSE b0 END, 4) AS b "
       "FROM fq, (SELECT unnest([0, 1]) AS a) WHERE step = 4")
def own_regressor(spark, sf):
    """Four updates of fitted-Q iteration with MLlib's linear regression as the regressor."""
    model = policy.q_iteration_with(linear_rows(spark, sf), policy.mllib_linear, GAMMA, 4)
    return model.frame(spark).select("action", F.round(F.col("coef")[0], 4).alias("c"), F.round(F.col("coef")[1], 4).alias("b"))


@query("U-02", f"""WITH {TRANS}, m AS (SELECT t, avg(s1) AS m FROM trans GROUP BY t),
d AS (SELECT t, abs(m - lag(m) OVER (ORDER BY t)) AS d FROM m)
SELECT subject, 0 AS cluster, CAST((SELECT arg_max(t, d) FROM d) AS INTEGER) AS tau FROM trans GROUP BY subject""")
def own_detector(spark, sf):
    """A detector that names the step with the largest jump of the cluster's mean state."""
    def largest_jump(trans, assignment, grid):
        means = label(trans, assignment).groupBy("cluster", "t").agg(F.avg("s1").alias("m"))
        jump = F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("cluster").orderBy("t")))
        return means.withColumn("d", jump).groupBy("cluster").agg(F.max_by("t", "d").cast("int").alias("tau"))

    trans = narrow_transitions(spark, sf)
    zero = trans.select("subject").distinct().withColumn("cluster", F.lit(0))
    seg = alternate.PanelSegmenter(horizon(spark, sf), k=1, init="clusters", only_changepoints=True, max_iter=1, detector=largest_jump)
    return seg.fit(trans, assignment=zero).result


@query("U-03", f"WITH {TRANS}, {em_sql(2, 1)} SELECT subject, cluster, 0 AS tau FROM lab2_1")
def own_clusterer(spark, sf):
    """A clusterer that reassigns once from the parity of the subject."""
    def once(trans, tau, k, given):
        subj = segment.prepared(trans, 1, tau)
        return segment.cluster_by_dynamics(subj, 2, 1, start(2), max_iter=1)

    trans = narrow_transitions(spark, sf)
    zero = trans.select("subject").distinct().withColumn("tau", F.lit(0))
    seg = alternate.PanelSegmenter(horizon(spark, sf), k=2, only_clusters=True, max_iter=1, clusterer=once)
    return seg.fit(trans, zero).result


@query("U-04", f"""WITH {TRANS}, {cv_sql(3, 40, 'TRUE')},
kd AS (SELECT grp, a, x, r + {GAMMA} * greatest(c0 + b0 * z, c1 + b1 * z) - CASE WHEN a = 1 THEN c1 + b1 * x ELSE c0 + b0 * x END AS tde,
  row_number() OVER (ORDER BY subject, t) AS id FROM base JOIN df ON fold = grp),
kp AS (SELECT p.grp, abs(p.a - q.a) AS ka, exp(-{BW} * (p.x - q.x) ** 2) AS ks, p.tde * q.tde AS e FROM kd p JOIN kd q ON p.grp = q.grp AND p.id < q.id),
kl AS (SELECT grp, avg((1 + ka + ks + ka * ks) * e) AS loss FROM kp GROUP BY grp)
SELECT 0 AS param_id, round(avg(loss), 7) AS test_error FROM kl""")
def own_metric(spark, sf):
    """Cross-validation scored by the kernel loss instead of the mean square."""
    trans = scaled(spark, sf)
    folds = ranking.contiguous_chunks(trans.select("subject").distinct(), "subject", 3)
    errors = policy.select_linear_cv(
        trans, folds, ["s1"], [LINEAR], GAMMA, tol=1e-10, early_stopping=False,
        metric=policy.kernel_metric(["x1"], bandwidth=BW))
    return errors.withColumn("test_error", F.round("test_error", 7))


@query("U-05", f"{FACTS} SELECT round(loss - 3 * k * power(n, 0.25), 3) AS ic FROM f")
def own_penalty(spark, sf):
    """A penalty given as an expression."""
    return facts(spark, sf).select(F.round(criteria.criterion("3 * k * power(n, 0.25)"), 3).alias("ic"))


@query("U-06")
def small_solves(spark, sf):
    """Three-state regression per region: coefficients and the log determinant of the Gram."""
    rows = label(scaled_transitions(spark, sf), region_assignment(spark, sf))
    layout = Moments(3)

    def logdet(batches):
        for pdf in batches:
            xx, _, _ = layout.design(pdf[layout.names].to_numpy(float))
            yield pd.DataFrame({"cluster": pdf["cluster"], "logdet": np.linalg.slogdet(xx)[1]})

    dets = moments_by(rows, ["cluster"], 3).mapInPandas(logdet, "cluster int, logdet double")
    return fit_by(rows, "cluster", 3).join(dets, "cluster").select(
        "cluster", F.transform("coef", lambda c: F.round(c, 6)).alias("coef"), F.round("sse", 4).alias("sse"),
        F.round("logdet", 4).alias("logdet"))


@query("U-07", f"""WITH {TRANS}, x AS (SELECT a, (s1 / 100) ** 2 AS x, y1 / 100 AS r FROM trans)
SELECT CAST(a AS INTEGER) AS action, round(regr_intercept(r, x), 5) AS c, round(regr_slope(r, x), 5) AS b FROM x GROUP BY a""")
def own_features(spark, sf):
    """Features [1, s^2] given as a function from columns to columns."""
    squares = FeatureMap(custom=lambda states: [F.lit(1.0), states[0] * states[0]])
    rows = materialize(policy.policy_rows(scaled(spark, sf), ["s1"], squares), "policy-rows")
    model = policy.q_iteration_with(rows, policy.mllib_linear, GAMMA, 0)
    return model.frame(spark).select("action", F.round(F.col("coef")[0], 5).alias("c"), F.round(F.col("coef")[1], 5).alias("b"))
