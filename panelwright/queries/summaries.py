"""Joins, aggregates, windows, sorts, sets and scalar functions (survey 2.3 - 2.8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars
from panelwright.functions.criteria import PENALTIES, bonus, criterion, size_weight
from panelwright.operators import moments as mo
from panelwright.operators import ranking, summary
from panelwright.plans import segment
from panelwright.plans.changepoint import label
from panelwright.queries.base import END_SQL, N_SQL, PANEL, REGION, TRANS, query
from panelwright.queries.detection import narrow_transitions
from panelwright.queries.prepare import region_tau
from panelwright.sources.tables import (
    horizon, region_assignment, supplier_month, supplier_month_narrow, table)

BASE = f"WITH {TRANS}, {REGION}, lab AS (SELECT trans.*, cluster FROM trans JOIN region_of USING (subject))"

# --- joins


@query("C-01", f"WITH {PANEL}, {REGION} SELECT cluster, subject, t, s1 FROM panel JOIN region_of USING (subject)")
def label_join(spark, sf):
    return label(supplier_month_narrow(spark, sf), region_assignment(spark, sf)).select("cluster", "subject", "t", "s1")


@query("C-02", f"WITH {REGION} SELECT subject, cluster, CAST(cluster * 10 AS INTEGER) AS tau FROM region_of")
def changepoint_join(spark, sf):
    return region_assignment(spark, sf).join(region_tau(spark, sf), "cluster").select(
        "subject", "cluster", "tau")


LINE = """fit AS (SELECT cluster, a, regr_slope(y1, s1) AS b, regr_intercept(y1, s1) AS c FROM lab GROUP BY cluster, a)"""


def region_lines(spark, sf):
    """(cluster, a, c, b): one line per region and action."""
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    return rows.groupBy("cluster", "a").agg(
        F.regr_intercept("y1", "s1").alias("c"), F.regr_slope("y1", "s1").alias("b"))


@query("C-03", f"""{BASE}, {LINE} SELECT subject, fit.cluster, round(sum((y1 - c - b * s1) ** 2) / 1e4, 3) AS err
FROM trans JOIN fit USING (a) GROUP BY subject, fit.cluster""")
def score_all_clusters(spark, sf):
    """Every subject against every region's model, from the subject's sums alone."""
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    coefs = pooled_coefs(subj, region_assignment(spark, sf))
    errs = F.array(*[F.struct(F.lit(k).alias("cluster"), e.alias("err"))
                     for k, e in zip(coefs, segment.error_columns(list(coefs.values()), 1))])
    return subj.select("subject", F.inline(errs)).select(
        "subject", "cluster", F.round(F.col("err") / 1e4, 3).alias("err"))


def pooled_coefs(subj, assignment):
    """Unweighted coefficients per cluster from the subjects' sums: a dict of K small matrices."""
    layout = mo.Moments(1)
    per = subj.join(assignment, "subject").groupBy("cluster").agg(*[F.sum(c).alias(c) for c in layout.names])
    got = sorted(per.collect(), key=lambda r: r["cluster"])
    xx, xy, _ = layout.design(np.array([[r[c] for c in layout.names] for r in got]))
    return dict(zip([r["cluster"] for r in got], mo.min_norm_solve(xx, xy)))


RESULTS = """res AS (SELECT o_orderstatus AS setting, o_orderpriority AS policy,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS seed,
  CAST(count(*) AS DOUBLE) AS n_orders, CAST(round(sum(o_totalprice)) AS DOUBLE) AS total FROM orders GROUP BY 1, 2, 3),
lng AS (SELECT setting, policy, seed, 'n_orders' AS measure, n_orders AS value FROM res
  UNION ALL SELECT setting, policy, seed, 'total', total FROM res),
diff AS (SELECT l.*, CASE WHEN l.policy = '1-URGENT' THEN 0.0 ELSE r.value - l.value END AS diff FROM lng l
  LEFT JOIN (SELECT setting, seed, measure, value FROM lng WHERE policy = '1-URGENT') r
  ON l.setting = r.setting AND l.seed = r.seed AND l.measure = r.measure)"""


def results(spark, sf):
    """(setting, policy, seed, n_orders, total): orders as a table of runs."""
    seed = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("seed")
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("setting"), F.col("o_orderpriority").alias("policy"), seed
    ).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.round(F.sum("o_totalprice")).alias("total"))


def long_results(spark, sf):
    return summary.melt(results(spark, sf), ["setting", "policy", "seed"], ["n_orders", "total"])


def differences(spark, sf):
    return summary.difference_to_reference(long_results(spark, sf), "1-URGENT")


@query("C-05", f"WITH {RESULTS} SELECT * FROM diff")
def reference_join(spark, sf):
    return differences(spark, sf)


@query("C-06", f"""WITH {RESULTS} SELECT setting, policy, round(avg(n_orders), 6) AS mean, count(*) AS size,
  round(stddev_samp(n_orders), 6) AS std FROM res GROUP BY ALL""")
def mean_size_std(spark, sf):
    return summary.mean_se(results(spark, sf), ["setting", "policy"], "n_orders").select(
        "setting", "policy", F.round("mean", 6).alias("mean"), "size", F.round("std", 6).alias("std"))


@query("C-07", f"""WITH {PANEL}, {REGION} SELECT te.cluster AS k_test, tr.cluster AS k_train, count(*) AS n, sum(s1) AS s
FROM panel JOIN region_of te USING (subject) JOIN (SELECT subject, CAST(subject % 3 AS INTEGER) AS cluster FROM region_of) tr USING (subject)
GROUP BY ALL""")
def cluster_pairing(spark, sf):
    """Rows by (test label, train label); pairs without rows do not appear."""
    test = region_assignment(spark, sf).select("subject", F.col("cluster").alias("k_test"))
    train = region_assignment(spark, sf).select("subject", (F.col("subject") % 3).cast("int").alias("k_train"))
    return supplier_month_narrow(spark, sf).join(test, "subject").join(train, "subject").groupBy(
        "k_test", "k_train").agg(F.count(F.lit(1)).alias("n"), F.sum("s1").alias("s"))


@query("C-08", f"{BASE}, {LINE} SELECT subject, t, lab.a, round(c + b * s1, 4) AS q FROM lab JOIN fit USING (cluster, a)")
def model_lookup(spark, sf):
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    return rows.join(region_lines(spark, sf), ["cluster", "a"]).select(
        "subject", "t", "a", F.round(F.col("c") + F.col("b") * F.col("s1"), 4).alias("q"))


@query("C-11", f"""{BASE}, {LINE}, m AS (SELECT cluster, max(c) FILTER (a = 0) AS c0, max(b) FILTER (a = 0) AS b0,
  max(c) FILTER (a = 1) AS c1, max(b) FILTER (a = 1) AS b1 FROM fit GROUP BY cluster)
SELECT x.cluster AS i, y.cluster AS j, round(sqrt((x.c0-y.c0)**2 + (x.b0-y.b0)**2 + (x.c1-y.c1)**2 + (x.b1-y.b1)**2), 4) AS dist
FROM m x JOIN m y ON x.cluster < y.cluster""")
def model_distance(spark, sf):
    """Distance of every two cluster models; the model table has one row per cluster."""
    wide = region_lines(spark, sf).groupBy("cluster").agg(*[
        F.max(F.when(F.col("a") == a, F.col(c))).alias(f"{c}{a}") for a in (0, 1) for c in "cb"])
    x, y = wide.alias("x"), wide.alias("y")
    sq = F.lit(0.0)
    for c in ("c0", "b0", "c1", "b1"):
        sq = sq + F.pow(F.col(f"x.{c}") - F.col(f"y.{c}"), F.lit(2))
    return x.join(y, F.col("x.cluster") < F.col("y.cluster")).select(
        F.col("x.cluster").alias("i"), F.col("y.cluster").alias("j"), F.round(F.sqrt(sq), 4).alias("dist")
    ).orderBy(F.col("dist").desc())


@query("C-13", f"""WITH {REGION} SELECT CAST(k AS INTEGER) AS cluster FROM (SELECT unnest(range(8)) AS k)
WHERE k NOT IN (SELECT cluster FROM region_of)""")
def empty_clusters(spark, sf):
    used = region_assignment(spark, sf).select("cluster").distinct()
    return spark.range(8).select(F.col("id").cast("int").alias("cluster")).join(used, "cluster", "left_anti")


# --- aggregates

@query("D-01", f"""{BASE} SELECT cluster, a, count(*)::DOUBLE AS n, sum(s1) AS s, sum(y1) AS y, sum(s1*s1) AS ss, sum(s1*y1) AS sy,
  sum(y1*y1) AS yy FROM lab GROUP BY cluster, a""")
def gram_aggregate(spark, sf):
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    m = mo.moments_by(rows, ["cluster"], 1)
    names = {"n": "n", "s0": "s", "y0": "y", "s0s0": "ss", "s0y0": "sy", "y0y0": "yy"}
    zero = F.struct(F.lit(0).alias("a"), *[(F.col(f"m_{k}") - F.col(f"k_{k}")).alias(v) for k, v in names.items()])
    one = F.struct(F.lit(1).alias("a"), *[F.col(f"k_{k}").alias(v) for k, v in names.items()])
    return m.select("cluster", F.inline(F.array(zero, one)))


SSE1 = "regr_syy(y1, s1) - regr_sxy(y1, s1) ** 2 / regr_sxx(y1, s1)"


@query("D-02", f"""{BASE}, e AS (SELECT cluster, a, regr_intercept(y1, s1) AS c, regr_slope(y1, s1) AS b, {SSE1} AS sse FROM lab GROUP BY cluster, a)
SELECT cluster, round(max(c) FILTER (a = 0), 5) AS c0, round(max(c) FILTER (a = 1) - max(c) FILTER (a = 0), 5) AS ca,
  round(max(b) FILTER (a = 0), 6) AS b0, round(max(b) FILTER (a = 1) - max(b) FILTER (a = 0), 6) AS ba, round(sum(sse), 2) AS sse FROM e GROUP BY cluster""")
def segment_least_squares(spark, sf):
    """[1, A, S, A*S] coefficients and SSE per region, from the Gram."""
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    return mo.fit_by(rows, "cluster", 1).select(
        "cluster", F.round(F.col("coef")[0], 5).alias("c0"), F.round(F.col("coef")[1], 5).alias("ca"),
        F.round(F.col("coef")[2], 6).alias("b0"), F.round(F.col("coef")[3], 6).alias("ba"),
        F.round("sse", 2).alias("sse"))


WSUM = """wlab AS (SELECT lab.*, 1.0::DOUBLE / count(*) OVER (PARTITION BY subject) AS w FROM lab),
wm AS (SELECT cluster, a, sum(w) AS n, sum(w*s1) AS s, sum(w*y1) AS y, sum(w*s1*s1) AS ss, sum(w*s1*y1) AS sy, sum(w*y1*y1) AS yy FROM wlab GROUP BY cluster, a),
wf AS (SELECT cluster, a, (n*sy - s*y) / (n*ss - s*s) AS b, (y - (n*sy - s*y) / (n*ss - s*s) * s) / n AS c FROM wm)"""


@query("D-03", f"""{BASE}, {WSUM} SELECT cluster, round(max(c) FILTER (a = 0), 5) AS c0, round(max(b) FILTER (a = 0), 6) AS b0,
  round(max(c) FILTER (a = 1), 5) AS c1, round(max(b) FILTER (a = 1), 6) AS b1 FROM wf GROUP BY cluster""")
def weighted_least_squares(spark, sf):
    """Every subject counts once: sums per subject divided by its steps."""
    subj = segment.subject_moments(narrow_transitions(spark, sf), 1).join(region_assignment(spark, sf), "subject")
    names = mo.Moments(1).names
    weighted = subj.groupBy("cluster").agg(*[F.sum(F.col(c) / F.col("m_n")).alias(c) for c in names])
    return mo.fit_rows(weighted, "cluster", 1).select(
        "cluster", F.round(F.col("coef")[0], 5).alias("c0"), F.round(F.col("coef")[2], 6).alias("b0"),
        F.round(F.col("coef")[0] + F.col("coef")[1], 5).alias("c1"),
        F.round(F.col("coef")[2] + F.col("coef")[3], 6).alias("b1"))


@query("D-04", f"WITH {PANEL} SELECT count(DISTINCT subject) AS n, count(DISTINCT t) - 1 AS t FROM panel")
def distinct_counts(spark, sf):
    return supplier_month_narrow(spark, sf).agg(
        F.countDistinct("subject").alias("n"), (F.countDistinct("t") - 1).alias("t"))


@query("D-05", f"WITH {REGION} SELECT cluster, count(*) AS n FROM region_of GROUP BY cluster")
def label_counts(spark, sf):
    return summary.value_counts(region_assignment(spark, sf), "cluster")


@query("D-06", f"WITH {REGION} SELECT cluster, min(subject) AS first_subject, count(*) AS n FROM region_of GROUP BY cluster")
def first_index(spark, sf):
    return summary.first_index(region_assignment(spark, sf))


@query("D-08", f"""WITH {PANEL}, {REGION} SELECT subject, round(avg(s1), 6) AS mean FROM panel JOIN region_of USING (subject)
WHERE t >= cluster * 10 GROUP BY subject""")
def subject_mean_after(spark, sf):
    tau = region_assignment(spark, sf).join(region_tau(spark, sf), "cluster")
    lev = segment.subject_levels(supplier_month_narrow(spark, sf), ["s1"], tau)
    return lev.select("subject", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@query("D-09", f"""WITH {PANEL}, {REGION} SELECT cluster, round(avg(s1), 6) AS mean, round(var_pop(s1), 4) AS var
FROM panel JOIN region_of USING (subject) GROUP BY cluster""")
def cluster_mean_var(spark, sf):
    return label(supplier_month_narrow(spark, sf), region_assignment(spark, sf)).groupBy("cluster").agg(
        F.round(F.avg("s1"), 6).alias("mean"), F.round(F.var_pop("s1"), 4).alias("var"))


@query("D-10", f"""WITH {PANEL}, {REGION} SELECT cluster, round(avg(s1) FILTER (t < cluster * 10), 6) AS s1_before,
  round(avg(s1) FILTER (t >= cluster * 10), 6) AS s1_after, round(avg(s1 ** 3) FILTER (t < cluster * 10), 2) AS cube_before,
  round(avg(s1 ** 3) FILTER (t >= cluster * 10), 2) AS cube_after FROM panel JOIN region_of USING (subject) GROUP BY cluster""")
def before_after_means(spark, sf):
    rows = label(supplier_month_narrow(spark, sf), region_assignment(spark, sf)).join(
        region_tau(spark, sf), "cluster").withColumn("cube", F.pow("s1", F.lit(3)))
    out = summary.before_after(rows, ["s1", "cube"])
    return out.select("cluster", F.round("s1_before", 6).alias("s1_before"), F.round("s1_after", 6).alias("s1_after"),
                      F.round("cube_before", 2).alias("cube_before"), F.round("cube_after", 2).alias("cube_after"))


@query("D-11", """SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT",
  count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
  count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW"
FROM orders GROUP BY 1""")
def cross_tab(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return summary.cross_tab(rows, "status", "o_orderpriority",
                             ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("D-12", f"WITH {REGION} SELECT cluster, list_sort(list(DISTINCT CAST(subject % 4 AS INTEGER))) AS present FROM region_of GROUP BY cluster")
def presence_lookup(spark, sf):
    rows = region_assignment(spark, sf).withColumn("tau", (F.col("subject") % 4).cast("int"))
    return summary.presence(rows, "cluster", "tau")


@query("D-13", f"""WITH {RESULTS} SELECT setting, policy, round(avg(n_orders), 6) AS mean, count(*) AS size, round(stddev_samp(n_orders), 6) AS std,
  round(stddev_samp(n_orders) / sqrt(count(*)), 6) AS se FROM res GROUP BY ALL""")
def mean_size_se(spark, sf):
    return summary.mean_se(results(spark, sf), ["setting", "policy"], "n_orders").select(
        "setting", "policy", F.round("mean", 6).alias("mean"), "size", F.round("std", 6).alias("std"),
        F.round("se", 6).alias("se"))


@query("D-14", f"""WITH {RESULTS} SELECT setting, policy, printf('%.3f (%.3f)', avg(n_orders), stddev_samp(n_orders) / sqrt(count(*))) AS text
FROM res GROUP BY ALL""")
def formatted_mean_se(spark, sf):
    return summary.mean_se_table(results(spark, sf), ["setting", "policy"], "n_orders")


@query("D-15", f"""WITH {RESULTS} SELECT setting, policy, measure, round(avg(diff), 6) AS avg_diff, round(stddev_samp(diff) / sqrt(count(*)), 6) AS se_diff
FROM diff GROUP BY ALL""")
def difference_summary(spark, sf):
    out = summary.mean_se(differences(spark, sf), ["setting", "policy", "measure"], "diff")
    return out.select("setting", "policy", "measure", F.round("mean", 6).alias("avg_diff"),
                      F.round("se", 6).alias("se_diff"))


@query("D-16", f"""WITH {TRANS}, per AS (SELECT subject, sum(r * power(0.9, t - 40)) AS d FROM trans WHERE t >= 40 GROUP BY subject)
SELECT round(avg(d), 6) AS discounted FROM per""")
def discounted_return(spark, sf):
    out = summary.discounted_return(narrow_transitions(spark, sf), 0.9, 40)
    return out.select(F.round("discounted", 6).alias("discounted"))


@query("D-17", f"WITH {TRANS} SELECT round(avg(r), 6) AS average FROM trans WHERE t >= 40")
def average_reward(spark, sf):
    return summary.discounted_return(narrow_transitions(spark, sf), 0.9, 40).select(F.round("average", 6).alias("average"))


@query("D-18", f"""{BASE}, per AS (SELECT subject, sum(r * power(0.9, t - 40)) AS d, sum(r) AS s, count(*) AS n FROM lab
  WHERE t >= 40 AND cluster < (SELECT max(cluster) FROM region_of) GROUP BY subject)
SELECT round(sum(s) / sum(n), 6) AS average, round(avg(d), 6) AS discounted FROM per""")
def subset_return(spark, sf):
    """Returns without the last cluster."""
    labels = region_assignment(spark, sf)
    last = labels.agg(F.max("cluster")).scalar()
    rows = label(narrow_transitions(spark, sf), labels).filter(F.col("cluster") < last)
    out = summary.discounted_return(rows, 0.9, 40)
    return out.select(F.round("average", 6).alias("average"), F.round("discounted", 6).alias("discounted"))


@query("D-19", f"""{BASE} SELECT CAST(t // 25 AS INTEGER) AS batch, cluster, round(avg(r), 6) AS reward, count(*) AS n FROM lab
GROUP BY GROUPING SETS ((t // 25), (t // 25, cluster))""")
def batch_report(spark, sf):
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf)).withColumn(
        "batch", F.floor(F.col("t") / 25).cast("int"))
    return rows.groupingSets([["batch"], ["batch", "cluster"]], "batch", "cluster").agg(
        F.round(F.avg("r"), 6).alias("reward"), F.count(F.lit(1)).alias("n"))


@query("D-20", f"""{BASE}, v AS (SELECT cluster AS k_test, CAST(subject % 3 AS INTEGER) AS k_train, subject, avg(r) AS value FROM lab GROUP BY ALL)
SELECT k_test, k_train, round(avg(value), 6) AS value FROM v GROUP BY GROUPING SETS ((), (k_test, k_train))""")
def ope_mean(spark, sf):
    rows = label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    per = rows.groupBy(F.col("cluster").alias("k_test"), (F.col("subject") % 3).cast("int").alias("k_train"), "subject").agg(
        F.avg("r").alias("value"))
    return per.groupingSets([[], ["k_test", "k_train"]], "k_test", "k_train").agg(F.round(F.avg("value"), 6).alias("value"))


@query("D-21", """WITH y AS (SELECT o_orderpriority AS method, year(o_orderdate) AS horizon, count(*)::DOUBLE AS value FROM orders
  WHERE NOT (o_orderpriority = '5-LOW' AND year(o_orderdate) = 1997) GROUP BY ALL),
w AS (SELECT method, max(value) FILTER (horizon = 1996) AS "1996", max(value) FILTER (horizon = 1997) AS "1997", max(value) FILTER (horizon = 1998) AS "1998" FROM y GROUP BY method)
SELECT method, "1996", "1997", "1998", round((coalesce("1996", 0) + coalesce("1997", 0) + coalesce("1998", 0)) /
  (("1996" IS NOT NULL)::INT + ("1997" IS NOT NULL)::INT + ("1998" IS NOT NULL)::INT), 6) AS average FROM w""")
def method_horizon_table(spark, sf):
    rows = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("horizon")
    ).agg(F.count(F.lit(1)).cast("double").alias("value")).filter("not (method = '5-LOW' and horizon = 1997)")
    return summary.horizon_table(rows, "method", "horizon", "value", [1996, 1997, 1998]).withColumn(
        "average", F.round("average", 6))


@query("D-22", f"WITH {PANEL}, {REGION} SELECT cluster, round(quantile_cont(s1, 0.99), 6) AS q FROM panel JOIN region_of USING (subject) GROUP BY cluster")
def percentile_linear(spark, sf):
    rows = label(supplier_month_narrow(spark, sf), region_assignment(spark, sf))
    return ranking.quantiles(rows, ["cluster"], "s1", {"q": 0.99}).select("cluster", F.round("q", 6).alias("q"))


@query("D-23", f"""WITH {PANEL} SELECT round(quantile_cont(s1, 0.05), 6) AS s1_lo, round(quantile_cont(s1, 0.95), 6) AS s1_hi,
  round(quantile_cont(s3, 0.05), 7) AS s3_lo, round(quantile_cont(s3, 0.95), 7) AS s3_hi FROM panel""")
def state_bounds(spark, sf):
    """5% and 95% of every state, the states as groups of one long table."""
    long = supplier_month(spark, sf).unpivot(["subject", "t"], ["s1", "s3"], "state", "x")
    q = ranking.quantiles(long, ["state"], "x", {"lo": 0.05, "hi": 0.95})
    return q.agg(*[F.max(F.when(F.col("state") == c, F.round(e, 6 if c == "s1" else 7))).alias(f"{c}_{e}")
                   for c in ("s1", "s3") for e in ("lo", "hi")])


@query("D-24", f"""WITH {PANEL}, {REGION}, m AS (SELECT cluster, avg(s1) + 50 AS stat FROM panel JOIN region_of USING (subject) GROUP BY cluster)
SELECT cluster, round(avg(CASE WHEN stat < s1 THEN 1.0 ELSE 0.0 END), 8) AS pvalue FROM m, panel GROUP BY cluster""")
def empirical_pvalue(spark, sf):
    """Share of all panel values above each region's statistic, without pairing
    statistics and values: both are ranked once on the value axis."""
    panel = supplier_month_narrow(spark, sf)
    stats = label(panel, region_assignment(spark, sf)).groupBy("cluster").agg((F.avg("s1") + 50).alias("stat"))
    return summary.exceedance(stats, "stat", panel.select(F.col("s1").alias("null")), "null").select(
        "cluster", F.round("pvalue", 8).alias("pvalue"))


QUAL = f"""{BASE}, {WSUM}, e AS (SELECT wlab.cluster, subject, w, (y1 - c - b * s1) ** 2 AS e2 FROM wlab JOIN wf USING (cluster, a))"""


@query("D-25", f"{QUAL} SELECT round(-sum(w * e2), 3) AS loss FROM e")
def cluster_quality_total(spark, sf):
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    q = segment.cluster_quality(subj, region_assignment(spark, sf), 1)
    return q.agg(F.round(F.sum("loss_normalized"), 3).alias("loss"))


@query("D-26", f"{QUAL} SELECT cluster, round(-sum(w * e2), 3) AS loss_normalized, round(-sum(e2), 1) AS loss_unnormalized FROM e GROUP BY cluster")
def cluster_quality_each(spark, sf):
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    q = segment.cluster_quality(subj, region_assignment(spark, sf), 1)
    return q.select("cluster", F.round("loss_normalized", 3).alias("loss_normalized"),
                    F.round("loss_unnormalized", 1).alias("loss_unnormalized"))


FACTS = f"""{QUAL}, f AS (SELECT 5.0::DOUBLE AS k, (SELECT count(*) FROM region_of)::DOUBLE AS n, {N_SQL}::DOUBLE AS t, 2.0::DOUBLE AS c,
  (SELECT sum({END_SQL} - cluster * 10) FROM region_of)::DOUBLE AS sum_len, (SELECT -sum(w * e2) FROM e) AS loss)"""


def facts(spark, sf):
    """One row with all that the criterion needs."""
    labels = region_assignment(spark, sf).join(region_tau(spark, sf), "cluster")
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    loss = segment.cluster_quality(subj, labels, 1).agg(F.sum("loss_normalized")).scalar()
    n_times = horizon(spark, sf)
    length = F.lit(n_times - 1) - F.col("tau")
    return labels.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(length).cast("double").alias("sum_len"),
        F.avg(length).alias("mean_len")
    ).select("*", F.lit(5.0).alias("k"), F.lit(float(n_times)).alias("t"), F.lit(2.0).alias("c"), loss.alias("loss"))


@query("D-28", f"""{FACTS} SELECT p.name AS penalty, round(CASE WHEN name = 'BIC' THEN -n * ln(-loss / n) ELSE loss END - CASE name
  WHEN 'log' THEN k * ln(sum_len) WHEN 'sqrt' THEN k * sqrt(sum_len) WHEN 'logN' THEN k * ln(n) WHEN 'Nlog(NT)/T' THEN c * k * n * ln(n * t) / t
  WHEN 'sqrt{{Nlog(NT)/T}}' THEN c * k * sqrt(n * ln(n * t) / t) WHEN 'sqrtN' THEN c * k * sqrt(n) ELSE k * ln(n) END, 3) AS ic
FROM f, (SELECT unnest(['log', 'sqrt', 'logN', 'Nlog(NT)/T', 'sqrt{{Nlog(NT)/T}}', 'sqrtN', 'BIC']) AS name) p""")
def information_criterion(spark, sf):
    row = facts(spark, sf)
    each = F.array(*[F.struct(F.lit(p).alias("penalty"), F.round(criterion(p), 3).alias("ic")) for p in PENALTIES])
    return row.select(F.inline(each))


@query("D-29", f"""{FACTS}, s AS (SELECT sum({END_SQL} - cluster * 10)::DOUBLE AS wl FROM region_of)
SELECT round(k * ln(sum_len), 6) AS penalty, round(sum_len / ln(sum_len), 6) AS h, round(sqrt(sum_len / ln(sum_len)), 6) AS h_sqrt,
  round(wl / (n * t) * sum_len / ln(sum_len), 6) AS c_term FROM f, s""")
def criterion_report(spark, sf):
    """Penalty and bonus terms; size-weighted segment lengths equal their sum over subjects."""
    m = F.col("sum_len")
    return facts(spark, sf).select(
        F.round(F.col("k") * F.ln(m), 6).alias("penalty"), F.round(bonus(m), 6).alias("h"),
        F.round(bonus(m, "sqrt"), 6).alias("h_sqrt"),
        F.round(size_weight(m, F.col("n"), F.col("t")) * bonus(m), 6).alias("c_term"))


@query("D-30", f"""WITH {REGION}, c AS (SELECT cluster AS a, CAST(subject % 3 AS INTEGER) AS b, count(*)::DOUBLE AS n FROM region_of GROUP BY ALL),
s AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n) AS n FROM c), sa AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY a)),
sb AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY b))
SELECT round((sij - sa.v * sb.v / (n * (n - 1) / 2)) / ((sa.v + sb.v) / 2 - sa.v * sb.v / (n * (n - 1) / 2)), 8) AS ari, CAST(n AS BIGINT) AS n FROM s, sa, sb""")
def adjusted_rand_index(spark, sf):
    a = region_assignment(spark, sf)
    b = a.select("subject", (F.col("subject") % 3).cast("int").alias("cluster"))
    return summary.adjusted_rand(a, b).select(F.round("ari", 8).alias("ari"), "n")


@query("D-31", f"""WITH {REGION} SELECT round(avg(CASE WHEN cluster <> 0 THEN abs(subject % 50 - cluster * 10) / (cluster * 10.0) END), 8) AS err,
  count(*) FILTER (cluster <> 0) AS n_used, count(*) FILTER (cluster = 0) AS n_zero FROM region_of""")
def relative_error(spark, sf):
    labels = region_assignment(spark, sf)
    true = labels.select("subject", (F.col("cluster") * 10).alias("tau"))
    pred = labels.select("subject", (F.col("subject") % 50).alias("tau"))
    return summary.relative_error(pred, true).select(F.round("err", 8).alias("err"), "n_used", "n_zero")


@query("D-35", f"""WITH {PANEL} SELECT round(avg(s1), 6) AS m1, round(avg(s3), 8) AS m3, round(covar_samp(s1, s1), 4) AS c11,
  round(covar_samp(s1, s3), 6) AS c13, round(covar_samp(s3, s3), 8) AS c33 FROM panel""")
def state_covariance(spark, sf):
    return supplier_month(spark, sf).agg(
        F.round(F.avg("s1"), 6).alias("m1"), F.round(F.avg("s3"), 8).alias("m3"),
        F.round(F.covar_samp("s1", "s1"), 4).alias("c11"), F.round(F.covar_samp("s1", "s3"), 6).alias("c13"),
        F.round(F.covar_samp("s3", "s3"), 8).alias("c33"))


@query("D-36", f"""WITH {PANEL}, {REGION}, g AS (SELECT cluster, t >= 40 AS after, count(*)::DOUBLE AS n, avg(s1) AS m1, avg(s3) AS m3,
  covar_pop(s1, s1) * count(*) AS e11, covar_pop(s1, s3) * count(*) AS e13, covar_pop(s3, s3) * count(*) AS e33
  FROM panel JOIN region_of USING (subject) GROUP BY ALL),
j AS (SELECT a.cluster, a.n + b.n AS n, a.n * b.n / (a.n + b.n) AS w, a.m1 - b.m1 AS d1, a.m3 - b.m3 AS d3, a.e11 + b.e11 AS e11, a.e13 + b.e13 AS e13,
  a.e33 + b.e33 AS e33 FROM g a JOIN g b ON a.cluster = b.cluster AND a.after AND NOT b.after),
r AS (SELECT cluster, n, w * (d1 * d1 * e33 - 2 * d1 * d3 * e13 + d3 * d3 * e11) / (e11 * e33 - e13 * e13) AS root FROM j)
SELECT cluster, CAST(n AS BIGINT) AS n, round(1 / (1 + root), 8) AS wilks, round(root / (1 + root), 8) AS pillai, round(root, 8) AS hotelling,
  round(root * (n - 3) / 2, 4) AS f FROM r""")
def manova(spark, sf):
    rows = label(supplier_month(spark, sf), region_assignment(spark, sf)).withColumn("after", F.col("t") >= 40)
    return summary.manova(rows, ["s1", "s3"], "after", "cluster").select(
        "cluster", "n", F.round("wilks", 8).alias("wilks"), F.round("pillai", 8).alias("pillai"),
        F.round("hotelling", 8).alias("hotelling"), F.round("f", 4).alias("f"))


@query("D-37", f"""WITH {RESULTS}, g AS (SELECT setting, policy, measure, avg(diff) AS m, stddev_samp(diff) / sqrt(count(*)) AS se FROM diff GROUP BY ALL)
SELECT setting, policy, max(printf('%.4f (%.4f)', m, se)) FILTER (measure = 'n_orders') AS n_orders,
  max(printf('%.4f (%.4f)', m, se)) FILTER (measure = 'total') AS total FROM g GROUP BY ALL""")
def melt_and_pivot(spark, sf):
    """Wide runs to long measures and back to one text column per measure."""
    text = summary.mean_se_table(differences(spark, sf), ["setting", "policy", "measure"], "diff", 4)
    return text.groupBy("setting", "policy").pivot("measure", ["n_orders", "total"]).agg(F.max("text"))


# --- windows

@query("E-02", f"WITH {PANEL} SELECT subject, t, round(avg(s1) OVER (PARTITION BY subject ORDER BY t), 6) AS fwd FROM panel")
def forward_mean(spark, sf):
    w = Window.partitionBy("subject").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return supplier_month_narrow(spark, sf).select("subject", "t", F.round(F.avg("s1").over(w), 6).alias("fwd"))


@query("E-03", f"""WITH {PANEL} SELECT subject, t, round(avg(s1) OVER (PARTITION BY subject ORDER BY t
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bwd FROM panel""")
def backward_mean(spark, sf):
    w = Window.partitionBy("subject").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return supplier_month_narrow(spark, sf).select("subject", "t", F.round(F.avg("s1").over(w), 6).alias("bwd"))


ERRS = f"{BASE}, {LINE}, err AS (SELECT subject, fit.cluster, sum((y1 - c - b * s1) ** 2) AS err FROM trans JOIN fit USING (a) GROUP BY ALL)"


@query("E-08", f"""{ERRS}, rk AS (SELECT cluster, subject, err, row_number() OVER (PARTITION BY cluster ORDER BY err, subject) AS rn FROM err)
SELECT cluster, subject, CAST(rn AS INTEGER) AS rn, round(err / 1e4, 3) AS err FROM rk WHERE rn <= 3""")
def repair_candidates(spark, sf):
    """The best-fitting subjects of every cluster, as the empty-cluster repair ranks them.

    Kept as the smallest three of a struct aggregate, so partial results merge
    on the map side and no cluster's subjects are sorted in one task.
    """
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    coefs = pooled_coefs(subj, region_assignment(spark, sf))
    errs = F.array(*[F.struct(F.lit(k).alias("cluster"), e.alias("err"))
                     for k, e in zip(coefs, segment.error_columns(list(coefs.values()), 1))])
    rows = subj.select("subject", F.inline(errs))
    return summary.smallest(rows, "cluster", ["err", "subject"], 3).select(
        "cluster", "subject", "rn", F.round(F.col("err") / 1e4, 3).alias("err"))


@query("E-09", f"WITH {TRANS} SELECT subject, count(*) AS steps, round(1.0 / count(*), 8) AS w FROM trans GROUP BY subject")
def steps_per_subject(spark, sf):
    """The weight 1/t_i, once per subject."""
    return narrow_transitions(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("steps")).select(
        "subject", "steps", F.round(1 / F.col("steps"), 8).alias("w"))


@query("E-10", f"""WITH {TRANS}, b AS (SELECT CAST(t // 25 AS INTEGER) AS batch, sum(r) AS s, count(*) AS n FROM trans GROUP BY 1)
SELECT batch, round(s / n, 6) AS epoch_mean, round(sum(s) OVER (ORDER BY batch) / sum(n) OVER (ORDER BY batch), 6) AS running_mean FROM b""")
def batch_trend(spark, sf):
    """Mean of every batch and mean since the start; the window runs over batches, not rows."""
    per = narrow_transitions(spark, sf).groupBy(F.floor(F.col("t") / 25).cast("int").alias("batch")).agg(
        F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("batch", F.round(F.col("s") / F.col("n"), 6).alias("epoch_mean"),
                      F.round(F.sum("s").over(w) / F.sum("n").over(w), 6).alias("running_mean"))


@query("E-12", f"""WITH {RESULTS} SELECT setting, policy, seed, total, min(total) OVER w AS best_before,
  abs(total - min(total) OVER w) < 1e3 AS settled FROM res
  WINDOW w AS (PARTITION BY setting, policy ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def convergence_delta(spark, sf):
    """Loss of every iteration of a run next to the smallest loss before it."""
    w = Window.partitionBy("setting", "policy").orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("total").over(w)
    return results(spark, sf).select("setting", "policy", "seed", "total", best.alias("best_before"),
                                     (F.abs(F.col("total") - best) < 1e3).alias("settled"))


# --- sort, limit, top-k

@query("F-01", f"WITH {RESULTS}, g AS (SELECT policy, avg(total) AS ic FROM res GROUP BY policy) SELECT policy, round(ic, 4) AS ic FROM g ORDER BY g.ic DESC, policy LIMIT 1")
def argmax_model(spark, sf):
    """The model of largest criterion, the first on ties."""
    g = results(spark, sf).groupBy("policy").agg(F.avg("total").alias("ic"))
    return g.orderBy(F.col("ic").desc(), "policy").limit(1).select("policy", F.round("ic", 4).alias("ic"))


@query("F-02", f"{ERRS} SELECT subject, arg_min(cluster, ROW(err, cluster)) AS cluster, round(min(err) / 1e4, 3) AS err FROM err GROUP BY subject")
def argmin_cluster(spark, sf):
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    coefs = pooled_coefs(subj, region_assignment(spark, sf))
    errs = F.array(*[F.struct(e.alias("err"), F.lit(k).alias("cluster"))
                     for k, e in zip(coefs, segment.error_columns(list(coefs.values()), 1))])
    best = subj.select("subject", F.array_min(errs).alias("b"))
    return best.select("subject", F.col("b.cluster").alias("cluster"), F.round(F.col("b.err") / 1e4, 3).alias("err"))


@query("F-03", f"WITH {RESULTS}, g AS (SELECT seed AS param_id, round(stddev_samp(n_orders), 6) AS err FROM res GROUP BY seed) SELECT param_id, err FROM g ORDER BY err, param_id LIMIT 1")
def argmin_cv_error(spark, sf):
    """The parameter of smallest error, the first on ties."""
    g = results(spark, sf).groupBy(F.col("seed").alias("param_id")).agg(F.round(F.stddev_samp("n_orders"), 6).alias("err"))
    return g.orderBy(F.col("err").asc_nulls_last(), "param_id").limit(1)


@query("F-04", f"""WITH {RESULTS}, g AS (SELECT seed AS iter, policy, sum(total) AS ic FROM res GROUP BY ALL)
SELECT iter, arg_max(policy, ROW(ic, policy)) AS policy, max(ic) AS ic FROM g GROUP BY iter""")
def argmax_per_iteration(spark, sf):
    g = results(spark, sf).groupBy(F.col("seed").alias("iter"), "policy").agg(F.sum("total").alias("ic"))
    best = F.max(F.struct("ic", "policy")).alias("b")
    return g.groupBy("iter").agg(best).select("iter", F.col("b.policy").alias("policy"), F.col("b.ic").alias("ic"))


@query("F-06", f"""WITH {PANEL}, m AS (SELECT subject, avg(s1) AS m FROM panel GROUP BY subject)
SELECT subject, round(m, 6) AS m FROM (SELECT *, row_number() OVER (ORDER BY m, subject) AS rn FROM m) WHERE rn = 5""")
def nth_smallest(spark, sf):
    means = supplier_month_narrow(spark, sf).groupBy("subject").agg(F.avg("s1").alias("m"))
    return ranking.nth_smallest(means, "m", 5, "subject").select("subject", F.round("m", 6).alias("m"))


@query("F-07", f"""{BASE}, {LINE}, z AS (SELECT * FROM fit WHERE a = 0) SELECT x.cluster AS i, y.cluster AS j,
  round(sqrt((x.c - y.c) ** 2 + (x.b - y.b) ** 2), 4) AS dist FROM z x JOIN z y ON x.cluster < y.cluster ORDER BY dist DESC""")
def sorted_distances(spark, sf):
    z = region_lines(spark, sf).filter("a = 0")
    x, y = z.alias("x"), z.alias("y")
    dist = F.sqrt(F.pow(F.col("x.c") - F.col("y.c"), F.lit(2)) + F.pow(F.col("x.b") - F.col("y.b"), F.lit(2)))
    return x.join(y, F.col("x.cluster") < F.col("y.cluster")).select(
        F.col("x.cluster").alias("i"), F.col("y.cluster").alias("j"), F.round(dist, 4).alias("dist")
    ).orderBy(F.col("dist").desc())


@query("F-08", """WITH e AS (SELECT o_orderstatus AS setting, count(*) AS size FROM orders GROUP BY 1),
r AS (SELECT *, dense_rank() OVER (ORDER BY size DESC) AS rn FROM e)
SELECT setting, size, CASE WHEN (SELECT count(DISTINCT size) FROM e) <> 3 THEN CAST(size AS VARCHAR)
  WHEN rn = 1 THEN 'Strong' WHEN rn = 2 THEN 'Moderate' ELSE 'Weak' END AS effect FROM r""")
def named_effects(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("setting")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(summary.name_effects(sizes, "size"), "size").select("setting", "size", "effect")


# --- sets

@query("S-01", f"WITH {PANEL} SELECT subject, t, s1, a FROM panel")
def append_batch(spark, sf):
    """History and the newest 25 steps as one bag."""
    panel = supplier_month_narrow(spark, sf)
    cut = horizon(spark, sf) - 25
    return panel.filter(F.col("t") < cut).unionByName(panel.filter(F.col("t") >= cut))


@query("S-02", f"WITH {REGION} (SELECT DISTINCT CAST(n_nationkey AS INTEGER) AS label FROM nation) EXCEPT (SELECT DISTINCT CAST(s_nationkey AS INTEGER) FROM supplier WHERE s_nationkey < 20)")
def unused_labels(spark, sf):
    every = table(spark, sf, "nation").select(F.col("n_nationkey").alias("label"))
    used = table(spark, sf, "supplier").filter("s_nationkey < 20").select(F.col("s_nationkey").alias("label"))
    return every.subtract(used)


@query("S-03", f"WITH {PANEL}, {REGION} SELECT DISTINCT cluster, a FROM panel JOIN region_of USING (subject)")
def distinct_labels(spark, sf):
    return label(supplier_month_narrow(spark, sf), region_assignment(spark, sf)).select("cluster", "a").distinct()


@query("S-04", f"""WITH {TRANS}, subj AS (SELECT subject, ntile(5) OVER (ORDER BY subject) - 1 AS fold FROM (SELECT DISTINCT subject FROM trans))
SELECT subject, t, s1 FROM trans WHERE subject NOT IN (SELECT subject FROM subj WHERE fold = 2)""")
def without_test_fold(spark, sf):
    trans = narrow_transitions(spark, sf)
    folds = ranking.contiguous_chunks(trans.select("subject").distinct(), "subject", 5)
    return trans.join(folds.filter("fold = 2"), "subject", "left_anti").select("subject", "t", "s1")


@query("S-05", f"WITH {PANEL} (SELECT DISTINCT a FROM panel WHERE t < 60) INTERSECT (SELECT DISTINCT a FROM panel WHERE t >= 60)")
def common_actions(spark, sf):
    panel = supplier_month_narrow(spark, sf)
    return panel.filter("t < 60").select("a").intersect(panel.filter("t >= 60").select("a"))


# --- scalar functions

@query("H-01", f"""WITH {PANEL} SELECT subject, t, power(s1, 2) AS sq, round(sqrt(s1), 8) AS rt, abs(s1 - 200) AS gap, CAST(floor(s1 / 7) AS BIGINT) AS fl,
  CAST(trunc((s1 - 200) / 7) AS INTEGER) AS tr, CAST(t // 25 AS INTEGER) AS d, t % 25 AS m FROM panel""")
def arithmetic(spark, sf):
    s, t = F.col("s1"), F.col("t")
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", F.pow(s, F.lit(2)).alias("sq"), F.round(F.sqrt(s), 8).alias("rt"), F.abs(s - 200).alias("gap"),
        F.floor(s / 7).alias("fl"), ((s - 200) / 7).cast("int").alias("tr"),
        F.floor(t / 25).cast("int").alias("d"), (t % 25).alias("m"))


@query("H-02", f"WITH {PANEL} SELECT subject, t, round(ln(s1), 8) AS ln, round(log10(s1), 8) AS lg FROM panel")
def logarithms(spark, sf):
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", F.round(F.ln("s1"), 8).alias("ln"), F.round(F.log10("s1"), 8).alias("lg"))


@query("H-03", f"WITH {PANEL} SELECT subject, t, round(exp(-0.5 * ((s1 - 180) / 60) ** 2), 8) AS k FROM panel")
def rbf_kernel(spark, sf):
    z = (F.col("s1") - 180) / 60
    return supplier_month_narrow(spark, sf).select("subject", "t", F.round(scalars.rbf(z * z, 0.5), 8).alias("k"))


@query("H-04", f"""WITH {PANEL}, m AS (SELECT avg(s1) AS mu, var_pop(s1) AS v FROM panel)
SELECT round(sum(-0.5 * ln(2 * pi() * v) - (s1 - mu) ** 2 / (2 * v)), 4) AS loglik FROM panel, m""")
def normal_loglik(spark, sf):
    """With maximum-likelihood moments the sum of log densities is -n/2 (ln 2 pi v + 1)."""
    return supplier_month_narrow(spark, sf).agg(
        F.round(-F.count(F.lit(1)) / 2 * (F.ln(F.lit(2.0) * F.pi() * F.var_pop("s1")) + 1), 4).alias("loglik"))


@query("H-05", f"""WITH {PANEL} SELECT subject, round(greatest(coalesce(var_pop(s1) FILTER (t < 1), 0), 2.2250738585072014e-308::DOUBLE) * 1e308, 6) AS v
FROM panel GROUP BY subject""")
def clamp_variance(spark, sf):
    """The variance of a single value is zero and is lifted to the smallest normal double."""
    v = F.coalesce(F.var_pop(F.when(F.col("t") < 1, F.col("s1"))), F.lit(0.0))
    return supplier_month_narrow(spark, sf).groupBy("subject").agg(
        F.round(scalars.clamp_variance(v) * 1e308, 6).alias("v"))


@query("H-06", f"""WITH {PANEL}, x AS (SELECT subject, CASE WHEN a = 1 THEN NULL ELSE s1 END AS v, power(CASE WHEN t = 3 THEN 1e200 ELSE s1 END, 2) AS b FROM panel)
SELECT subject, median(v) AS med, count(*) FILTER (isinf(b)) AS n_inf FROM x GROUP BY subject""")
def inf_and_median(spark, sf):
    big = F.pow(F.when(F.col("t") == 3, F.lit(1e200)).otherwise(F.col("s1")), F.lit(2))
    return supplier_month_narrow(spark, sf).groupBy("subject").agg(
        F.percentile(F.when(F.col("a") != 1, F.col("s1")), F.lit(0.5)).alias("med"),
        F.sum((big == F.lit(float("inf"))).cast("bigint")).alias("n_inf"))


@query("H-07", """SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS name, replace(o_orderpriority, '-', '/') AS path,
  replace(replace(o_orderpriority, '-', '/'), '/', '_') AS safe, regexp_replace(o_orderpriority, '[0-9]+', '', 'g') AS no_digits,
  o_orderstatus || '_' || o_orderpriority AS tag, printf('%.2f', o_totalprice) AS price FROM orders""")
def strings(spark, sf):
    pr = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.split(pr, "-")[1].alias("name"), F.replace(pr, F.lit("-"), F.lit("/")).alias("path"),
        F.replace(F.replace(pr, F.lit("-"), F.lit("/")), F.lit("/"), F.lit("_")).alias("safe"),
        F.regexp_replace(pr, "[0-9]+", "").alias("no_digits"), F.concat_ws("_", "o_orderstatus", pr).alias("tag"),
        F.format_string("%.2f", "o_totalprice").alias("price"))


@query("H-08", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("H-09", """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS dot,
  len(embedding[1:8]) AS head, round(list_sum(embedding[1:8]::DOUBLE[]), 6) AS cum8,
  len(list_filter(embedding, lambda x: x > 0)) AS n_pos, CAST(3 * label AS BIGINT) AS rep FROM embeddings""")
def array_functions(spark, sf):
    e = F.col("embedding").cast("array<double>")
    head = F.slice(e, 1, 8)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(scalars.dot(e, F.reverse(e)), 6).alias("dot"), F.size(head).cast("bigint").alias("head"),
        F.round(F.element_at(scalars.running_sum(head), -1), 6).alias("cum8"),
        F.size(scalars.positions(e, lambda v: v > 0)).cast("bigint").alias("n_pos"),
        F.aggregate(F.array_repeat("label", 3), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("rep"))


@query("H-10", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'Sign-up' WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Page view' ELSE event_type END AS name FROM events""")
def recode_names(spark, sf):
    """Raw names to display names; a name without a display form stays."""
    shown = {"signup": "Sign-up", "click": "Click", "view": "Page view"}
    return table(spark, sf, "events").select("event_id", scalars.recode(F.col("event_type"), shown).alias("name"))
