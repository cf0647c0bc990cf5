"""Scans, projections, filters and feature construction (survey 2.1 A-01..A-04, A-08, 2.2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.functions import features as feat
from panelwright.functions.grid import (
    ScanGrid, linear_grid, nearest, parameter_frame)
from panelwright.operators import pairs, ranking, scaling
from panelwright.operators import transitions as tr
from panelwright.queries.base import N_SQL, NATION_MONTH, PANEL, REGION, TRANS, USER_DAY, query
from panelwright.queries.detection import narrow_transitions, wide_transitions
from panelwright.session import run_path
from panelwright.sources import files
from panelwright.sources.tables import (
    horizon, nation_month, region_assignment, supplier_month, supplier_month_narrow, table, user_day)


@query("A-01", f"""WITH {PANEL} SELECT subject AS study_id, t AS day, s1 AS step, s3 AS mood,
  CASE WHEN a = 1 THEN 'steps' ELSE 'none' END AS notification FROM
  (SELECT subject, t, s1, round(s3, 6) AS s3, a FROM panel)""")
def panel_csv_scan(spark, sf):
    """The panel written as CSV files and read back with a declared schema."""
    path = run_path(spark, "panel-csv")
    supplier_month(spark, sf).select(
        F.col("subject").alias("study_id"), F.col("t").alias("day"), F.col("s1").alias("step"),
        F.round("s3", 6).alias("mood"),
        F.when(F.col("a") == 1, "steps").otherwise("none").alias("notification"),
    ).write.option("header", True).csv(path)
    return files.read_csv(spark, path, "study_id bigint, day int, step double, mood double, notification string")


@query("A-02", f"WITH {PANEL} SELECT subject, t, s1, round(s2, 7) AS s2, round(s3, 7) AS s3, a FROM panel")
def panel_parquet_scan(spark, sf):
    return supplier_month(spark, sf).select(
        "subject", "t", "s1", F.round("s2", 7).alias("s2"), F.round("s3", 7).alias("s3"), "a")


@query("A-03", """SELECT o_orderstatus AS setting, o_orderpriority AS policy, count(*) AS n,
  round(sum(o_totalprice) / count(*), 3) AS mean_value FROM orders GROUP BY ALL""")
def result_tree_scan(spark, sf):
    """Per-run files below setting=/policy= folders, read by partition discovery."""
    path = run_path(spark, "result-tree")
    files.write_results(
        table(spark, sf, "orders").select(
            F.col("o_orderstatus").alias("setting"), F.col("o_orderpriority").alias("policy"),
            F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("value")),
        path, ["setting", "policy"])
    return files.read_results(spark, path).groupBy("setting", "policy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / F.count(F.lit(1)), 3).alias("mean_value"))


@query("A-04", """WITH done AS (SELECT DISTINCT o_orderpriority AS policy, o_orderstatus AS setting FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderstatus AS setting, o_orderpriority AS policy, count(*) AS n FROM orders
WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.policy = o_orderpriority AND done.setting = o_orderstatus) GROUP BY ALL""")
def skip_finished(spark, sf):
    """Runs whose key is already in the sink are not computed again."""
    path = run_path(spark, "finished")
    runs = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("setting"), F.col("o_orderpriority").alias("policy")
    ).agg(F.count(F.lit(1)).alias("n"))
    files.write_results(runs.filter("setting = 'F'"), path, ["setting", "policy"])
    return files.pending(runs, path, ["setting", "policy"])


@query("A-08", f"""SELECT CAST(u AS INTEGER) AS u, CAST(basis AS INTEGER) AS basis FROM (WITH {PANEL}
  SELECT t AS u, count(DISTINCT a) AS basis FROM panel GROUP BY t)""")
def small_csv_sink(spark, sf):
    path = run_path(spark, "basis-csv")
    files.write_small_csv(
        supplier_month(spark, sf).groupBy(F.col("t").alias("u")).agg(F.countDistinct("a").alias("basis")), path)
    return files.read_csv(spark, path, "u int, basis int")


@query("B-01", f"WITH {PANEL} SELECT subject, t, power(s1, 3) AS step, power(s1, 2) AS sleep FROM panel")
def power_scale(spark, sf):
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", F.pow("s1", F.lit(3)).alias("step"), F.pow("s1", F.lit(2)).alias("sleep"))


@query("B-02", f"""WITH {PANEL}, m AS (SELECT avg(s1) AS m1, stddev_pop(s1) AS d1, avg(s2) AS m2, stddev_pop(s2) AS d2 FROM panel)
SELECT subject, t, round((s1 - m1) / d1, 6) AS s1, round((s2 - m2) / d2, 6) AS s2 FROM panel, m""")
def zscore_table(spark, sf):
    return scaling.zscore(supplier_month(spark, sf), ["s1", "s2"], suffix="").select(
        "subject", "t", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"))


@query("B-03", f"""WITH {PANEL}, {REGION}
SELECT subject, t, cluster, round((s1 - avg(s1) OVER w) / stddev_pop(s1) OVER w, 6) AS s1,
       round((s2 - avg(s2) OVER w) / stddev_pop(s2) OVER w, 6) AS s2
FROM panel JOIN region_of USING (subject) WINDOW w AS (PARTITION BY cluster)""")
def zscore_by_cluster(spark, sf):
    rows = supplier_month(spark, sf).join(region_assignment(spark, sf), "subject")
    return scaling.zscore_by(rows, "cluster", ["s1", "s2"], suffix="").select(
        "subject", "t", "cluster", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"))


@query("B-04", f"""WITH {PANEL}, act AS (SELECT * FROM panel WHERE t >= 40),
m AS (SELECT avg(s1) AS m1, stddev_pop(s1) AS d1 FROM act)
SELECT subject, t, round((s1 - m1) / d1, 6) AS s1 FROM act, m""")
def zscore_active(spark, sf):
    """Standardise the rows at or after the latest change point only."""
    active = supplier_month_narrow(spark, sf).filter("t >= 40")
    return scaling.zscore(active, ["s1"], suffix="").select("subject", "t", F.round("s1", 6).alias("s1"))


BACK = f"power(z * {{0}} + {scaling.STEP_MEAN!r}, 3)"
Z1 = f"""WITH {PANEL}, z AS (SELECT subject, t, s1 / 100.0 AS z FROM panel)"""


@query("B-05", f"{Z1} SELECT subject, t, round({BACK.format(repr(scaling.STEP_STD))}, 3) AS steps FROM z")
def steps_back(spark, sf):
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", F.round(scaling.steps_back(F.col("s1") / 100), 3).alias("steps"))


@query("B-06", f"{Z1} SELECT subject, t, round({BACK.format(repr(0.1 * scaling.STEP_STD))}, 3) AS steps FROM z")
def steps_back_scaled(spark, sf):
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", F.round(scaling.steps_back(F.col("s1") / 100, 0.1), 3).alias("steps"))


@query("B-07", f"""WITH {PANEL} SELECT subject, t, CASE WHEN a = 1 THEN 1e200 ELSE s1 END AS x FROM panel WHERE a = 1""")
def overflow_report(spark, sf):
    """Inputs whose value on the original scale overflows."""
    rows = supplier_month_narrow(spark, sf).select(
        "subject", "t", F.when(F.col("a") == 1, F.lit(1e200)).otherwise(F.col("s1")).alias("x"))
    return scaling.overflow_report(rows, "x", ["subject", "t"]).select("subject", "t", "x")


@query("B-08", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS a FROM events")
def action_encoding(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", (F.col("event_type") == "purchase").cast("int").alias("a"))


@query("B-09", f"WITH {TRANS} SELECT subject, t, r FROM trans")
def reward_derivation(spark, sf):
    return narrow_transitions(spark, sf).select("subject", "t", "r")


@query("B-10", "SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS specialty FROM orders")
def key_extraction(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.split("o_orderpriority", "-")[1].alias("specialty"))


TRANS_COLS = ", ".join(["subject, t, a, s1", "round(s2, 7) AS s2", "round(s3, 7) AS s3", "r, y1",
                        "round(y2, 7) AS y2", "round(y3, 7) AS y3"])


@query("B-11", f"WITH {TRANS} SELECT {TRANS_COLS} FROM trans")
def transition_builder(spark, sf):
    return wide_transitions(spark, sf).select(
        "subject", "t", "a", "s1", F.round("s2", 7).alias("s2"), F.round("s3", 7).alias("s3"), "r", "y1",
        F.round("y2", 7).alias("y2"), F.round("y3", 7).alias("y3"))


@query("B-12", f"""WITH {TRANS} SELECT subject, t, 1.0::DOUBLE AS x0, a::DOUBLE AS x1, s1 AS x2, round(s2, 7) AS x3,
  a * s1 AS x4, round(a * s2, 7) AS x5 FROM trans""")
def interaction_design(spark, sf):
    row = feat.interaction_row(F.col("a"), [F.col("s1"), F.col("s2")])
    return wide_transitions(spark, sf).select("subject", "t", row.alias("x")).select(
        "subject", "t", *[(F.round(F.col("x")[i], 7) if i in (3, 5) else F.col("x")[i]).alias(f"x{i}")
                          for i in range(6)])


@query("B-13", f"""WITH {PANEL}, z AS (SELECT subject, t, s1 / 100 AS u, s3 * 10 AS v FROM panel)
SELECT subject, t, 1.0::DOUBLE AS f0, round(u, 10) AS f1, round(v, 10) AS f2, round(u * u, 10) AS f3, round(u * v, 10) AS f4, round(v * v, 10) AS f5 FROM z""")
def polynomial_features(spark, sf):
    terms = feat.polynomial_terms([F.col("s1") / 100, F.col("s3") * 10], 2)
    return supplier_month(spark, sf).select(
        "subject", "t", *[F.round(c, 10).alias(f"f{i}") for i, c in enumerate(terms)])


RFF_W, RFF_B = feat.fourier_weights(3, 1, 1.0, seed=1)


@query("B-14", f"""WITH {PANEL}, z AS (SELECT subject, t, s1 / 100 AS s FROM panel)
SELECT subject, t, 1.0::DOUBLE AS f0, """ + ", ".join(
    f"round({float(np.sqrt(2 / 3))!r}::DOUBLE * cos({float(RFF_B[d])!r}::DOUBLE + s * {float(RFF_W[0, d])!r}::DOUBLE), 6) AS f{d + 1}"
    for d in range(3)) + " FROM z")
def random_fourier(spark, sf):
    terms = feat.FeatureMap("rbf", dim=3, bandwidth=1.0).terms([F.col("s1") / 100])
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", *[F.round(c, 6).alias(f"f{i}") for i, c in enumerate(terms)])


@query("B-15", f"""WITH {TRANS} SELECT a, count(*) AS n, sum(s1) AS sum_s1, sum(s1 * s1) AS sum_s1s1 FROM trans GROUP BY a""")
def per_action_split(spark, sf):
    return narrow_transitions(spark, sf).groupBy("a").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s1").alias("sum_s1"), F.sum(F.col("s1") * F.col("s1")).alias("sum_s1s1"))


def region_tau(spark, sf):
    """One change point per region, spaced over the horizon."""
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("cluster"), (F.col("r_regionkey") * 10).alias("tau"))


@query("B-16", f"""WITH {TRANS}, {REGION} SELECT subject, t, cluster, a, s1, y1 FROM trans JOIN region_of USING (subject)
WHERE t >= cluster * 10""")
def post_change_slice(spark, sf):
    return tr.post_change(narrow_transitions(spark, sf), region_assignment(spark, sf), region_tau(spark, sf)).select(
        "subject", "t", "cluster", "a", "s1", "y1")


@query("B-17", f"WITH {TRANS} SELECT subject, t, s1, y1 FROM trans WHERE t BETWEEN {N_SQL} - 31 AND {N_SQL} - 2")
def recent_window(spark, sf):
    return tr.recent_window(narrow_transitions(spark, sf), horizon(spark, sf), 30).select("subject", "t", "s1", "y1")


@query("B-18", f"""WITH {TRANS} SELECT CASE WHEN t < 60 THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(s1) AS s
FROM trans WHERE t <= 60 GROUP BY 1""")
def time_split(spark, sf):
    return tr.time_split(narrow_transitions(spark, sf), 60).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s1").alias("s"))


@query("B-19", f"""WITH {TRANS}, subj AS (SELECT subject, CAST(ntile(5) OVER (ORDER BY subject) - 1 AS INTEGER) AS fold
  FROM (SELECT DISTINCT subject FROM trans)) SELECT subject, t, fold FROM trans JOIN subj USING (subject)""")
def cv_folds(spark, sf):
    return ranking.assign_folds(narrow_transitions(spark, sf), 5).select("subject", "t", "fold")


@query("B-20", "SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer")
def contiguous_chunks(spark, sf):
    return ranking.contiguous_chunks(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 7)


GRID_VALUES = [-1.0, 0.0, 0.5, 1.0, 2.5, 5.0]


@query("B-22", f"""WITH {PANEL}, g AS (SELECT unnest([{', '.join(map(str, GRID_VALUES))}]::DOUBLE[]) AS v, unnest(range({len(GRID_VALUES)})) AS i)
SELECT subject, t, arg_min(v, ROW(abs(v - s1 / 100), i)) AS s1 FROM panel, g GROUP BY subject, t""")
def nearest_grid_value(spark, sf):
    return supplier_month_narrow(spark, sf).select(
        "subject", "t", nearest(F.col("s1") / 100, GRID_VALUES).alias("s1"))


@query("B-23", f"""WITH {PANEL}, h AS (SELECT max(t) + 1 AS tt FROM panel),
k AS (SELECT unnest(range(25, tt - 1)) AS kappa, tt FROM h)
SELECT CAST(kappa AS INTEGER) AS kappa, CAST(unnest(range(CAST(floor(0.1 * tt - 1) AS INTEGER) + 1, CAST(floor(kappa - 0.1 * tt) AS INTEGER) + 1)) AS INTEGER) AS u FROM k""")
def candidate_grid(spark, sf):
    """The scan grid for the horizon found in the panel."""
    horizon = supplier_month_narrow(spark, sf).agg(F.max("t")).first()[0] + 1
    return ScanGrid(horizon).frame(spark)


@query("B-24", f"""WITH {PANEL}, h AS (SELECT max(t) AS tt FROM panel)
SELECT DISTINCT CAST(floor(0.1 * tt + i * (0.8 * tt) / 6) AS INTEGER) AS u FROM h, (SELECT unnest(range(7)) AS i)""")
def linear_candidates(spark, sf):
    steps = supplier_month_narrow(spark, sf).agg(F.max("t")).first()[0]
    return spark.createDataFrame([(u,) for u in linear_grid(steps, steps, 0.1, 7)], "u int")


@query("B-25", f"""WITH {TRANS}, g AS (SELECT * FROM (VALUES (3), (4), (5)) d(depth), (VALUES (40), (50), (60)) l(leaf))
SELECT CAST(depth AS DOUBLE) AS depth, CAST(leaf AS DOUBLE) AS leaf, count(*) AS n FROM trans, g
WHERE t >= depth * leaf / 10 GROUP BY ALL""")
def parameter_product(spark, sf):
    """Every (depth, leaf) pair, each with the rows its own cut keeps."""
    params = parameter_frame(spark, {"max_depth": [3, 4, 5], "min_samples_leaf": [40, 50, 60]}).select(
        F.col("params")["max_depth"].alias("depth"), F.col("params")["min_samples_leaf"].alias("leaf"))
    per_t = narrow_transitions(spark, sf).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return per_t.join(params, F.col("t") >= F.col("depth") * F.col("leaf") / 10).groupBy(
        "depth", "leaf").agg(F.sum("n").alias("n"))


@query("E-01", f"""WITH {USER_DAY}, led AS (SELECT subject, t, a, s1, lead(t) OVER w AS tn, lead(s1) OVER w AS y1
  FROM panel WINDOW w AS (PARTITION BY subject ORDER BY t)) SELECT subject, t, a, s1, y1 FROM led WHERE tn = t + 1""")
def lead_transition(spark, sf):
    """User-day transitions, with series cut into blocks of eight days."""
    return tr.transitions(user_day(spark, sf).select("subject", "t", "s1", "a"), ["s1"], block=8).select(
        "subject", "t", "a", "s1", "y1")


@query("D-07", f"""WITH {USER_DAY}, want AS (SELECT subject, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT subject FROM panel), (SELECT unnest(range(30)) AS t))
SELECT 'gap' AS kind, subject, t, 1::BIGINT AS n FROM want ANTI JOIN panel USING (subject, t)""")
def validation_report(spark, sf):
    return tr.validation_report(user_day(spark, sf).select("subject", "t", "a", "s1"), 30, ["s1"])


@query("C-12", f"""WITH {NATION_MONTH} SELECT x.subject AS i, y.subject AS j, round(corr(x.s1, y.s1), 6) + 0.0 AS corr
FROM panel x JOIN panel y ON x.t = y.t AND x.subject < y.subject GROUP BY ALL""")
def subject_correlation(spark, sf):
    return pairs.series_correlation(nation_month(spark, sf), "s1", block=8).select(
        "i", "j", F.round("corr", 6).alias("corr"))
