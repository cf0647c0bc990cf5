"""Segmentation and alternating estimation (survey 2.10, 2.11, A-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators.scaling import zscore
from panelwright.operators.transitions import transitions
from panelwright.plans import alternate, segment
from panelwright.plans.changepoint import label
from panelwright.queries.base import N_SQL, PANEL, TRANS, query
from panelwright.queries.detection import narrow_transitions
from panelwright.queries.prepare import region_tau
from panelwright.queries.summaries import BASE, QUAL, WSUM
from panelwright.session import materialize
from panelwright.sources.tables import horizon, region_assignment, supplier_month, supplier_month_narrow


def scaled_transitions(spark, sf, states=("s1", "s2", "s3")):
    panel = zscore(supplier_month(spark, sf).select("subject", "t", "a", *states), list(states), suffix="")
    return transitions(panel, list(states))


def start(k):
    return (F.col("subject") % k).cast("int")


# --- SQL text: hard EM unrolled, one CTE per fit and per reassignment (p = 1).

def em_sql(k: int, steps: int, where: str = "TRUE") -> str:
    """CTEs lab0..lab{steps}; lab_i holds (subject, cluster, err, n) after i reassignments."""
    ctes = [
        f"rows{k} AS (SELECT subject, a, s1, y1, 1.0::DOUBLE / count(*) OVER (PARTITION BY subject) AS w FROM trans WHERE {where})",
        f"lab{k}_0 AS (SELECT DISTINCT subject, CAST(subject % {k} AS INTEGER) AS cluster FROM rows{k})",
    ]
    for i in range(1, steps + 1):
        ctes.append(
            f"m{k}_{i} AS (SELECT cluster, a, sum(w) AS n, sum(w*s1) AS s, sum(w*y1) AS y, sum(w*s1*s1) AS ss, sum(w*s1*y1) AS sy "
            f"FROM rows{k} JOIN lab{k}_{i - 1} USING (subject) GROUP BY cluster, a)")
        ctes.append(
            f"f{k}_{i} AS (SELECT cluster, a, (n*sy-s*y)/(n*ss-s*s) AS b, (y-(n*sy-s*y)/(n*ss-s*s)*s)/n AS c FROM m{k}_{i})")
        ctes.append(
            f"e{k}_{i} AS (SELECT subject, cluster, sum((y1-c-b*s1)**2) AS err, count(*) AS n FROM rows{k} JOIN f{k}_{i} USING (a) GROUP BY ALL)")
        ctes.append(
            f"lab{k}_{i} AS (SELECT subject, arg_min(cluster, ROW(err, cluster)) AS cluster, min(err) AS err, any_value(n) AS n FROM e{k}_{i} GROUP BY subject)")
    return ",\n".join(ctes)


EM = f"WITH {TRANS}, "
# More rounds than it takes until nobody moves; those after it change nothing.
ROUNDS = 30


@query("K-01")
def cluster_by_mean(spark, sf):
    lev = segment.subject_levels(supplier_month_narrow(spark, sf), ["s1"], 40)
    return segment.cluster_by_mean(lev, 3).select("subject", F.round("mean", 6).alias("mean"), "cluster")


@query("K-02", f"""WITH {PANEL}, x AS (SELECT subject, CAST(subject % 3 AS INTEGER) AS cluster, s1 FROM panel WHERE t >= 41),
m AS (SELECT cluster AS k, avg(s1) AS mu, var_pop(s1) AS v FROM x GROUP BY cluster),
e AS (SELECT subject, k, sum((s1 - mu) ** 2) / any_value(v) AS err FROM x, m GROUP BY subject, k)
SELECT subject, arg_min(k, ROW(err, k)) AS cluster FROM e GROUP BY subject""")
def cluster_by_marginal(spark, sf):
    """One reassignment by scaled distance; the full loop repeats it until nothing moves."""
    lev = segment.subject_levels(supplier_month_narrow(spark, sf), ["s1"], 40, shift=1)
    return segment.cluster_by_marginal(lev, 3, start(3), max_iter=1)


@query("K-03", f"{EM}{em_sql(3, ROUNDS)} SELECT subject, cluster, round(err / n / 10, 4) AS err FROM lab3_{ROUNDS}")
def cluster_by_dynamics(spark, sf):
    """Hard EM from the labels subject mod 3 until nobody moves."""
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    found = segment.cluster_by_dynamics(subj, 3, 1, start(3))
    err = F.col("err") / F.col("m_n") / 10
    return found.scored.select("subject", "cluster", F.round(err, 4).alias("err"))


DENS = f"""{BASE}, {WSUM}, e AS (SELECT subject, wf.cluster, sum((y1 - c - b * s1) ** 2) AS e FROM trans JOIN wf USING (a) GROUP BY ALL),
s AS (SELECT sqrt(avg(e * e)) AS sc FROM e)"""


@query("K-04", f"{DENS} SELECT round(sum(exp(-0.5 * (e / sc) ** 2) / (sc * sqrt(2 * pi()))) * 1e4, 6) AS loss FROM e, s")
def density_score(spark, sf):
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    coefs = segment.weighted_fit(subj.join(region_assignment(spark, sf), "subject"), 5, 1)
    return segment.density_loss(subj, coefs, 1).select(F.round(F.col("loss") * 1e4, 6).alias("loss"))


@query("K-05", f"{EM}{em_sql(1, ROUNDS)}, {em_sql(2, ROUNDS)}, {em_sql(3, ROUNDS)}, l AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, -sum(err / n) AS loss, count(*) AS n FROM lab{k}_{ROUNDS}" for k in (1, 2, 3)) +
    ") SELECT k, round(loss / 1000, 4) AS loss, round((loss - 2 * k * sqrt(n)) / 1000, 4) AS ic FROM l")
def select_k(spark, sf):
    """Every K in one pass per iteration; the criterion of each."""
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    n_times = horizon(spark, sf)
    n = float(n_times - 1)
    _, table = segment.select_k(subj, [1, 2, 3], 1, n_times, (n, n), "sqrtN", 2.0,
                                init={k: start(k) for k in (1, 2, 3)})
    return table.select("k", F.round(F.col("loss") / 1000, 4).alias("loss"), F.round(F.col("ic") / 1000, 4).alias("ic"))


@query("K-06", f"""{QUAL} SELECT cluster, count(DISTINCT subject) AS n_subjects, round(-sum(w * e2), 3) AS loss_normalized,
  round(-sum(e2), 1) AS loss_unnormalized FROM e GROUP BY cluster""")
def cluster_quality(spark, sf):
    subj = segment.prepared(narrow_transitions(spark, sf), 1)
    return segment.cluster_quality(subj, region_assignment(spark, sf), 1).select(
        "cluster", "n_subjects", F.round("loss_normalized", 3).alias("loss_normalized"),
        F.round("loss_unnormalized", 1).alias("loss_unnormalized"))


@query("K-07")
def cluster_at_end(spark, sf):
    """Clusters on the last step only, K chosen by the criterion; subjects without a row there get no label."""
    found = alternate.run_method("cluster_atend", scaled_transitions(spark, sf, ("s1",)), horizon(spark, sf), (1, 2, 3), c=0.5)
    return found.select("subject", "cluster", "tau")


@query("K-08", f"{EM}{em_sql(2, ROUNDS, f't >= {N_SQL} - 26')} SELECT subject, cluster, round(err / n / 10, 4) AS err FROM lab2_{ROUNDS}")
def initial_window(spark, sf):
    """The first clustering uses the shortest window's steps only."""
    subj = segment.prepared(narrow_transitions(spark, sf), 1, horizon(spark, sf) - 26)
    found = segment.cluster_by_dynamics(subj, 2, 1, start(2))
    err = F.col("err") / F.col("m_n") / 10
    return found.scored.select("subject", "cluster", F.round(err, 4).alias("err"))


@query("K-09", f"""{BASE}, b AS (SELECT cluster, CASE WHEN t >= cluster * 10 + 20 THEN 1 ELSE 0 END AS after, a, regr_intercept(y1, s1) AS c, regr_slope(y1, s1) AS b
  FROM lab GROUP BY ALL),
w AS (SELECT cluster, after, max(c) FILTER (a = 0) AS c0, max(c) FILTER (a = 1) - max(c) FILTER (a = 0) AS ca, max(b) FILTER (a = 0) AS b0,
  max(b) FILTER (a = 1) - max(b) FILTER (a = 0) AS ba FROM b GROUP BY ALL),
l AS (SELECT cluster, after, '1' AS term, c0 AS coef FROM w UNION ALL SELECT cluster, after, 'a', ca FROM w
  UNION ALL SELECT cluster, after, 's1', b0 FROM w UNION ALL SELECT cluster, after, 'a:s1', ba FROM w)
SELECT l.cluster, l.after, l.term, 'y1' AS response, round(l.coef, 4) AS coef, round(l.coef - r.coef, 4) AS contrast FROM l
JOIN l r ON r.cluster = 0 AND r.after = 0 AND r.term = l.term""")
def segment_contrasts(spark, sf):
    labels = region_assignment(spark, sf).join(region_tau(spark, sf), "cluster").withColumn(
        "tau", F.col("tau") + 20)
    out = segment.block_contrasts(narrow_transitions(spark, sf), labels, 1)
    return out.withColumn("coef", F.round("coef", 4)).withColumn("contrast", F.round("contrast", 4))


# --- alternating runs: three standardised states, simulated limits

def whole(spark, sf):
    """The estimator's own windows (all lengths from max(25, 2 eps T)) and draws."""
    return dict(n_times=horizon(spark, sf), p=3)


@query("M-01")
def segment_and_detect(spark, sf):
    est = alternate.PanelSegmenter(k=2, init="clusters", max_iter=10, **whole(spark, sf)).fit(scaled_transitions(spark, sf))
    return est.result


@query("M-02")
def detect_and_segment(spark, sf):
    est = alternate.PanelSegmenter(k=2, init="changepoints", max_iter=10, **whole(spark, sf)).fit(scaled_transitions(spark, sf))
    return est.result


@query("M-03")
def fit_front_door(spark, sf):
    """K from a list in every round; the run log."""
    est = alternate.PanelSegmenter(k=[1, 2, 3], init="clusters", max_iter=10, **whole(spark, sf)).fit(scaled_transitions(spark, sf))
    return est.run_log()


@query("M-04")
def fit_tune_k(spark, sf):
    _, table = alternate.fit_tune_k([1, 2], scaled_transitions(spark, sf), init="clusters", max_iter=10, **whole(spark, sf))
    return table


@query("M-05")
def fit_tune_k_each_iter(spark, sf):
    _, log = alternate.fit_tune_k_each_iter([1, 2], scaled_transitions(spark, sf), **whole(spark, sf))
    return log


@query("M-06")
def method_presets(spark, sf):
    """Labels and change points of every method, one row per method and label."""
    trans = materialize(scaled_transitions(spark, sf, ("s1",)), "transitions")
    truth = region_assignment(spark, sf).join(region_tau(spark, sf), "cluster")
    n_times = horizon(spark, sf)
    out = None
    for method in alternate.PRESETS:
        found = alternate.run_method(method, trans, n_times, (1, 2), truth)
        rows = found.groupBy(F.lit(method).alias("method"), "tau").agg(
            F.count(F.lit(1)).alias("n_subjects"), F.countDistinct("cluster").alias("n_clusters"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("M-07")
def test_period_labels(spark, sf):
    """Label sources for scoring, cross-tabulated against the training labels."""
    trans = scaled_transitions(spark, sf, ("s1",))
    n_times = horizon(spark, sf)
    own = label(trans.select("subject").distinct(), region_assignment(spark, sf)).withColumn("tau", F.lit(20))
    out = None
    for kind in ("test_set_only", "after_cp", "after_proposed_cp", "proposed_g_index", "g_index"):
        found = alternate.test_period_labels(kind, trans, n_times, own, n_times - 23, own, (1, 2))
        rows = own.select("subject", F.col("cluster").alias("k_train")).join(
            found.withColumnRenamed("cluster", "k_test"), "subject"
        ).groupBy(F.lit(kind).alias("source"), "k_train", "k_test").agg(F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("A-05")
def detection_sink(spark, sf):
    """A run written below method=/seed= and read back."""
    path = alternate.estimate_path(spark)
    seg = alternate.PanelSegmenter(k=1, init="clusters", max_iter=1, only_changepoints=True, **whole(spark, sf))
    trans = scaled_transitions(spark, sf)
    est = seg.fit(trans, assignment=trans.select("subject").distinct().withColumn("cluster", F.lit(0)))
    alternate.write_estimate(est, path, "only_cp", 1)
    return spark.read.parquet(path)
