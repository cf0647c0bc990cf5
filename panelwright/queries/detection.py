"""Change-point detection on the supplier-month panel (survey section 2.9, E-04..E-07, E-11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.grid import ScanGrid
from panelwright.operators.scaling import zscore
from panelwright.operators.transitions import fill_dense, transitions
from panelwright.plans import changepoint as cp
from panelwright.plans import nulls
from panelwright.queries.base import END_SQL, N_SQL, PANEL, REGION, TRANS, query
from panelwright.session import run_path
from panelwright.sources.tables import (
    horizon, region_assignment, supplier_month, supplier_month_narrow)

# Limit used where a query is checked against SQL; simulated limits are used elsewhere.
LIMIT = 5.0
# Windows of the mean and marginal scans: from max(25, 2 eps T) to T - 1.
KAPPA_SQL = f"(SELECT unnest(range(greatest(25, CAST(floor(0.2e0 * {N_SQL}) AS BIGINT)), {N_SQL})) AS kappa)"


def level_windows(n_times):
    return max(25, int(0.2 * n_times)), n_times - 1


def narrow_transitions(spark, sf):
    return transitions(supplier_month_narrow(spark, sf), ["s1"])


def wide_transitions(spark, sf):
    return transitions(supplier_month(spark, sf), ["s1", "s2", "s3"])


def scan_grid(spark, sf, **kw):
    return ScanGrid(horizon(spark, sf), **kw)


def fixed_limits(spark, grid):
    return spark.range(1).select(F.explode(grid.kappa_column()).alias("kappa"), F.lit(LIMIT).alias("threshold"))


# --- SQL text: every candidate split summed directly over its rows' time sums.

SUMS = """
  sum(CASE WHEN {0} THEN 1e0 ELSE 0e0 END) AS {1}n, sum(CASE WHEN {0} THEN s1 ELSE 0e0 END) AS {1}s,
  sum(CASE WHEN {0} THEN y1 ELSE 0e0 END) AS {1}y, sum(CASE WHEN {0} THEN s1*s1 ELSE 0e0 END) AS {1}ss,
  sum(CASE WHEN {0} THEN s1*y1 ELSE 0e0 END) AS {1}sy, sum(CASE WHEN {0} THEN y1*y1 ELSE 0e0 END) AS {1}yy"""

COLS = ("n", "s", "y", "ss", "sy", "yy")


def time_sums(source: str) -> str:
    return (f"tsum AS (SELECT cluster, t, {SUMS.format('a = 0', 'z')}, {SUMS.format('a = 1', 'w')}"
            f" FROM {source} GROUP BY cluster, t)")


def sse_sql(pre: str) -> str:
    n, s, y, ss, sy, yy = (f"{pre}{c}" for c in COLS)
    return (f"(CASE WHEN {n} <= 0 THEN 0e0 WHEN {n}*{ss}-{s}*{s} <= 1e-9*{n}*{ss} THEN ({n}*{yy}-{y}*{y})/{n} "
            f"ELSE greatest((({n}*{yy}-{y}*{y}) - ({n}*{sy}-{s}*{y})*({n}*{sy}-{s}*{y})/({n}*{ss}-{s}*{s}))/{n}, 0e0) END)")


def part_sums(cond: str, pre: str) -> str:
    return ", ".join(f"sum(CASE WHEN {cond} THEN {g}{c} ELSE 0e0 END) AS {pre}{g}{c}" for g in "zw" for c in COLS)


TINY_SQL = "2.2250738585072014e-308"


def scan_sql(scale: float = 1.0, per_obs: bool = False) -> str:
    """CTEs grid, seg, stats(cluster, kappa, u, stat) from tsum."""
    div = " / obs" if per_obs else ""
    return f"""
hz AS (SELECT max(t) AS e, max(t) + 1 AS n FROM panel),
kap AS (SELECT e, n, unnest(range(greatest(25, CAST(floor(2 * 0.1e0 * n) AS BIGINT)), n - 1)) AS kappa FROM hz),
grid AS (SELECT e, kappa, unnest(range(greatest(CAST(trunc(0.1e0 * n - 1) AS BIGINT) + 1, 1), CAST(floor(kappa - 0.1e0 * n) AS BIGINT) + 1)) AS u FROM kap),
seg AS (
  SELECT cluster, kappa, u, {part_sums('t < e - kappa + u', 'l')},
         {part_sums('t >= e - kappa + u', 'r')}, {part_sums('TRUE', 'f')}
  FROM grid JOIN tsum ON t >= e - kappa GROUP BY cluster, kappa, u),
stats AS (
  SELECT cluster, kappa, u, {0.5 * scale}e0 * obs * ln(greatest(e0/obs, {TINY_SQL}) / greatest(e1/obs, {TINY_SQL})){div} AS stat
  FROM (SELECT cluster, kappa, u, fzn + fwn AS obs, {sse_sql('fz')} + {sse_sql('fw')} AS e0,
        {sse_sql('lz')} + {sse_sql('lw')} + {sse_sql('rz')} + {sse_sql('rw')} AS e1 FROM seg))"""


BEST = """best AS (SELECT cluster, kappa, max(stat) AS stat, arg_min(u, ROW(-stat, u)) AS u FROM stats GROUP BY cluster, kappa)"""


def tau_sql(limit: float) -> str:
    return f"""hit AS (SELECT cluster, min(kappa) FILTER (stat >= {limit}) AS kappa FROM best GROUP BY cluster)
SELECT hit.cluster, CAST(CASE WHEN hit.kappa IS NULL THEN 0 ELSE {END_SQL} - greatest(hit.kappa - 1, (SELECT min(kappa) FROM kap)) END AS INTEGER) AS tau,
       CAST(hit.kappa AS INTEGER) AS kappa, round(best.stat, 4) AS stat FROM hit LEFT JOIN best USING (cluster, kappa)"""


LABELLED = "lab AS (SELECT trans.*, cluster FROM trans JOIN region_of USING (subject))"
BY_REGION = f"WITH {TRANS}, {REGION}, {LABELLED}, {time_sums('lab')}"
POOLED = f"WITH {TRANS}, {time_sums('(SELECT *, 0 AS cluster FROM trans)')}"
BY_SUBJECT = f"WITH {TRANS}, {time_sums('(SELECT *, subject AS cluster FROM trans)')}"


def _tau(found):
    return found.select("cluster", "tau", "kappa", F.round("stat", 4).alias("stat"))


@query("G-13", f"{POOLED}, {scan_sql()}, {BEST} SELECT CAST(kappa AS INTEGER) AS kappa, CAST(u AS INTEGER) AS u, round(stat, 4) AS stat FROM best")
def pooled_scan(spark, sf):
    """Pooled detection: the best split of every window."""
    grid = scan_grid(spark, sf)
    return cp.best_splits(narrow_transitions(spark, sf), grid).select("kappa", "u", F.round("stat", 4).alias("stat"))


@query("G-01", f"{BY_REGION}, {scan_sql()}, {BEST}, {tau_sql(LIMIT)}")
def transition_change(spark, sf):
    grid = scan_grid(spark, sf)
    trans = narrow_transitions(spark, sf)
    return _tau(cp.detect_transition_change(
        trans, grid, assignment=region_assignment(spark, sf), limits=fixed_limits(spark, grid)))


@query("G-12", f"{BY_SUBJECT}, {scan_sql()}, {BEST}, " + tau_sql(LIMIT).replace("hit.cluster,", "hit.cluster AS subject,"))
def individual_change(spark, sf):
    grid = scan_grid(spark, sf)
    found = cp.detect_individually(narrow_transitions(spark, sf), grid, limits=fixed_limits(spark, grid))
    return found.select("subject", "tau", "kappa", F.round("stat", 4).alias("stat"))


@query("E-04", f"""{BY_REGION} SELECT cluster, t,
  sum(zn + wn) OVER w AS m_n, sum(zs + ws) OVER w AS m_s0, sum(zss + wss) OVER w AS m_s0s0, sum(wsy) OVER w AS k_s0y0
  FROM tsum WINDOW w AS (PARTITION BY cluster ORDER BY t)""")
def prefix_gram(spark, sf):
    rows = cp.label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    return cp.prefix_moments(cp.time_moments(rows, 1), 1).select(
        "cluster", "t", "m_n", "m_s0", "m_s0s0", "k_s0y0")


@query("E-05", f"""{BY_REGION} SELECT cluster, t, sum(zn + wn) OVER w AS m_n, sum(zsy + wsy) OVER w AS m_s0y0
  FROM tsum
  WINDOW w AS (PARTITION BY cluster ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def suffix_gram(spark, sf):
    """Sums over steps at or after t: the total less the prefix before t."""
    rows = cp.label(narrow_transitions(spark, sf), region_assignment(spark, sf))
    mom = cp.time_moments(rows, 1)
    every = Window.partitionBy("cluster")
    run = every.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return mom.select("cluster", "t", *[
        (F.sum(c).over(every) - F.coalesce(F.sum(c).over(run), F.lit(0.0))).alias(c) for c in ("m_n", "m_s0y0")])


@query("E-06", f"""{BY_REGION}, {scan_sql()}, {BEST},
seq AS (SELECT cluster, kappa, stat, coalesce(lag(kappa) OVER (PARTITION BY cluster ORDER BY kappa), kappa) AS prev FROM best)
SELECT cluster, CAST(coalesce({END_SQL} - min(prev) FILTER (stat >= 2.0), 0) AS INTEGER) AS tau,
       CAST(min(kappa) FILTER (stat >= 2.0) AS INTEGER) AS kappa FROM seq GROUP BY cluster""")
def first_rejection(spark, sf):
    grid = scan_grid(spark, sf)
    trans = narrow_transitions(spark, sf)
    best = cp.best_splits(trans, grid, assignment=region_assignment(spark, sf))
    limits = fixed_limits(spark, grid).withColumn("threshold", F.lit(2.0))
    return cp.first_rejection(best, limits, grid).select("cluster", "tau", "kappa")


@query("E-07", f"{BY_REGION}, {scan_sql()}, {BEST} SELECT cluster, CAST(kappa AS INTEGER) AS kappa, CAST(u AS INTEGER) AS u, round(stat, 4) AS stat FROM best")
def best_split_by_region(spark, sf):
    grid = scan_grid(spark, sf)
    stats = cp.split_statistics(narrow_transitions(spark, sf), grid, assignment=region_assignment(spark, sf))
    return cp.best_split(stats).select("cluster", "kappa", "u", F.round("stat", 4).alias("stat"))


@query("C-04", f"{POOLED}, {scan_sql()} SELECT CAST(kappa AS INTEGER) AS kappa, CAST(u AS INTEGER) AS u, round(stat, 4) AS stat FROM stats")
def candidate_statistics(spark, sf):
    """Every (kappa, u) candidate scored against the per-time sums."""
    grid = scan_grid(spark, sf)
    stats = cp.split_statistics(narrow_transitions(spark, sf), grid)
    return stats.select("kappa", "u", F.round("stat", 4).alias("stat"))


DENSE = f"""cells AS (
  SELECT subject, t, coalesce(s1, 0.0) AS s1, cluster
  FROM (SELECT DISTINCT subject FROM panel) CROSS JOIN (SELECT unnest(range(0, {N_SQL})) AS t)
  LEFT JOIN panel USING (subject, t) JOIN region_of USING (subject)),
facts AS (SELECT count(DISTINCT subject) AS n_all FROM panel)"""


def dense_panel(spark, sf):
    return fill_dense(supplier_month_narrow(spark, sf), horizon(spark, sf), {"s1": 0.0, "a": 0})


TOP_U = f"(CAST(floor({N_SQL} - 0.1e0 * {N_SQL}) AS BIGINT) - 1)"
LOW_U = f"CAST(floor({N_SQL} - kappa + 0.1e0 * {N_SQL}) AS INTEGER)"


@query("G-02", f"""WITH {PANEL}, {REGION}, {DENSE},
fwd AS (SELECT subject, cluster, t, avg(s1) OVER (PARTITION BY subject ORDER BY t) AS f,
        avg(s1) OVER (PARTITION BY subject ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM cells),
per_u AS (SELECT cluster, t AS u, count(*) AS nk, abs(sum(f - b)) AS d FROM fwd WHERE t <= {TOP_U} GROUP BY cluster, t),
scored AS (SELECT cluster, kappa, u, nk, sqrt(({N_SQL} - u) * (u - {N_SQL} + kappa) / (kappa * kappa)) * nk * d AS stat
  FROM per_u, {KAPPA_SQL}
  WHERE u > {LOW_U}),
best AS (SELECT cluster, kappa, nk, max(stat) AS stat, arg_min(u, ROW(-stat, u)) AS u FROM scored GROUP BY cluster, kappa, nk),
lim AS (SELECT *, 50.0 * power(kappa * nk, -0.5) * log10(n_all * {N_SQL}) AS threshold FROM best, facts)
SELECT cluster, CAST(CASE WHEN stat < threshold THEN {LOW_U} + 1 ELSE u END AS INTEGER) AS tau,
       round(stat, 3) AS stat, round(threshold, 4) AS threshold FROM lim WHERE kappa = {N_SQL} - 1""")
def mean_change(spark, sf):
    n_times = horizon(spark, sf)
    found = cp.detect_mean_change(dense_panel(spark, sf), n_times, level_windows(n_times), c1=50.0,
                                  assignment=region_assignment(spark, sf))
    return found.select("cluster", "tau", F.round("stat", 3).alias("stat"), F.round("threshold", 4).alias("threshold"))


@query("G-03", f"""WITH {PANEL}, {REGION}, {DENSE},
cuts AS (SELECT unnest(range(0, {TOP_U} + 1)) AS u),
var AS (SELECT cluster, u, count(DISTINCT subject) AS nk, count(*) AS n, var_pop(s1) AS v0,
   (var_pop(s1) FILTER (t <= u) * count(*) FILTER (t <= u) + var_pop(s1) FILTER (t > u) * count(*) FILTER (t > u)) / count(*) AS v1
  FROM cells, cuts GROUP BY cluster, u),
scored AS (SELECT cluster, kappa, u, nk, n / 2.0 * ln(v0 / v1) / (kappa * nk) AS stat
  FROM var, {KAPPA_SQL}
  WHERE u > {LOW_U}),
best AS (SELECT cluster, kappa, nk, max(stat) AS stat, arg_min(u, ROW(-stat, u)) AS u FROM scored GROUP BY cluster, kappa, nk),
lim AS (SELECT *, power(0.05 * power(kappa * nk, -0.5) * log10(n_all * {N_SQL}), 2) AS threshold FROM best, facts),
row1 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY kappa) AS rn FROM lim WHERE stat >= threshold)
SELECT c.cluster, CAST(coalesce(row1.u, 0) AS INTEGER) AS tau, CAST(row1.kappa AS INTEGER) AS kappa, round(row1.stat, 6) AS stat
FROM (SELECT DISTINCT cluster FROM best) c LEFT JOIN row1 ON row1.cluster = c.cluster AND row1.rn = 1""")
def marginal_change(spark, sf):
    n_times = horizon(spark, sf)
    found = cp.detect_marginal_change(dense_panel(spark, sf), n_times, level_windows(n_times), c1=0.05,
                                      assignment=region_assignment(spark, sf), rule="first")
    return found.select("cluster", "tau", "kappa", F.round("stat", 6).alias("stat"))


@query("G-08", f"""{BY_REGION},
seg AS (
  SELECT cluster, shift, {part_sums('(t + shift) % e < 40', 'l')},
         {part_sums('(t + shift) % e >= 40', 'r')}, {part_sums('TRUE', 'f')}
  FROM tsum, (SELECT {END_SQL} AS e, unnest(range(0, {END_SQL})) AS shift) GROUP BY cluster, shift)
SELECT cluster, CAST(shift AS INTEGER) AS shift, round(obs * ln((e0/obs) / (e1/obs)), 4) AS stat
  FROM (SELECT cluster, shift, fzn + fwn AS obs, {sse_sql('fz')} + {sse_sql('fw')} AS e0,
        {sse_sql('lz')} + {sse_sql('lw')} + {sse_sql('rz')} + {sse_sql('rw')} AS e1 FROM seg)""")
def cyclic_shift(spark, sf):
    out = cp.cyclic_shift_statistics(narrow_transitions(spark, sf), horizon(spark, sf), 40,
                                     assignment=region_assignment(spark, sf))
    return out.select("cluster", "shift", F.round("stat", 4).alias("stat"))


@query("B-26", f"""WITH {TRANS}, tsum AS (SELECT t, count(*) AS n, sum(s1) AS s FROM trans GROUP BY t)
SELECT CAST(shift AS INTEGER) AS shift, CAST((t + shift) % e AS INTEGER) AS pos, n, s
FROM tsum, (SELECT {END_SQL} AS e, unnest(range(0, {END_SQL})) AS shift)""")
def time_roll(spark, sf):
    steps = horizon(spark, sf) - 1
    per_t = narrow_transitions(spark, sf).groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s1").alias("s"))
    return per_t.select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("shift"), "t", "n", "s").select(
        "shift", ((F.col("t") + F.col("shift")) % steps).alias("pos"), "n", "s")


# --- simulated limits

@query("G-05")
def null_threshold_bridge(spark, sf):
    """The pooled scan held against simulated bridge limits of its own windows."""
    grid = scan_grid(spark, sf)
    best = cp.best_splits(narrow_transitions(spark, sf), grid)
    sample = nulls.null_sample(spark, grid.kappas(), cp.dense_df(1), draws=4000)
    return best.join(F.broadcast(nulls.thresholds(sample, 0.01)), "kappa").select(
        "kappa", F.round("stat", 4).alias("stat"), F.round("threshold", 4).alias("threshold"),
        (F.col("stat") >= F.col("threshold")).alias("rejected"))


@query("G-06")
def null_threshold_chi2(spark, sf):
    grid = scan_grid(spark, sf)
    best = cp.best_splits(narrow_transitions(spark, sf), grid)
    counts = [len(grid.splits(k)) for k in grid.kappas()]
    sample = nulls.null_sample(spark, grid.kappas(), cp.dense_df(1), 4000, "chi2", counts)
    return best.join(F.broadcast(nulls.thresholds(sample, 0.01)), "kappa").select(
        "kappa", F.round("stat", 4).alias("stat"), F.round("threshold", 4).alias("threshold"),
        (F.col("stat") >= F.col("threshold")).alias("rejected"))


@query("G-07")
def null_threshold_permutation(spark, sf):
    trans = narrow_transitions(spark, sf)
    found = cp.detect_transition_change(
        trans, scan_grid(spark, sf), assignment=region_assignment(spark, sf), threshold="permutation", draws=1000)
    return found.select("cluster", "tau", "kappa", F.round("stat", 4).alias("stat"))


@query("B-27")
def time_shuffle(spark, sf):
    """Window shuffles of the pooled panel: one scan maximum per replicate."""
    mom = cp.time_moments(cp.label(narrow_transitions(spark, sf), None), 1)
    return cp.permutation_sample(mom, scan_grid(spark, sf), 1, draws=1000)


@query("G-14")
def transition_change_pvalues(spark, sf):
    """Every window with its p-value, three state variables, per region."""
    grid = scan_grid(spark, sf)
    panel = zscore(supplier_month(spark, sf), ["s1", "s2", "s3"], suffix="")
    trans = transitions(panel, ["s1", "s2", "s3"])
    best = cp.best_splits(trans, grid, p=3, assignment=region_assignment(spark, sf))
    sample = nulls.null_sample(spark, grid.kappas(), cp.dense_df(3), draws=1000)
    return cp.with_pvalues(best, sample).select(
        "cluster", "kappa", "u", F.round("stat", 4).alias("stat"), F.round("pvalue", 4).alias("pvalue"))


@query("E-11")
def bridge_maximum(spark, sf):
    """Largest bridge value per window next to the panel's own maximum."""
    grid = scan_grid(spark, sf)
    best = cp.best_splits(narrow_transitions(spark, sf), grid)
    sample = nulls.null_sample(spark, grid.kappas(), cp.dense_df(1), draws=1000)
    top = sample.groupBy("kappa").agg(F.max("stat").alias("bridge_max"), F.avg("stat").alias("bridge_mean"))
    return best.join(F.broadcast(top), "kappa").select(
        "kappa", F.round("stat", 4).alias("stat"), F.round("bridge_max", 4).alias("bridge_max"),
        F.round("bridge_mean", 4).alias("bridge_mean"))


@query("A-07")
def threshold_cache(spark, sf):
    """Draws are written on the first request and only read on the second."""
    grid = scan_grid(spark, sf)
    cache = nulls.NullCache(spark, run_path(spark, "null-cache"))
    ks = grid.kappas()
    cache.sample(ks[: len(ks) // 2], cp.dense_df(1), 1000)
    sample = cache.sample(ks, cp.dense_df(1), 1000)
    best = cp.best_splits(narrow_transitions(spark, sf), grid)
    return best.join(F.broadcast(nulls.thresholds(sample, 0.05)), "kappa").select(
        "kappa", F.round("stat", 4).alias("stat"), F.round("threshold", 4).alias("threshold"))


@query("S-06")
def null_union(spark, sf):
    """Two groups of replicates appended, then one p-value per window."""
    grid = scan_grid(spark, sf)
    ks = grid.kappas()
    sample = nulls.null_sample(spark, ks, cp.dense_df(1), 500, seed=1).unionByName(
        nulls.null_sample(spark, ks, cp.dense_df(1), 500, seed=2).withColumn("rep", F.col("rep") + 500))
    best = cp.best_splits(narrow_transitions(spark, sf), grid)
    return cp.with_pvalues(best, sample).select(
        "kappa", "u", F.round("stat", 4).alias("stat"), F.round("pvalue", 4).alias("pvalue"))
