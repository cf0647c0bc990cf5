"""Policy learning and evaluation (survey 2.12 Q-*, A-06, C-09, C-10, D-27, D-32..D-34, F-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.features import FeatureMap
from panelwright.operators import kernel, ranking
from panelwright.operators.transitions import transitions
from panelwright.plans import policy, trees
from panelwright.plans.changepoint import label
from panelwright.queries.base import PANEL, REGION, TRANS, query
from panelwright.queries.detection import narrow_transitions
from panelwright.queries.prepare import region_tau
from panelwright.queries.tree_sql import bin_sql, evaluate_sql, fit_sql, value_sql, with_trees
from panelwright.session import materialize, run_path
from panelwright.sources import files
from panelwright.sources.tables import region_assignment, supplier_month, supplier_month_narrow

GAMMA = 0.5
LINEAR = FeatureMap("polynomial", degree=1)


def scaled(spark, sf):
    """Transitions with state and reward in hundreds, so that Q stays near one."""
    t = narrow_transitions(spark, sf)
    return t.select("subject", "t", "a", (F.col("s1") / 100).alias("s1"), (F.col("y1") / 100).alias("y1"),
                    (F.col("r") / 100).alias("r"))


def linear_rows(spark, sf):
    return materialize(policy.policy_rows(scaled(spark, sf), ["s1"], LINEAR), "policy-rows")


def fitted(rows, max_iter=200):
    return policy.fitted_q_iteration(rows, GAMMA, max_iter=max_iter).model


# --- SQL text: fitted-Q iteration and evaluation as recursions that end by the operators' own rules.

def coef_sql(y: str) -> str:
    return ", ".join(f"regr_{kind}({y}, x) FILTER (a = {a}) AS {c}{a}" for a in (0, 1) for c, kind in (("c", "intercept"), ("b", "slope")))


def line_sql(q: str, x: str, a: str = "a") -> str:
    return f"CASE WHEN {a} = 1 THEN {q}.c1 + {q}.b1 * {x} ELSE {q}.c0 + {q}.b0 * {x} END"


def fqi_sql(max_iter: int = 200, tol: float = 1e-6) -> str:
    """CTEs row0 (the rows), fq (coefficients after each update) and qf (the last ones).

    An update's change is that of the fitted values against their size; the first is compared with zero.
    """
    return f"""row0 AS (SELECT subject, t, a, s1 / 100 AS x, y1 / 100 AS z, y1 / 100 AS r FROM trans),
fq AS (
  SELECT 0 AS step, {coef_sql('r')}, false AS done FROM row0
  UNION ALL (
  WITH cur AS (SELECT * FROM fq WHERE NOT done),
  nx AS (SELECT any_value(step) + 1 AS step, {coef_sql('y')}
    FROM (SELECT a, x, step, r + {GAMMA} * greatest(c0 + b0 * z, c1 + b1 * z) AS y FROM row0, cur) HAVING count(*) > 0),
  mv AS (SELECT sqrt(sum((new - old) ** 2)) / (sqrt(sum(old * old)) + 1e-6) AS err FROM (
    SELECT {line_sql('nx', 'x')} AS new, CASE WHEN cur.step = 0 THEN 0 ELSE {line_sql('cur', 'x')} END AS old FROM row0, nx, cur))
  SELECT nx.*, err <= {tol} OR step > {max_iter} AS done FROM nx, mv)),
qf AS (SELECT c0, b0, c1, b1 FROM fq WHERE done)"""


def fqe_sql(pi: str = "CASE WHEN c1 + b1 * z > c0 + b0 * z THEN 1 ELSE 0 END", relative: bool = False, max_iter: int = 200,
            rows: str = "row0, qf") -> str:
    """CTEs act (rows with pi), ev (coefficients after each round) and ef, the evaluated ones."""
    return f"""act AS (SELECT row0.*, {pi} AS pi FROM {rows}),
ev AS (
  SELECT 0 AS step, c0, b0, c1, b1, false AS done FROM qf
  UNION ALL (
  WITH cur AS (SELECT * FROM ev WHERE NOT done),
  nx AS (SELECT any_value(step) + 1 AS step, {coef_sql('y')}
    FROM (SELECT a, x, step, r + {GAMMA} * {line_sql('cur', 'z', 'pi')} AS y FROM act, cur) HAVING count(*) > 0),
  mv AS (SELECT avg((new - old) ** 2{' / (old * old)' if relative else ''}) AS err FROM (
    SELECT {line_sql('nx', 'z', 'pi')} AS new, {line_sql('cur', 'z', 'pi')} AS old FROM act, nx, cur))
  SELECT nx.*, err < 1e-7 OR step >= {max_iter} AS done FROM nx, mv)),
ef AS (SELECT c0, b0, c1, b1 FROM ev WHERE done)"""


FQI = f"WITH RECURSIVE {TRANS}, {fqi_sql()}"
COEFS = "SELECT CAST(a AS INTEGER) AS action, round(CASE a WHEN 1 THEN c1 ELSE c0 END, 6) AS c, round(CASE a WHEN 1 THEN b1 ELSE b0 END, 6) AS b FROM qf, (SELECT unnest([0, 1]) AS a)"


@query("Q-01", f"{FQI} {COEFS}")
def fitted_q_iteration(spark, sf):
    """Linear fitted-Q iteration until the fitted values settle."""
    return fitted(linear_rows(spark, sf)).frame(spark).select(
        "action", F.round(F.col("coef")[0], 6).alias("c"), F.round(F.col("coef")[1], 6).alias("b"))


GREEDY = "CASE WHEN c1 + b1 * {0} > c0 + b0 * {0} THEN 1 ELSE 0 END"


@query("Q-03", f"{FQI} SELECT subject, t, {GREEDY.format('x')} AS opt_action, round(greatest(c0 + b0 * x, c1 + b1 * x), 5) AS opt_value FROM row0, qf")
def greedy_policy(spark, sf):
    rows = linear_rows(spark, sf)
    return policy.greedy(rows, fitted(rows)).select(
        "subject", "t", "opt_action", F.round("opt_value", 5).alias("opt_value"))


@query("F-05", f"{FQI} SELECT subject, t, {GREEDY.format('x')} AS opt_action FROM row0, qf")
def greedy_action(spark, sf):
    """Arg-max action from a model table, joined by cluster."""
    rows = linear_rows(spark, sf)
    return policy.greedy_from_table(rows, fitted(rows).frame(spark)).select("subject", "t", "opt_action")


VOTE = f"""{FQI}, m AS (SELECT CASE step WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS m, c0, b0, c1, b1 FROM fq WHERE step IN (0, 2) OR done),
v AS (SELECT subject, t, m, {{0}} AS a, greatest(c0 + b0 * {{1}}, c1 + b1 * {{1}}) AS q FROM row0, m),
n AS (SELECT subject, t, a, count(*) AS n, avg(q) AS q FROM v GROUP BY ALL)"""


def three_models(rows):
    """The Q functions after the first fit, after two updates and after the last."""
    first = policy.LinearQ({k: policy._solve(g, b) for k, (g, b, _) in policy._grams(rows, 2).items()})
    return [first, fitted(rows, 1), fitted(rows)]


@query("Q-04", VOTE.format(GREEDY.format("x"), "x") +
       " SELECT subject, t, CAST(arg_max(a, ROW(n, -a)) AS INTEGER) AS a, round(arg_max(q, ROW(n, -a)), 5) AS q FROM n GROUP BY subject, t")
def vote_policy(spark, sf):
    rows = linear_rows(spark, sf)
    return policy.vote(rows, three_models(rows)).select("subject", "t", "a", F.round("q", 5).alias("q"))


@query("D-34", VOTE.format(GREEDY.format("x"), "x") +
       " SELECT subject, t, CAST(arg_max(a, ROW(n, -a)) AS INTEGER) AS a, round(arg_max(q, ROW(n, -a)), 5) AS q FROM n GROUP BY subject, t")
def majority_vote(spark, sf):
    """The vote over a long table with one row per model."""
    rows = linear_rows(spark, sf)
    long = None
    for i, m in enumerate(three_models(rows)):
        one = policy.greedy(rows, m).select("subject", "t", F.lit(i).alias("model"), F.col("opt_action").alias("a"),
                                            F.col("opt_value").alias("q"))
        long = one if long is None else long.unionByName(one)
    return policy.vote_long(long, ["subject", "t"]).select("subject", "t", "a", F.round("q", 5).alias("q"))


TDE = f"""{FQI}, td AS (SELECT subject, t, a, x, r + {GAMMA} * greatest(c0 + b0 * z, c1 + b1 * z) - CASE WHEN a = 1 THEN c1 + b1 * x ELSE c0 + b0 * x END AS tde
FROM row0, qf)"""


def td_rows(spark, sf):
    rows = linear_rows(spark, sf)
    return policy.with_td_error(rows, fitted(rows), GAMMA)


@query("Q-05", f"{TDE} SELECT subject, t, round(tde, 5) AS tde FROM td")
def td_error(spark, sf):
    return td_rows(spark, sf).select("subject", "t", F.round("tde", 5).alias("tde"))


@query("D-32", f"{TDE} SELECT round(avg(tde * tde), 6) AS loss FROM td")
def td_loss(spark, sf):
    td = td_rows(spark, sf)
    return td.agg(F.round(policy.squared_loss(td), 6).alias("loss"))


BW = 4.0


@query("C-09", f"{TDE}, i AS (SELECT *, row_number() OVER (ORDER BY subject, t) AS id FROM td) "
       f"SELECT round(sum(exp(-{BW} * (p.x - q.x) ** 2) * p.tde * q.tde) / 1000, 4) AS s FROM i p JOIN i q ON p.id < q.id")
def pair_sum(spark, sf):
    """Kernel-weighted sum of products over all pairs of rows, without the pairs."""
    return kernel.kernel_pair_sum(td_rows(spark, sf), "x1", BW, "cluster").select(F.round(F.col("s") / 1000, 4).alias("s"))


def td_with_states(spark, sf):
    """The TD errors beside the second and third state of their steps.

    Both sides have a row per step; by the size of its compressed files one would be broadcast.
    """
    more = transitions(supplier_month(spark, sf), ["s1", "s2", "s3"]).select(
        "subject", "t", (F.col("s2") / 20000).alias("u"), (20 * F.col("s3")).alias("v"))
    return td_rows(spark, sf).join(more.hint("merge"), ["subject", "t"])


@query("D-33", f"{TDE}, i AS (SELECT td.a, tde, x, s2 / 20000 AS u, 20 * s3 AS v, row_number() OVER (ORDER BY subject, t) AS id FROM td JOIN trans USING (subject, t)), "
       f"k AS (SELECT exp(-{BW} * ((p.x - q.x) ** 2 + (p.u - q.u) ** 2 + (p.v - q.v) ** 2)) AS ks, abs(p.a - q.a) AS ka, p.tde * q.tde AS e FROM i p JOIN i q ON p.id < q.id) "
       "SELECT round(avg((1 + ka + ks + ka * ks) * e), 7) AS loss FROM k")
def kernel_td_loss(spark, sf):
    """Kernel loss over all three states, without the pairs."""
    return kernel.kernel_td_loss(td_with_states(spark, sf), ["x1", "u", "v"], BW).select(F.round("loss", 7).alias("loss"))


@query("C-10", f"""WITH {PANEL}, i AS (SELECT s1, row_number() OVER (ORDER BY subject, t) AS id FROM panel)
SELECT median(d) AS median, round(1 / median(d), 8) AS bandwidth FROM (SELECT abs(p.s1 - q.s1) AS d FROM i p JOIN i q ON p.id < q.id) WHERE d > 0""")
def median_bandwidth(spark, sf):
    """Median positive distance over the steps of all subjects."""
    return kernel.median_bandwidth(supplier_month_narrow(spark, sf), ["s1"]).select(
        "median", F.round("bandwidth", 8).alias("bandwidth"))


@query("Q-06", f"{FQI}, {fqe_sql()} SELECT subject, t, round(CASE WHEN pi = 1 THEN c1 + b1 * z ELSE c0 + b0 * z END, 5) AS value FROM act, ef")
def fitted_q_evaluation(spark, sf):
    rows = linear_rows(spark, sf)
    done = policy.fitted_q_evaluation(rows, fitted(rows), GAMMA)
    return done.values().select("subject", "t", F.round("value", 5).alias("value"))


@query("Q-07", f"""{FQI}, {fqe_sql(relative=True)}, f AS (SELECT subject, arg_min(x, t) AS x FROM row0 GROUP BY subject)
SELECT subject, round(greatest(c0 + b0 * x, c1 + b1 * x), 5) AS value FROM f, ef""")
def evaluation_at_start(spark, sf):
    """Evaluated Q at each subject's first state under the greedy action."""
    rows = linear_rows(spark, sf)
    done = policy.fitted_q_evaluation(rows, fitted(rows), GAMMA, rule="relative")
    return policy.initial_values(rows, done.model, done.model).select("subject", F.round("value", 5).alias("value"))


@query("Q-08", f"{VOTE.format(GREEDY.format('z'), 'z')}, pv AS (SELECT subject, t, CAST(arg_max(a, ROW(n, -a)) AS INTEGER) AS pi FROM n GROUP BY subject, t), "
       + fqe_sql("pi", rows="row0 JOIN pv USING (subject, t)")
       + " SELECT subject, t, round(CASE WHEN pi = 1 THEN c1 + b1 * z ELSE c0 + b0 * z END, 5) AS value FROM act, ef")
def evaluation_of_vote(spark, sf):
    rows = linear_rows(spark, sf)
    models = three_models(rows)
    done = policy.fitted_q_evaluation(rows, models[-1], GAMMA, policy="vote", models=models)
    return done.values().select("subject", "t", F.round("value", 5).alias("value"))


@query("Q-12")
def epsilon_greedy(spark, sf):
    rows = linear_rows(spark, sf)
    scored = policy.epsilon_greedy(policy.greedy(rows, fitted(rows)), 0.2)
    return scored.select("subject", "t", "opt_action", "action")


@query("A-06", f"{FQI} {COEFS}")
def policy_sink(spark, sf):
    """Models written to Parquet, read back, and used as the table they are."""
    path = run_path(spark, "models")
    files.write_models(fitted(linear_rows(spark, sf)).frame(spark), path)
    return files.read_models(spark, path).select(
        "action", F.round(F.col("coef")[0], 6).alias("c"), F.round(F.col("coef")[1], 6).alias("b"))


# --- trees: one per (cluster, action), on the steps after the cluster's change, to their own stop rule

TREE_GAMMA = GAMMA
TREE_ROWS = f"""{TRANS}, {REGION}, base AS (SELECT subject, t, cluster AS g, a, s1 / 100 AS x, y1 / 100 AS z, y1 / 100 AS r
  FROM trans JOIN region_of USING (subject) WHERE t >= cluster * 10 + 20)"""


def cell_sql(name: str, source: str, depth: str = "2", leaf: str = "40") -> str:
    """CTEs: the rows of ``source`` (g, a, x, z, r) with their bins, and as cells."""
    return f"""{name}_coded AS (SELECT s.*, p.code AS cx, q.code AS cz FROM {source} s JOIN bin p ON p.v = s.x JOIN bin q ON q.v = s.z),
{name} AS (SELECT g, a, {depth} AS depth, {leaf} AS leaf, cx, cz, count(*)::DOUBLE AS n, sum(r) AS r FROM {name}_coded GROUP BY ALL)"""


def tree_rows(spark, sf):
    """Rows of every region after its change point."""
    rows = policy.policy_rows(label(scaled(spark, sf), region_assignment(spark, sf)), ["s1"], LINEAR, "cluster")
    taus = region_assignment(spark, sf).join(region_tau(spark, sf), "cluster").select("subject", (F.col("tau") + 20).alias("tau"))
    return materialize(trees.post_change(rows, taus), "policy-rows")


Q_X = [value_sql(f"t{a}", "c.cx") for a in (0, 1)]


@query("Q-02", f"""WITH RECURSIVE {TREE_ROWS}, {bin_sql('base')}, {cell_sql('cells', 'base')}, {fit_sql('fit', 'cells', TREE_GAMMA)}
SELECT CAST(g AS INTEGER) AS cluster, CASE WHEN {Q_X[1]} > {Q_X[0]} THEN 1 ELSE 0 END AS action, count(*) AS n,
  round(avg(greatest({Q_X[0]}, {Q_X[1]})), 6) AS value, CAST(any_value(t0.step) AS INTEGER) AS rounds
FROM cells_coded c {with_trees('fit')} GROUP BY 1, 2""")
def tree_q_iteration(spark, sf):
    """Trees of depth two as Q functions of each region: greedy action counts, mean value, rounds until the rule stopped."""
    rows = tree_rows(spark, sf)
    fit = trees.tree_policies(rows, TREE_GAMMA, max_depth=2, min_leaf=40)
    rounds = spark.createDataFrame([(k, n) for k, n in zip(fit.trees.clusters, fit.iterations)], "cluster int, rounds int")
    return policy.greedy(rows, fit.trees).groupBy("cluster", F.col("opt_action").alias("action")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("opt_value"), 6).alias("value")).join(rounds, "cluster")


CV_GRID = [{"max_depth": d, "min_samples_leaf": m} for d in (1, 2) for m in (20, 60)]
CV_FOLDS = 3


@query("Q-09", f"""WITH RECURSIVE {TRANS},
fold_of AS (SELECT subject, ntile({CV_FOLDS}) OVER (ORDER BY subject) - 1 AS fold FROM (SELECT DISTINCT subject FROM trans)),
base AS (SELECT fold, a, s1 / 100 AS x, y1 / 100 AS z, y1 / 100 AS r FROM trans JOIN fold_of USING (subject)), {bin_sql('base')},
grid AS (SELECT * FROM (VALUES {", ".join(f"({i}, {p['max_depth']}, {p['min_samples_leaf']})" for i, p in enumerate(CV_GRID))}) v(param_id, depth, leaf)),
model AS (SELECT param_id * {CV_FOLDS} + f AS g, param_id, depth, leaf, f FROM grid, (SELECT unnest(range({CV_FOLDS})) AS f)),
train AS (SELECT g, depth, leaf, a, x, z, r FROM base JOIN model ON fold <> f), {cell_sql('cells', 'train', 'depth', 'leaf')},
{fit_sql('fit', 'cells', TREE_GAMMA, 200, 1e-4, True)},
test AS (SELECT g, param_id, a, r, p.code AS cx, q.code AS cz FROM base JOIN model ON fold = f JOIN bin p ON p.v = x JOIN bin q ON q.v = z),
loss AS (SELECT g, param_id, avg((r + {TREE_GAMMA} * greatest({value_sql('t0', 'c.cz')}, {value_sql('t1', 'c.cz')}) - CASE WHEN c.a = 1 THEN {Q_X[1]} ELSE {Q_X[0]} END) ** 2) AS loss
  FROM test c {with_trees('fit')} GROUP BY g, param_id)
SELECT 0 AS cluster, CAST(param_id AS INTEGER) AS param_id, round(avg(loss), 6) AS test_error FROM loss GROUP BY param_id""")
def select_model_cv(spark, sf):
    """Depth and leaf size by three-fold test error, all settings and folds in the same passes."""
    trans = scaled(spark, sf)
    folds = ranking.contiguous_chunks(trans.select("subject").distinct(), "subject", CV_FOLDS)
    rows = policy.policy_rows(trans, ["s1"], LINEAR).join(folds, "subject")
    return trees.select_tree_cv(materialize(rows, "cv-rows"), CV_GRID, CV_FOLDS, TREE_GAMMA).withColumn(
        "test_error", F.round("test_error", 6))


@query("Q-11", f"""WITH RECURSIVE {TRANS}, {REGION},
steps AS (SELECT subject, t, cluster AS g, cluster AS k_train, subject % 2 AS k_test, a, s1 / 100 AS x, y1 / 100 AS z, y1 / 100 AS r
  FROM trans JOIN region_of USING (subject)), {bin_sql('steps')},
train AS (SELECT * FROM steps WHERE t < 60), {cell_sql('cells', 'train', '2', '40')}, {fit_sql('fit', 'cells', TREE_GAMMA)},
test AS (SELECT * REPLACE (k_test * 100 + k_train AS g) FROM steps WHERE t >= 60), {cell_sql('tests', 'test', '2', '10')},
start AS (SELECT p.g, a, c0, cl, cr, v0, v1, v2, v3 FROM (SELECT DISTINCT g, k_train FROM test) p JOIN fit ON fit.g = p.k_train),
{evaluate_sql('done', 'tests', 'start', TREE_GAMMA)},
first AS (SELECT subject, any_value(g) AS g, any_value(k_test) AS k_test, any_value(k_train) AS k_train, arg_min(cx, t) AS cx FROM tests_coded GROUP BY subject)
SELECT subject, CAST(k_test AS BIGINT) AS k_test, CAST(k_train AS BIGINT) AS k_train, round(greatest({Q_X[0]}, {Q_X[1]}), 5) AS value
FROM first c {with_trees('done')}""")
def ope_by_segment(spark, sf):
    """Value of every subject on the last steps, by test and training label; trees grown anew in each round."""
    rows = materialize(policy.policy_rows(label(scaled(spark, sf), region_assignment(spark, sf)), ["s1"], LINEAR, "cluster"), "policy-rows")
    bins = trees.bins_of(rows)
    specs = [trees.Spec(k, -1, 2, 40) for k in trees.clusters_of(rows)]
    fit = trees.fit_q(trees.cells(rows.filter("t < 60"), bins), specs, bins, TREE_GAMMA)
    test = region_assignment(spark, sf).select("subject", (F.col("subject") % 2).alias("k_test"))
    return trees.ope_by_segment(rows.filter("t >= 60"), test, fit.trees, TREE_GAMMA, 2, 10).withColumn("value", F.round("value", 5))


def cv_sql(folds: int, updates: int, where: str) -> str:
    parts = [f"fold_of AS (SELECT subject, ntile({folds}) OVER (ORDER BY subject) - 1 AS fold FROM (SELECT DISTINCT subject FROM trans))",
             f"base AS (SELECT fold, subject, t, a, s1 / 100 AS x, y1 / 100 AS z, y1 / 100 AS r FROM trans JOIN fold_of USING (subject) WHERE {where})",
             f"tr AS (SELECT g AS grp, base.* FROM base, (SELECT unnest(range({folds})) AS g) WHERE fold <> g)",
             "c0 AS (SELECT grp, a, regr_intercept(r, x) AS c, regr_slope(r, x) AS b FROM tr GROUP BY ALL)"]
    for i in range(1, updates + 1):
        parts.append(f"d{i} AS (SELECT grp, max(c) FILTER (a=0) AS c0, max(b) FILTER (a=0) AS b0, max(c) FILTER (a=1) AS c1, max(b) FILTER (a=1) AS b1 FROM c{i - 1} GROUP BY grp)")
        parts.append(f"c{i} AS (SELECT grp, a, regr_intercept(r + {GAMMA} * greatest(c0 + b0 * z, c1 + b1 * z), x) AS c, regr_slope(r + {GAMMA} * greatest(c0 + b0 * z, c1 + b1 * z), x) AS b FROM tr JOIN d{i} USING (grp) GROUP BY ALL)")
    n = updates
    parts.append(f"df AS (SELECT grp, max(c) FILTER (a=0) AS c0, max(b) FILTER (a=0) AS b0, max(c) FILTER (a=1) AS c1, max(b) FILTER (a=1) AS b1 FROM c{n} GROUP BY grp)")
    parts.append(f"te AS (SELECT grp, avg((r + {GAMMA} * greatest(c0 + b0 * z, c1 + b1 * z) - CASE WHEN a = 1 THEN c1 + b1 * x ELSE c0 + b0 * x END) ** 2) AS loss FROM base JOIN df ON fold = grp GROUP BY grp)")
    return ",\n".join(parts)


@query("Q-10", f"WITH {TRANS}, {cv_sql(3, 40, 't % 5 = 0')} SELECT 0 AS param_id, round(avg(loss), 6) AS test_error FROM te")
def cv_at_sampled_times(spark, sf):
    """Fit and score at every fifth step only; the next state is the step after it."""
    trans = scaled(spark, sf)
    folds = ranking.contiguous_chunks(trans.select("subject").distinct(), "subject", 3)
    times = trans.select("t").distinct().filter("t % 5 = 0")
    return policy.select_linear_cv(trans, folds, ["s1"], [LINEAR], GAMMA, tol=1e-10, early_stopping=False,
                                   times=times).withColumn("test_error", F.round("test_error", 6))
