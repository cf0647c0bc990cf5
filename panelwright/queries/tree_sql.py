"""Check SQL of tree policies: growth to depth two, fitted-Q iteration and evaluation as recursions."""

from __future__ import annotations

# A tree is a row (c0, cl, cr, v0..v3): the root's cut, its children's cuts and the four leaves' values.
NO_CUT = 1 << 20


def bin_sql(source: str, bins: int = 64) -> str:
    """CTEs bin (v, code) and ends (code, lo, hi) of the x and z of ``source``."""
    return f"""vals AS (SELECT v, count(*) AS c FROM (SELECT x AS v FROM {source} UNION ALL SELECT z FROM {source}) GROUP BY v),
below AS (SELECT v, coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(c) OVER () AS n, count(*) OVER () AS k FROM vals),
bin AS (SELECT v, CASE WHEN k <= {bins} THEN row_number() OVER (ORDER BY v) - 1 ELSE dense_rank() OVER (ORDER BY floor({bins} * b / n)) - 1 END AS code FROM below),
ends AS (SELECT code, min(v) AS lo, max(v) AS hi FROM bin GROUP BY code)"""


def value_sql(tree: str, code: str) -> str:
    """Value of a tree row at a bin."""
    return (f"CASE WHEN {code} <= {tree}.c0 THEN CASE WHEN {code} <= {tree}.cl THEN {tree}.v0 ELSE {tree}.v1 END "
            f"ELSE CASE WHEN {code} <= {tree}.cr THEN {tree}.v2 ELSE {tree}.v3 END END")


def _split_sql(name: str, source: str, keys: str) -> str:
    """CTE ``name`` (keys, cut): the first of the best cuts of each group of ``source`` (keys, leaf, cx, n, y)."""
    over = f"PARTITION BY {keys}"
    return f"""{name}_h AS (SELECT {keys}, any_value(leaf) AS leaf, cx, sum(n) AS n, sum(y) AS y FROM {source} GROUP BY {keys}, cx),
{name}_w AS (SELECT *, sum(n) OVER ({over} ORDER BY cx) AS ln, sum(y) OVER ({over} ORDER BY cx) AS ls, sum(n) OVER ({over}) AS tn,
  sum(y) OVER ({over}) AS ts, lead(cx) OVER ({over} ORDER BY cx) AS nx FROM {name}_h),
{name}_g AS (SELECT {keys}, cx, nx, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain, 1e-10 * ts * ts / tn AS small
  FROM {name}_w WHERE ln >= leaf AND tn - ln >= leaf),
{name}_b AS (SELECT *, max(gain) OVER ({over}) AS most FROM {name}_g),
{name}_c AS (SELECT {keys}, min(cx) AS cx, arg_min(nx, cx) AS nx FROM {name}_b WHERE most > small AND gain >= most - small GROUP BY {keys}),
{name} AS (SELECT {keys}, greatest(any_value({name}_c.cx), least(max(e.code), any_value({name}_c.nx) - 1)) AS cut
  FROM {name}_c JOIN ends p ON p.code = {name}_c.cx JOIN ends q ON q.code = {name}_c.nx JOIN ends e ON e.hi <= (p.hi + q.lo) / 2 GROUP BY {keys})"""


def grow_sql(name: str, source: str) -> str:
    """CTE ``name`` (g, a, c0, cl, cr, v0..v3): trees on ``source`` (g, a, depth, leaf, cx, n, y) to depth two at most."""
    s = f"{name}_"
    means = ", ".join(f"sum(y) FILTER (part = {i}) / sum(n) FILTER (part = {i}) AS v{i}" for i in range(4))
    return f"""{_split_sql(s + 'r', source, 'g, a')},
{s}s AS (SELECT {source}.*, coalesce(cut, {NO_CUT}) AS c0, cx > coalesce(cut, {NO_CUT}) AS side FROM {source} LEFT JOIN {s}r USING (g, a)),
{s}t AS (SELECT * FROM {s}s WHERE depth >= 2 AND c0 < {NO_CUT}),
{_split_sql(s + 'k', s + 't', 'g, a, side')},
{s}l AS (SELECT {s}s.*, coalesce(cut, {NO_CUT}) AS c1 FROM {s}s LEFT JOIN {s}k USING (g, a, side)),
{s}p AS (SELECT *, (CASE WHEN side THEN 2 ELSE 0 END) + (CASE WHEN cx > c1 THEN 1 ELSE 0 END) AS part FROM {s}l),
{name} AS (SELECT g, a, any_value(c0) AS c0, coalesce(any_value(c1) FILTER (NOT side), {NO_CUT}) AS cl, coalesce(any_value(c1) FILTER (side), {NO_CUT}) AS cr,
  {means} FROM {s}p GROUP BY g, a)"""


def with_trees(tree: str) -> str:
    """Joins that add the trees of both actions as t0 and t1 by g."""
    return f"JOIN (SELECT * FROM {tree} WHERE a = 0) t0 USING (g) JOIN (SELECT * FROM {tree} WHERE a = 1) t1 USING (g)"


def fit_sql(name: str, cells: str, gamma: float, max_iter: int = 200, tol: float = 1e-6, early: bool = False) -> str:
    """CTEs ending in ``name``: trees after the last round of fitted-Q iteration of each g.

    ``cells`` has (g, a, depth, leaf, cx, cz, n, r). Round 0 is fitted to r; the rounds' change is compared
    with zero first.
    """
    s = f"{name}_"
    own = f"CASE WHEN c.a = 1 THEN {value_sql('t1', 'c.cx')} ELSE {value_sql('t0', 'c.cx')} END"
    target = f"c.r + {gamma} * c.n * greatest({value_sql('t0', 'c.cz')}, {value_sql('t1', 'c.cz')})"
    stop = f"step > {max_iter} OR err <= {tol}" + (" OR abs(err - low) < 1e-5" if early else "")
    return f"""{s}y0 AS (SELECT g, a, depth, leaf, cx, n, r AS y FROM {cells}),
{grow_sql(s + 'q0', s + 'y0')},
{s}all AS (
  SELECT 0 AS step, {s}q0.*, 1e300::DOUBLE AS err, 1e300::DOUBLE AS low, false AS done FROM {s}q0
  UNION ALL (
  WITH cur AS (SELECT * FROM {s}all WHERE NOT done),
  y AS (SELECT c.g, c.a, c.depth, c.leaf, c.cx, c.n, {target} AS y FROM {cells} c {with_trees('cur')}),
  {grow_sql('nw', 'y')},
  was AS (SELECT c.g, c.a, c.cx, sum(c.n) AS n, any_value(CASE WHEN t0.step = 0 THEN 0 ELSE {own} END) AS q FROM {cells} c {with_trees('cur')} GROUP BY c.g, c.a, c.cx),
  moved AS (SELECT was.g, sqrt(sum(n * ((CASE WHEN was.a = 1 THEN {value_sql('t1', 'was.cx')} ELSE {value_sql('t0', 'was.cx')} END) - q) ** 2))
    / (sqrt(sum(n * q * q)) + 1e-6) AS err FROM was {with_trees('nw')} GROUP BY was.g),
  past AS (SELECT g, any_value(step) + 1 AS step, any_value(low) AS low FROM cur GROUP BY g)
  SELECT step, nw.*, err, least(low, err) AS low, ({stop}) AS done FROM nw JOIN moved USING (g) JOIN past USING (g))),
{name} AS (SELECT g, a, c0, cl, cr, v0, v1, v2, v3, step FROM {s}all WHERE done)"""


def evaluate_sql(name: str, cells: str, start: str, gamma: float, max_iter: int = 500, tol: float = 1e-7) -> str:
    """CTEs ending in ``name``: the evaluated trees of each g, from those of ``start`` whose greedy policy is followed."""
    s = f"{name}_"
    q0, q1 = value_sql("t0", "c.cz"), value_sql("t1", "c.cz")
    taken = f"CASE WHEN c.pi = 1 THEN {q1} ELSE {q0} END"
    return f"""{s}c AS (SELECT c.*, CASE WHEN {q1} > {q0} THEN 1 ELSE 0 END AS pi FROM {cells} c {with_trees(start)}),
{s}all AS (
  SELECT 0 AS step, g, a, c0, cl, cr, v0, v1, v2, v3, 1e300::DOUBLE AS err, false AS done FROM {start}
  UNION ALL (
  WITH cur AS (SELECT * FROM {s}all WHERE NOT done),
  y AS (SELECT c.g, c.a, c.depth, c.leaf, c.cx, c.n, c.r + {gamma} * c.n * ({taken}) AS y FROM {s}c c {with_trees('cur')}
    WHERE EXISTS (SELECT 1 FROM {s}c q WHERE q.g = c.g AND q.pi = c.a)),
  {grow_sql('gr', 'y')},
  nw AS (SELECT * FROM gr UNION ALL SELECT g, a, c0, cl, cr, v0, v1, v2, v3 FROM cur WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.g = cur.g AND gr.a = cur.a)),
  old AS (SELECT c.g, c.pi, c.cz, sum(c.n) AS n, any_value({taken}) AS q FROM {s}c c {with_trees('cur')} GROUP BY c.g, c.pi, c.cz),
  moved AS (SELECT c.g, sum(n * (({taken}) - q) ** 2 / (q * q)) / sum(n) AS err FROM old c {with_trees('nw')} GROUP BY c.g),
  past AS (SELECT g, any_value(step) + 1 AS step FROM cur GROUP BY g)
  SELECT step, nw.*, err, (err < {tol} OR step >= {max_iter}) AS done FROM nw JOIN moved USING (g) JOIN past USING (g))),
{name} AS (SELECT g, a, c0, cl, cr, v0, v1, v2, v3, step FROM {s}all WHERE done)"""
