"""Registry of runnable queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under its survey id, with the SQL that must agree with it."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# Common table expressions shared by the check SQL.
PANEL = """
panel AS (
  SELECT l_suppkey AS subject,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t,
         sum(l_quantity) AS s1, avg(l_extendedprice) AS s2, avg(l_discount) AS s3,
         CASE WHEN 3 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > count(*)
              THEN 1 ELSE 0 END AS a
  FROM lineitem
  GROUP BY 1, 2)
"""

# Time points of the panel, and its last one.
N_SQL = "(SELECT max(t) + 1 FROM panel)"
END_SQL = "(SELECT max(t) FROM panel)"

TRANS = PANEL + """,
lagged AS (
  SELECT subject, t, a, s1, s2, s3,
         lead(t) OVER w AS tn, lead(s1) OVER w AS y1, lead(s2) OVER w AS y2, lead(s3) OVER w AS y3
  FROM panel WINDOW w AS (PARTITION BY subject ORDER BY t)),
trans AS (SELECT subject, t, a, s1, s2, s3, y1 AS r, y1, y2, y3 FROM lagged WHERE tn = t + 1)
"""

REGION = """
region_of AS (
  SELECT s_suppkey AS subject, n_regionkey AS cluster
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""

USER_DAY = """
panel AS (
  SELECT user_id AS subject, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
         CAST(count(*) AS DOUBLE) AS s1, avg(value) AS s2,
         CASE WHEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS a
  FROM events GROUP BY 1, 2)
"""

NATION_MONTH = """
panel AS (
  SELECT CAST(c_nationkey AS BIGINT) AS subject,
         CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t,
         CAST(count(*) AS DOUBLE) AS s1
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""
