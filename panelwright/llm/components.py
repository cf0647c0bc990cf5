"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import drop_path, materialize_at, run_path


#: Keys that are broadcast at most, as each holds more than this share of the rows; and the fewest rows of such a key.
MAX_FREQUENT, FREQUENT = 10_000, 100


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``table`` of one row per ``key``, whose column ``n`` tells how many rows have the key.

    Keys that hold more than a ``MAX_FREQUENT``-th of the ``total`` rows are broadcast: there are fewer than
    ``MAX_FREQUENT`` of them, whatever the data. All others meet their rows by a merge join, where none is large.
    ``n`` isn't returned.
    """
    limit = max(FREQUENT, total // MAX_FREQUENT)
    common = table.filter(F.col(n) > limit).drop(n).withColumn("_frequent", F.lit(True))
    met = rows.join(F.broadcast(common), key, "left")
    rest = met.filter("_frequent is null").select(*rows.columns).join(
        table.filter(F.col(n) <= limit).drop(n).hint("merge"), key, how)
    return met.filter("_frequent").drop("_frequent").unionByName(rest)


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b) that isn't its component's smallest.

    Alternating stars: first every node hands its larger neighbours to the
    smallest node it knows, then every node and its smaller neighbours go to the
    smallest of them. Links never grow in number, and the rounds grow with the
    logarithm of the longest path. Each round's links are a table in the shared
    folder; the one before is removed. A node with very many neighbours is one
    aggregate row and a join that may be split. Joins ask for a merge, as the compressed links, by which Spark
    judges the size, are a small part of what a broadcast of the nodes takes.
    """
    spark = links.sparkSession
    path = run_path(spark, "links")
    current = materialize_at(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), path)
    state = _state(current)
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least.hint("merge"), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(least.select("a", "low")).distinct())
        following = run_path(spark, "links")
        current = materialize_at(small, following)
        drop_path(spark, path)
        path, before, state = following, state, _state(current)
        if state == before:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
