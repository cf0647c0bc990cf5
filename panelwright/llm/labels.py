"""Labelled documents for training: a bounded sample that may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled ids that a classifier is fitted on, at most about; all if there are fewer.
MAX_LABELLED = 200_000


def sample(labels: DataFrame, label: str, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label): one row per labelled id, thinned evenly by a hash of the id to about ``bound`` rows.

    Ids with several labels take the largest; null ids and labels are left out.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return rows


def labelled(docs: DataFrame, sampled: DataFrame, how: str = "left") -> DataFrame:
    """(doc_id, text, label) of documents, joined with a sample whose size is bounded."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(sampled), "doc_id", how)
