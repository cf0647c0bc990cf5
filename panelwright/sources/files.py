"""File sources and sinks: CSV panels, result trees, model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the study's daily panel file.
DAILY_SCHEMA = (
    "STUDY_PRTCPT_ID string, Date date, Day int, STEP_COUNT double, SLEEP_COUNT double, "
    "MOOD double, Notification_type string, TeamName string"
)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", header).csv(path)


def daily_panel(spark: SparkSession, path: str) -> DataFrame:
    """The study's daily file as (subject, t, s1, s2, s3, a, specialty).

    States stay on the file's scale. The time index counts days from the
    earliest date in the file.
    """
    rows = read_csv(spark, path, DAILY_SCHEMA)
    start = rows.agg(F.min("Date")).scalar()
    return rows.select(
        F.col("STUDY_PRTCPT_ID").alias("subject"), F.datediff("Date", start).alias("t"),
        F.col("STEP_COUNT").alias("s1"), F.col("SLEEP_COUNT").alias("s2"), F.col("MOOD").alias("s3"),
        (F.col("Notification_type") == "steps").cast("int").alias("a"),
        F.split("TeamName", "_")[1].alias("specialty"),
    )


def write_results(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Partitioned by the run key; a rerun replaces its own partitions only. A key may have several files."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All runs below ``path``; the run key comes back from the folder names."""
    return spark.read.option("basePath", path).parquet(path)


def pending(work: DataFrame, path: str, keys: Sequence[str], refit: bool = False) -> DataFrame:
    """The part of a work list whose key is not yet in the sink."""
    if refit:
        return work
    try:
        done = read_results(work.sparkSession, path).select(*keys).distinct()
    except AnalysisException:
        return work
    return work.join(done, list(keys), "left_anti")


def write_small_csv(df: DataFrame, path: str) -> None:
    """One CSV file; for tables of a few rows per candidate time only."""
    df.repartition(1).write.option("header", True).csv(path)


def write_models(models: DataFrame, path: str) -> None:
    """(cluster, action, coef) tables, one folder per cluster."""
    write_results(models, path, ["cluster"])


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark, path)
