"""Standardisation and its inverses.

Population standard deviation throughout (``stddev_pop``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Mean and standard deviation of the study's step count on the
# cube-root scale.
STEP_STD = 4.141009340555169
STEP_MEAN = 19.343480280896884


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Z-score over the whole table.

    The moments enter as scalar subqueries: one aggregate row, no join, and no
    window that would pull the table into one partition.
    """
    m = df.agg(F.struct(*[F.avg(c).alias(f"{c}_m") for c in cols],
                        *[F.stddev_pop(c).alias(f"{c}_s") for c in cols]).alias("m")).scalar()
    return df.withColumns({f"{c}{suffix}": (F.col(c) - m[f"{c}_m"]) / m[f"{c}_s"] for c in cols})


def zscore_by(df: DataFrame, key: str, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Z-score inside each group of ``key``.

    Group moments come from a partial aggregate and return by a join, so one
    big group never has to sit in a single window partition.
    """
    m = df.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                            *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.join(m, key)
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def steps_back(x: F.Column, factor: float = 1.0) -> F.Column:
    """Standardised cube-root step count to steps."""
    return F.pow(x * F.lit(factor * STEP_STD) + F.lit(STEP_MEAN), F.lit(3.0))


def overflow_report(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose value on the original scale is not finite."""
    back = steps_back(F.col(col))
    inf = F.lit(float("inf"))
    return df.select(*keys, F.col(col), back.alias("back")).filter(F.abs(F.col("back")) == inf)
