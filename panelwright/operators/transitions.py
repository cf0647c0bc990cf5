"""Panel rows to transitions, validation, slices and the candidate grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of one subject that a single window group may hold. A longer series is
# cut into blocks, and each block borrows the first row of the next one.
BLOCK = 4096


def _blocked_lead(df: DataFrame, cols: Sequence[str], block: int) -> DataFrame:
    """Add ``next_t`` and ``next_<col>`` without gathering a whole series."""
    blk = F.floor(F.col("t") / block).cast("int")
    own = F.struct(blk.alias("blk"), F.lit(True).alias("own"))
    halo = F.struct((blk - 1).alias("blk"), F.lit(False).alias("own"))
    seats = F.when(F.col("t") % block == 0, F.array(own, halo)).otherwise(F.array(own))
    seated = df.select("*", F.inline(seats).alias("_blk", "_own"))
    w = Window.partitionBy("subject", "_blk").orderBy("t")
    led = seated.select(
        "*", F.lead("t").over(w).alias("next_t"),
        *[F.lead(c).over(w).alias(f"next_{c}") for c in cols],
    )
    return led.filter("_own").drop("_blk", "_own")


def with_next(panel: DataFrame, states: Sequence[str], block: int | None = None) -> DataFrame:
    """Add ``next_t`` and the next value of every state column.

    With ``block`` unset the window is per subject: right for panels whose
    horizon is a few thousand steps at most. Set it for longer series.
    """
    if block:
        return _blocked_lead(panel, states, block)
    w = Window.partitionBy("subject").orderBy("t")
    return panel.select(
        "*", F.lead("t").over(w).alias("next_t"),
        *[F.lead(c).over(w).alias(f"next_{c}") for c in states],
    )


def transitions(
    panel: DataFrame,
    states: Sequence[str],
    reward: str | None = None,
    block: int | None = BLOCK,
) -> DataFrame:
    """(subject, t, a, states, r, y1..yp): one row per observed step t -> t+1.

    The reward defaults to the next value of the first state. A gap in t drops
    the step instead of pairing two rows that are not neighbours.
    """
    led = with_next(panel, states, block).filter(F.col("next_t") == F.col("t") + 1)
    r = F.col(reward) if reward else F.col(f"next_{states[0]}")
    return led.select(
        "subject", "t", "a", *states, r.alias("r"),
        *[F.col(f"next_{c}").alias(f"y{i + 1}") for i, c in enumerate(states)],
    )


def validation_report(panel: DataFrame, horizon: int, states: Sequence[str]) -> DataFrame:
    """(kind, subject, t, n): every breach of the panel contract.

    ``duplicate``: more than one row for (subject, t). ``gap``: a step in
    0..horizon-1 without a row. ``bad_action``: action outside {0, 1}.
    ``bad_state``: NULL or NaN state.
    """
    key_n = panel.groupBy("subject", "t").agg(F.count(F.lit(1)).alias("n"))
    dup = key_n.filter("n > 1").select(F.lit("duplicate").alias("kind"), "subject", "t", "n")
    want = (
        panel.select("subject").distinct()
        .select("subject", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("t"))
    )
    gap = want.join(key_n, ["subject", "t"], "left_anti").select(
        F.lit("gap").alias("kind"), "subject", "t", F.lit(1).cast("bigint").alias("n"))
    bad_a = panel.filter(~F.coalesce(F.col("a").isin(0, 1), F.lit(False)))
    broken = F.lit(False)
    for c in states:
        broken = broken | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    bad_s = panel.filter(broken)

    def count(df, kind):
        return df.groupBy("subject", "t").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), "subject", "t", "n")

    return dup.unionByName(gap).unionByName(count(bad_a, "bad_action")).unionByName(count(bad_s, "bad_state"))


def fill_dense(panel: DataFrame, horizon: int, fills: dict[str, float | int]) -> DataFrame:
    """Add the missing (subject, t) cells with given values.

    One aggregate over the union of the panel and an empty scaffold; no join.
    """
    cols = [c for c in panel.columns if c not in ("subject", "t")]
    scaffold = panel.select("subject").distinct().select(
        "subject", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("t"),
        *[F.lit(None).cast(panel.schema[c].dataType).alias(c) for c in cols],
    )
    return panel.unionByName(scaffold).groupBy("subject", "t").agg(
        *[F.coalesce(F.max(c), F.lit(fills[c]).cast(panel.schema[c].dataType)).alias(c) for c in cols])


def post_change(trans: DataFrame, assignment: DataFrame, changepoint: DataFrame) -> DataFrame:
    """Rows at or after the change point of the subject's cluster, with the cluster."""
    labels = assignment.join(changepoint.select("cluster", "tau"), "cluster")
    return trans.join(labels, "subject").filter(F.col("t") >= F.col("tau")).drop("tau")


def recent_window(trans: DataFrame, n_times: int, kappa: int) -> DataFrame:
    """The last ``kappa`` transitions of a panel of ``n_times`` time points."""
    return trans.filter(F.col("t").between(n_times - kappa - 1, n_times - 2))


def time_split(trans: DataFrame, t_train: int) -> DataFrame:
    """Label rows ``train`` (t < t_train) or ``test`` (the one step t_train)."""
    return trans.filter(F.col("t") <= t_train).withColumn(
        "part", F.when(F.col("t") < t_train, "train").otherwise("test"))
