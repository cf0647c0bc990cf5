"""Operators whose result is one row per pair."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ranking import with_row_number


def series_correlation(panel: DataFrame, state: str, block: int = 256) -> DataFrame:
    """(i, j, corr), i < j: correlation of two subjects over their common steps, NaN where undefined.

    A blocked matrix product: subjects are cut into blocks, and each pair of
    blocks is one task that multiplies two block x T matrices. Rows travel once
    per block, not once per partner subject.
    """
    numbered = with_row_number(panel.select("subject").distinct(), "subject")
    place = numbered.select("subject", F.floor((F.col("rn") - 1) / block).cast("int").alias("own"),
                            F.floor((F.col("n") - 1) / block).cast("int").alias("last"))
    seats = F.sequence(F.lit(0), F.col("last"))
    rows = panel.select("subject", "t", F.col(state).cast("double").alias("x")).join(place, "subject").select(
        "subject", "t", "x", "own", F.explode(seats).alias("other")
    ).select("subject", "t", "x", "own",
             F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))

    def correlate(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="subject", columns="t", values="x")
        own_of = pdf.drop_duplicates("subject").set_index("subject")["own"].reindex(wide.index).to_numpy()
        left, right = wide[own_of == key[0]], wide[own_of == key[1]]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"i": [], "j": [], "corr": []})
        lv, rv = left.to_numpy(float), right.to_numpy(float)
        mean = np.nanmean(wide.to_numpy(float))
        lm, rm = ~np.isnan(lv), ~np.isnan(rv)
        lv, rv = np.where(lm, lv - mean, 0.0), np.where(rm, rv - mean, 0.0)
        n = lm.astype(float) @ rm.T.astype(float)
        sx, sy = lv @ rm.T.astype(float), lm.astype(float) @ rv.T
        sxx, syy, sxy = (lv * lv) @ rm.T.astype(float), lm.astype(float) @ (rv * rv).T, lv @ rv.T
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        flat = (vx <= 1e-9 * n * sxx) | (vy <= 1e-9 * n * syy)
        corr = np.where(flat, np.nan, (n * sxy - sx * sy) / np.sqrt(np.where(flat, 1.0, vx * vy)))
        li, rj = left.index.to_numpy(), right.index.to_numpy()
        keep = (li[:, None] < rj[None, :]) & (n > 0)
        i, j = np.nonzero(keep)
        return pd.DataFrame({"i": li[i], "j": rj[j], "corr": corr[i, j]})

    out = rows.groupBy("b1", "b2").applyInPandas(correlate, "i bigint, j bigint, corr double")
    # A series that is constant over the common steps has no correlation.
    return out.withColumn("corr", F.coalesce("corr", F.lit(float("nan"))))
