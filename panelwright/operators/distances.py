"""Order statistics of the distances between all pairs of values, without forming the pairs.

Values are counted in bins of equal width. Two values whose bins are k apart are between k - 1 and
k + 1 widths apart, so counts of pairs by k, a correlation of the bins' counts, enclose the
wanted distance in three neighbouring k. Only pairs at those k are looked at again, with every
bin cut into ``SPLIT``: a bin meets three partners, whatever the number of values. When few
values are left in a bin, the distances of the pairs at the last three k are counted exactly.
Each step is linear in the distinct values; a step shuffles bins, never pairs of bins.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ranking import cumulative_counts
from panelwright.session import materialize

FIRST, SPLIT = 4096, 16
#: Pairs of values a distinct value that the exact count may form.
PAIRS = 8


def _lag_join(bins: DataFrame, limits: list[tuple[int, int, int]]) -> DataFrame:
    """Rows of ``bins`` beside those of the bins above them at the allowed lags; the partner's columns end in 2.

    ``limits`` has (bins a former bin was cut into, least lag, largest lag) of every step; the last is of ``b`` itself.
    """
    there = bins.select(*[F.col(c).alias(f"{c}2") for c in bins.columns])
    _, least, most = limits[-1]
    at = F.explode(F.array(*[F.lit(d).cast("long") for d in range(least, most + 1)])).alias("lag")
    met = bins.select("*", at).withColumn("b2", F.col("b") + F.col("lag")).join(there, "b2")
    for size, least, most in limits[:-1]:
        met = met.filter((F.floor(F.col("b2") / size) - F.floor(F.col("b") / size)).between(least, most))
    return met


class PairDistances:
    """The positive distances of ``values`` (v), each pair of rows once. Null and NaN are left out."""

    def __init__(self, values: DataFrame, first: int = FIRST):
        rows = values.select(F.col("v").cast("double").alias("v")).filter("v is not null and not isnan(v)")
        points = materialize(rows.groupBy("v").agg(F.count(F.lit(1)).alias("w")), "points")
        exact = F.col("w").cast("decimal(38,0)")
        facts = points.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"),
                           F.sum("w").alias("w"), F.sum(exact * exact).alias("ww")).first()
        self.n = facts["n"]
        #: Number of positive distances.
        self.pairs = 0 if not self.n else (facts["w"] ** 2 - int(facts["ww"])) // 2
        if not self.pairs:
            return
        # No value lies on the far edge of the last bin.
        self.width = (facts["high"] - facts["low"]) / first * (1 + 1e-9)
        place = F.col("v") - F.lit(facts["low"])
        bin = F.least(F.floor(place / F.lit(self.width)).cast("long"), F.lit(first - 1).cast("long"))
        self.binned = points.select("v", "w", bin.alias("b"), (place - bin * F.lit(self.width)).alias("rest"))
        counts = [0] * first
        for r in self.binned.groupBy("b").agg(F.sum("w").alias("w")).collect():
            counts[r["b"]] = r["w"]
        same = (sum(c * c for c in counts) - int(facts["ww"])) // 2
        self.counts = [same, *_lagged(counts)]

    def nth(self, rank: int) -> float:
        """The distance with ``rank`` smaller or equal ones before it."""
        k, below = _first_above(dict(enumerate(self.counts)), rank)
        below -= self.counts[k - 1] if k else 0
        binned, width, limits = self.binned, self.width, [(1, max(k - 1, 0), k + 1)]
        while True:
            bins = binned.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
            formed = _lag_join(bins, limits).agg(F.sum(F.col("n") * F.col("n2"))).first()[0] or 0
            if formed <= PAIRS * self.n or len(limits) > 12:
                return self._exact(binned, limits, rank - below)
            width /= SPLIT
            inside = F.greatest(F.least(F.floor(F.col("rest") / F.lit(width)), F.lit(SPLIT - 1)), F.lit(0)).cast("int")
            cut = binned.withColumn("i", inside)
            fine = self._fine(cut, limits)
            k, before = _first_above(fine, rank - below)
            below += sum(c for d, c in fine.items() if d < k - 1)
            binned = cut.select("v", "w", (F.col("b") * SPLIT + F.col("i")).alias("b"),
                                (F.col("rest") - F.col("i") * F.lit(width)).alias("rest"))
            limits = [(size * SPLIT, least, most) for size, least, most in limits] + [(1, max(k - 1, 0), k + 1)]

    def _fine(self, cut: DataFrame, limits: list[tuple[int, int, int]]) -> dict[int, int]:
        """{lag of the parts: pairs} of the pairs at the lags, where ``i`` is a value's part of its bin."""
        square = F.col("w").cast("decimal(38,0)") * F.col("w")
        # A bin is one row of SPLIT counts, however many rows it stands for.
        parts = cut.groupBy("b").agg(
            F.array(*[F.sum(F.when(F.col("i") == i, F.col("w")).otherwise(0)) for i in range(SPLIT)]).alias("c"),
            F.array(*[F.sum(F.when(F.col("i") == i, square).otherwise(0)) for i in range(SPLIT)]).cast("array<string>").alias("cc"))

        def correlated(batches):
            total: dict[int, int] = {}
            for pdf in batches:
                x, y = (np.array(pdf[c].tolist(), dtype=object).reshape(len(pdf), SPLIT) for c in ("c", "c2"))
                lag = pdf["lag"].to_numpy()
                for d in np.unique(lag):
                    at = lag == d
                    products = x[at].T @ y[at]
                    for i in range(SPLIT):
                        for j in range(SPLIT):
                            fine = int(d) * SPLIT + j - i
                            if d or j > i:
                                total[fine] = total.get(fine, 0) + int(products[i, j])
                            elif i == j:  # a part with itself: pairs of different values, once
                                own = sum(int(v[i]) for v in pdf["cc"][at])
                                total[0] = total.get(0, 0) + (int(products[i, i]) - own) // 2
            yield pd.DataFrame({"lag": np.array(list(total), dtype=np.int64), "pairs": np.array(list(map(str, total.values())), dtype=object)})

        got = _lag_join(parts, limits).select("lag", "c", "cc", "c2").mapInPandas(correlated, "lag long, pairs string")
        rows = got.groupBy("lag").agg(F.sum(F.col("pairs").cast("decimal(38,0)")).alias("pairs")).collect()
        return {r["lag"]: int(r["pairs"]) for r in rows}

    def _exact(self, binned: DataFrame, limits: list[tuple[int, int, int]], rank: int) -> float:
        """The distance of this rank among the pairs at the lags."""
        met = _lag_join(binned, limits).filter((F.col("lag") > 0) | (F.col("v") < F.col("v2")))
        by = met.groupBy(F.abs(F.col("v") - F.col("v2")).alias("d")).agg(F.sum(F.col("w") * F.col("w2")).alias("c"))
        by = materialize(by.filter("d > 0"), "distances")
        at = cumulative_counts(by, [], "d", "c").filter((F.col("below") <= rank) & (F.lit(rank) < F.col("below") + F.col("c")))
        return at.first()["value"]

    def median(self) -> float | None:
        """The middle distance, or the mean of the two middle ones; None without a positive distance."""
        if not self.pairs:
            return None
        low = self.nth((self.pairs - 1) // 2)
        return low if self.pairs % 2 else (low + self.nth(self.pairs // 2)) / 2


def _lagged(counts: list[int]) -> list[int]:
    """Sums of products of the counts at each lag from 1, exact: 16 bits at a time, in doubles."""
    parts, rest = [], list(counts)
    while any(rest):
        parts.append(np.array([r & 0xFFFF for r in rest], np.float64))
        rest = [r >> 16 for r in rest]
    out = [0] * (len(counts) - 1)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            both = np.correlate(b, a, "full")[len(counts):]
            out = [o + (int(v) << (16 * (i + j))) for o, v in zip(out, both)]
    return out


def _first_above(counts: dict[int, int], rank: int) -> tuple[int, int]:
    """The first lag whose running total exceeds ``rank``, and the total before it."""
    total = 0
    for k in sorted(counts):
        if total + counts[k] > rank:
            return k, total
        total += counts[k]
    raise ValueError("rank beyond the pairs")


def median_distance(panel: DataFrame, state: str) -> Any:
    """Median of the positive distances between all pairs of rows of one state."""
    return PairDistances(panel.select(F.col(state).alias("v"))).median()
