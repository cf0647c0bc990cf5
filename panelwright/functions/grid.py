"""Candidate grids, as scalars on the driver and as columns."""

from __future__ import annotations

from itertools import product

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ScanGrid:
    """Window lengths kappa and split positions u of a change scan.

    ``n_times`` counts time points, so transitions run over t = 0..n_times-2.
    A window of length kappa holds the last kappa transitions; u splits it into
    its first u and its last kappa-u transitions.
    """

    def __init__(self, n_times: int, kappa_min: int | None = None, kappa_max: int | None = None,
                 step: int = 1, eps: float = 0.1):
        self.n_times = n_times
        self.eps = eps
        self.kappa_min = max(25, int(2 * eps * n_times)) if kappa_min is None else kappa_min
        self.kappa_max = n_times if kappa_max is None else kappa_max
        self.step = step

    def kappas(self) -> list[int]:
        return list(range(self.kappa_min, min(self.kappa_max, self.n_times - 1), self.step))

    def u_low(self) -> int:
        return int(self.eps * self.n_times - 1) + 1

    def u_high(self, kappa: int) -> int:
        return int(kappa - self.eps * self.n_times)

    def splits(self, kappa: int) -> list[int]:
        return [u for u in range(self.u_low(), self.u_high(kappa) + 1) if 0 < u < kappa]

    def kappa_column(self) -> F.Column:
        ks = self.kappas()
        return F.sequence(F.lit(ks[0]), F.lit(ks[-1]), F.lit(self.step))

    def split_column(self, kappa: F.Column) -> F.Column:
        """Array of split positions for a kappa column; empty when there is none."""
        hi = F.least((kappa - F.lit(self.eps * self.n_times)).cast("int"), kappa - 1)
        lo = F.lit(max(self.u_low(), 1))
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(kappa, u): the whole grid."""
        return (
            spark.range(1).select(F.explode(self.kappa_column()).alias("kappa"))
            .select("kappa", F.explode(self.split_column(F.col("kappa"))).alias("u"))
        )


def linear_grid(total: int, length: int, eps: float, m: int) -> list[int]:
    """m equally spaced split times between eps*total and length - eps*total."""
    lo, hi = eps * total, length - eps * total
    step = (hi - lo) / (m - 1) if m > 1 else 0.0
    return sorted({int(lo + step * i) if i < m - 1 or m == 1 else int(hi) for i in range(m)})


def parameter_grid(grid: dict[str, list]) -> list[dict]:
    """Cartesian product of named lists, keys in sorted order."""
    keys = sorted(grid)
    return [dict(zip(keys, values)) for values in product(*[grid[k] for k in keys])]


def parameter_frame(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """The same product as a table with ``param_id`` in product order."""
    rows = [(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(parameter_grid(grid))]
    return spark.createDataFrame(rows, "param_id int, params map<string,double>")


def nearest(x: F.Column, values: list[float]) -> F.Column:
    """The grid value nearest to x; the earlier one on ties."""
    pick = F.lit(values[0])
    gap = F.abs(x - F.lit(values[0]))
    for v in values[1:]:
        d = F.abs(x - F.lit(v))
        pick = F.when(d < gap, F.lit(v)).otherwise(pick)
        gap = F.least(gap, d)
    return pick


def geometric_tail(lam: float) -> int:
    """Series terms after which a Poisson(lam) tail is below double precision."""
    return int(math.ceil(lam + 12.0 * math.sqrt(lam + 1.0) + 40.0))
