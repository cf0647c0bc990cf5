"""Null distributions of the scan statistic and the cache of their draws.

The law of the standardised bridge depends on the window length and the degrees
of freedom only: the number of subjects cancels. One random walk per replicate
serves every window length, because a window of length kappa may use the first
kappa steps of the walk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

#: Bytes of random walks that a task holds at once.
WALK = 1 << 26
NULL_SCHEMA = "kappa int, rep bigint, stat double"


def _bridge_block(key: Sequence[int], reps: int, kappas: Sequence[int], df: int) -> np.ndarray:
    """(reps, len(kappas)): max over u of the squared norm of the bridge.

    Where the walks of all replicates would take more than ``WALK`` bytes, the same draws are made
    several times and only some of the replicates kept each time.
    """
    per = max(1, WALK // (8 * max(kappas) * df))
    return np.concatenate([_bridges(key, reps, slice(at, at + per), kappas, df) for at in range(0, reps, per)])


def _bridges(key: Sequence[int], reps: int, held: slice, kappas: Sequence[int], df: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=key))
    top = max(kappas)
    # Drawn step by step, so a window's draws do not depend on the longest one asked for.
    steps = np.stack([rng.standard_normal((reps, df))[held] for _ in range(top)], axis=1)
    walk = np.cumsum(steps, axis=1, out=steps)
    out = np.empty((len(walk), len(kappas)))
    for j, k in enumerate(kappas):
        u = np.arange(1, k, dtype=float)
        bridge = walk[:, : k - 1, :] - (u / k)[None, :, None] * walk[:, k - 1: k, :]
        norm = np.einsum("rud,rud->ru", bridge, bridge) * (k / (u * (k - u)))[None, :]
        out[:, j] = norm.max(axis=1) if k > 1 else 0.0
    return out


def _chi2_block(rng: np.random.Generator, reps: int, counts: Sequence[int], df: int) -> np.ndarray:
    """(reps, len(counts)): max of m chi-square(df) draws for every m."""
    draws = rng.chisquare(df, size=(max(counts), reps)).T
    best = np.maximum.accumulate(draws, axis=1)
    return best[:, [m - 1 for m in counts]]


def null_sample(
    spark: SparkSession,
    kappas: Sequence[int],
    df: int,
    draws: int,
    kind: str = "bridge",
    split_counts: Sequence[int] | None = None,
    seed: int = 1,
    block: int = 250,
) -> DataFrame:
    """(kappa, rep, stat): ``draws`` replicates per window length.

    Replicates come in blocks, each with its own counter-based generator, so
    the sample does not depend on how Spark partitions the blocks.
    """
    kappas = [int(k) for k in kappas]
    counts = [int(c) for c in (split_counts or kappas)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"]:
                reps = min(block, draws - int(b) * block)
                key = [seed, int(b) << 20 | df]
                rng = np.random.Generator(np.random.Philox(key=key))
                stat = _bridge_block(key, reps, kappas, df) if kind == "bridge" else _chi2_block(rng, reps, counts, df)
                rep = int(b) * block + np.arange(reps)
                yield pd.DataFrame({
                    "kappa": np.tile(np.array(kappas, dtype=np.int32), reps),
                    "rep": np.repeat(rep, len(kappas)),
                    "stat": stat.ravel(),
                })

    n_blocks = -(-draws // block)
    parts = min(n_blocks, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, n_blocks, 1, parts).mapInPandas(draw, NULL_SCHEMA)


def thresholds(sample: DataFrame, alpha: float) -> DataFrame:
    """(kappa, threshold): the (1 - alpha) quantile, linearly interpolated."""
    return sample.groupBy("kappa").agg(F.percentile("stat", F.lit(1.0 - alpha)).alias("threshold"))


class NullCache:
    """Draws kept as Parquet under ``root`` by (kind, df, draws, seed) and, for each window, its length
    and number of splits; read before drawing.

    Only windows that the store lacks are drawn. Each has a folder of its own that is
    overwritten, so two writers of one window leave one sample.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, root: str, kappa: int, splits: int | None) -> str:
        return f"{root}/own=w{kappa}" if splits is None else f"{root}/own=w{kappa}-s{splits}"

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(NULL_SCHEMA).parquet(path)
        except AnalysisException:
            return None

    def sample(self, kappas: Sequence[int], df: int, draws: int, kind: str = "bridge",
               split_counts: Sequence[int] | None = None, seed: int = 1) -> DataFrame:
        counts = dict(zip(map(int, kappas), split_counts)) if split_counts is not None else {}
        root = f"{self.root}/{kind}-df{df}-draws{draws}-seed{seed}"
        paths = {int(k): self._path(root, int(k), counts.get(int(k))) for k in kappas}
        missing = [k for k, path in sorted(paths.items()) if self._read(path) is None]
        if missing:
            fresh = null_sample(
                self.spark, missing, df, draws, kind, [counts[k] for k in missing] if counts else None, seed)
            name = F.concat(F.lit("w"), F.col("kappa").cast("string"))
            if counts:
                splits = F.create_map(*[F.lit(v) for k in missing for v in (k, int(counts[k]))])
                name = F.concat(name, F.lit("-s"), splits[F.col("kappa")].cast("string"))
            # One job writes all windows that are missing; each replaces its own folder only.
            (fresh.withColumn("own", name).repartition(len(missing), "own").write.partitionBy("own")
             .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root))
        return self.spark.read.schema(NULL_SCHEMA).parquet(*paths.values())
