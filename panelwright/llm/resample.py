"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of target text (the
documents labelled good), one of raw text (all documents). A document's weight is
the log ratio of its probabilities under the two. The sample is drawn without
replacement in proportion to the weights by Gumbel top-k: noise is added to each
log weight and the k largest keys are kept. k is the number of documents that
are likelier under the target model, so nothing is thinned for its own sake;
rejected are those that look less like the target than like the raw text, give
or take the noise.

Features of a token are itself, the pair with the token before, and the shapes
(case, number, marks, repetition) of three tokens in a row. The smoothing adds
the same number of expected observations to both models, so rare n-grams say
little. Raw text is counted over all documents; the labelled ids are a bounded
sample (``labels.MAX_LABELLED``).

Defined results: a document without a token (null, empty, white space) has no
weight and is rejected; without any good label all other documents weigh 0 and are
kept. The noise is a hash of id and text, so repeated rows get the same key. Rows whose
key equals the k-th largest are all kept. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import labels as label_rows
from panelwright.llm.text import U64, Tokens, grouped, mix, text_sums
from panelwright.session import materialize

BITS = 15
SMOOTHING = 16.0
SEED = 7
_SALT = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0))
_SHAPES = np.random.default_rng(5).integers(1, 1 << 62, 7, dtype=U64)


def features(group: list[bytes], bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of each kind of feature, one per token, and the index of each text's first token."""
    tokens = Tokens(group, shapes=True)
    h, n = tokens.hashes, len(tokens.hashes)
    opening = np.zeros(n + 2, bool)
    opening[tokens.first] = True
    opening = opening[:n]
    before = np.concatenate([[U64(0)], h[:-1]]) if n else h
    before = np.where(opening, U64(0), before)
    shape = np.where(tokens.marks, h, _SHAPES[tokens.shape])
    shape = np.where(~tokens.marks & (before == h), _SHAPES[6], shape)
    one = np.where(opening, U64(1), np.concatenate([[U64(1)], shape[:-1]]) if n else shape)
    two = np.where(opening, U64(1), np.concatenate([[U64(1)], one[:-1]]) if n else shape)
    with np.errstate(over="ignore"):
        pair = mix(before * U64(31) + h + _SALT[1])
        three = mix((two * U64(31) + one) * U64(31) + shape + _SALT[2])
    low = U64(64 - bits)
    return [(x >> low).astype(np.int64) for x in (mix(h + _SALT[0]), pair, three)], tokens.first


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, target) of a task's documents."""
    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for batch in batches:
        good = np.array([x == 1 for x in batch.column("label").to_pylist()], bool)
        for at, group in grouped(x.as_py() for x in batch.column("text")):
            found, first = features(group, bits)
            chosen = np.repeat(good[at : at + len(group)], np.diff(first))
            for place in found:
                raw += np.bincount(place, minlength=1 << bits)
                target += np.bincount(place[chosen], minlength=1 << bits)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])],
        names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, quality: DataFrame, label: str = "quality", bits: int = BITS,
               smoothing: float = SMOOTHING, bound: int = label_rows.MAX_LABELLED) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) of each bucket."""
    rows = label_rows.labelled(docs, label_rows.sample(quality, label, bound)).select("text", "label")
    counted = (
        rows.mapInArrow(lambda b: _counts(b, bits), "bucket int, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counted["bucket"].to_numpy()] = counted["raw"].to_numpy()
    target[counted["bucket"].to_numpy()] = counted["target"].to_numpy()
    if not target.sum():
        return np.zeros(1 << bits)
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + smoothing) - np.log(expected + smoothing)


def log_weight(spark, table: np.ndarray, text: Column) -> Column:
    """Log importance weight of a text column; null without a token."""
    shared = spark.sparkContext.broadcast(table)
    bits = int(len(table)).bit_length() - 1

    @F.pandas_udf("double")
    def weighed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = np.full(len(part), np.nan)
            for at, group in grouped(part):
                found, first = features(group, bits)
                total = sum(text_sums(shared.value[place], first) for place in found)
                out[at : at + len(group)] = np.where(np.diff(first) > 0, total, np.nan)
            yield pd.Series(out)

    return F.nanvl(weighed.asNondeterministic()(text), F.lit(None).cast("double"))


def gumbel(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of id and text."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int, gather: int = 10_000, bins: int = 1024) -> float | None:
    """The k-th largest value, by counting in ever narrower ranges; at most ``gather`` values reach the driver."""
    if k <= 0:
        return None
    rows = rows.select(F.col(column).alias("x")).filter("x is not null")
    ends = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).first()
    if ends["n"] <= k:
        return ends["low"]
    low, high, inside = ends["low"], ends["high"], ends["n"]
    while inside > gather and low < high:
        width = (high - low) / bins
        if not width:
            break
        spot = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("spot")
        cells = sorted((r["spot"], r["n"], r["low"], r["high"]) for r in rows.filter((F.col("x") >= low) & (F.col("x") <= high))
                       .groupBy(spot).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
                       .collect())
        for _, n, cell_low, cell_high in reversed(cells):
            if k <= n:
                low, high, inside = cell_low, cell_high, n
                break
            k -= n
    if low == high:
        return low
    values = sorted((r["x"] for r in rows.filter((F.col("x") >= low) & (F.col("x") <= high)).collect()), reverse=True)
    return values[k - 1]


class Sampler:
    """Models fitted on ``docs``, and the least key of the sample drawn from them.

    ``quality`` has doc_id and quality (1 is good). ``weights`` has (doc_id, log_ratio, key, kept).
    """

    def __init__(self, docs: DataFrame, quality: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING,
                 seed: int = SEED):
        self.docs, self.seed = docs, seed
        self.table = log_ratios(docs, quality, bits=bits, smoothing=smoothing)
        scored = docs.select("doc_id", self._weight().alias("log_ratio"), self._noise().alias("noise"))
        scored = materialize(scored.select("doc_id", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("key")),
                             "weights")
        k = scored.filter("log_ratio >= 0").count()
        self.least = kth_largest(scored, "key", k)
        self.weights = scored.withColumn("kept", self._chosen(F.col("key")))

    def _weight(self) -> Column:
        return log_weight(self.docs.sparkSession, self.table, F.col("text"))

    def _noise(self) -> Column:
        return gumbel(F.col("doc_id"), F.col("text"), self.seed)

    def _chosen(self, key: Column) -> Column:
        return F.lit(False) if self.least is None else F.coalesce(key >= F.lit(self.least), F.lit(False))

    def rows(self) -> DataFrame:
        """The rows of ``docs`` in the sample, all columns as they are."""
        return self.docs.filter(self._chosen(self._weight() + self._noise()))
