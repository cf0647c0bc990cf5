"""Toxicity by maximum-scoring segments.

A token's score is its log-odds between toxic and other labelled documents under
an informative Dirichlet prior (the whole corpus's token counts), lowered by two
standard errors, less a constant that every token pays. Words and their first
``PREFIX`` bytes are counted, and the clearer odds of the two hold, so a rare word
is judged by its stem. Most tokens score below
zero, so the sum drifts down and rises only inside a toxic passage. One linear scan
(Ruzzo-Tompa) finds all maximal-scoring segments. The best chance segment of a
text of n tokens follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)):
lambda solves sum p exp(lambda score) = 1 over the tokens of non-toxic text, K is fitted on
non-toxic documents that the odds were not learned from. A segment's evidence is
lambda S - ln(K n); a document's score is a logistic function of the evidence of its best
segment and of all significant ones together, fitted on the same held-back documents.

Corpus counts are over all documents; the labelled ids are a bounded sample
(``labels.MAX_LABELLED``), three quarters for the odds and the rest for calibration.

Defined results: null and empty texts have no segment and get the score of a text
without evidence. If one of the two classes is missing, every score is the share of toxic
labels (0 without labels). Repeated rows score alike; texts of any length are
scanned whole. Columns score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import labels as label_rows
from panelwright.llm.text import U64, Tokens, grouped, mix

BITS = 18
PRIOR = 10_000.0
COST = 0.25
PREFIX = 5
THRESHOLD = 0.3


def token_buckets(group: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of a group and of their prefixes, and the index of each text's first word."""
    tokens = Tokens(group, prefix=PREFIX)
    words = ~tokens.marks
    first = np.append(0, np.cumsum(words))[tokens.first]
    low = U64(64 - bits)
    stems = mix(tokens.prefixes[words] ^ U64(0x9E3779B97F4A7C15))
    return (mix(tokens.hashes[words]) >> low).astype(np.int64), (stems >> low).astype(np.int64), first


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, sum), left to right, in linear time.

    Only positive scores can begin or end one, so the scan steps from one to the next.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.append(0.0, np.cumsum(scores))
    found: list[tuple[int, int, float, float]] = []
    for i in up.tolist():
        start, stop, low, high = i, i + 1, total[i], total[i + 1]
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= low:
                at -= 1
            if at < 0 or found[at][3] >= high:
                found.append((start, stop, low, high))
                break
            start, low = found[at][0], found[at][2]
            del found[at:]
    return [(a, b, float(h - c)) for a, b, c, h in found]


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, corpus, toxic, other) of a task's documents."""
    counts = np.zeros((3, 1 << bits), np.int64)
    for batch in batches:
        label = np.array([-1 if x is None else x for x in batch.column("label").to_pylist()])
        for at, group in grouped(x.as_py() for x in batch.column("text")):
            *found, first = token_buckets(group, bits)
            kind = np.repeat(label[at : at + len(group)], np.diff(first))
            for place in found:
                counts[0] += np.bincount(place, minlength=1 << bits)
                for row, value in ((1, 1), (2, 0)):
                    counts[row] += np.bincount(place[kind == value], minlength=1 << bits)
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), *(pa.array(c[used]) for c in counts)],
        names=["bucket", "corpus", "toxic", "other"])


def log_odds(corpus: np.ndarray, toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds from counts under the prior, nearer to 0 by two standard errors."""
    alpha = prior * corpus / max(corpus.sum(), 1) + 1e-9
    a, b = toxic + alpha, other + alpha
    total_a, total_b = toxic.sum() + prior, other.sum() + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(a / np.maximum(total_a - a, 1)) - np.log(b / np.maximum(total_b - b, 1))
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(delta) * np.maximum(0, np.abs(delta) - 2 * error)


def decay(score: np.ndarray, weight: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda score) = 1; p are the weights' shares."""
    used = weight > 0
    score, share = score[used], weight[used] / weight.sum()
    if not len(score) or score.max() <= 0 or (score * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(np.minimum(high * score, 700))).sum() < 1:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        if (share * np.exp(np.minimum(middle * score, 700))).sum() < 1:
            low = middle
        else:
            high = middle
    return high


def evidence(found: list[tuple[int, int, float]], n: int, lam: float, k: float) -> tuple[float, float]:
    """(best, all): lambda S - ln(K n) of the best segment, and the sum over segments above 0, at least 0."""
    if not found or not n:
        return 0.0, 0.0
    each = [lam * s - np.log(max(k * n, 1e-300)) for _, _, s in found]
    return max(0.0, max(each)), sum(x for x in each if x > 0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """Log-odds by bucket, and calibration."""

    def __init__(self, table: np.ndarray, lam: float = 1.0, k: float = 1.0, weights=None, constant: float = 0.0):
        self.table, self.lam, self.k, self.weights, self.constant = table, lam, k, weights, constant
        self.bits = int(len(table)).bit_length() - 1

    def token_scores(self, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word of a group, and the index of each text's first word."""
        words, stems, first = token_buckets(group, self.bits)
        a, b = self.table[words], self.table[stems]
        return np.where(np.abs(a) >= np.abs(b), a, b) - COST, first

    def scan(self, texts) -> Iterator[tuple[list[tuple[int, int, float]], int]]:
        """(segments, number of words) of each text."""
        for _, group in grouped(texts):
            scores, first = self.token_scores(group)
            above = np.append(0, np.cumsum(scores > 0))
            for a, b in zip(first[:-1], first[1:]):
                yield (segments(scores[a:b]) if above[b] > above[a] else []), int(b - a)

    @staticmethod
    def design(best: np.ndarray, every: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(best)), np.minimum(best, 50), np.log1p(every), best > 0], axis=1)

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        pairs = np.array([evidence(f, n, self.lam, self.k) for f, n in self.scan(texts)]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.design(pairs[:, 0], pairs[:, 1]) @ self.weights, -30, 30)))


def _best(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(label, n, best): words and largest segment sum of calibration documents; then, with label -1, how many
    words of the documents with label 0 have each score (in steps of 0.05)."""
    steps: dict[float, int] = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        labels = batch.column("label").to_pylist()
        rows = [(n, max((s for _, _, s in found), default=0.0)) for found, n in shared.value.scan(texts)]
        calm = (x for x, label in zip(texts, labels) if label == 0)
        for _, group in grouped(calm):
            score, n = np.unique(np.round(shared.value.token_scores(group)[0], 2) // 0.05 * 0.05, return_counts=True)
            for x, m in zip(score.tolist(), n.tolist()):
                steps[x] = steps.get(x, 0) + m
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array([n for n, _ in rows], pa.int64()),
             pa.array([s for _, s in rows], pa.float64())], names=["label", "n", "best"])
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1] * len(steps), pa.int32()), pa.array(list(steps.values()), pa.int64()),
         pa.array(list(steps), pa.float64())], names=["label", "n", "best"])


def _evidence(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(label, best, every): evidence of calibration documents once lambda and K are known."""
    for batch in batches:
        m = shared.value
        pairs = [evidence(found, n, m.lam, m.k) for found, n in m.scan(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label").cast(pa.int32()), pa.array([x for x, _ in pairs], pa.float64()),
             pa.array([x for _, x in pairs], pa.float64())], names=["label", "best", "every"])


def extreme_constant(n: np.ndarray, best: np.ndarray, lam: float) -> float:
    """K from words and best segment sums of non-toxic documents: K n exp(-lambda S) has mean 1."""
    return len(n) / max(float((n * np.exp(-lam * best)).sum()), 1e-12)


def train(docs: DataFrame, toxic: DataFrame, label: str = "toxic", bits: int = BITS,
          bound: int = label_rows.MAX_LABELLED) -> Model:
    """Fit on ``docs`` (doc_id, text) and the labels in ``toxic`` (doc_id, toxic)."""
    sampled = label_rows.sample(toxic, label, bound)
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4))
    rows = label_rows.labelled(docs, sampled.withColumn("fold", fold).filter("fold < 3").drop("fold"))
    counted = (
        rows.select("text", "label").mapInArrow(
            lambda b: _counts(b, bits), "bucket int, corpus long, toxic long, other long")
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("corpus", "toxic", "other")]).toArrow())
    place = counted["bucket"].to_numpy()
    counts = np.zeros((3, 1 << bits))
    for row, name in enumerate(("corpus", "toxic", "other")):
        counts[row, place] = counted[name].to_numpy()
    model = Model(log_odds(*counts))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = label_rows.labelled(docs, sampled.withColumn("fold", fold).filter("fold = 3").drop("fold"), "inner")
    held = held.select("text", "label")
    seen = held.mapInArrow(lambda b: _best(b, shared), "label int, n long, best double").toArrow()
    y, n, best = (seen[c].to_numpy() for c in ("label", "n", "best"))
    steps = y < 0
    step_score, step_n = best[steps], n[steps].astype(float)
    y, n, best = y[~steps], n[~steps], best[~steps]
    if not counts[1].sum() or not counts[2].sum() or len(set(y)) < 2:
        share = float(np.mean(y)) if len(y) else 0.0
        return Model(model.table, constant=share)
    lam = decay(step_score, step_n)
    calm = (y == 0) & (n > 0)
    k = extreme_constant(n[calm], best[calm], lam)
    fitted = docs.sparkSession.sparkContext.broadcast(Model(model.table, lam, k))
    pairs = held.mapInArrow(lambda b: _evidence(b, fitted), "label int, best double, every double").toArrow()
    weights = logistic(Model.design(pairs["best"].to_numpy(), pairs["every"].to_numpy()), pairs["label"].to_numpy().astype(float))
    return Model(model.table, lam, k, weights)


def toxicity(spark, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.score(list(part)), dtype="float64")

    return scored.asNondeterministic()(text)


def passages(spark, model: Model, text: Column) -> Column:
    """Significant passages of a text column: array of (start, stop, sum), in words, stop exclusive."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,stop:int,sum:double>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            m = shared.value
            yield pd.Series([
                [{"start": a, "stop": b, "sum": s} for a, b, s in spans if evidence([(a, b, s)], n, m.lam, m.k)[0] > 0]
                for spans, n in m.scan(list(part))])

    return found.asNondeterministic()(text)


def learnable(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """crc32 of the id's text modulo ``folds`` isn't ``fold``; a null id isn't learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != fold, F.lit(False))


def flag(docs: DataFrame, toxic: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """``docs`` with score and predicted; labels of ids that are not ``learnable`` aren't used."""
    model = train(docs, toxic.filter(learnable(F.col("doc_id"))), **fit)
    return (
        docs.withColumn("score", toxicity(docs.sparkSession, model, F.col("text")))
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))


def drop_toxic(docs: DataFrame, toxic: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The rows of ``docs`` that ``flag`` doesn't predict toxic, all columns as they are."""
    model = train(docs, toxic.filter(learnable(F.col("doc_id"))), **fit)
    return docs.filter(toxicity(docs.sparkSession, model, F.col("text")) < threshold)
