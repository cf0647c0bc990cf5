"""Calibration of op10 on documents of unequal length, and n-grams of op1 at the edge of a piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import rng  # noqa: F401
from panelwright.llm import langid, passages


def test_extreme_value_constant_does_not_depend_on_length(spark, rng):
    calm, hot = [f"calm{i}" for i in range(60)], [f"mild{i}" for i in range(12)]
    text = lambda n, share: " ".join(rng.choice(hot if rng.random() < share else calm) for _ in range(n))
    rows = [(i, text(rng.choice([20, 100, 400]), 0.5 if i % 4 == 0 else 0.05)) for i in range(800)]
    labels = [(i, int(i % 4 == 0)) for i in range(800)]
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4))
    held = spark.range(10_000, 10_100).select(F.col("id").alias("doc_id")).filter(fold == 3).first().doc_id
    long = (held, text(200_000, 0.05))
    k = [
        passages.train(spark.createDataFrame(r, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int"), bits=12).k
        for r, y in ((rows, labels), (rows + [long], labels + [(held, 0)]))]
    assert 0.7 < k[1] / k[0] < 1.4


@pytest.mark.parametrize("n", [3, 31, 32, 33, 34, 35, 36, 64, 65, 66, 67, 98])
def test_no_ngram_is_lost_at_the_edge_of_a_piece(monkeypatch, n):
    monkeypatch.setattr(langid, "GROUP", 32)
    text = langid.normalise("a" * (n - 2))
    assert len(text) == n
    found = [sum((x < 1 << 8).sum() for x in parts) for parts in zip(*(langid.buckets(p, o, 8) for _, p, o in langid.pieces([text])))]
    assert found == [n - 1, n - 2] and np.concatenate([o for o, _, _ in langid.pieces([text] * 3)]).max() == 2
