"""The filter audit against documents removed one by one."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import no_docs, odd_docs, prose, rng  # noqa: F401
from panelwright.llm import interaction


def fails(rows):
    """(A..E) of each (doc_id, text, ...), text by text."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        w = t.encode().split()
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                    any(c in "#$%&*|" for c in t),
                    i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)))
    return out


def audited(rows, flags, marks):
    """{(part, order, step): counts}, by removing documents one filter after the other."""
    out = {}
    parts = [r[2] or "" for r in rows]
    for part in set(parts):
        own = [k for k, p in enumerate(parts) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                f = "ABCDE".index(letter)
                gone = [k for k in left if flags[k][f]]
                redundant = sum(flags[k][f] for k in own if k not in left)
                left = [k for k in left if not flags[k][f]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(flags[k][f] and sum(flags[k]) == 1 for k in own),
                    *(sum(marks.get(rows[k][0], (0, 0))[m] for k in gone) for m in (0, 1))]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def test_audit_of_texts_is_that_of_removal(spark, rng):
    long = prose(rng, 230)
    texts = [None, "", " \n", "AB", "a#b", long, long + " $", long.upper(), "x " * 300, long + " X" * 300,
             " ".join(f"w{k}" for k in range(199)), " ".join(f"w{k}" for k in range(200)), "é" * 97 + "AB", "é" * 98 + "AB"]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(120)]
    rows += [(5, rows[5][1], "b"), (None, long, "a"), (200, "only | one", "single"), (-3, long, "a")]
    docs = spark.createDataFrame(
        [(i, t, p, "clash", "clash") for i, t, p in rows],
        "doc_id long, text string, source string, quality string, first string")
    marks = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 3)]
    labels = [(i, q, int(t)) for i, q, t in marks] + [(3, 0, None), (7, None, 1), (None, 1, 1), (7, 0, 0)]
    got = interaction.audit_texts(
        docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {}
    for i, q, t in labels:
        old = known.get(i, (0, 0))
        known[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    known.pop(None)
    want = audited(rows, fails(rows), known)
    assert len(got) == len(want) == 4 * 600
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[
            r.part, r.filter_order, r.step]


def test_min_plus_is_the_first_failed_filter():
    orders = list(permutations(range(4)))
    step = interaction.min_plus(interaction.class_masks(4), interaction.positions(orders))
    for c in range(16):
        for o, order in enumerate(orders):
            hits = [k for k, f in enumerate(order, 1) if c >> f & 1]
            assert step[c, o] == (hits[0] if hits else np.inf)


def test_any_filters_orders_and_weights(spark):
    rows = spark.createDataFrame([("p", 5, None, 2), ("p", 1, 9, 3), ("p", 9, 9, None)], "part string, x int, y int, w int")
    got = interaction.audit(rows, {"low": F.col("x") < 6, "high": F.col("y") > 5}, F.lit("all"), {"weight": F.col("w")},
                            orders=[(1, 0)]).collect()
    assert [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.weight, r.shapley) for r in got] == [
        ("all", "highlow", 1, 1, 2, 0, 1, 3, 2), ("all", "highlow", 2, 0, 1, 1, 1, 2, 1)]
    with pytest.raises(ValueError):
        interaction.audit(rows, {}, F.lit(""))


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit_texts(no_docs.withColumn("source", F.lit("s")), none).count() == 0
    got = interaction.audit_texts(odd_docs.withColumn("source", F.lit(None).cast("string")), none)
    assert got.filter("part = '' and kept + removed = 28 and step = 1").count() == 120
    assert got.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)
