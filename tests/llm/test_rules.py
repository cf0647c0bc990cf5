"""Counts of texts against plain loops, and rules learned from planted data."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import NORTH, ODD, no_docs, odd_docs, prose, rng  # noqa: F401
from panelwright.llm import decision_list, text_stats


def plain(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_distinct": len(set(words)), "n_capitals": sum("A" <= c <= "Z" for c in t),
        "n_digits": sum("0" <= c <= "9" for c in t), "n_marks": sum(33 <= ord(c) < 127 and not c.isalnum() for c in t)}


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_counts_are_those_of_a_loop(rng, monkeypatch, size):
    monkeypatch.setattr(text_stats, "SLICE", size)
    texts = ODD + ["a a a", "a a a a", "a b c a b c", "a b a b a", "x\n\nx\n x\nx", "#x|<>\r\n#x|<>\r\n", "\x1c a\x85b c d"]
    texts += ["".join(rng.choice("ab \t\n\x0b\x1cé#|Z3.漢") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    got = text_stats.counts(pa.array(texts)).to_pylist()
    assert got == [plain(t) for t in texts]
    assert len(text_stats.counts(pa.array([], pa.string()))) == 0


def test_windows_of_many_words_are_renumbered(rng):
    assert text_stats._combined(np.array([5, 1 << 40, 5]), 1 << 61, np.array([0, 1, 2]), 7)[0].tolist() == [0, 8, 2]
    text = " ".join(rng.choice(["a", "b", "c"]) + str(rng.randint(0, 30)) for _ in range(20000))
    assert text_stats.counts(pa.array([text])).to_pylist()[0] == plain(text)


def labelled(rng, n=900):
    """Documents; every third is bad: marks after words, or one phrase over and over."""
    rows, marks = [], []
    for i in range(n):
        words = prose(rng, rng.randint(60, 120)).split()
        kind = i % 6
        if kind == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        elif kind == 3:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(kind not in (0, 3))))
    return rows, marks


def test_rules_find_both_kinds_of_bad_text(spark, rng):
    rows, marks = labelled(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if m[0] < 600], "doc_id long, quality int")
    judged, rules = decision_list.judge(docs, labels)
    got = {r.doc_id: r for r in judged.collect()}
    base = {i: n for i, n in got.items() if n.base_failed}
    assert rules and not base
    assert all(got[i].kept == bool(q) for i, q in marks)
    # The conditional expression says what the rules say, in their order.
    for i, text in rows:
        c = plain(text)
        ratios = {k: np.array([c[a] / c[b] if c[b] else 0.0]) for k, (a, b) in decision_list.RATIOS.items()}
        first = next((n for n, r in enumerate(rules, 1) if r.holds(ratios, 1)[0]), 0)
        assert got[i].rule == first
    again = decision_list.judge(docs.repartition(7), labels)[1]
    assert again == rules


def test_best_condition_has_the_largest_gain(rng):
    rows = {"x": np.array([rng.randint(0, 9) for _ in range(60)], float), "y": np.array([rng.random() for _ in range(60)])}
    bad = np.array([rng.random() < 0.2 + 0.1 * (x > 5) + 0.3 * (y > 0.7) for x, y in zip(rows["x"], rows["y"])])

    def gain(held):
        p, n = bad[held].sum(), held.sum()
        return p * (np.log2(p / n) - np.log2(bad.mean())) if p else 0.0

    tried = [gain(v <= t) for v in rows.values() for t in v] + [gain(v > t) for v in rows.values() for t in v if (v > t).any()]
    found, condition = decision_list.best_condition(rows, bad)
    assert found == pytest.approx(max(tried)) and gain(condition.holds(rows)) == pytest.approx(found)


def test_rules_are_pruned_and_precise():
    rng = np.random.default_rng(3)
    rows = {"x": rng.random(3000), "noise": rng.random(3000)}
    bad = rows["x"] > 0.8
    part = np.arange(3000) % 3
    rules = decision_list.learn(rows, bad, part)
    assert [str(c).split()[0] for r in rules for c in r.conditions] == ["x"]
    assert abs(rules[0].conditions[0].threshold - 0.8) < 0.01 and rules[0].conditions[0].above
    assert decision_list.learn(rows, rng.random(3000) < 0.2, part) == []  # nothing to learn
    assert decision_list.learn(rows, np.zeros(3000, bool), part) == [] and decision_list.learn(rows, np.ones(3000, bool), part) == []
    assert decision_list.learn({"x": np.zeros(0)}, np.zeros(0, bool), np.zeros(0)) == []


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = decision_list.judge(odd_docs, none)
    assert rules == [] and judged.count() == odd_docs.count() and "text" not in judged.columns
    assert judged.filter("body = 'clash' and lang = 'clash'").count() == odd_docs.count()
    assert judged.filter("not base_failed or kept or rule <> 0").count() == 0
    assert decision_list.judge(no_docs, none)[0].count() == 0
    phrase = " ".join(["one two three four"] * 20)
    rows = spark.createDataFrame([(1, phrase), (2, " ".join(map(str, range(49)))), (3, " ".join(map(str, range(50)))), (3, None),
                                  (None, " ".join(map(str, range(60))))], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 0)], "doc_id long, quality int")
    got = decision_list.judge(rows, marks)[0].orderBy("n_words", F.desc("doc_id")).collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in got] == [
        (3, 0, True, False), (2, 49, True, False), (3, 50, False, True), (None, 60, False, True), (1, 80, True, False)]
