"""Quality rules: a learned decision list over counts of a text.

Sequential covering: from the labelled documents a rule is grown, a conjunction of
thresholds on interpretable ratios, condition by condition, each with the largest
information gain on two thirds of the rows. It is pruned on the other third, back to the
conditions that tell bad from good there, and kept if it is precise enough. What it covers is
taken away and the next rule is learned from the rest, until no rule is worth keeping.
The list becomes one Spark conditional expression: the number of the first rule that holds.

How it is spread: the counts of all documents are made in one pass and written as narrow rows. The
list is fitted on at most about ``labels.MAX_LABELLED`` labelled ids, thinned by a hash of the id, of
which one row of ratios each reaches the driver; judging is a projection.

Defined results: a null or empty text has no words and fails the base. Without labels, without good
or without bad ones, the list is empty and the base alone decides. Ids with several labels take the
largest; an id with several texts gives its smallest row of counts to the fit. Repeated rows are
judged each; null ids are judged and never fitted on. Extra columns stay as they are, but for those named
like a count or a verdict, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import labels as label_rows
from panelwright.llm.text_stats import COUNTS, text_counts
from panelwright.session import materialize

#: Ratios that rules speak of, as (count, count).
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "capital_share": ("n_capitals", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}
#: Words that a text must have, and percent of words in repeated windows that it may have.
MIN_WORDS, MAX_REPEATED = 50, 50


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.threshold!r}"

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.ratio] > self.threshold if self.above else rows[self.ratio] <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents for which it holds are bad."""

    conditions: tuple[Condition, ...]

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))

    def holds(self, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for c in self.conditions:
            out &= c.holds(rows)
        return out


def best_condition(rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The condition of the largest information gain (first on ties): covered bad rows times the bits that each saves."""
    total, all_bad = len(bad), int(bad.sum())
    if not all_bad or all_bad == total:
        return None
    prior = np.log2(all_bad / total)
    best = None
    for name, values in rows.items():
        order = np.argsort(values, kind="stable")
        sorted_values, hits = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(sorted_values[1:] > sorted_values[:-1])
        if not len(cuts):
            continue
        low_bad, low_all = hits[cuts], cuts + 1
        for above, n_bad, n_all in ((False, low_bad, low_all), (True, all_bad - low_bad, total - low_all)):
            gain = n_bad * (np.log2(np.maximum(n_bad, 1e-9) / n_all) - prior)
            at = int(gain.argmax())
            if best is None or gain[at] > best[0]:
                middle = (sorted_values[cuts[at]] + sorted_values[cuts[at] + 1]) / 2
                # The middle of two neighbouring doubles may round up to the larger one.
                middle = float(middle if middle < sorted_values[cuts[at] + 1] else sorted_values[cuts[at]])
                best = (float(gain[at]), Condition(name, above, middle))
    return best if best is not None and best[0] > 1e-9 else None


def _of(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in rows.items()}


def grow(rows: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Conditions until no good row is covered, none gains, or there are ``most``."""
    found: list[Condition] = []
    while len(found) < most and (best := best_condition(rows, bad)):
        found.append(best[1])
        held = best[1].holds(rows)
        rows, bad = _of(rows, held), bad[held]
    return found


def prune(conditions: Sequence[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The shortest start of ``conditions`` that best tells bad from good; its precision and covered bad rows."""
    best = (Rule(()), 0.0, 0)
    worth = -np.inf
    held = np.ones(len(bad), bool)
    for i, c in enumerate(conditions, 1):
        held = held & c.holds(rows)
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        if p + n and (p - n) / (p + n) > worth:
            worth = (p - n) / (p + n)
            best = (Rule(tuple(conditions[:i])), p / (p + n), p)
    return best


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, precision: float = 0.95, least: int = 2,
          most_conditions: int = 4, most_rules: int = 32) -> list[Rule]:
    """Rules in order. ``part`` 0 holds the rows that prune, all others grow.

    A rule is kept if at least ``precision`` of the pruning rows that it covers are bad, and ``least`` of them.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        growing, pruning = left & (part != 0), left & (part == 0)
        conditions = grow(_of(rows, growing), bad[growing], most_conditions)
        rule, right, covered = prune(conditions, _of(rows, pruning), bad[pruning])
        if not rule.conditions or right < precision or covered < least:
            break
        rules.append(rule)
        left &= ~rule.holds(rows, len(bad))
    return rules


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def first_rule(rules: Sequence[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; 0 if none does."""
    chain = None
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule.conditions:
            holds &= ratio(c.ratio) > c.threshold if c.above else ratio(c.ratio) <= c.threshold
        chain = F.when(holds, i) if chain is None else chain.when(holds, i)
    return F.lit(0) if chain is None else chain.otherwise(0)


def fit(counted: DataFrame, quality: DataFrame, label: str = "quality", bound: int = label_rows.MAX_LABELLED,
        **settings) -> list[Rule]:
    """Rules from the labelled rows of ``counted`` (doc_id and ``COUNTS``) that pass the base; label 1 is good."""
    chosen = label_rows.sample(quality, label, bound)
    rows = (
        counted.select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "label", "c.*")
        .filter(~base_failed())
        .select("doc_id", (F.col("label") != 1).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"),
                *[ratio(r).alias(r) for r in RATIOS])
        .toArrow().sort_by("doc_id"))
    columns = {r: rows[r].to_numpy() for r in RATIOS}
    return learn(columns, rows["bad"].to_numpy().astype(bool), rows["part"].to_numpy(), **settings)


def judge(docs: DataFrame, quality: DataFrame, label: str = "quality", **settings) -> tuple[DataFrame, list[Rule]]:
    """``docs`` without its text, with ``COUNTS``, base_failed, rule and kept; and the rules.

    ``rule`` is the number of the first rule that holds for a text that passes the base, else 0.
    """
    made = [*COUNTS, "base_failed", "rule", "kept"]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "_counts", *made)]
    counted = materialize(docs.select(*others, text_counts(F.col("text")).alias("_counts")).select(*others, "_counts.*"), "counts")
    rules = fit(counted, quality, label, **settings)
    judged = counted.withColumn("base_failed", base_failed())
    judged = judged.withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(first_rule(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
