"""Audit of filters that overlap: what each one removes in every order of application.

A document is removed by the first filter, in the order applied, that it fails. Write
the failures of a document as a row of a mask matrix (0 where it fails the filter,
infinity where it passes) and the orders as a position matrix (the inverse
permutations: the place of each filter in each order). Their min-plus product is the
removal step of each document in each order. Documents with equal failures have equal
removal steps, so the product is formed over classes of failures, 2^filters at most, and
the classes' weights are scattered onto (order, step).

How it is spread: rows are summed to one row per part and class before any shuffle, so
a part that holds a third of all rows is no larger than another; the product and the
scatter run per part beside the sums, in as many tasks as there are parts to fill them.

Defined results: a null flag is no failure; a null part is the empty string; weights
are whole numbers, null counts as zero. Every part has a row for every order and step, zeros
included; an empty table has no rows. Columns that aren't named are not read.
``text_flags`` takes a null text as empty; among documents of one text those of the smallest id
pass "identical to an earlier one", all rows of that id if it is repeated, and so does
a row without an id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialize

#: Filters of one audit at most: orders grow with the factorial of their number.
MAX_FILTERS = 7


def class_masks(n: int) -> np.ndarray:
    """(classes, filters): 0 where the class fails the filter, infinity where it passes."""
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    return np.where(fails == 1, 0.0, np.inf)


def positions(orders: Sequence[Sequence[int]]) -> np.ndarray:
    """(filters, orders): the step, from 1, at which each order applies each filter."""
    return np.argsort(np.array(orders), axis=1).T + 1.0


def min_plus(masks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(classes, orders): the removal step, infinity for a class that passes every filter."""
    step = np.full((len(masks), place.shape[1]), np.inf)
    for f in range(masks.shape[1]):
        np.minimum(step, masks[:, f, None] + place[f], out=step)
    return step


class Audit:
    """Removal steps of all classes in all orders, and the counts they drive."""

    def __init__(self, n: int, orders: Sequence[Sequence[int]] | None = None):
        self.orders = np.array(list(permutations(range(n))) if orders is None else orders)
        self.n, place = n, positions(self.orders)
        masks = class_masks(n)
        step = min_plus(masks, place)
        cells = np.arange(self.orders.size).reshape(self.orders.shape)
        # Where a class is removed: its cell of (order, step).
        self.removed_class, order = np.nonzero(np.isfinite(step))
        self.removed_cell = cells[order, step[self.removed_class, order].astype(int) - 1]
        # Where it is redundant: cells of filters that it fails after its removal.
        late = (masks[:, :, None] == 0) & (place > step[:, None, :])
        self.late_class, filters, order = np.nonzero(late)
        self.late_cell = cells[order, place[filters, order].astype(int) - 1]

    def _scatter(self, cell: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(self.orders.size, np.int64)
        np.add.at(out, cell, weight)
        return out

    def counts(self, rows: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Counts by (order, step), flattened; ``rows`` by class, ``weights`` by (weight, class)."""
        removed = self._scatter(self.removed_cell, rows[self.removed_class])
        by_order = removed.reshape(self.orders.shape)
        shares = np.zeros(self.n, np.int64)
        np.add.at(shares, self.orders, by_order)
        return {
            "kept": (rows.sum() - by_order.cumsum(1)).ravel(),
            "removed": removed,
            "redundant": self._scatter(self.late_cell, rows[self.late_class]),
            "unique_fails": rows[1 << self.orders].ravel(),
            "shapley": shares[self.orders].ravel(),
        } | {i: self._scatter(self.removed_cell, w[self.removed_class]) for i, w in enumerate(weights)}


def _audited(batches: Iterator[pa.RecordBatch], names: Sequence[str], lost: Sequence[str],
             orders: Sequence[Sequence[int]] | None) -> Iterator[pa.RecordBatch]:
    """Rows by order and step of each part; a part comes as lists by class."""
    audit = Audit(len(names), orders)
    texts = pa.array(["".join(names[f] for f in o) for o in audit.orders for _ in range(audit.n)])
    steps = pa.array(np.tile(np.arange(1, audit.n + 1, dtype=np.int32), len(audit.orders)))
    for batch in batches:
        for row in batch.to_pylist():
            sums = np.zeros((1 + len(lost), 1 << audit.n), np.int64)
            for c in row["classes"]:
                sums[:, c["mask"]] = [c["n"], *c["w"]]
            found = audit.counts(sums[0], sums[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(texts)), texts, steps]
                + [pa.array(found[k]) for k in ("kept", "removed", "redundant", "unique_fails")]
                + [pa.array(found[i]) for i in range(len(lost))] + [pa.array(found["shapley"])],
                names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"])


def audit(flags: DataFrame, filters: dict[str, Column], part: Column, lost: dict[str, Column] | None = None,
          orders: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, *lost, shapley).

    ``filters`` maps a filter's short name to the column that tells a failure; ``lost`` maps a
    count's name to a weight of the rows, summed over those removed at the step. ``orders`` are
    permutations of the filters' places; all of them by default. ``shapley`` is what the step's
    filter removes, summed over the orders.
    """
    names, lost = list(filters), lost or {}
    if not 1 <= len(names) <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters")
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    weights = {f"w{i}": F.coalesce(c.cast("long"), F.lit(0).cast("long")) for i, c in enumerate(lost.values())}
    classes = (
        flags.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"),
                     *[w.alias(k) for k, w in weights.items()])
        .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in weights]))
    # At most one entry per class of failures.
    rows = classes.groupBy("part").agg(F.collect_list(
        F.struct("mask", "n", F.array(*weights).cast("array<long>").alias("w"))).alias("classes"))
    sums = list(lost)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    schema += "".join(f"`{k}` long, " for k in sums) + "shapley long"
    return rows.mapInArrow(lambda b: _audited(b, names, sums, orders), schema)


def text_flags(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, few, repetitive, capitals, symbols, copy) of ``docs``: what the five text filters say.

    few: under 200 words; repetitive: less than half of the words are distinct; capitals: over 2 % of
    the characters are A-Z; symbols: one of ``#$%&*|``; copy: the text of a smaller doc_id.

    Texts are read once and become a row of flags and a fingerprint (SHA-256). The smallest id of a
    fingerprint is an aggregate; rows meet it by (fingerprint, id), not by fingerprint alone, so the
    copies of one text spread over all tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(part).cast("string").alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"),
        (F.size(words) < 200).alias("few"),
        (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("repetitive"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)).alias("capitals"),
        text.rlike(r"[#$%&*|]").alias("symbols"))
    rows = materialize(rows, "flags")
    first = rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    first = first.withColumn("first", F.lit(True))
    return (
        rows.join(first, ["print", "doc_id"], "left")
        .select("doc_id", "part", "few", "repetitive", "capitals", "symbols",
                (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("copy")))


def audit_texts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five text filters A to E, with the labelled good and toxic documents lost at each step.

    An id with several labels counts as good, or toxic, if one of them says so.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
        .groupBy("doc_id").agg(one("quality"), one("toxic")))
    flags = text_flags(docs, part).join(marks, "doc_id", "left")
    filters = dict(zip("ABCDE", map(F.col, ("few", "repetitive", "capitals", "symbols", "copy"))))
    return audit(flags, filters, F.col("part"), {"good_lost": F.col("quality"), "toxic_lost": F.col("toxic")})
