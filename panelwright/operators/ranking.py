"""Global row numbers, contiguous chunks and folds without a global window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Distinct values or rows of a range, and the fewest ranges that a table is cut into.
RANGE_ROWS = 1 << 18
LEAST_RANGES = 16


def ranges_for(rows: DataFrame) -> int:
    """Number of ranges, in proportion to the number of rows."""
    return max(LEAST_RANGES, -(-rows.count() // RANGE_ROWS))


def cumulative_counts(df: DataFrame, by: list[str], col: str, weight: str | None = None,
                      buckets: int | None = None) -> DataFrame:
    """(by, value, c, below, n): every distinct value with its count and the count below it.

    Equal values are merged first, then cut into ranges at approximate
    quantiles: a range is summed up on its own and shifted by the ranges below.
    No task sees a whole group, and ties cost nothing.
    """
    per = df.groupBy(*by, F.col(col).cast("double").alias("value")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("c"))
    buckets = buckets or ranges_for(per)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(per.approxQuantile("value", probs, 1.0 / (4 * buckets))))
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="value", outputCol="_b").transform(per)
    # At most ``buckets`` rows per group.
    sizes = ranged.groupBy(*by, "_b").agg(F.sum("c").alias("_c"))
    keys = by or [F.lit(0)]
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"),
                           F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    inside = Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, [*by, "_b"]).select(
        *by, "value", "c", (F.coalesce(F.sum("c").over(inside), F.lit(0)) + F.col("_off")).alias("below"), "n")


def quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """(by, <name> ...): exact quantiles by linear interpolation, for groups of any size.

    NULL and NaN are left out.
    """
    x = F.col(col).cast("double")
    cum = cumulative_counts(df.filter(x.isNotNull() & ~F.isnan(x)), by, col)
    aggs = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("n") - 1)
        for part, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("below") <= at) & (at < F.col("below") + F.col("c"))
            aggs.append(F.max(F.when(held, F.col("value"))).alias(f"_{part}_{name}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_w_{name}"))
    got = cum.groupBy(*by).agg(*aggs)
    return got.select(*by, *[
        (F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in probs])


def with_row_number(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Add ``rn`` = 1..n in the order of the unique numeric column ``key``, and ``n``.

    Rows are cut into ranges at approximate quantiles; a range's rows are
    numbered on their own and shifted by the size of the ranges below it. The
    result is exact whatever the quality of the quantiles.
    """
    buckets = buckets or ranges_for(df)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(key, probs, 1.0 / (4 * buckets))))
    keyed = df.withColumn("_k", F.col(key).cast("double"))
    splits = [float("-inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_k", outputCol="_b").transform(keyed).drop("_k")
    # At most ``buckets`` rows, one for each range: small enough to order in one window.
    sizes = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    below = sizes.select(
        "_b",
        F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy()).alias("n"),
    )
    w = Window.partitionBy("_b").orderBy(key)
    return (
        ranged.join(below, "_b")
        .withColumn("rn", (F.row_number().over(w) + F.col("_off")).cast("bigint"))
        .drop("_b", "_off")
    )


def chunk_of(rn: F.Column, n: F.Column, folds: int) -> F.Column:
    """Chunk 0..folds-1 of row ``rn`` (1-based): the first n % folds chunks get one row more."""
    size = F.floor(n / folds)
    extra = n % folds
    edge = extra * (size + 1)
    i = rn - 1
    big = F.floor(i / (size + 1))
    small = extra + F.floor((i - edge) / F.greatest(size, F.lit(1)))
    return F.when(i < edge, big).otherwise(small).cast("int")


def contiguous_chunks(df: DataFrame, key: str, folds: int, buckets: int | None = None) -> DataFrame:
    """Add ``fold``: contiguous chunks in the order of ``key`` (as ``ntile``)."""
    return with_row_number(df, key, buckets).withColumn(
        "fold", chunk_of(F.col("rn"), F.col("n"), folds)).drop("rn", "n")


def fold_plan(n_subjects: int, n_steps: int, nfold: int) -> tuple[str, int]:
    """Which axis cross-validation splits, and into how many folds.

    Subjects when there are more than four; else time when there are at least
    two steps per fold; else single rows; else no split at all.
    """
    if n_subjects > 4:
        return "subject", nfold
    if n_steps >= 2 * nfold:
        return "time", nfold
    rows = n_subjects * n_steps
    if rows >= 2 * nfold:
        return "row", nfold
    half = -(-rows // 2)
    return ("row", half) if half > 2 else ("none", 0)


def assign_folds(trans: DataFrame, nfold: int, hashed_seed: int | None = None) -> DataFrame:
    """Add ``fold`` to transitions by the rule of :func:`fold_plan`.

    ``hashed_seed`` orders subjects by a hash instead of by id.
    """
    facts = trans.agg(F.countDistinct("subject").alias("n"), F.countDistinct("t").alias("T")).first()
    axis, k = fold_plan(facts["n"], facts["T"], nfold)
    if axis == "none":
        return trans.withColumn("fold", F.lit(None).cast("int"))
    if axis == "time":
        steps = trans.select("t").distinct()
        return trans.join(contiguous_chunks(steps, "t", k), "t")
    if axis == "row":
        # Rows here number fewer than four subjects times two steps per fold.
        w = Window.partitionBy().orderBy("subject", "t")
        return trans.withColumn("fold", F.ntile(k).over(w) - 1)
    subjects = trans.select("subject").distinct()
    if hashed_seed is None:
        folds = contiguous_chunks(subjects, "subject", k)
    else:
        keyed = subjects.withColumn(
            "_h", F.shiftright(F.xxhash64("subject", F.lit(hashed_seed)), 11).cast("double"))
        folds = contiguous_chunks(keyed, "_h", k).drop("_h")
    return trans.join(folds, "subject")


def nth_smallest(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    """The n-th smallest row (1-based); ties broken by ``tie``."""
    first = df.orderBy(F.col(col).asc(), F.col(tie).asc()).limit(n)
    return first.orderBy(F.col(col).desc(), F.col(tie).desc()).limit(1)
